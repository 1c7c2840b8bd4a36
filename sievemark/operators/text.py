"""Manuscript text: reported statistics, similarity, phrase densities, compliance statements, scorers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievemark.functions import wordlists as W
from sievemark.functions.ladder import CONCERN, CRITICAL, NOTE, SUSPICIOUS, ladder
from sievemark.functions.text import let, letter_words, phrase_counts, runs, tokens

_P = r"\s*,?\s*[Pp]\s*([<=≤])\s*(\d*\.\d+)"
_EQ = r"\s*[<>≤≥]?=?\s*"
_TAIL = r"([\s,;.]*(?:one[-\s]?tailed|two[-\s]?tailed|one[-\s]?sided|two[-\s]?sided))?"
_CHI = r"(?:chi2|χ\s*²|χ\s*2|χ\s*\^2)"
# Family, pattern, groups of df1, df2, statistic, sign and p (0: none).
STATISTICS = (
    ("t", rf"(?i)t\s*\(\s*(\d+(?:\.\d+)?)\s*\){_EQ}(-?\d+\.\d+){_P}{_TAIL}", (1, 0, 2, 3, 4)),
    ("F", rf"F\s*\(\s*(\d+(?:\.\d+)?)\s*,\s*(\d+(?:\.\d+)?)\s*\){_EQ}(\d+\.\d+){_P}", (1, 2, 3, 4, 5)),
    ("chi2", rf"(?iu){_CHI}\s*\(\s*(\d+)\s*\){_EQ}(\d+\.\d+){_P}", (1, 0, 2, 3, 4)),
    ("r", rf"\br\s*\(\s*(\d+)\s*\){_EQ}(-?\.\d+|-?0?\.\d+|-?\d+\.\d+){_P}", (1, 0, 2, 3, 4)),
    ("z", rf"(?i)\bz{_EQ}(-?\d+\.\d+){_P}", (0, 0, 1, 2, 3)),
    ("Q", rf"\bQ\s*\(\s*(\d+)\s*\){_EQ}(\d+\.\d+){_P}", (1, 0, 2, 3, 4)),
    ("r2", rf"(?i)(?:r²|r2|r\^2){_EQ}(0?\.\d+|1\.0+)\s*,?\s*n\s*=\s*(\d+){_P}", (2, 0, 1, 3, 4)),
    ("chi2", rf"(?iu){_CHI}{_EQ}(\d+\.\d+)\s*,\s*(?:df|d\.f\.)\s*=\s*(\d+)\s*,\s*[Pp]\s*([<=≤])\s*(\d*\.\d+)", (2, 0, 1, 3, 4)),
    ("H", rf"\bH\s*\(\s*(\d+)\s*\){_EQ}(\d+\.\d+){_P}", (1, 0, 2, 3, 4)),
)


def _parsed(family: str, pattern: str, groups: tuple[int, ...]):
    """From the text of a test to its parts."""
    d1, d2, st, sign, p = groups

    def one(m: Column) -> Column:
        number = lambda g: F.regexp_extract(m, pattern, g).try_cast("double") if g else F.lit(None).cast("double")
        tail = F.lower(F.regexp_extract(m, pattern, 5)).contains("one") if family == "t" else F.lit(False)
        return F.struct(F.lit(family).alias("family"), m.alias("raw"), number(d1).alias("df1"), number(d2).alias("df2"), number(st).alias("stat"), F.regexp_extract(m, pattern, sign).alias("sign"), number(p).alias("p"), tail.alias("one_tailed"))

    return one


def reported_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, family, raw, df1, df2, stat, sign, p, one_tailed, one_tailed_text of each reported test."""
    text = F.col(text_col)
    parts = [F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), _parsed(family, pattern, groups)) for family, pattern, groups in STATISTICS]
    likely = text.rlike(r"[Pp]\s*[<=≤]")
    found = docs.where(likely).select(F.col(id_col).alias("doc_id"), text.rlike("(?i)one-?[ ]?tailed|one-?[ ]?sided").alias("one_tailed_text"), F.inline(F.concat(*parts)))
    return found.where("(family <> 'r' or abs(stat) < 1) and (family <> 'r2' or (stat > 0 and stat < 1 and df1 > 2))")


def _recomputed(family: Column) -> tuple[Column, Column]:
    """p of the statistic (two-sided for t, r, z), and its one-sided half; each distribution runs in one vectorised call."""
    from sievemark.functions.special import chi2_sf, f_sf, t_sf, z_sf

    stat, df1, df2 = F.col("stat"), F.col("df1"), F.col("df2")
    t_of_r = stat * F.sqrt(df1 / F.greatest(1 - stat * stat, F.lit(1e-12)))
    f_of_r2 = stat / ((1 - stat) / (df1 - 2))
    t_like = t_sf(F.when(family == "t", F.abs(stat)).when(family == "r", F.abs(t_of_r)), F.when(family.isin("t", "r"), df1))
    f_like = f_sf(F.when(family == "F", stat).when(family == "r2", f_of_r2), F.when(family == "F", df1).when(family == "r2", F.lit(1.0)), F.when(family == "F", df2).when(family == "r2", df1 - 2))
    chi = chi2_sf(F.when(family.isin("chi2", "Q", "H"), stat), F.when(family.isin("chi2", "Q", "H"), df1))
    z = z_sf(F.when(family == "z", F.abs(stat)))
    one = F.when(family.isin("t", "r"), t_like).when(family == "z", z)
    return F.when(family.isin("t", "r", "z"), 2 * one).when(family.isin("F", "r2"), f_like).otherwise(chi), one


def _inconsistent(p: str) -> tuple[Column, Column]:
    """(numerically, in the decision at 0.05) inconsistent with the reported p."""
    decimals = F.length(F.regexp_replace(F.regexp_extract(F.format_string("%.10f", "p"), r"\.(\d+)", 1), "0+$", "")).cast("int")
    step = F.pow(F.lit(10.0), -decimals)
    # The value's exact decimal expansion, rounded half to even: what p / step * step would blur at half steps.
    exact = F.col(p).cast("decimal(38,25)")
    rounded = F.coalesce(*[F.when(decimals == k, F.bround(exact, k).cast("double")) for k in range(11)])
    numeric = F.when(F.col("sign") == "=", F.abs(rounded - F.col("p")) > step / 2 + 1e-12).otherwise(F.col(p) >= F.col("p"))
    claimed = F.when(F.col("sign") == "=", F.col("p") < 0.05).otherwise(F.col("p") <= 0.05)
    return numeric, claimed != (F.col(p) < 0.05)


def statcheck(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Reported against recomputed p-values: numeric, decision, severity of each inconsistent test."""
    found = reported_statistics(docs, id_col, text_col)
    two, one = _recomputed(F.col("family"))
    found = found.withColumn("two_sided", two).withColumn("one_sided", one)
    found = found.withColumn("first", F.when(F.col("one_tailed"), F.col("one_sided")).otherwise(F.col("two_sided")))
    n1, d1 = _inconsistent("first")
    n2, d2 = _inconsistent("one_sided")
    rescued = F.col("one_tailed_text") & F.col("family").isin("t", "r", "z") & (n1 | d1) & ~n2 & ~d2
    found = found.withColumn("computed_p", F.when(rescued, F.col("one_sided")).otherwise(F.col("first")))
    numeric, decision = _inconsistent("computed_p")
    found = found.withColumn("numeric", numeric).withColumn("decision", decision)
    return found.withColumn("severity", ladder((F.col("decision"), SUSPICIOUS), (F.col("numeric"), CONCERN))).drop("two_sided", "one_sided", "first")


def hashed_shingles(words: Column, n: int) -> Column:
    """Distinct 64-bit hashes of the runs of n words; none of fewer words."""
    one = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(n)]))
    return F.array_distinct(let(words, lambda w: F.when(F.size(w) >= n, one(w)).otherwise(F.array().cast("array<bigint>"))))


def text_similarity(queries: DataFrame, corpus: DataFrame, n: int = 5, least: float = 0.10) -> DataFrame:
    """queries(query_id, text) against corpus(label, text) by shared n-word shingles: jaccard of 0.10 or more.

    An inverted-index equi-join on 64-bit hashes of the shingles; texts of the corpus with equal sets are
    compared once, and sizes travel with the rows, so that one aggregation of the matches follows. Texts
    of fewer than n + 5 words aren't queried.
    """
    pattern = "[A-Za-z\\u4e00-\\u9fff]+"
    q = queries.withColumn("w", tokens(F.lower("text"), pattern)).where(F.size("w") >= n + 5).withColumn("s", hashed_shingles(F.col("w"), n)).select("query_id", F.size("s").alias("nq"), F.explode("s").alias("g"))
    sets = corpus.withColumn("s", F.sort_array(hashed_shingles(tokens(F.lower("text"), pattern), n))).where(F.size("s") > 0).withColumn("set_id", F.struct(F.xxhash64("s").alias("a"), F.hash("s").alias("b"), F.size("s").alias("nc")))
    c = sets.groupBy("set_id").agg(F.first("s").alias("s")).select("set_id", F.explode("s").alias("g"))
    m = q.join(c, "g").groupBy("query_id", "set_id", "nq").agg(F.count("*").alias("k"))
    m = m.withColumn("jaccard", F.col("k") / (F.col("nq") + F.col("set_id.nc") - F.col("k"))).where(F.col("jaccard") >= least)
    m = m.join(sets.select("set_id", "label"), "set_id")
    return m.select("query_id", "label", "jaccard", ladder((F.col("jaccard") >= 0.5, CRITICAL), (F.col("jaccard") >= 0.25, SUSPICIOUS), otherwise=CONCERN).alias("severity"))


# Patterns of the statements that a manuscript should make, without regard to case.
DATA_STATEMENT = (r"data\s+availability", r"data\s+sharing", r"availability\s+of\s+(?:data|materials)", r"data\s+and\s+code\s+availability", "数据可用性", "数据共享")
VAGUE = (r"available\s+(?:from|upon)\s+(?:the\s+)?(?:corresponding\s+)?author", r"available\s+on\s+(?:reasonable\s+)?request", r"available\s+upon\s+reasonable\s+request")
ACCESSIONS = (r"\b(?=10\.\d{4,9}/[^\s\)\]\}])[^\s\)\]\}]{40,}", r"\bGSE\d+\b", r"\bSRA\d+\b|\bSRP\d+\b", r"\bPRJ[NEDA][A-Z]\d+\b", r"\bE-MTAB-\d+\b", r"\bGCF_\d+\.\d+\b|\bGCA_\d+\.\d+\b", r"\bENS[A-Z]+\d+\b", r"\bzenodo\.org/record/\d+\b", r"\bfigshare\.com/[a-z]+/\d+\b", r"\bdryad\.\w+/[\w\.]+\b", r"\bgithub\.com/[\w\-]+/[\w\-]+", r"\bdoi\.org/[\w\./\-]+")
ETHICS = (r"approved\s+by\s+(?:the\s+)?[\w\s]+(?:committee|board|IRB|IACUC)", r"ethics?\s+(?:committee|board|approval)\s+(?:number|no\.?)\s*[:#]?\s*\S+", r"IRB\s+(?:approval|number|protocol)", r"institutional\s+review\s+board", r"institutional\s+animal\s+care\s+and\s+use\s+committee", "伦理(?:委员会|审查|批件|审批)", "动物实验伦理")
INTERESTS = (r"(?:competing|conflict(?:s)?\s+of)\s+interests?", r"declarations?\s+of\s+interest", r"financial\s+disclosures?", "利益冲突")
REGISTRATION = (r"\bNCT\d{8}\b", r"\bISRCTN\d+\b", r"\bChiCTR-?[\w]+\b", r"\bACTRN\d+\b", r"\bEudraCT\s*\d{4}-\d{6}-\d{2}\b", r"\bDRKS\d+\b", r"trial\s+registration:?\s*\S+", r"registered\s+(?:at|in|with)\s+\S+")


def any_of(text: Column, patterns: tuple[str, ...]) -> Column:
    return text.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns))


def compliance(docs: DataFrame) -> DataFrame:
    """T3 over (doc_id, text, paper_year, is_clinical_trial, is_human_subjects, is_animal_study): doc_id, rule, severity. Texts of fewer than 200 characters are left out."""
    text, year = F.col("text"), F.col("paper_year")
    rows = docs.where(F.length("text") >= 200).withColumns({"stmt": any_of(text, DATA_STATEMENT), "vague": any_of(text, VAGUE), "accession": any_of(text, ACCESSIONS), "ethics": any_of(text, ETHICS), "coi": any_of(text, INTERESTS), "reg": any_of(text, REGISTRATION)})
    missing = ~F.col("stmt") & (year.isNull() | (year >= 2018))
    rule = lambda condition, name, severity: F.when(condition, F.struct(F.lit(name).alias("rule"), F.lit(severity).cast("int").alias("severity")) if isinstance(severity, int) else F.struct(F.lit(name).alias("rule"), severity.cast("int").alias("severity")))
    strict = F.when(year < 2010, CONCERN).otherwise(SUSPICIOUS)
    found = F.array(
        rule(missing, "no data statement", CONCERN),
        rule(~missing & F.col("vague") & ~F.col("accession"), "vague availability", CONCERN),
        rule(F.col("is_clinical_trial") & ~F.col("reg") & ~F.coalesce(year < 2005, F.lit(False)), "unregistered trial", strict),
        rule((F.col("is_human_subjects") | F.col("is_animal_study")) & ~F.col("ethics"), "no ethics approval", CONCERN),
        rule(~F.col("coi"), "no statement of interests", NOTE),
    )
    return rows.select("doc_id", F.inline(F.filter(found, lambda x: x.isNotNull())))


def tortured_phrases(docs: DataFrame) -> DataFrame:
    """T4: doc_id, n_unique, n_total, phrases, severity of texts (200 characters or more) with paraphrased terms."""
    found = docs.where(F.length("text") >= 200).select("doc_id", phrase_counts(F.col("text"), letter_words(F.col("text")), W.TORTURED, loose=True).alias("hits")).where(F.size("hits") > 0)
    total = F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    names = F.array_join(F.array_sort(F.transform("hits", lambda x: x["phrase"])), "; ")
    return found.select("doc_id", F.size("hits").cast("long").alias("n_unique"), total.alias("n_total"), names.alias("phrases"), ladder(((F.size("hits") >= 3) | (total >= 5), CRITICAL), otherwise=SUSPICIOUS).alias("severity"))


def stylometry(docs: DataFrame) -> DataFrame:
    """T5: rates of words of method, certainty and of adjectives, in texts of 500 words or more."""
    rows = docs.select("doc_id", tokens(F.lower("text"), "[A-Za-z]+").alias("w")).withColumn("n_words", F.size("w").cast("long")).where("n_words >= 500")
    listed = lambda words: F.size(F.filter("w", lambda x: x.isin(*words)))
    adjective = F.size(F.filter("w", lambda x: (F.length(x) > 4) & x.rlike(f"(?:{'|'.join(W.ADJECTIVE_ENDINGS)})$")))
    rows = rows.withColumns({"method_rate": listed(W.METHODOLOGY) / F.col("n_words"), "certainty_rate": listed(W.CERTAINTY) / F.col("n_words"), "adjective_rate": adjective / F.col("n_words")})
    flags = (F.col("method_rate") > 0.05).cast("int") + (F.col("certainty_rate") > 0.01).cast("int") + (((0.10 - F.col("adjective_rate")) / 0.10) > 0.7).cast("int")
    return rows.drop("w").withColumn("flags", flags).withColumn("severity", ladder((F.col("flags") >= 3, CONCERN), (F.col("flags") == 2, NOTE)))


def leaks(docs: DataFrame) -> DataFrame:
    """Traces of generated text that was left in."""
    found = reduce(lambda a, b: a + b, [F.regexp_count("text", F.lit(f"(?i){p}")) for p in W.LEAKS])
    return docs.where(any_of(F.col("text"), W.LEAKS)).select("doc_id", found.cast("long").alias("n_leaks"), F.lit(CRITICAL).cast("int").alias("severity"))


def style_phrases(docs: DataFrame, extra: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Density of stock phrases per word, counts by profile, the strongest profile; texts of 300 characters or more."""
    profiles = {"gpt": W.STYLE_GPT, "claude": W.STYLE_CLAUDE, "gemini": W.STYLE_GEMINI}
    profiles = {k: (*v, *(extra or {}).get(k, ())) for k, v in profiles.items()}
    rows = docs.where(F.length("text") >= 300).withColumn("words_", letter_words(F.col("text")))
    rows = rows.select("doc_id", F.regexp_count("text", F.lit(r"\b[a-zA-Z]+\b")).cast("long").alias("n_words"), *[F.aggregate(phrase_counts(F.col("text"), F.col("words_"), v, loose=False), F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias(k) for k, v in profiles.items()])
    rows = rows.withColumn("n_phrases", F.col("gpt") + F.col("claude") + F.col("gemini")).withColumn("density", F.coalesce(F.col("n_phrases") / F.nullif("n_words", F.lit(0)), F.lit(0.0)))
    best = F.greatest(*profiles)
    provider = F.when(best < 3, "none").when(F.col("gpt") == best, "gpt").when(F.col("claude") == best, "claude").otherwise("gemini")
    return rows.withColumn("provider", provider).withColumn("severity", ladder((F.col("density") >= 0.006, SUSPICIOUS), (F.col("density") >= 0.003, CONCERN), (F.col("provider") != "none", NOTE)))


def perplexity(logprobs: DataFrame, inverted: bool = False) -> DataFrame:
    """T7 over (doc_id, seg, logprob) of tokens: geometric mean of the segments' perplexities."""
    s = logprobs.groupBy("doc_id", "seg").agg(F.exp(-F.avg("logprob")).alias("ppl"))
    d = s.groupBy("doc_id").agg(F.count("*").alias("n_segments"), F.exp(F.avg(F.log("ppl"))).alias("perplexity"))
    p = F.col("perplexity")
    steps = ((p > 1.70, CRITICAL), (p > 1.56, SUSPICIOUS), (p > 1.46, NOTE)) if inverted else ((p < 5, CRITICAL), (p < 10, SUSPICIOUS), (p < 20, NOTE))
    return d.withColumn("severity", ladder(*steps))


def curvature(scores: DataFrame) -> DataFrame:
    """T8 over (doc_id, seg, score_original, scores_perturbed): mean of (perturbed mean - original) / spread over segments with two scores or more."""
    n = F.size("scores_perturbed")
    mean = F.aggregate("scores_perturbed", F.lit(0.0), lambda a, x: a + x) / n
    var = F.aggregate("scores_perturbed", F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / n
    sd = F.when(F.sqrt(var) > 0, F.sqrt(var)).otherwise(F.lit(0.5))
    d = scores.where(n >= 2).select("doc_id", ((mean - F.col("score_original")) / sd).alias("c")).groupBy("doc_id").agg(F.count("*").alias("n_segments"), F.avg("c").alias("curvature"))
    return d.withColumn("severity", ladder((F.col("curvature") < -1.5, CRITICAL), (F.col("curvature") < -0.5, SUSPICIOUS), (F.col("curvature") < 0, NOTE)))


def linear_scores(segments: DataFrame, model: DataFrame, intercept: float, threshold: float = 0.9) -> DataFrame:
    """T9 over segments(doc_id, seg, text) and model(term, idf, coef): sublinear tf-idf, L2-normalised, logistic; tiers by the share of segments above the threshold."""
    t = segments.select("doc_id", "seg", F.explode(tokens(F.lower("text"), r"(?U)\b\w\w+\b")).alias("term")).groupBy("doc_id", "seg", "term").agg(F.count("*").alias("tf"))
    x = t.join(model, "term").withColumn("x", (1 + F.log("tf")) * F.col("idf"))
    s = x.groupBy("doc_id", "seg").agg((F.sum(F.col("x") * F.col("coef")) / F.sqrt(F.sum(F.col("x") * F.col("x")))).alias("dot"))
    s = segments.select("doc_id", "seg").join(s, ["doc_id", "seg"], "left").withColumn("prob", 1 / (1 + F.exp(-(F.coalesce("dot", F.lit(0.0)) + intercept))))
    d = s.groupBy("doc_id").agg(F.count("*").alias("n_segments"), F.max("prob").alias("max_prob"), *[F.avg((F.col("prob") >= v).cast("int")).alias(name) for name, v in (("high", threshold), ("mid", 0.7), ("low", 0.5))])
    return d.withColumn("severity", ladder((F.col("high") >= 0.25, SUSPICIOUS), (F.col("mid") >= 0.25, CONCERN), (F.col("low") >= 0.25, NOTE)))


def reagent_years(docs: DataFrame, reach: int = 60) -> DataFrame:
    """Years after the paper's near a word of reagents or instruments: doc_id, position, year, keyword (the first listed)."""
    pieces = F.split("text", r"\b(?=(?:19[0-9]{2}|20[0-9]{2}|21[0-9]{2})\b)")
    rows = docs.where(F.col("text").rlike(r"\b(?:19|20|21)[0-9]{2}\b")).withColumn("pieces", pieces)
    ends = F.transform(F.col("pieces"), lambda p, i: F.aggregate(F.slice(F.transform("pieces", lambda x: F.length(x)), 1, i + 1), F.lit(0), lambda a, n: a + n))
    rows = rows.withColumn("at", F.explode(F.when(F.size("pieces") > 1, F.slice(ends, 1, F.size("pieces") - 1)).otherwise(F.array().cast("array<int>"))))
    rows = rows.withColumn("year", F.substring("text", F.col("at") + 1, F.lit(4)).try_cast("int")).where("year > paper_year")
    low = F.greatest(F.col("at") - reach, F.lit(0))
    near = F.lower(F.substring("text", low + 1, F.col("at") + 4 + reach - low))
    keyword = F.coalesce(*[F.when(F.contains(near, F.lit(k)), F.lit(k)) for k in W.REAGENT_CONTEXT])
    return rows.withColumn("keyword", keyword).where("keyword is not null").select("doc_id", F.col("at").cast("long").alias("position"), "year", "keyword", F.lit(NOTE).cast("int").alias("severity"))


# Identifiers of trial registries.
TRIAL_IDS = (r"\bNCT\d{8}\b", r"\bISRCTN\d{8}\b", r"\bChiCTR-?[\w\d-]+\b", r"\bACTRN\d{14}\b", r"\bEudraCT\s*\d{4}-\d{6}-\d{2}\b", r"\bDRKS\d{8}\b")


def trial_ids(text: Column) -> Column:
    return F.array_distinct(F.transform(F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in TRIAL_IDS]), lambda x: F.trim(F.upper(x))))


# Kinds of numbers in running text.
P_VALUE = r"\b[Pp]\s*[<=≤>≥]\s*(\d+\.?\d*[eE][+-]?\d+|\d*\.\d+)"
PERCENT = r"(-?\d+\.?\d*)\s*%"
MEAN_SD = r"(-?\d+\.\d+)\s*(?:±|\+\-|\+/\-)\s*(\d+\.\d+)"
DECIMAL = r"(?<![\d\.])-?\d+\.\d+(?![\d\.])"


def inline_numbers(docs: DataFrame) -> DataFrame:
    """doc_id with the numbers in its text by kind; a decimal that belongs to another kind isn't general."""
    text = F.col("text")
    blank = reduce(lambda t, p: F.regexp_replace(t, p, " "), (P_VALUE, MEAN_SD, PERCENT), text)
    numbers = lambda p, g: F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(g)), lambda x: x.try_cast("double"))
    return docs.select("doc_id", numbers(P_VALUE, 1).alias("p_values"), numbers(PERCENT, 1).alias("percentages"), numbers(MEAN_SD, 1).alias("means"), numbers(MEAN_SD, 2).alias("sds"), F.transform(F.regexp_extract_all(blank, F.lit(DECIMAL), F.lit(0)), lambda x: x.try_cast("double")).alias("decimals"))


def mined_phrases(docs: DataFrame, stopwords: tuple[str, ...], low: int = 2, high: int = 4, least: int = 3, per_million: float = 200.0, usual: dict[str, float] | None = None) -> DataFrame:
    """Frequent runs of words over all texts: phrase, n. Runs of stopwords alone are left out, and those less than twice as frequent as people's own texts have them (usual: phrase to its rate in a million)."""
    w = docs.select(tokens(F.lower("text"), r"\b[a-z]{2,}\b").alias("w"))
    total = w.agg(F.sum(F.size("w")).alias("total"))
    grams = w.select(F.explode(F.concat(*[runs(F.col("w"), n) for n in range(low, high + 1)])).alias("phrase")).groupBy("phrase").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    content = F.exists(F.split("phrase", " "), lambda x: ~x.isin(*stopwords))
    rate = F.col("n") * 1e6 / F.col("total")
    kept = grams.where(content).join(F.broadcast(total)).where(rate >= per_million)
    if usual:
        base = F.create_map(*[F.lit(x) for pair in usual.items() for x in pair])
        kept = kept.where(F.coalesce(rate >= 2 * F.try_element_at(base, F.col("phrase")), F.lit(True)))
    return kept.select("phrase", "n")


def normalised_dictionary(phrases: DataFrame) -> DataFrame:
    """K9 over (provider, phrase): trimmed, in lower case, each once, none blank; written as JSON it is the user's dictionary."""
    return phrases.select("provider", F.lower(F.trim("phrase")).alias("phrase")).where("phrase <> ''").distinct()


def merged_dictionaries(base: DataFrame, *others: DataFrame) -> DataFrame:
    """2.12: the phrases of all dictionaries, each once per provider."""
    return normalised_dictionary(reduce(DataFrame.unionByName, (x.select("provider", "phrase") for x in (base, *others))))


def beside_builtin(user: DataFrame, builtin: dict[str, tuple[str, ...]]) -> DataFrame:
    """The built-in phrases as they are, and the user's that none of them equals but for case: provider, phrase, own."""
    spark = user.sparkSession
    given = spark.createDataFrame([(k, p) for k, ps in builtin.items() for p in ps], "provider string, phrase string")
    key = given.select("provider", F.lower("phrase").alias("phrase"))
    more = normalised_dictionary(user).join(key.select("provider").distinct(), "provider", "left_semi").join(key, ["provider", "phrase"], "left_anti")
    return given.withColumn("own", F.lit(False)).unionByName(more.withColumn("own", F.lit(True)))

def repeated_narratives(logs: DataFrame, n: int = 4, least: float = 0.40, min_words: int = 30) -> DataFrame:
    """I5 over (file_id, entry_id, narrative): pairs of narratives of a file that share much of their n-word shingles (their 64-bit hashes).

    Narratives with one and the same set of shingles form a class and are compared once: file_id,
    entry_a, entry_b (the classes' smallest entries), size_a, size_b, jaccard; a class of several entries
    is paired with itself. Candidates come from prefixes of the rarest shingles, so frequent passages pair nothing by themselves.
    """
    rows = logs.withColumn("w", tokens(F.lower("narrative"), "[a-z0-9]+")).where(F.size("w") >= min_words).withColumn("s", F.sort_array(hashed_shingles(F.col("w"), n))).select("file_id", "entry_id", "s")
    c = rows.groupBy("file_id", F.struct(F.xxhash64("s").alias("a"), F.hash("s").alias("b"), F.size("s").alias("k")).alias("h")).agg(F.min("entry_id").alias("entry"), F.count("*").alias("size"), F.first("s").alias("s")).withColumn("k", F.size("s"))
    long = c.select("file_id", "entry", "size", "k", F.explode("s").alias("g"))
    df = long.groupBy("file_id", "g").agg(F.count("*").alias("df")).where("df > 1")
    # Shingles that no other class has can't match; they are the rarest, and come first in every prefix.
    ranked = long.join(df, ["file_id", "g"]).groupBy("file_id", "entry", "size", "k").agg(F.array_sort(F.collect_list(F.struct("df", "g"))).alias("o"))
    alone = F.col("k") - F.size("o")
    prefix = F.col("k") - F.ceil(F.lit(least) * F.col("k")).cast("int") + 1 - alone
    p = ranked.where(prefix > 0).select("file_id", "entry", "size", "k", F.transform("o", lambda x: x["g"]).alias("gs"), F.explode(F.slice("o", 1, F.greatest(prefix, F.lit(0)))).alias("x")).select("file_id", "entry", "size", "k", "gs", F.col("x.g").alias("g"))
    slim = p.select("file_id", "entry", "k", "g")
    other = slim.select("file_id", "g", F.col("entry").alias("entry_b"), F.col("k").alias("kb"))
    pairs = slim.join(other, ["file_id", "g"]).where((F.col("entry") < F.col("entry_b")) & (F.least("k", "kb") >= least * F.greatest("k", "kb"))).select("file_id", F.col("entry").alias("entry_a"), "entry_b").distinct()
    side = lambda x: ranked.select("file_id", F.col("entry").alias(f"entry_{x}"), F.col("size").alias(f"size_{x}"), F.col("k").alias(f"k_{x}"), F.transform("o", lambda y: y["g"]).alias(f"g_{x}"))
    m = pairs.join(side("a"), ["file_id", "entry_a"]).join(side("b"), ["file_id", "entry_b"]).withColumn("shared", F.size(F.array_intersect("g_a", "g_b")))
    m = m.withColumn("jaccard", F.col("shared") / (F.col("k_a") + F.col("k_b") - F.col("shared"))).where(F.col("jaccard") >= least).select("file_id", "entry_a", "entry_b", "size_a", "size_b", "jaccard")
    own = c.where("size > 1").select("file_id", F.col("entry").alias("entry_a"), F.col("entry").alias("entry_b"), F.col("size").alias("size_a"), F.col("size").alias("size_b"), F.lit(1.0).alias("jaccard"))
    j = F.col("jaccard")
    return m.unionByName(own).withColumn("severity", ladder((j >= 0.95, CRITICAL), (j >= 0.80, SUSPICIOUS), (j >= 0.60, CONCERN), otherwise=NOTE))


def newest_per(df: DataFrame, key: str, order: str) -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("_rn = 1").drop("_rn")
