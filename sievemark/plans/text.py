"""Queries of the text detectors. Texts of the documents get statistics, phrases and statements by id, so that every rule meets some."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemark.functions import wordlists as W
from sievemark.functions.text import phrase_pattern, strip_markup
from sievemark.operators import text as T
from sievemark.plans import series as S
from sievemark.sources.tables import table

#: Added to a text by its id modulo the number of entries.
CLAIMS = (
    " We found t(28) = 2.20, p = .036 and F(2, 30) = 4.50, p < .05.",
    " Here chi2(3) = 9.10, p = 0.028; z = 2.50, p = .012.",
    " A link r(40) = .35, p = .02 (one-tailed) and t(12) = 1.90, p = .04.",
    " Then Q(4) = 12.5, p = .014, and H(2) = 8.50, p = 0.140.",
    " Fit r2 = 0.85, n = 30, p < 0.001; chi2 = 15.30, df = 4, p = 0.004.",
    " Nothing to report, p > 0.05; 12.5% of 3.10 +- 0.20 and 7.25 left.",
    " Registered as NCT01234567 and ISRCTN12345678, again NCT01234567.",
)
PHRASES = (" The fluffy rationale and head part investigation show bosom danger.", " We apply colossal information.", "", " The haze figuring is haze  figuring.", "")
STYLES = (" We delve into the rich tapestry, a testament to synergy; noteworthy, pivotal role.", "", " I should mention that it's important to note the trade-offs, with that said.", " As an AI language model, I cannot access this. Regenerate response", "", "")
STATEMENTS = (
    " Data availability: data are available on request. Conflicts of interest: none.",
    " Data availability: available on request, 10.1234/abcdefghijklmnopqrstuvwxyz012345 (40 characters with it).",
    " Data availability: available on request, 10.1234/abcdefghijklmnopqrstuvwxyz01234567 (so are these).",
    " Data availability: available on request, see 10.1234/short for it.",
    " Data are available upon reasonable request. Competing interests: none.",
    " Trial registration: NCT01234567. Approved by the ethics committee of our board.",
    " Data sharing: see GSE12345. Declaration of interest: none. IRB approval given.",
    "",
)
REAGENTS = (" The antibody was purchased from Sigma in 2031.", " In 2035 nothing.", " Lot no 7 of the kit, made 2019.", "", " Samples of 2040 on the microscope, then 2041.")
STOP = ("the", "of", "and", "to", "is", "de", "la", "der", "die", "que", "le", "on", "for")
TERMS = (("the", 1.2, 0.8), ("of", 1.4, -0.5), ("and", 1.5, 0.3), ("que", 2.0, -1.2), ("der", 2.2, 1.7), ("leur", 3.0, 2.0), ("with", 2.4, 1.1))


def _with(docs: DataFrame, additions: tuple[str, ...]) -> DataFrame:
    n = len(additions)
    return docs.withColumn("text", F.concat("text", F.element_at(F.array(*map(F.lit, additions)), (F.col("doc_id") % n + 1).cast("int"))))


def _docs(spark: SparkSession, sf_dir: str, additions: tuple[str, ...] = ("",)) -> DataFrame:
    return _with(table(spark, sf_dir, "documents").select("doc_id", "text"), additions)


def b4_statcheck_extract(spark, sf_dir):
    found = T.reported_statistics(_docs(spark, sf_dir, CLAIMS))
    return found.select("doc_id", "family", "raw", "df1", "df2", "stat", "sign", "p")


def b4_statcheck(spark, sf_dir):
    return T.statcheck(_docs(spark, sf_dir, CLAIMS)).select("doc_id", "family", "raw", F.round("computed_p", 6).alias("computed_p"), "numeric", "decision", "severity")


def t1_text_similarity(spark, sf_dir):
    corpus = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("label"), "text")
    return T.text_similarity(_docs(spark, sf_dir).withColumnRenamed("doc_id", "query_id"), corpus).withColumn("jaccard", F.round("jaccard", 6))


def t3_compliance(spark, sf_dir):
    d = F.col("doc_id")
    docs = _docs(spark, sf_dir, STATEMENTS).withColumns({"paper_year": F.when(d % 7 != 0, (1998 + d % 27).cast("int")), "is_clinical_trial": d % 3 == 0, "is_human_subjects": d % 4 == 0, "is_animal_study": d % 10 == 1})
    return T.compliance(docs)


def t4_tortured_phrases(spark, sf_dir):
    return T.tortured_phrases(_docs(spark, sf_dir, PHRASES))


def t5_stylometry(spark, sf_dir):
    found = T.stylometry(_docs(spark, sf_dir))
    return found.withColumns({c: F.round(c, 6) for c in ("method_rate", "certainty_rate", "adjective_rate")})


def t6_leaks(spark, sf_dir):
    return T.leaks(_docs(spark, sf_dir, STYLES))


def t6_ai_phrases(spark, sf_dir):
    return T.style_phrases(_docs(spark, sf_dir, STYLES)).withColumn("density", F.round("density", 6))


def t7_perplexity(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("seg"), F.posexplode(F.split("text", " ")).alias("i", "w"))
    return T.perplexity(turns.select("doc_id", "seg", (-(F.col("i") % 7 + F.col("doc_id") % 5) / 3.0).alias("logprob"))).withColumn("perplexity", F.round("perplexity", 6))


def t8_curvature(spark, sf_dir):
    d = F.col("conv_id")
    scores = table(spark, sf_dir, "conversations").select(d.alias("doc_id"), F.col("turn").alias("seg"), (-(d % 11) / 4.0 - 1).alias("score_original"), F.array(-(d % 7) / 3.0 - 1, -(F.col("turn") % 3) / 2.0 - 2, F.lit(-1.5)).alias("scores_perturbed"))
    return T.curvature(scores).withColumn("curvature", F.round("curvature", 6))


def t9_tfidf_lr(spark, sf_dir):
    segments = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("seg", "text"))
    model = spark.createDataFrame(TERMS, "term string, idf double, coef double")
    found = T.linear_scores(segments, model, -0.4)
    return found.select("doc_id", "n_segments", *[F.round(c, 6).alias(c) for c in ("max_prob", "high", "mid", "low")], "severity")


def g5_reagent_year(spark, sf_dir):
    docs = _docs(spark, sf_dir, REAGENTS).withColumn("paper_year", (2018 + F.col("doc_id") % 5).cast("int"))
    return T.reagent_years(docs).select("doc_id", "year", "keyword", "severity")


def trial_ids(spark, sf_dir):
    found = _docs(spark, sf_dir, CLAIMS).select("doc_id", F.array_join(T.trial_ids(F.col("text")), ",").alias("ids"))
    return found.where("ids <> ''")


def inline_numbers(spark, sf_dir):
    found = T.inline_numbers(_docs(spark, sf_dir, CLAIMS))
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0))), 4)
    return found.select("doc_id", *[x for c in ("p_values", "percentages", "means", "sds") for x in (F.size(c).cast("long").alias(f"n_{c}"), total(c).alias(f"sum_{c}"))])


def jats_strip_markup(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", strip_markup(F.col("html")).alias("text"))


def ngram_mining(spark, sf_dir):
    return T.mined_phrases(_docs(spark, sf_dir), STOP)


def i5_batch_repetition(spark, sf_dir):
    logs = table(spark, sf_dir, "documents").select(F.col("source").alias("file_id"), F.col("doc_id").alias("entry_id"), F.col("text").alias("narrative"))
    return T.repeated_narratives(logs).withColumn("jaccard", F.round("jaccard", 6))


QUERIES = {f.__name__: f for f in (b4_statcheck_extract, b4_statcheck, t1_text_similarity, t3_compliance, t4_tortured_phrases, t5_stylometry, t6_leaks, t6_ai_phrases, t7_perplexity, t8_curvature, t9_tfidf_lr, g5_reagent_year, trial_ids, inline_numbers, jats_strip_markup, ngram_mining, i5_batch_repetition)}


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _docs_sql(additions: tuple[str, ...]) -> str:
    return f"docs as (select doc_id, text || ([{', '.join(map(_lit, additions))}])[doc_id % {len(additions)} + 1] as text from documents)"


#: Letters beyond ASCII count as word characters on the other side.
_ASCII = r"regexp_replace(text, '[^\x00-\x7F]', '_', 'g')"


def _extract_sql() -> str:
    parts = []
    for family, pattern, groups in T.STATISTICS:
        p = _lit(pattern.replace("(?iu)", "(?i)"))
        cols = [f"try_cast(regexp_extract(raw, {p}, {g}) as double)" if g and k != 3 else f"regexp_extract(raw, {p}, {g})" if g else "cast(null as double)" for k, g in enumerate(groups)]
        parts.append(f"select doc_id, '{family}' as family, raw, {cols[0]} as df1, {cols[1]} as df2, {cols[2]} as stat, {cols[3]} as sign, {cols[4]} as p from (select doc_id, unnest(regexp_extract_all(text, {p})) as raw from docs)")
    return " union all ".join(parts)


def _phrases_sql(phrases: tuple[str, ...], loose: bool) -> str:
    return f"(select unnest([{', '.join(map(_lit, phrases))}]) as phrase, unnest([{', '.join(_lit(phrase_pattern(p, loose)) for p in phrases)}]) as pattern)"


def _any_sql(patterns: tuple[str, ...], column: str = "text") -> str:
    return f"regexp_matches({column}, {_lit('(?i)' + '|'.join(f'(?:{p})' for p in patterns))})"


def _style_sql() -> str:
    counts = ", ".join(f"(select coalesce(sum(len(regexp_extract_all(t, pattern))), 0) from {_phrases_sql(v, False)}) as {k}" for k, v in (("gpt", W.STYLE_GPT), ("claude", W.STYLE_CLAUDE), ("gemini", W.STYLE_GEMINI)))
    return f"""with {_docs_sql(STYLES)}, a as (select doc_id, {_ASCII} as t from docs where length(text) >= 300),
        c as (select doc_id, len(regexp_extract_all(t, '\\b[a-zA-Z]+\\b')) as n_words, {counts} from a),
        d as (select *, gpt + claude + gemini as n, case when n_words = 0 then 0 else (gpt + claude + gemini) / n_words end as density, greatest(gpt, claude, gemini) as best from c),
        e as (select *, case when best < 3 then 'none' when gpt = best then 'gpt' when claude = best then 'claude' else 'gemini' end as provider from d)
        select doc_id, cast(n_words as bigint) as n_words, cast(gpt as bigint) as gpt, cast(claude as bigint) as claude, cast(gemini as bigint) as gemini, cast(n as bigint) as n_phrases, round(density, 6) as density, provider,
               cast(case when density >= 0.006 then 3 when density >= 0.003 then 2 when provider <> 'none' then 1 else 0 end as int) as severity from e"""


def _statcheck_sql() -> str:
    """Distributions by Simpson's rule, once for each distinct statistic."""
    x = "case when family = 'r' then stat * sqrt(df1 / greatest(1 - stat * stat, 1e-12)) when family = 'r2' then sqrt(stat / ((1 - stat) / (df1 - 2))) else stat end"
    one = f"case when family in ('t', 'r', 'r2') then {S.t_sf('x', 'd')} when family = 'z' then 1 - {S.normal_cdf('abs(x)')} when family = 'F' then {S.f_sf('x', 'd', 'd2')} else 1 - {S.chi2_cdf('x', 'd')} end"
    off = lambda c: f"case when sign = '=' then abs(round_even({c}, digits) - p) > pow(10.0, -digits) / 2 + 1e-12 else {c} >= p end"
    wrong = lambda c: f"((case when sign = '=' then p < 0.05 else p <= 0.05 end) <> ({c} < 0.05))"
    return f"""with {_docs_sql(CLAIMS)}, f as ({_extract_sql()}), g as (select * from f where (family <> 'r' or abs(stat) < 1) and (family <> 'r2' or (stat > 0 and stat < 1 and df1 > 2))),
        u as (select distinct family, df1, df2, stat, {x} as x, cast(case when family = 'r2' then df1 - 2 else coalesce(df1, 1) end as double) as d, cast(coalesce(df2, 1) as double) as d2 from g),
        v as (select family, df1, df2, stat, {one} as one from u),
        w as (select g.*, v.one, case when g.family in ('t', 'r', 'z', 'r2') then 2 * v.one else v.one end as two, g.family = 't' and regexp_matches(raw, '(?i)one[-\\s]?(tailed|sided)$') as tailed,
                     regexp_matches(text, '(?i)one-?[ ]?tailed|one-?[ ]?sided') as said, cast(length(regexp_replace(split_part(printf('%.10f', p), '.', 2), '0+$', '')) as int) as digits
              from g join v on v.family = g.family and v.df1 is not distinct from g.df1 and v.df2 is not distinct from g.df2 and v.stat = g.stat join docs on docs.doc_id = g.doc_id),
        k as (select *, case when tailed then one else two end as first from w),
        c as (select *, case when said and family in ('t', 'r', 'z') and ({off('first')} or {wrong('first')}) and not {off('one')} and not {wrong('one')} then one else first end as computed from k)
        select doc_id, family, raw, round(computed, 6) as computed_p, {off('computed')} as numeric, {wrong('computed')} as decision, cast(case when {wrong('computed')} then 3 when {off('computed')} then 2 else 0 end as int) as severity from c"""


_SHINGLES = "case when len(w) >= {n} then list_distinct(list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i:i + {m}], ' '))) else [] end"

ORACLE_SQL = {
    "b4_statcheck_extract": f"with {_docs_sql(CLAIMS)}, f as ({_extract_sql()}) select * from f where (family <> 'r' or abs(stat) < 1) and (family <> 'r2' or (stat > 0 and stat < 1 and df1 > 2))",
    "b4_statcheck": _statcheck_sql(),
    "t1_text_similarity": f"""with q as (select doc_id, regexp_extract_all(lower(text), '[a-z\\x{{4e00}}-\\x{{9fff}}]+') as w from documents),
        qs as (select doc_id, {_SHINGLES.format(n=5, m=4)} as s from q where len(w) >= 10), c as (select item_id, regexp_extract_all(lower(text), '[a-z\\x{{4e00}}-\\x{{9fff}}]+') as w from benchmark), cs as (select item_id, {_SHINGLES.format(n=5, m=4)} as s from c),
        m as (select a.doc_id, b.item_id, na, nb, count(*) as k from (select doc_id, len(s) as na, unnest(s) as g from qs) a join (select item_id, len(s) as nb, unnest(s) as g from cs) b on a.g = b.g group by all),
        j as (select doc_id as query_id, item_id as label, k / (na + nb - k) as j from m)
        select query_id, label, round(j, 6) as jaccard, cast(case when j >= 0.5 then 4 when j >= 0.25 then 3 else 2 end as int) as severity from j where j >= 0.1""",
    "t3_compliance": f"""with {_docs_sql(STATEMENTS)}, y as (select doc_id, text, case when doc_id % 7 <> 0 then 1998 + doc_id % 27 end as y, doc_id % 3 = 0 as trial, doc_id % 4 = 0 or doc_id % 10 = 1 as subjects,
            {_any_sql(T.DATA_STATEMENT)} as stmt, {_any_sql(T.VAGUE)} as vague, {_any_sql(T.ACCESSIONS[1:])} or len(list_filter(regexp_extract_all(text, '\\b10\\.\\d{{4,9}}/[^\\s\\)\\]\\}}]+'), lambda x: length(x) >= 40)) > 0 as acc, {_any_sql(T.ETHICS)} as eth, {_any_sql(T.INTERESTS)} as coi, {_any_sql(T.REGISTRATION)} as reg from docs where length(text) >= 200)
        select doc_id, 'no data statement' as rule, cast(2 as int) as severity from y where not stmt and (y is null or y >= 2018)
        union all select doc_id, 'vague availability', 2 from y where not (not stmt and (y is null or y >= 2018)) and vague and not acc
        union all select doc_id, 'unregistered trial', case when y < 2010 then 2 else 3 end from y where trial and not reg and (y is null or y >= 2005)
        union all select doc_id, 'no ethics approval', 2 from y where subjects and not eth
        union all select doc_id, 'no statement of interests', 1 from y where not coi""",
    "t4_tortured_phrases": f"""with {_docs_sql(PHRASES)}, c as (select doc_id, phrase, len(regexp_extract_all(text, pattern)) as n from docs, {_phrases_sql(W.TORTURED, True)} where length(text) >= 200),
        g as (select doc_id, count(*) as u, sum(n) as t, string_agg(phrase, '; ' order by phrase) as p from c where n > 0 group by all)
        select doc_id, u as n_unique, cast(t as bigint) as n_total, p as phrases, cast(case when u >= 3 or t >= 5 then 4 else 3 end as int) as severity from g""",
    "t5_stylometry": f"""with w as (select doc_id, regexp_extract_all(lower(text), '[a-z]+') as w from documents), r as (select doc_id, cast(len(w) as bigint) as n_words,
            len(list_filter(w, lambda x: x in ({', '.join(map(_lit, W.METHODOLOGY))}))) / len(w) as m, len(list_filter(w, lambda x: x in ({', '.join(map(_lit, W.CERTAINTY))}))) / len(w) as c,
            len(list_filter(w, lambda x: length(x) > 4 and regexp_matches(x, '(?:{'|'.join(W.ADJECTIVE_ENDINGS)})$'))) / len(w) as a from w where len(w) >= 500),
        f as (select *, cast(m > 0.05 as int) + cast(c > 0.01 as int) + cast((0.1 - a) / 0.1 > 0.7 as int) as flags from r)
        select doc_id, n_words, round(m, 6) as method_rate, round(c, 6) as certainty_rate, round(a, 6) as adjective_rate, flags, cast(case when flags >= 3 then 2 when flags = 2 then 1 else 0 end as int) as severity from f""",
    "t6_leaks": f"with {_docs_sql(STYLES)}, c as (select doc_id, {' + '.join(f'len(regexp_extract_all(text, {_lit("(?i)" + p)}))' for p in W.LEAKS)} as n from docs) select doc_id, cast(n as bigint) as n_leaks, cast(4 as int) as severity from c where n > 0",
    "t6_ai_phrases": _style_sql(),
    "t7_perplexity": """with t as (select conv_id as doc_id, turn as seg, string_split(text, ' ') as w from conversations), u as (select doc_id, seg, unnest(range(len(w))) as i from t),
        s as (select doc_id, seg, exp(-avg(-(i % 7 + doc_id % 5) / 3.0)) as ppl from u group by all), d as (select doc_id, count(*) as n_segments, exp(avg(ln(ppl))) as p from s group by all)
        select doc_id, n_segments, round(p, 6) as perplexity, cast(case when p < 5 then 4 when p < 10 then 3 when p < 20 then 1 else 0 end as int) as severity from d""",
    "t8_curvature": """with s as (select conv_id as doc_id, -(conv_id % 11) / 4.0 - 1 as o, [-(conv_id % 7) / 3.0 - 1, -(turn % 3) / 2.0 - 2, -1.5] as p from conversations),
        c as (select doc_id, (list_avg(p) - o) / case when list_stddev_pop(p) > 0 then list_stddev_pop(p) else 0.5 end as c from s), d as (select doc_id, count(*) as n_segments, avg(c) as c from c group by all)
        select doc_id, n_segments, round(c, 6) as curvature, cast(case when c < -1.5 then 4 when c < -0.5 then 3 when c < 0 then 1 else 0 end as int) as severity from d""",
    "t9_tfidf_lr": f"""with m as (select * from (values {', '.join(f"('{t}', {i}, {c})" for t, i, c in TERMS)}) v(term, idf, coef)),
        l as (select doc_id, string_split(text, chr(10)) as ls from documents), s as (select doc_id, unnest(range(len(ls))) as seg, unnest(ls) as line from l),
        t as (select doc_id, seg, unnest(regexp_extract_all(lower(line), '[\\p{{L}}\\p{{N}}_\\p{{M}}]+')) as term from s), f as (select doc_id, seg, term, count(*) as tf from t where length(term) >= 2 group by all),
        x as (select doc_id, seg, sum((1 + ln(tf)) * idf * coef) / sqrt(sum(pow((1 + ln(tf)) * idf, 2))) as d from f join m on m.term = f.term group by all),
        p as (select s.doc_id, s.seg, 1 / (1 + exp(-(coalesce(d, 0) - 0.4))) as p from s left join x on x.doc_id = s.doc_id and x.seg = s.seg),
        g as (select doc_id, count(*) as n_segments, max(p) as m, avg(cast(p >= 0.9 as int)) as h, avg(cast(p >= 0.7 as int)) as i, avg(cast(p >= 0.5 as int)) as o from p group by all)
        select doc_id, n_segments, round(m, 6) as max_prob, round(h, 6) as high, round(i, 6) as mid, round(o, 6) as low, cast(case when h >= 0.25 then 3 when i >= 0.25 then 2 when o >= 0.25 then 1 else 0 end as int) as severity from g""",
    "g5_reagent_year": f"""with {_docs_sql(REAGENTS)}, i as (select doc_id, text, 2018 + doc_id % 5 as py, unnest(range(1, length(text) - 2)) as i from docs where regexp_matches(text, '(19|20|21)[0-9][0-9]')),
        y as (select doc_id, text, py, i, try_cast(text[i:i + 3] as int) as year from i where regexp_matches(text[i:i + 3], '^(19|20|21)[0-9][0-9]$') and not regexp_matches(text[i - 1:i - 1], '^[A-Za-z0-9_]$') and not regexp_matches(text[i + 4:i + 4], '^[A-Za-z0-9_]$')),
        k as (select unnest({list(W.REAGENT_CONTEXT)}) as keyword, unnest(range({len(W.REAGENT_CONTEXT)})) as o),
        m as (select doc_id, i, year, arg_min(keyword, o) as keyword from y, k where year > py and contains(lower(text[greatest(i - 60, 1):i + 63]), keyword) group by all)
        select doc_id, year, keyword, cast(1 as int) as severity from m""",
    "trial_ids": f"""with {_docs_sql(CLAIMS)}, a as (select doc_id, list_concat({', '.join(f'regexp_extract_all(text, {_lit(p)})' for p in T.TRIAL_IDS)}) as l from docs), u as (select doc_id, unnest(range(len(l))) as i, upper(trim(unnest(l))) as x from a),
        f as (select doc_id, x, min(i) as i from u group by all) select doc_id, string_agg(x, ',' order by i) as ids from f group by all""",
    "inline_numbers": f"""with {_docs_sql(CLAIMS)}, n as (select doc_id, regexp_extract_all(text, {_lit(T.P_VALUE)}, 1) as p_values, regexp_extract_all(text, {_lit(T.PERCENT)}, 1) as percentages, regexp_extract_all(text, {_lit(T.MEAN_SD)}, 1) as means, regexp_extract_all(text, {_lit(T.MEAN_SD)}, 2) as sds from docs)
        select doc_id, {', '.join(f'cast(len({c}) as bigint) as n_{c}, round(coalesce(list_sum(list_transform({c}, lambda x: try_cast(x as double))), 0), 4) as sum_{c}' for c in ("p_values", "percentages", "means", "sds"))} from n""",
    "jats_strip_markup": r"""with a as (select page_id, regexp_replace(regexp_replace(html, '(?i)</?(?:sup|sub)\b[^>]*>', '', 'g'), '<[^>]+>', ' ', 'g') as t from pages)
        select page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(t, '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g')) as text from a""",
    "ngram_mining": f"""with w as (select regexp_extract_all({_ASCII.replace('text', 'lower(text)')}, '\\b[a-z]{{2,}}\\b') as w from documents), t as (select sum(len(w)) as total from w),
        g as (select unnest(list_concat({', '.join(f"case when len(w) >= {n} then list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i:i + {n - 1}], ' ')) else [] end" for n in (2, 3, 4))})) as phrase from w),
        c as (select phrase, count(*) as n from g group by all having count(*) >= 3)
        select phrase, n from c, t where n * 1e6 / total >= 200 and len(list_filter(string_split(phrase, ' '), lambda x: x not in ({', '.join(map(_lit, STOP))}))) > 0""",
    "i5_batch_repetition": f"""with w as (select source, doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') as w from documents), r as (select source, doc_id, list_sort({_SHINGLES.format(n=4, m=3)}) as s from w where len(w) >= 30),
        c as (select source, min(doc_id) as e, count(*) as size, s, len(s) as k from r group by source, s), l as (select source, e, size, k, unnest(s) as g from c),
        m as (select a.source, a.e as ea, b.e as eb, a.size as sa, b.size as sb, a.k as ka, b.k as kb, count(*) as n from l a join l b on a.source = b.source and a.g = b.g and a.e < b.e group by all),
        j as (select source, ea, eb, sa, sb, n / (ka + kb - n) as j from m union all select source, e, e, size, size, 1.0 from c where size > 1)
        select source as file_id, ea as entry_a, eb as entry_b, sa as size_a, sb as size_b, round(j, 6) as jaccard, cast(case when j >= 0.95 then 4 when j >= 0.8 then 3 when j >= 0.6 then 2 else 1 end as int) as severity from j where j >= 0.4""",
}
