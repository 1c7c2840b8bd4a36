"""Combining findings: false-discovery rates, escalation over independent methods, integrity score; report queries and look-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievemark.functions.ladder import CONCERN, CRITICAL, NOTE, SUSPICIOUS, ladder

# The methods' clusters of shared assumptions.
CLUSTERS = {
    "A1": "digit_distribution", "A2": "digit_distribution", "A3": "inter_column_relation", "A5": "digit_distribution", "A6": "data_quality", "A7": "digit_distribution",
    "B1": "summary_statistic_consistency", "B4": "summary_statistic_consistency", "B5": "publication_bias", "B6": "summary_statistic_consistency", "B7": "publication_bias", "B8": "summary_statistic_consistency",
    "C1": "randomization_check", "D1": "variance_structure", "D2": "missing_data", "E1": "within_subject_dependence",
    "F1": "image_forensics", "F2": "image_forensics", "F3": "image_forensics", "F4": "image_forensics", "F5": "metadata_forensics", "F6": "image_forensics", "F7": "image_synthesis_forensics",
    "G1": "metadata_forensics", "G3": "metadata_forensics", "G4": "metadata_forensics", "G5": "metadata_forensics",
    "I1": "industrial_conservation", "I2": "industrial_temporal_integrity", "I5": "industrial_narrative_integrity", "I6": "industrial_temporal_integrity",
    "M1": "citation_network", "T1": "text_similarity", "T2": "trial_consistency", "T3": "compliance", "T4": "paper_mill_signature", "T5": "linguistic_pattern", "T6": "paper_mill_signature", "T7": "paper_mill_signature", "T8": "paper_mill_signature", "T9": "llm_text_signature",
}


def adjusted(findings: DataFrame) -> DataFrame:
    """findings(doc_key, finding_id, p_value, ...) with p_adjusted: Benjamini and Hochberg within a report; without p: null."""
    p = findings.where("p_value is not null").withColumn("rank", F.row_number().over(Window.partitionBy("doc_key").orderBy("p_value", "finding_id"))).withColumn("m", F.count("*").over(Window.partitionBy("doc_key")))
    back = Window.partitionBy("doc_key").orderBy(F.desc("rank")).rowsBetween(Window.unboundedPreceding, 0)
    p = p.withColumn("p_adjusted", F.least(F.lit(1.0), F.min(F.col("p_value") * F.col("m") / F.col("rank")).over(back))).drop("rank", "m")
    return p.unionByName(findings.where("p_value is null").withColumn("p_adjusted", F.lit(None).cast("double")))


def escalated(findings: DataFrame) -> DataFrame:
    """Per report: counts by severity, clusters with a concern or more, and the overall severity."""
    cluster = F.create_map(*[F.lit(x) for kv in CLUSTERS.items() for x in kv])
    rows = findings.withColumn("cluster", F.when(F.col("severity") >= CONCERN, F.try_element_at(cluster, F.col("detector_id"))))
    count = lambda s, name: F.count_if(F.col("severity") == s).alias(name)
    g = rows.groupBy("doc_key").agg(F.count("*").alias("n_findings"), count(CRITICAL, "n_critical"), count(SUSPICIOUS, "n_suspicious"), count(CONCERN, "n_concern"), count(NOTE, "n_note"), F.array_join(F.sort_array(F.collect_set("cluster")), ",").alias("clusters"), F.countDistinct("cluster").alias("n_clusters"))
    n = F.col("n_clusters")
    return g.withColumn("overall", ladder(((F.col("n_critical") > 0) | (n >= 3), CRITICAL), ((F.col("n_suspicious") > 0) | (n >= 2), SUSPICIOUS), (F.col("n_concern") > 0, CONCERN), (F.col("n_note") > 0, NOTE)))


def summarised(reports: DataFrame) -> DataFrame:
    """escalated() with a summary in words: counts, clusters and, from two of them on, what their agreement means."""
    n, names = F.col("n_clusters"), F.when(F.col("clusters") == "", "none").otherwise(F.regexp_replace("clusters", ",", ", "))
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    counts = text("Total findings: ", F.col("n_findings"), " | CRITICAL: ", F.col("n_critical"), ", SUSPICIOUS: ", F.col("n_suspicious"), ", CONCERN: ", F.col("n_concern"), " | Independent evidence clusters: ", n, " (", names, ")")
    agreement = text(" | CONVERGENCE (", F.when(n >= 3, "strong").otherwise("notable"), "): methods with different assumptions point the same way, which one innocent cause seldom explains. This is a reason to investigate and to ask the authors, not a finding against anyone.")
    return reports.withColumn("summary", F.when(n >= 2, F.concat(counts, agreement)).otherwise(counts))


def integrity(findings: DataFrame) -> DataFrame:
    """Stouffer over adjusted p-values strictly between 0 and 1: integrity_z and score per report."""
    from sievemark.functions.special import z_ppf, z_sf

    q = adjusted(findings).where("p_adjusted > 0 and p_adjusted < 1").withColumn("z", z_ppf(1 - F.col("p_adjusted")))
    g = q.groupBy("doc_key").agg(F.count("*").alias("k"), (F.sum("z") / F.sqrt(F.count("*").cast("double"))).alias("integrity_z"))
    return findings.select("doc_key").distinct().join(g, "doc_key", "left").withColumn("integrity_score", F.nanvl(z_sf("integrity_z"), F.lit(None)))


def difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """K10 over (detector_id, summary): findings that a report gained or lost."""
    key = ["detector_id", "summary"]
    side = lambda df, new: df.select(*key, F.lit(not new).alias("was"), F.lit(new).alias("is"))
    # Both sides meet in one aggregation. A finding without a name equals no other.
    k = side(old, False).unionByName(side(new, True)).groupBy(*key).agg(F.max("was").alias("was"), F.max("is").alias("is"))
    blank = F.col("detector_id").isNull() | F.col("summary").isNull()
    changes = F.array_compact(F.array(F.when(F.col("is") & (~F.col("was") | blank), "added"), F.when(F.col("was") & (~F.col("is") | blank), "removed")))
    return k.select(*key, F.explode(changes).alias("change"))


def digest(findings: DataFrame, threshold: int = SUSPICIOUS, detectors: int = 6, reports: int = 30) -> DataFrame:
    """K6: the most severe reports with their first detectors."""
    g = findings.groupBy("doc_key").agg(F.max("severity").alias("overall"), F.count("*").alias("n_findings"), F.array_join(F.slice(F.sort_array(F.collect_set("detector_id")), 1, detectors), ",").alias("detectors"))
    return g.where(F.col("overall") >= threshold).orderBy(F.desc("overall"), "doc_key").limit(reports)


def doi_key(doi: Column) -> Column:
    """A DOI in lower case, without the address of its resolver."""
    return F.regexp_replace(F.lower(F.trim(doi)), "https://doi.org/", "")


def openalex_key(work: Column) -> Column:
    """The last part of a work's address: W123 of https://openalex.org/W123."""
    return F.element_at(F.split(F.trim(work), "/"), -1)


def retraction_status(works: DataFrame) -> DataFrame:
    """Landed CrossRef works (doi, json): doi, is_retracted and the kinds of the updates that retract it."""
    updates = F.from_json(F.get_json_object("json", "$.update-to"), "array<struct<type:string,DOI:string>>")
    kinds = F.filter(F.transform(updates, lambda u: F.lower(u["type"])), lambda t: t.isin("retraction", "retract", "withdrawal"))
    return works.select(doi_key(F.col("doi")).alias("doi"), F.coalesce(F.size(kinds) > 0, F.lit(False)).alias("is_retracted"), F.coalesce(F.array_join(F.sort_array(kinds), ","), F.lit("")).alias("kinds"))


def works_of(landed: DataFrame) -> DataFrame:
    """Landed OpenAlex works (json): work, doi, title, year, is_retracted, authors (keys) and references (keys)."""
    w = F.from_json("json", "id string, doi string, title string, publication_year int, is_retracted boolean, authorships array<struct<author:struct<id:string>>>, referenced_works array<string>")
    rows = landed.select(w.alias("w")).where("w.id is not null")
    none = F.array().cast("array<string>")
    return rows.select(openalex_key(F.col("w.id")).alias("work"), doi_key(F.col("w.doi")).alias("doi"), "w.title", F.col("w.publication_year").alias("year"), F.coalesce("w.is_retracted", F.lit(False)).alias("is_retracted"), F.coalesce(F.transform("w.authorships", lambda a: openalex_key(a["author"]["id"])), none).alias("authors"), F.coalesce(F.transform("w.referenced_works", openalex_key), none).alias("references"))


def found_works(works: DataFrame, first_year: int | None = None, last_year: int | None = None, author: str | None = None) -> DataFrame:
    """Works of the years and the author, filters that reach the scan of a landed table."""
    rows = works if first_year is None else works.where(F.col("year") >= first_year)
    rows = rows if last_year is None else rows.where(F.col("year") <= last_year)
    return rows if author is None else rows.where(F.array_contains("authors", author))


def fresh(landed: DataFrame, now: str, days: int = 7) -> DataFrame:
    """S23 over (key, fetched, ...): of each key the newest answer, if it is at most so many days old."""
    row = F.struct(*landed.columns)
    recent = landed.where(F.col("fetched") >= F.lit(now).cast("timestamp") - F.make_interval(days=F.lit(days)))
    return recent.groupBy("key").agg(F.max_by(row, F.struct("fetched", *landed.columns)).alias("r")).select("r.*").select(landed.columns)


def retraction_index(csv: DataFrame) -> DataFrame:
    """S18 over (_row_id, doi, date, reason): the last row of each identifier; empty and unavailable ones don't count."""
    key = doi_key(F.col("doi"))
    rows = csv.withColumn("key", key).where("key is not null and key not in ('', 'unavailable')")
    return rows.groupBy("key").agg(F.max_by("date", "_row_id").alias("date"), F.max_by("reason", "_row_id").alias("reason"))


def sanctioned(names: DataFrame, actions: DataFrame, as_of: str) -> DataFrame:
    """S19 over names(name) and actions(who, action_end): either name within the other, and the action not over (or its end unreadable).

    The shorter name's first three characters stand somewhere in the longer one, so names meet in
    equi-joins on runs of up to three characters before containment is checked.
    """
    a = actions.where("length(trim(who)) > 0").select("who", "action_end", F.lower(F.trim("who")).alias("w")).where(F.coalesce(F.col("action_end").try_cast("date") >= F.lit(as_of).cast("date"), F.lit(True))).distinct()
    n = names.select("name", F.lower(F.trim("name")).alias("n")).where("length(n) > 0").distinct()
    runs = lambda c: F.explode(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.transform(F.array(*map(F.lit, (1, 2, 3))), lambda k: F.substring(F.col(c), i, k))))))
    inner = n.withColumn("g", runs("n")).join(a.withColumn("g", F.substring("w", 1, 3)), "g").where(F.contains("n", "w"))
    outer = n.withColumn("g", F.substring("n", 1, 3)).join(a.withColumn("g", runs("w")), "g").where(F.contains("w", "n"))
    return inner.unionByName(outer).select("name", "who", "action_end").distinct()


# What a reviewing model may raise, and how severe it is.
REVIEW = {"statistics": SUSPICIOUS, "logic": CONCERN, "methods": CONCERN}


def reviewed(replies: DataFrame, most: int = 5, checked: int = 60) -> DataFrame:
    """LLM_REVIEW over (doc_id, text, reply): category and severity of the issues, the first `most` of a reply, whose passage begins in the text as quoted."""
    rows = replies.withColumn("r", F.from_json("reply", "issues array<struct<category:string,passage:string>>")).select("doc_id", "text", F.inline(F.slice("r.issues", 1, most)))
    severity = F.lit(NOTE)
    for name, s in REVIEW.items():
        severity = F.when(F.col("category") == name, s).otherwise(severity)
    return rows.where(F.contains("text", F.substring("passage", 1, checked))).select("doc_id", "category", severity.cast("int").alias("severity"))


def count_ladder(counts: DataFrame, column: str, *cuts: tuple[int, int]) -> DataFrame:
    """Severity by a count, from the highest cut down."""
    return counts.withColumn("severity", ladder(*[(F.col(column) >= n, s) for n, s in cuts]))


def likelihood_ratio(judged: DataFrame) -> DataFrame:
    """Over (flagged, positive): rates of true and false positives and their ratio; infinite without a false one."""
    g = judged.agg(F.avg(F.when(F.col("positive"), F.col("flagged").cast("int"))).alias("tpr"), F.avg(F.when(~F.col("positive"), F.col("flagged").cast("int"))).alias("fpr"))
    return g.withColumn("lr_plus", F.when(F.col("fpr") > 0, F.col("tpr") / F.col("fpr")).when(F.col("tpr") > 0, F.lit(float("inf"))))
