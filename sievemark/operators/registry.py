"""The detectors by name: what relation each reads, which of them to run, and their findings in one form.

A detector is a function from relations to rows (doc_key, summary, p_value, severity). Further ones are
registered like the given ones; a selection by identifier, by cluster of methods or by what is at hand is
a filter on the registry, so detectors that can't apply are left out rather than failing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemark.operators import evidence, hashes, images, network, numeric, reported, text

FINDINGS = ["doc_key", "finding_id", "detector_id", "summary", "p_value", "severity"]


@dataclass(frozen=True)
class Detector:
    id: str
    needs: tuple[str, ...]
    run: Callable[..., DataFrame]

    @property
    def cluster(self) -> str | None:
        return evidence.CLUSTERS.get(self.id)


REGISTRY: dict[str, list[Detector]] = {}


def register(detector: Detector) -> None:
    """Adds a part of a detector; several parts of one identifier all run."""
    REGISTRY.setdefault(detector.id, []).append(detector)


def select(ids: Iterable[str] | None = None, clusters: Iterable[str] | None = None, have: Iterable[str] | None = None) -> list[Detector]:
    """The registered detectors of the identifiers, the clusters and the relations at hand, as far as these are given."""
    ids, clusters, have = (None if x is None else set(x) for x in (ids, clusters, have))
    return [d for parts in REGISTRY.values() for d in parts if (ids is None or d.id in ids) and (clusters is None or d.cluster in clusters) and (have is None or have.issuperset(d.needs))]


def _rows(df: DataFrame, key: str, summary: Column, p: Column | None = None) -> DataFrame:
    return df.where("severity > 0").select(F.col(key).cast("string").alias("doc_key"), summary.alias("summary"), (F.lit(None) if p is None else p).cast("double").alias("p_value"), F.col("severity").cast("int").alias("severity"))


def scan(relations: dict[str, DataFrame], detectors: list[Detector] | None = None) -> DataFrame:
    """All findings of the detectors whose relations are at hand: FINDINGS. finding_id numbers equal rows alike, so that reruns agree."""
    chosen = select(have=relations) if detectors is None else [d for d in detectors if set(d.needs) <= set(relations)]
    if not chosen:
        raise ValueError("no detector applies to " + ", ".join(sorted(relations)))
    parts = [d.run(*(relations[n] for n in d.needs)).withColumn("detector_id", F.lit(d.id)) for d in chosen]
    every = reduce(DataFrame.unionByName, parts)
    # A figure's findings are its document's.
    every = every.withColumns({"summary": F.when(F.col("doc_key").contains("!"), F.concat(F.substring_index("doc_key", "!", -1), F.lit(": "), F.col("summary"))).otherwise(F.col("summary")), "doc_key": F.substring_index("doc_key", "!", 1)})
    return every.withColumn("finding_id", F.xxhash64("doc_key", "detector_id", "summary")).select(FINDINGS)


def reports(findings: DataFrame) -> DataFrame:
    """Per document: counts, clusters, overall severity, integrity score and a summary in words; adjusted p-values stand in adjusted(findings)."""
    return evidence.summarised(evidence.escalated(findings)).join(evidence.integrity(findings), "doc_key")


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _number(name: str, digits: int = 3) -> Column:
    return F.format_string(f"%.{digits}f", F.col(name).cast("double"))


def _pairs(cells: DataFrame) -> DataFrame:
    return numeric.cell_pairs(cells)


_GIVEN = (
    Detector("A1", ("cells",), lambda c: _rows(numeric.terminal_digit(c), "file_id", _text("last digits of ", F.col("col"), ": V = ", _number("cramers_v")))),
    Detector("A1", ("cells",), lambda c: _rows(numeric.lag1_digits(c), "file_id", _text("last digits of ", F.col("col"), " repeat: z = ", _number("z")))),
    Detector("A1", ("cells",), lambda c: _rows(numeric.joint_entropy(c), "file_id", _text("digits across a row: z = ", _number("z")))),
    Detector("A2", ("cells",), lambda c: _rows(numeric.benford(c), "file_id", _text("first digits of ", F.col("col"), ": chi-square ", _number("chi2")))),
    Detector("A2", ("cells",), lambda c: _rows(numeric.benford_segments(c), "file_id", _text("segments of ", F.col("col"), " deviate alike"))),
    Detector("A3", ("cells",), lambda c: _rows(_pairs(c), "file_id", _text("constant ", F.col("kind"), " of ", F.col("a"), " and ", F.col("b")))),
    Detector("A5", ("cells",), lambda c: _rows(numeric.decimal_consistency(c), "file_id", _text("few fractions in ", F.col("col")))),
    Detector("A6", ("cells",), lambda c: _rows(numeric.implausible(c), "file_id", _text(F.col("rule"), " in ", F.col("col"), ": ", F.col("n_hit"), " values"))),
    Detector("A7", ("cells",), lambda c: _rows(numeric.zero_five(c), "file_id", _text("0 and 5 end ", F.col("col"), " at a rate of ", _number("ratio")), F.col("p_value"))),
    Detector("D1", ("cells",), lambda c: _rows(numeric.block_variance(c), "file_id", _text("blocks of ", F.col("col"), " vary alike: ", _number("rel_std", 4)))),
    Detector("D2", ("cells",), lambda c: _rows(numeric.complete_cells(c), "file_id", F.lit("no value is missing"))),
    Detector("B1", ("means",), lambda m: _rows(reported.grim(m), "label", F.lit("the mean isn't one of whole numbers"))),
    Detector("B4", ("texts",), lambda t: _rows(text.statcheck(t), "doc_id", _text("reported test: ", F.col("raw")))),
    Detector("B5", ("p_values",), lambda v: _rows(reported.insufficient_variance(v), "label", _text("variance of z ", _number("var_z")), F.col("p_left"))),
    Detector("B6", ("deviations",), lambda m: _rows(reported.grimmer(m), "label", F.lit("mean and deviation aren't those of whole numbers"))),
    Detector("B7", ("p_values",), lambda v: _rows(reported.p_curve(v), "label", _text("significant p-values near 0.05: ", F.col("near")))),
    Detector("C1", ("arms",), lambda a: _rows(reported.carlisle(a), "trial_id", _text("groups are ", F.col("reading")), F.col("p_value"))),
    Detector("E1", ("repeats",), lambda v: _rows(numeric.icc(v), "file_id", _text("repeats of a subject: correlation ", _number("icc")))),
    Detector("F1", ("images",), lambda i: _rows(hashes.hamming_pairs(i), "doc_id", _text("images ", F.col("image_a"), " and ", F.col("image_b"), " at a distance of ", F.col("distance")))),
    Detector("F3", ("pictures",), lambda p: _rows(images.copy_moves(p), "origin", _text(F.col("votes"), " patches moved alike"))),
    Detector("F6", ("pictures",), lambda p: _rows(images.patch_splices(p), "origin", _text("patches unlike their surroundings, a cluster of ", F.col("cluster")))),
    Detector("F7", ("pictures",), lambda p: _rows(images.spectra(p), "origin", _text("outer spectrum: z = ", _number("z")))),
    Detector("F4", ("images", "image_store"), lambda i, s: _rows(hashes.cross_paper(i.select(F.col("doc_id").alias("paper_id"), "authors", "phash"), s), "paper_id", _text("an image like one of ", F.col("other_id")))),
    Detector("F5", ("photos",), lambda p: _rows(hashes.exif_clusters(p), "doc_id", F.lit("times and cameras of the images"))),
    Detector("G3", ("revisions",), lambda r: _rows(r, "path", _text(F.col("n_unique"), " editing sessions"))),
    Detector("G4", ("files",), lambda f: _rows(hashes.file_metadata(f), "file_id", F.lit("time of creation, creator or revisions of the file"))),
    Detector("G5", ("dated_texts",), lambda t: _rows(text.reagent_years(t), "doc_id", _text("year ", F.col("year"), " near ", F.col("keyword")))),
    Detector("M1", ("edges", "authors"), lambda e, a: _rows(network.mill_findings(e, a), "graph_id", _text(F.col("rule"), ": ", F.col("detail")))),
    Detector("T3", ("dated_texts",), lambda t: _rows(text.compliance(t), "doc_id", F.col("rule"))),
    Detector("T4", ("texts",), lambda t: _rows(text.tortured_phrases(t), "doc_id", F.col("phrases"))),
    Detector("T5", ("texts",), lambda t: _rows(text.stylometry(t), "doc_id", F.lit("rates of words"))),
    Detector("T6", ("texts",), lambda t: _rows(text.leaks(t), "doc_id", _text(F.col("n_leaks"), " traces of generated text"))),
    Detector("T6", ("texts",), lambda t: _rows(text.style_phrases(t), "doc_id", _text("stock phrases: ", F.col("n_phrases")))),
)
for _d in _GIVEN:
    register(_d)
