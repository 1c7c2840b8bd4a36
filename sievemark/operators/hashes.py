"""Perceptual hashes of images, and metadata of image and office files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemark.functions.ladder import CONCERN, CRITICAL, NOTE, SUSPICIOUS, ladder

FAR = 8


def sign_hash(vector: Column) -> Column:
    """64 bits: which of the first 64 entries are positive."""
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)
    return F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.when(F.get(vector, i) > 0, bit(i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))


#: First bits of the five segments of a hash, and the end.
CUTS = (0, 13, 26, 39, 52, 64)


def segments(h: Column, near: bool = False) -> Column:
    """The five segments of a hash, with all their neighbours of one bit if wanted.

    Of two hashes that differ in eight bits at most, one segment differs in one at most: 5 rows on one
    side meet 69 on the other, which pairs less than one in a hundred of unlike hashes.
    """
    out = []
    for k, (a, b) in enumerate(zip(CUTS, CUTS[1:], strict=False)):
        bits = F.shiftrightunsigned(h, a).bitwiseAND(F.lit((1 << (b - a)) - 1))
        out += [F.struct(F.lit(k).alias("k"), bits.bitwiseXOR(F.lit(m).cast("long")).alias("bits")) for m in [0, *(1 << i for i in range(b - a) if near)]]
    return F.array(*out)


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)).cast("int")


def close_hashes(left: DataFrame, right: DataFrame, scope: str | None = None) -> DataFrame:
    """Distinct pairs (a, b, distance) of a hash of left and one of right within FAR bits; with a scope, both of the same.

    Each side is reduced to distinct hashes; left looks up the neighbours of its segments.
    """
    own = [scope] if scope else []
    x = left.select(*own, F.col("phash").alias("a")).distinct().select(*own, "a", F.explode(segments(F.col("a"), near=True)).alias("s"))
    y = right.select(*own, F.col("phash").alias("b")).distinct().select(*own, "b", F.explode(segments(F.col("b"))).alias("s"))
    d = distance(F.col("a"), F.col("b"))
    return x.join(y, [*own, "s"]).where(d <= FAR).select(*own, "a", "b", d.alias("distance")).distinct()


def _ladder(d: Column) -> Column:
    return ladder((d <= 2, CRITICAL), (d <= 5, SUSPICIOUS), otherwise=CONCERN)


def hamming_pairs(images: DataFrame) -> DataFrame:
    """F1 over (doc_id, image_id, phash): pairs of a document's images within eight bits; equal hashes of a document are compared once and stand for their images (n_a, n_b)."""
    u = images.groupBy("doc_id", "phash").agg(F.min("image_id").alias("image_id"), F.count("*").alias("n"))
    side = lambda h, x: u.select("doc_id", F.col("phash").alias(h), F.col("image_id").alias(f"image_{x}"), F.col("n").alias(f"n_{x}"))
    near = close_hashes(u, u, "doc_id").where("a <> b")
    p = near.join(side("a", "a"), ["doc_id", "a"]).join(side("b", "b"), ["doc_id", "b"]).where("image_a < image_b").select("doc_id", "image_a", "image_b", "n_a", "n_b", "distance")
    own = u.where("n > 1").select("doc_id", F.col("image_id").alias("image_a"), F.col("image_id").alias("image_b"), F.col("n").alias("n_a"), F.col("n").alias("n_b"), F.lit(0).alias("distance"))
    return p.unionByName(own).withColumn("severity", _ladder(F.col("distance")))


def cross_paper(images: DataFrame, store: DataFrame) -> DataFrame:
    """F4 over images and store of (paper_id, authors, phash): images within eight bits of another paper's; shared authors soften it a step."""
    x = images.select("paper_id", "authors", F.col("phash").alias("a")).distinct()
    y = store.select(F.col("paper_id").alias("other_id"), F.col("authors").alias("other_authors"), F.col("phash").alias("b")).distinct()
    names = lambda c: F.transform(F.split(c, ";"), lambda a: F.lower(F.trim(a)))
    near = close_hashes(images, store)
    p = near.join(x, "a").join(y, "b").where("paper_id <> other_id").select("paper_id", "other_id", F.col("a").alias("phash"), F.col("b").alias("other_hash"), "distance", F.arrays_overlap(names("authors"), names("other_authors")).alias("shared")).distinct()
    soft = ladder((F.col("distance") <= 2, SUSPICIOUS), otherwise=CONCERN)
    return p.withColumn("severity", F.when(F.col("shared"), soft).otherwise(_ladder(F.col("distance"))))


def upserted(store: DataFrame, new: DataFrame, order: str | None = None) -> DataFrame:
    """K8: the store with new hashes in place of equal ones; of new rows with one hash the last by the order column counts (without one: the largest row)."""
    row = F.struct(*new.columns)
    last = new.groupBy("phash").agg(F.max_by(row, F.struct(order, *new.columns) if order else row).alias("r")).select("r.*").select(new.columns)
    return store.join(last.select("phash"), "phash", "left_anti").select(new.columns).unionByName(last)


def exif_clusters(photos: DataFrame) -> DataFrame:
    """F5 over (doc_id, image_id, model, shot): long spans, many cameras, shots of one second; three images or more."""
    same = photos.groupBy("doc_id", "shot").agg(F.count("*").alias("k")).where("shot is not null").groupBy("doc_id").agg(F.max("k").alias("same_second"))
    g = photos.groupBy("doc_id").agg(F.count("*").alias("n"), F.countDistinct("model").alias("n_models"), F.floor((F.unix_timestamp(F.max("shot")) - F.unix_timestamp(F.min("shot"))) / 86400).alias("span_days")).where("n >= 3")
    g = g.join(same, "doc_id", "left")
    return g.withColumn("severity", ladder((F.col("same_second") >= 3, SUSPICIOUS), (F.col("span_days") > 5 * 365, CONCERN), (F.col("n_models") > 2, NOTE)))


# Names of image editors.
EDITORS = ("adobe photoshop", "gimp", "imagej", "fiji", "snapseed", "lightroom")
# Makers of publishers' files, who needn't be authors.
PUBLISHERS = (
    "springer", "elsevier", "wiley", "oxford university press", "cambridge university press", "sage", "taylor & francis", "nature publishing group", "frontiers", "mdpi", "plos",
    "ieee", "acm", "apa", "ams", "rsc", "acs", "aip", "iop", "biomed central", "hindawi", "emerald", "informa", "bmj", "the lancet", "cell press", "arxiv.org", "biorxiv", "medrxiv",
    "latex", "pdflatex", "xelatex", "acrobat distiller", "microsoft® word", "microsoft word", "libreoffice", "pages", "openoffice", "ghostscript",
)


def _has_any(text: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.contains(text, F.lit(w))
    return found


def exif_times(photos: DataFrame) -> DataFrame:
    """G1 over (image_id, shot, software, claimed_start, submitted): shots before the study or after submission, edited images."""
    days = lambda a, b: F.floor((F.unix_timestamp(a) - F.unix_timestamp(b)) / 86400)
    early, late = days(F.col("claimed_start"), F.col("shot")) > 1, days(F.col("shot"), F.col("submitted")) > 1
    software = F.lower(F.trim("software"))
    edited = F.coalesce(_has_any(software, EDITORS), F.lit(False))
    severity = ladder((early | late, CRITICAL), (edited & software.contains("photoshop"), CONCERN), (edited, NOTE))
    return photos.select("image_id", F.coalesce(early, F.lit(False)).alias("early"), F.coalesce(late, F.lit(False)).alias("late"), edited.alias("edited"), severity.alias("severity"))


def unexpected_makes(photos: DataFrame) -> DataFrame:
    """G1 over (doc_id, make, expected_make): documents of several makes of camera, none of which is the one that the paper names."""
    g = photos.where("trim(make) <> ''").groupBy("doc_id").agg(F.count_distinct(F.trim("make")).alias("n_makes"), F.array_join(F.sort_array(F.collect_set(F.trim("make"))), ", ").alias("makes"), F.max("expected_make").alias("expected_make"), F.max((F.lower(F.trim("make")) == F.lower("expected_make")).cast("int")).alias("met"))
    return g.where("n_makes > 1 and expected_make <> '' and met = 0").drop("met").withColumn("severity", F.lit(CONCERN).cast("int"))


def file_metadata(files: DataFrame) -> DataFrame:
    """G4 over (file_id, creator, created, revision, authors, claimed_start): creation before the study, a creator who is no author, few revisions."""
    early = F.floor((F.unix_timestamp("claimed_start") - F.unix_timestamp("created")) / 86400) > 1
    who = F.lower(F.trim("creator"))
    known = F.exists("authors", lambda a: F.contains(F.lower(a), who) | F.contains(who, F.lower(a)))
    stranger = (F.length(who) > 0) & (F.size("authors") > 0) & ~known & ~_has_any(who, PUBLISHERS)
    return files.select("file_id", F.coalesce(early, F.lit(False)).alias("early"), F.coalesce(stranger, F.lit(False)).alias("stranger"), ladder((early, CRITICAL), (stranger, CONCERN), (F.col("revision") <= 2, NOTE)).alias("severity"))
