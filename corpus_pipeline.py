"""From documents to packed sequences: language, near duplicates, benchmark, personal data, packing.

Every stage works on the rows that its predecessor has kept and returns the columns of documents; the
last returns the packed pieces. A rerun of a lost task repeats that task alone: between stages rows are
Parquet files in the folder that the cluster shares.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemark.llm import decontaminate, langid, packing, pii, simhash
from sievemark.llm.common import scratch, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language can be told; those without letters go, and they alone where no document is labelled.

    A null or empty text has no letters and goes. Repeated rows stay or go together; columns of any name are passed on.
    """
    model = langid.fit(docs)
    # Columns of any name pass under names of their own.
    own = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    found = langid.identify(docs.toDF(*own.values()), model, own["doc_id"], own["text"], keep=tuple(own.values()))
    told = F.col("lang_pred") != langid.UNKNOWN if model.languages else F.col(own["text"]).rlike(r"\p{L}")
    return found.where(told).select(*[F.col(v).alias(c) for c, v in own.items()])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, that of the smallest id; repeated rows are copies, and rows without an id stay."""
    return simhash.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; all of them if it is empty. A null text holds no passage."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the kind in place of each piece of personal data, and n_chars, where there is one, of what results; a null text stays null."""
    left = pii.redacted(docs)
    if "n_chars" not in docs.columns:
        return left
    return left.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens; a null text is empty and gives the piece of the end id."""
    return packing.pack_documents(docs)


STAGES = [("language ID", language), ("SimHash near-dedup", near_duplicates), ("benchmark decontamination", decontamination), ("PII", personal_data), ("best-fit packing", packed)]

#: The stages are iterative or statistical; tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs
