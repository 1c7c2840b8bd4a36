"""Tabular sources: Parquet tables, and delimited files with the usual spellings of a missing value."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Texts that stand for a missing value.
MISSING = ("", "NA", "N/A", "NaN", "null", "None", "#N/A", "-nan", "nan", "n/a", "<NA>", "NULL")


#: Bytes of a table below which its rows aren't dealt out.
SPREAD_BYTES = 2_000_000


def spread(df: DataFrame, path: str) -> DataFrame:
    """df, dealt out to all cores if its files give fewer than half as many partitions; a table of many files stays as it is.

    What is dealt out is so less than a partition a core; columns and filters still reach the scan.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = folder.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(folder).getLength()
    return df.repartition(cores) if size >= SPREAD_BYTES and 2 * df.rdd.getNumPartitions() <= cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    return spread(spark.read.parquet(path), path)


def delimited(spark: SparkSession, path: str, separator: str = ",", header: bool = True) -> DataFrame:
    """A CSV or TSV file: texts of missing values become null before types are told; _row_id keeps the file's order."""
    raw = spark.read.csv(path, sep=separator, header=header, inferSchema=False)
    clean = raw.select(*[F.when(~F.trim(F.col(f"`{c}`")).isin(*MISSING), F.col(f"`{c}`")).alias(c) for c in raw.columns])
    tests = {c: (F.count_if(F.col(f"`{c}`").isNotNull()).alias(f"n_{i}"), F.count_if(F.col(f"`{c}`").rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$")).alias(f"d_{i}"), F.count_if(F.col(f"`{c}`").rlike(r"^\s*[+-]?\d{1,18}\s*$")).alias(f"i_{i}")) for i, c in enumerate(clean.columns)}
    found = clean.agg(*[x for t in tests.values() for x in t]).first()
    kinds = {c: "long" if found[f"n_{i}"] and found[f"n_{i}"] == found[f"i_{i}"] else "double" if found[f"n_{i}"] and found[f"n_{i}"] == found[f"d_{i}"] else "string" for i, c in enumerate(clean.columns)}
    return clean.select(*[F.col(f"`{c}`").cast(kinds[c]).alias(c) for c in clean.columns], F.monotonically_increasing_id().alias("_row_id"))


def tsv(spark: SparkSession, path: str) -> DataFrame:
    return delimited(spark, path, "\t")
