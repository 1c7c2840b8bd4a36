"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemark.sources.tables import table  # noqa: F401

#: Characters of text that a Python worker turns into arrays at a time.
CHUNK_CHARS = 4_000_000


def shared_folder(spark: SparkSession) -> str:
    """The folder for reliable checkpoints that the session names.

    Only a session of one machine (a test) that names none gets a folder of its own; on a cluster, where
    executors wouldn't see such a folder, it is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir names no folder that the cluster shares")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="sievemark-ckpt-"))
    return sc.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, which goes when the application ends: results that are read lazily need it until then."""
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return folder


def own_name(name: str, taken: list[str]) -> str:
    """A column name that none of the taken ones equals, whatever their case."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name = "_" + name
    return name


def no_clash(keep: tuple[str, ...], results: tuple[str, ...]) -> None:
    """Columns that are to be passed on can't have a result's name."""
    lower = {c.lower() for c in results}
    if clash := [c for c in keep if c.lower() in lower]:
        raise ValueError(f"columns {clash} have names of result columns; rename them first")


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(texts: list[bytes], limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of whole texts of about limit bytes; a longer text is a run of its own."""
    i = size = 0
    for j, x in enumerate(texts):
        if j > i and size + len(x) > limit:
            yield i, j
            i, size = j, 0
        size += len(x)
    if i < len(texts):
        yield i, len(texts)


def crc_bucket(column: str, n: int):
    """crc32 of the value as text, modulo n."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n
