"""Structured Streaming forms of the ordered checks: rate limits, repeated uploads, steps back in time, daily digests, a growing hash store."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemark.operators import hashes


def rate_limits(requests: DataFrame, most: int = 30, late: str = "1 minute") -> DataFrame:
    """Keys with more than `most` requests in a minute that slides by seconds, over (key, ts)."""
    counted = requests.withWatermark("ts", late).groupBy(F.window("ts", "60 seconds", "1 second"), "key").agg(F.count("*").alias("hits"))
    return counted.where(F.col("hits") > most).select("key", F.col("window.start").alias("start"), "hits")


def first_uploads(files: DataFrame, within: str = "5 minutes") -> DataFrame:
    """Files whose digest hasn't been seen within the watermark, over (sha256, ts)."""
    return files.withWatermark("ts", within).dropDuplicatesWithinWatermark(["sha256"])


def backward_steps(feed: DataFrame) -> DataFrame:
    """feed_id, row_id, ts, behind: events older than the newest before them, over (feed_id, row_id, ts).

    No watermark stands before this, as late events are what it is to find; the state is one timestamp a feed.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        newest = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("row_id")
        out = []
        for r in rows.itertuples():
            us = int(pd.Timestamp(r.ts).value // 1000)
            if newest is not None and us < newest:
                out.append((key[0], int(r.row_id), r.ts, (newest - us) / 1e6))
            newest = us if newest is None else max(newest, us)
        state.update((newest,))
        yield pd.DataFrame(out, columns=["feed_id", "row_id", "ts", "behind"])

    return feed.groupBy("feed_id").applyInPandasWithState(step, "feed_id long, row_id long, ts timestamp, behind double", "newest long", "append", "NoTimeout")


def daily_digest(findings: DataFrame, threshold: int = 3, late: str = "1 hour") -> DataFrame:
    """Per day: reports and findings at the threshold or above, over (doc_key, detector_id, severity, ts).

    Findings are counted per day and report first, and reports per day after that, so that the count of reports is exact.
    """
    day = F.window("ts", "1 day")
    per = findings.where(F.col("severity") >= threshold).withWatermark("ts", late).groupBy(day.alias("w"), "doc_key").agg(F.count("*").alias("n"), F.max("severity").alias("worst"))
    return per.groupBy(F.window("w", "1 day").alias("d")).agg(F.count("*").alias("n_reports"), F.sum("n").alias("n_findings"), F.max("worst").alias("worst")).select(F.col("d.start").alias("day"), "n_reports", "n_findings", "worst")


def hash_store(images: DataFrame, folder: str, checkpoint: str, found: str):
    """Looks up each micro-batch of (paper_id, authors, phash) in a Parquet store, writes what it finds, then adds the batch.

    A batch that is run again replaces its own output and doesn't see what it added before.
    """
    spark = images.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)

    def batch(new: DataFrame, number: int) -> None:
        new = new.select("paper_id", "authors", "phash")
        store = new.sparkSession.read.schema("paper_id string, authors string, phash long, batch long").parquet(folder).where(F.col("batch") < number).drop("batch")
        hashes.cross_paper(new, store).write.mode("overwrite").parquet(f"{found}/batch={number}")
        new.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return images.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
