"""Process data: mass balance, timestamps, smoothness; windows run within one feed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievemark.functions.ladder import CONCERN, CRITICAL, NOTE, SUSPICIOUS, ladder


def number(value) -> Column:
    """A number as text or as it is; text that Java alone takes for one, such as 1d or 0x1p3, is none."""
    text = F.trim(F.col(value).cast("string"))
    return F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text.try_cast("double"))


def mass_balance(log: DataFrame, sources: list[str], sinks: list[str], tolerance_pct: float) -> DataFrame:
    """I1 over a log with file_id: rows where what goes in and what comes out differ by more than the tolerance."""
    add = lambda cs: reduce(lambda a, b: a + b, [number(c) for c in cs])
    negative = reduce(lambda a, b: a | b, [number(c) < 0 for c in [*sources, *sinks]])
    rows = log.select("file_id", add(sources).alias("i"), add(sinks).alias("o"), negative.alias("negative")).where("i is not null and o is not null")
    rows = rows.withColumn("off", F.coalesce(F.abs((F.col("i") - F.col("o")) / F.nullif("i", F.lit(0.0))) * 100 > tolerance_pct, F.lit(False)))
    g = rows.groupBy("file_id").agg(F.count("*").alias("n"), F.count_if("off").alias("violations"), F.count_if("negative").alias("negatives")).where("n >= 5")
    least = lambda share: F.greatest(F.lit(1), F.floor(share * F.col("n")))
    v = F.col("violations")
    return g.withColumn("severity", ladder((F.col("negatives") > 0, CRITICAL), (v >= least(0.30), SUSPICIOUS), (v >= least(0.15), CONCERN), (v >= least(0.05), NOTE)))


def timestamp_integrity(feed: DataFrame, expected_seconds: float) -> DataFrame:
    """I2 over (feed_id, row_id, ts): steps back, outlying gaps, whole minutes, jumps of an hour or a shift."""
    rows = feed.where("ts is not null").withColumn("dt", F.expr("(unix_micros(ts) - unix_micros(lag(ts) over (partition by feed_id order by row_id))) div 1000000")).withColumn("k", F.count("*").over(Window.partitionBy("feed_id"))).where("k >= 20")
    m = rows.groupBy("feed_id").agg(F.median("dt").alias("med"))
    d = rows.join(m, "feed_id")
    mad = d.groupBy("feed_id").agg(F.median(F.abs(F.col("dt") - F.col("med"))).alias("mad"))
    z = F.abs(F.col("dt") - F.col("med")) / (1.4826 * F.when(F.col("mad") == 0, 1e-9).otherwise(F.col("mad")))
    jump = lambda s: F.abs(F.col("dt") - s) <= 10 + 1e-5 * s
    g = d.join(mad, "feed_id").groupBy("feed_id").agg(F.count("*").alias("n"), F.count_if(F.col("dt") < 0).alias("backward"), F.count_if(z >= 4).alias("outlying"), F.count_if((F.second("ts") == 0) & (F.expr("unix_micros(ts) % 1000000") == 0)).alias("whole_minutes"), F.count_if(jump(3600) | jump(28800)).alias("jumps"))
    share = F.col("whole_minutes") / F.col("n")
    fast = F.lit(expected_seconds < 60)
    return g.withColumn("severity", ladder((F.col("jumps") >= 5, CRITICAL), ((F.col("backward") > 0) | (F.col("outlying") >= 10) | fast & (share > 0.5), SUSPICIOUS), ((F.col("outlying") >= 3) | fast & (share > 0.15), CONCERN)))


def oversmooth(series: DataFrame) -> DataFrame:
    """I6 over (feed_id, row_id, x): noise of the steps against the spread, and how steps follow each other."""
    w = Window.partitionBy("feed_id").orderBy("row_id")
    d = series.where("x is not null").withColumn("d", F.col("x") - F.lag("x").over(w))
    m = d.groupBy("feed_id").agg(F.count("*").alias("n"), F.avg("d").alias("md"), F.stddev_samp("x").alias("sx"), F.stddev_samp("d").alias("sd"), F.countDistinct(F.round("d", 9)).alias("n_steps")).where("n >= 50 and sx > 0")
    d = d.where("d is not null").join(m, "feed_id").withColumn("c", F.col("d") - F.col("md"))
    d = d.withColumn("p", F.lag("c").over(w))
    g = d.groupBy("feed_id").agg(F.max("n").alias("n"), F.max("n_steps").alias("n_steps"), (F.max("sd") / F.max("sx")).alias("noise"), (F.sum(F.col("c") * F.col("p")) / F.nullif(F.sum(F.col("c") * F.col("c")), F.lit(0.0))).alias("lag1"))
    noise, lag1 = F.col("noise"), F.col("lag1")
    return g.withColumn("severity", ladder((F.col("n_steps") <= 2, CRITICAL), ((noise < 0.0005) | (lag1 > 0.85), SUSPICIOUS), ((noise < 0.002) | (lag1 > 0.7), CONCERN), ((noise < 0.005) | (lag1 > 0.5), NOTE)))
