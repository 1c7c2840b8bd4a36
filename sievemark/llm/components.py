"""Connected components of a graph whose edges stay distributed.

Alternating large-star and small-star steps (Kiveris et al., 2014): every step rewires edges towards
smaller ids and keeps the components, until each vertex hangs on the smallest id of its component.
A step is one map-side combined aggregation and one equi-join; the driver sees three numbers a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemark.llm.common import checkpointed


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Here u > v holds for every edge."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """links(u, v) of any direction, repeats and loops allowed -> node, component (its smallest id).

    Null ends are ignored; nodes without a link to another don't appear; an empty input gives no rows.
    """
    edges = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges, before = checkpointed(edges), None
    for _ in range(rounds):
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        edges, before = checkpointed(_small_star(_large_star(edges))), now
    raise RuntimeError("components did not settle")
