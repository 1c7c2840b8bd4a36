"""Citation graphs: edges(graph_id, src, dst) and authors(graph_id, node, author); joins stay within a graph."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievemark.functions.ladder import CONCERN, SUSPICIOUS, ladder


def simple_edges(edges: DataFrame) -> DataFrame:
    return edges.where("src <> dst").select("graph_id", "src", "dst").distinct()


#: Nodes that a graph needs for any of M1's findings.
LEAST_NODES = 8


def large_enough(edges: DataFrame, least: int = LEAST_NODES) -> DataFrame:
    """The edges of graphs of `least` nodes or more."""
    return edges.join(_large(edges, least), "graph_id", "left_semi")


def _large(edges: DataFrame, least: int = LEAST_NODES) -> DataFrame:
    """The graphs of `least` nodes or more."""
    nodes = edges.select("graph_id", F.explode(F.array("src", "dst")).alias("n")).distinct()
    return nodes.groupBy("graph_id").agg(F.count("*").alias("k")).where(F.col("k") >= least).select("graph_id")


def _pairs(edges: DataFrame) -> DataFrame:
    """graph_id, a < b, and whether an edge leads up (a to b) and down: distinct edges and their answers from one aggregation."""
    up = F.col("src") < F.col("dst")
    return edges.where("src <> dst").groupBy("graph_id", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.max(up).alias("up"), F.max(~up).alias("down"))


def reciprocal(edges: DataFrame) -> DataFrame:
    """M1: share of edges that are answered."""
    both = F.col("up") & F.col("down")
    g = _pairs(edges).groupBy("graph_id").agg((F.count("*") + F.count_if(both)).alias("n_edges"), F.count_if(both).alias("pairs")).join(_large(edges), "graph_id", "left_semi")
    return g.withColumn("ratio", 2 * F.col("pairs") / F.col("n_edges")).withColumn("severity", ladder((F.col("ratio") >= 0.2, SUSPICIOUS), (F.col("ratio") >= 0.1, CONCERN)))


def short_cycles(edges: DataFrame) -> DataFrame:
    """M1: simple directed cycles of three and four nodes, each counted once, from its smallest node.

    For the smallest node a and the one opposite, c, the ways there and back by one node each are counted; four
    nodes are a way there with a way back, but for those by the same node. No cycle is a row.
    """
    way = lambda x, y, there: F.struct(F.col(x).alias("src"), F.col(y).alias("dst"), (F.col("up") & F.col("down")).alias("both"), F.col(there).alias("there"))
    e = _pairs(edges).select("graph_id", F.inline(F.array(way("a", "b", "up"), way("b", "a", "down")))).where("there").drop("there")
    first = e.select("graph_id", F.col("src").alias("x"), F.col("dst").alias("m"), F.col("both").alias("r"))
    ways = first.join(e.select("graph_id", F.col("src").alias("m"), F.col("dst").alias("y"), F.col("both").alias("s")), ["graph_id", "m"]).where("x <> y and m > least(x, y)")
    ahead = F.col("x") < F.col("y")
    one = lambda c: c.cast("long")
    ends = ways.select("graph_id", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("c"), one(ahead).alias("p"), one(~ahead).alias("q"), one(ahead & F.col("r") & F.col("s")).alias("same"), F.lit(0).cast("long").alias("back"))
    close = e.where("src > dst").select("graph_id", F.col("dst").alias("a"), F.col("src").alias("c"), *[F.lit(v).cast("long").alias(k) for k, v in (("p", 0), ("q", 0), ("same", 0), ("back", 1))])
    n = ends.unionByName(close).groupBy("graph_id", "a", "c").agg(*[F.sum(k).alias(k) for k in ("p", "q", "same", "back")])
    n = n.groupBy("graph_id").agg(F.sum(F.col("p") * F.col("back")).alias("n3"), F.sum(F.col("p") * F.col("q") - F.col("same")).alias("n4"))
    g = e.select("graph_id").distinct().join(_large(edges), "graph_id", "left_semi").join(n, "graph_id", "left").na.fill(0)
    n = F.col("n3") + F.col("n4")
    return g.withColumn("severity", ladder((n >= 8, SUSPICIOUS), (n >= 3, CONCERN)))


def author_density(edges: DataFrame, authors: DataFrame) -> DataFrame:
    """M1: how densely an author's nodes (three or more) cite each other."""
    a = authors.select("graph_id", "node", "author").distinct().join(large_enough(edges).select("graph_id").distinct(), "graph_id", "left_semi")
    n = a.groupBy("graph_id", "author").agg(F.count("*").alias("n_nodes")).where("n_nodes >= 3")
    own = a.join(n, ["graph_id", "author"])
    inner = simple_edges(large_enough(edges)).join(own.select("graph_id", F.col("node").alias("src"), "author"), ["graph_id", "src"]).join(own.select("graph_id", F.col("node").alias("dst"), "author"), ["graph_id", "dst", "author"])
    m = inner.groupBy("graph_id", "author").agg(F.count("*").alias("n_inner"))
    g = n.join(m, ["graph_id", "author"], "left").withColumn("n_inner", F.coalesce("n_inner", F.lit(0)))
    g = g.withColumn("density", F.col("n_inner") / (F.col("n_nodes") * (F.col("n_nodes") - 1)))
    return g.withColumn("severity", ladder((F.col("density") >= 0.6, SUSPICIOUS), (F.col("density") >= 0.4, CONCERN)))


#: Pairs of linked nodes up to which a graph is taken as a whole.
TOGETHER = 50_000


def cliques(edges: DataFrame) -> DataFrame:
    """M1: maximal undirected cliques of four nodes or more that share references; of each graph's, the first five by members.

    A clique is found in the neighbourhood of its smallest node, so a graph of more than TOGETHER edges isn't
    gathered in a task; smaller ones are, since their neighbourhoods are many times their edges.
    """

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        near: dict[int, set[int]] = {}
        for a, b in zip(pdf.a.tolist(), pdf.b.tolist(), strict=True):
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
        found: list[tuple[int, ...]] = []
        for least in sorted(near):
            around = {x: near[x] & near[least] for x in near[least]}
            found += sorted(c for c in _maximal(around, (least,), {x for x in around if x > least}, {x for x in around if x < least}) if len(c) >= 4)
            if len(found) >= 5:
                break
        return pd.DataFrame([(int(pdf.graph_id.iloc[0]), list(c)) for c in found[:5]], columns=["graph_id", "members"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        near: dict[int, set[int]] = {}
        for a, b in zip(pdf.a, pdf.b, strict=True):
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
        least = pdf.node.iloc[0]
        found = _maximal(near, (least,), {x for x in near if x > least}, {x for x in near if x < least})
        rows = [(int(pdf.graph_id.iloc[0]), list(map(int, c))) for c in sorted(x for x in found if len(x) >= 4)[:5]]
        return pd.DataFrame(rows, columns=["graph_id", "members"])

    e = simple_edges(large_enough(edges))
    every = _pairs(edges).select("graph_id", "a", "b")
    size = every.groupBy("graph_id").agg(F.count("*").alias("size")).join(_large(edges), "graph_id", "left_semi")
    small = every.join(size.where(F.col("size") <= TOGETHER), "graph_id", "left_semi")
    between = every.join(size.where(F.col("size") > TOGETHER), "graph_id", "left_semi")
    both = between.unionByName(between.select("graph_id", F.col("b").alias("a"), F.col("a").alias("b")))
    side = lambda name: both.select("graph_id", F.col("a").alias("node"), F.col("b").alias(name))
    around = between.join(side("b").where("b > node"), ["graph_id", "b"]).join(side("a"), ["graph_id", "node", "a"])
    found = around.groupBy("graph_id", "node").applyInPandas(run, "graph_id long, members array<long>")
    found = found.unionByName(small.groupBy("graph_id").applyInPandas(whole, "graph_id long, members array<long>"))
    key = ["graph_id", "members"]
    found = found.withColumn("k", F.row_number().over(Window.partitionBy("graph_id").orderBy("members"))).where("k <= 5").select(*key, F.explode("members").alias("src"))
    cited = found.join(e, ["graph_id", "src"]).withColumn("outside", (~F.array_contains("members", F.col("dst"))).cast("long"))
    n = cited.groupBy(*key).agg(F.count_distinct("src").alias("n"), F.sum("outside").alias("total")).where("n >= 2")
    times = cited.where("outside = 1").groupBy(*key, "dst").agg(F.count("*").alias("times"))
    common = n.join(times, key, "left").groupBy(*key, "n", "total").agg(F.count(F.when(F.col("times") == F.col("n"), 1)).alias("common"))
    shared = F.when(F.col("total") > 0, F.col("common") / (F.col("total") / F.col("n"))).otherwise(0.0)
    return common.select(*key, shared.alias("shared")).withColumn("severity", ladder((F.col("shared") >= 0.5, SUSPICIOUS)))


def mill_findings(edges: DataFrame, authors: DataFrame) -> DataFrame:
    """M1 as a whole: graph_id, rule, detail, severity of what each graph shows; of an author's clusters the first by name that is dense enough."""
    percent = lambda c: F.format_string("%.1f%%", 100 * F.col(c))
    row = lambda df, rule, detail: df.where("severity > 0").select("graph_id", F.lit(rule).alias("rule"), detail.alias("detail"), "severity")
    dense = author_density(edges, authors).where("severity > 0").groupBy("graph_id").agg(F.min_by(F.struct("author", "density", "severity"), "author").alias("f")).select("graph_id", "f.*")
    parts = [
        row(reciprocal(edges), "reciprocal citations", F.concat(percent("ratio"), F.lit(" of edges are answered"))),
        row(short_cycles(edges), "short cycles", F.concat((F.col("n3") + F.col("n4")).cast("string"), F.lit(" cycles of three or four nodes"))),
        row(cliques(edges), "shared references", F.concat(F.lit("clique of "), F.array_join("members", ","))),
        row(dense, "author cluster", F.concat(F.lit("author "), F.col("author").cast("string"), F.lit(" at a density of "), percent("density"))),
    ]
    return reduce(DataFrame.unionByName, parts)


def _maximal(near: dict[int, set[int]], clique: tuple[int, ...], candidates: set[int], seen: set[int]) -> Iterator[tuple[int, ...]]:
    """Maximal cliques that extend one by candidates, and not by what has been seen; with pivots."""
    stack = [(clique, candidates, seen)]
    while stack:
        clique, candidates, seen = stack.pop()
        if not candidates and not seen:
            yield tuple(sorted(clique))
            continue
        pivot = max(candidates | seen, key=lambda x: len(near[x] & candidates))
        for x in sorted(candidates - near[pivot]):
            stack.append(((*clique, x), candidates & near[x], seen & near[x]))
            candidates = candidates - {x}
            seen = seen | {x}
