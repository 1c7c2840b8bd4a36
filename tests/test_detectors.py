"""Reference detectors on small built inputs: one case that fires, one that doesn't, and odd values."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievemark.functions import special
from sievemark.functions.digits import first_digit, fraction_text, last_digit, number_text
from sievemark.operators import evidence, hashes, network, numeric, process, reported
from sievemark.operators import text as T


def cells(spark, columns):
    rows = [("f", c, i, float(v)) for c, vs in columns.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "file_id string, col string, row_id long, val double")


def by_col(df):
    return {r.col: r for r in df.collect()}


def test_number_text_and_digits(spark):
    values = [2.5, 3.0, 100.0, 0.0, 12345678.5, 1e7, 1e-4, 0.00012, 1e16, 1.5e-7, -2.50, 1234567890123.25, 0.1, 1e22]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = df.select(number_text(F.col("v")).alias("t"), last_digit(F.col("v")).alias("d"), first_digit(F.col("v")).alias("f"), fraction_text(F.col("v")).alias("p")).collect()
    for v, r in zip(values, got, strict=True):
        assert r.t == repr(v), v
        text = repr(v).rstrip("0").rstrip(".") if "." in repr(v) else repr(v).rstrip("0")
        assert r.d == int(text[-1]), v
        assert r.f == (int(next(c for c in repr(abs(v)) if c in "123456789")) if v else None)
    whole = spark.createDataFrame([(100,), (0,), (-120,), (7,)], "v long").select(last_digit(F.col("v"), is_int=True).alias("d"))
    assert [r.d for r in whole.collect()] == [1, 0, 2, 7]


def test_digit_detectors(spark):
    rng = random.Random(1)
    c = cells(spark, {"biased": [k + 0.5 for k in range(200)], "uniform": [k / 10 + 0.01 * (k % 10) + 0.001 * (1 + k % 9) for k in range(200)], "few": [1.5] * 9, "bases": [10 ** (4 * k / 300) for k in range(300)], "spread": [float(rng.randint(1, 9)) * 10 ** (k % 4) for k in range(300)]})
    a1 = by_col(numeric.terminal_digit(c))
    assert a1["biased"].severity == 4 and "few" not in a1
    a2 = by_col(numeric.benford(c))
    assert a2["bases"].severity == 0 and a2["spread"].severity > 0
    a7 = by_col(numeric.zero_five(c))
    assert a7["biased"].p_value < 1e-100 or a7["biased"].severity == 4
    a5 = by_col(numeric.decimal_consistency(c))
    assert a5["biased"].severity == 4
    assert by_col(numeric.lag1_digits(c))["biased"].severity == 3
    assert numeric.terminal_digit(c.where("false")).count() == 0


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_ordered_statistics_move_the_cells_once(spark):
    c = cells(spark, {"a": [0.5, 1.5] * 60, "line": [float(k) for k in range(90)], "flat": [1.0] * 90})
    assert exchanges(numeric.block_variance(c)) == 1 and {r.col for r in numeric.block_variance(c).collect()} == {"a"}
    plan = numeric.joint_entropy(c)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("repartition") == 0 and "collect_list" not in plan
    got = numeric.joint_entropy(c).first()
    assert (got.cols, got.n_rows) == (3, 90)
    plan = numeric.benford_segments(c)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Window") < plan.index("[1-9]") < plan.index("Join")


def test_relations(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(10, 2, 40), rng.normal(5, 1, 40)
    rows = [("f", float(x), float(y), float(x - 3), float(2 * y), float(x + 2 * y)) for x, y in zip(a, b, strict=True)]
    df = spark.createDataFrame(rows, "file_id string, a double, b double, c double, d double, e double")
    found = {(r.a, r.b, r.kind): r.severity for r in numeric.column_pairs(df, "file_id", ["a", "b", "c", "d", "e"]).collect()}
    assert found == {("a", "c", "difference"): 4, ("b", "d", "ratio"): 3}
    fits = {r.col: r.severity for r in numeric.multivariate(df.select("file_id", "a", "b", "e"), "file_id", ["a", "b", "e"]).collect()}
    assert fits == {"a": 4, "b": 4, "e": 4}


def test_smoothness_and_plausibility(spark):
    rng = random.Random(2)
    c = cells(spark, {"smooth": [0.0, 1.0] * 100, "noise": [rng.gauss(0, 1) for _ in range(200)], "line": [float(k) for k in range(200)]})
    d1 = by_col(numeric.block_variance(c))
    assert d1["smooth"].severity == 4 and d1["noise"].severity == 0 and "line" not in d1
    assert 0.3 < by_col(numeric.hurst(c))["noise"].hurst < 0.8
    p = cells(spark, {"age": [30.0] * 19 + [150.0], "sd_percent": [999.0, 50.0], "x": [1e11]})
    got = {(r.col, r.rule): r.severity for r in numeric.implausible(p).collect()}
    assert got == {("age", "age"): 2, ("sd_percent", "sentinel"): 2, ("sd_percent", "percentage"): 2, ("x", "sentinel"): 2}
    values = [("f", s, float(s + rng.gauss(0, 0.1))) for s in range(8) for _ in range(4)] + [("g", s, rng.gauss(0, 1)) for s in range(30) for _ in range(4)]
    e1 = {r.file_id: r for r in numeric.icc(spark.createDataFrame(values, "file_id string, subject_id long, value double")).collect()}
    assert e1["f"].icc > 0.9 and e1["f"].severity == 0 and abs(e1["g"].icc) < 0.3


def test_subject_column(spark):
    rows = [(k, k % 5, k % 2, 1.0) for k in range(40)]
    df = spark.createDataFrame(rows, "id long, Mouse long, lab long, value double")
    assert numeric.subject_column(df) == "Mouse" and numeric.subject_column(df.drop("Mouse")) is None
    assert numeric.numeric_columns(df) == ["id", "Mouse", "lab", "value"]


def test_special_functions():
    x = np.array([0.0, 0.5, 3.0, 20.0, 90.0])
    for df in (2, 8):
        want = [math.exp(-v / 2) * sum((v / 2) ** k / math.factorial(k) for k in range(df // 2)) for v in x]
        assert special.chi2_sf_np(x, df) == pytest.approx(want, rel=1e-10)
    assert special.t_sf_np(np.array([1.0, 2.0]), 1.0) == pytest.approx([0.5 - math.atan(v) / math.pi for v in (1, 2)], rel=1e-10)
    assert special.f_sf_np(np.array([2.5]), 2.0, 10.0) == pytest.approx([(1 + 2 * 2.5 / 10) ** -5], rel=1e-10)
    for k, n, p in ((3, 10, 0.2), (0, 5, 0.5), (5, 5, 0.5), (-1, 5, 0.5)):
        assert special.binomial_cdf_np(k, n, p) == pytest.approx(sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1)), rel=1e-10)
    assert special.normal_sf(np.array([1.959963984540054])) == pytest.approx([0.025])


def test_statcheck(spark):
    claims = [("a", "t(28) = 2.20, p = .036"), ("b", "t(28) = 2.20, p = .5"), ("c", "F(2, 30) = 4.50, p < .05"), ("d", "z = 2.50, p = .2"), ("e", "r(40) = .35, p = .02"), ("f", "chi2(2) = 5.991, p = .05"), ("g", "nothing p = here"), ("h", None), ("i", "t(12) = 1.90, p = .04 (one-tailed)")]
    got = {r.doc_id: r for r in T.statcheck(spark.createDataFrame(claims, "doc_id string, text string")).collect()}
    assert {k: v.severity for k, v in got.items()} == {"a": 0, "b": 3, "c": 0, "d": 3, "e": 0, "f": 0, "i": 0}


def test_text_screens(spark):
    long = "word " * 60
    df = spark.createDataFrame([(1, long + "The fluffy rationale, head part investigation and bosom  danger."), (2, long + "as an AI language model I"), (3, long), (4, None)], "doc_id long, text string")
    assert {r.doc_id: (r.n_unique, r.severity) for r in T.tortured_phrases(df).collect()} == {1: (3, 4)}
    assert [r.doc_id for r in T.leaks(df).collect()] == [2]
    years = spark.createDataFrame([(1, "The antibody of 2031 and 2010.", 2020), (2, "In 2031 nothing.", 2020)], "doc_id long, text string, paper_year int")
    assert [(r.doc_id, r.year, r.keyword, r.position) for r in T.reagent_years(years).collect()] == [(1, 2031, "antibody", 16)]
    a = " ".join(f"w{k}" for k in range(60))
    logs = spark.createDataFrame([("f", 1, a), ("f", 2, a), ("f", 3, a + " tail"), ("f", 4, " ".join(f"v{k}" for k in range(60))), ("g", 5, a), ("f", 6, "short")], "file_id string, entry_id long, narrative string")
    got = sorted((r.entry_a, r.entry_b, r.size_a, r.severity) for r in T.repeated_narratives(logs).collect())
    assert got == [(1, 1, 2, 4), (1, 3, 2, 4)]


def test_segments(spark):
    from sievemark.functions.text import packed_segments

    df = spark.createDataFrame([("One two. Three four! Five six? Seven.",), ("",)], "t string")
    assert [r[0] for r in df.select(packed_segments(F.col("t"), 22)).collect()] == [["One two. Three four!", "Five six? Seven."], []]


def test_reported(spark):
    items = spark.createDataFrame([("ok", 3.5, 10, 2, 1), ("bad", 3.14, 10, 2, 1)], "label string, mean double, n int, decimal_places int, scale_items int")
    assert {r.label: r.severity for r in reported.grim(items).collect()} == {"ok": 0, "bad": 2}
    ps = spark.createDataFrame([("pile", 0.041 + 0.0008 * k) for k in range(11)] * 6 + [("fair", 0.0005 * k) for k in range(1, 60)], "label string, p double")
    got = {r.label: r.severity for r in reported.p_curve(ps).collect()}
    assert got["pile"] >= 2 and got["fair"] == 0
    impossible = spark.createDataFrame([("x", 3.0, 9.0, 1, 10, 1, 5), ("y", 3.0, 1.1, 1, 10, 1, 5)], "label string, mean double, sd double, sd_decimals int, n int, scale_min int, scale_max int")
    assert {r.label: r.possible for r in reported.sprite(impossible).collect()} == {"x": False, "y": True}


def test_insufficient_variance_against_scalar_rules(spark):
    from statistics import NormalDist, variance

    rng, normal = random.Random(6), NormalDist()
    groups = {"alike": [0.01 + 0.0001 * k for k in range(60)], "wide": [rng.random() for _ in range(60)], "few": [0.01] * 9, "edges": [0.0, 1.0, *[rng.random() * 0.05 for _ in range(20)]], "weak": [rng.uniform(0.5, 0.9) for _ in range(70)]}
    got = {r.label: r for r in reported.insufficient_variance(spark.createDataFrame([(g, float(p)) for g, ps in groups.items() for p in ps], "label string, p double")).collect()}
    assert set(got) == {"alike", "wide", "edges", "weak"}
    for g, r in got.items():
        zs = [normal.inv_cdf(1 - p / 2) for p in groups[g] if 0 < p < 1]
        k = len(zs)
        power = sorted(normal.cdf(abs(z) - 1.645) for z in zs)[k // 2]
        q = variance(zs) * (k - 1)
        left = 1 - float(special.chi2_sf_np(q, k - 1))
        index, i2 = sum(p < 0.05 for p in groups[g]) / k - power, max(0, (q - k + 1) / q)
        meta = index < -0.35 or i2 < 0.02
        want = 0 if left > 0.1 and not meta else 3 if left < 0.001 or left < 0.01 and meta else 2 if left < 0.01 else 1
        assert (r.k, r.severity) == (k, min(want, 1) if k < 50 else want)
        assert (r.var_z, r.r_index, r.i2, r.p_left) == pytest.approx((variance(zs), index, i2, left), abs=1e-9)
    assert got["alike"].severity == 3


def test_carlisle_readings(spark):
    arm = "struct<arm:string,n:int,mean:double,sd:double>"
    rows = [("alike", v, [("a", 100, 10.0, 2.0), ("b", 100, 10.0 + 1e-4 * v, 2.0)]) for v in range(8)] + [("unlike", v, [("a", 100, 10.0, 2.0), ("b", 100, 12.0, 2.0)]) for v in range(8)] + [("few", v, [("a", 100, 10.0, 2.0), ("b", 100, 12.0, 2.0)]) for v in range(4)]
    got = {r.trial_id: r for r in reported.carlisle(spark.createDataFrame(rows, f"trial_id string, variable int, arms array<{arm}>")).collect()}
    assert set(got) == {"alike", "unlike"}
    assert (got["alike"].reading, got["alike"].tail, got["alike"].severity) == ("too alike", "high", 3)
    assert (got["unlike"].reading, got["unlike"].tail, got["unlike"].severity) == ("too unlike", "low", 3) and got["unlike"].log10_bf == 10


def test_reconstruction(spark):
    items = [("ok", 3.0, 1.15, 10, 3.0, 1.0, 5.0), ("min", 3.0, 1.15, 10, 3.0, 0.0, 5.0), ("median", 3.0, 1.15, 10, 5.0, None, None), ("none", 3.0, 1.15, 10, None, None, None), ("wide", 3.0, 9.0, 10, 3.0, None, None), ("sum", 9.0, 1.0, 10, 3.0, None, None)]
    df = spark.createDataFrame(items, "label string, mean double, sd double, n int, reported_median double, reported_min double, reported_max double").selectExpr("*", "1 as mean_decimals", "2 as sd_decimals", "1 as scale_min", "5 as scale_max")
    got = {r.label: (r.n_samples > 0, r.outside, r.severity) for r in reported.reconstructed(df).collect()}
    assert got == {"ok": (True, "", 0), "min": (True, "min", 4), "median": (True, "median", 4), "wide": (False, "", 0)}
    fails = {r.label: (r.scale_ok, r.severity) for r in reported.grimmer(df).collect()}
    assert fails["sum"] == (False, 2) and fails["ok"] == (True, 0)


def test_reconstruction_of_many_members(spark):
    rows = [(f"{k}", 4.0 + k / 100, sd, n, lo, 7.0) for k, (sd, n, lo) in enumerate([(2.0, 9000, 1.0), (1.2, 9000, 0.0), (2.9, 20000, 1.0), (2.0, 150, 1.0), (0.3, 400, None)])]
    df = spark.createDataFrame(rows, "label string, mean double, sd double, n int, reported_min double, reported_max double").selectExpr("*", "2 as mean_decimals", "2 as sd_decimals", "1 as scale_min", "7 as scale_max", "cast(4 as double) as reported_median")
    got = {r.label: (r.n_samples, r.outside) for r in reported.reconstructed(df).collect()}
    assert len(got) == 5 and all(n == 50 for n, _ in list(got.values())[:4]) and got["4"][0] > 0
    assert got["0"][1] == "" and "min" in got["1"][1] and got["3"][1] == ""
    for x in reported.samples(4.01, 2.0, 9000, 1, 7, 0.005, random.Random(1), 3, 50, 250):
        assert (len(x), sum(x), x) == (9000, 36090, sorted(x)) and abs(np.std(x, ddof=1) - 2.0) <= 0.005 + 1e-9


def test_possible_samples_are_told_exactly():
    for n, low, high in ((2, 1, 7), (4, 1, 5), (6, -2, 3), (9, 0, 3)):
        spread: dict[int, set[float]] = {}
        for xs in itertools.combinations_with_replacement(range(low, high + 1), n):
            spread.setdefault(sum(xs), set()).add(((sum(x * x for x in xs) - sum(xs) ** 2 / n) / (n - 1)) ** 0.5)
        for total in range(low * n - 1, high * n + 2):
            for sd in (k / 20 for k in range(0, 90)):
                for slack in (0.005, 0.05, 0.5):
                    want = any(abs(x - sd) <= slack + 1e-9 for x in spread.get(total, ()))
                    assert reported.possible(total / n, sd, n, low, high, slack) == want, (n, low, high, total, sd, slack)
    assert reported.possible(3.0, 1.5, 100_000, 1, 7, 0.005) and not reported.possible(3.0, 3.5, 100_000, 1, 7, 0.005)


def test_process(spark):
    rows = [(k, 10.0, 10.0 if k < 10 else 5.0) for k in range(20)]
    log = spark.createDataFrame(rows, "k long, i double, o double").withColumn("file_id", F.lit("f"))
    r = process.mass_balance(log, ["i"], ["o"], 1.0).first()
    assert (r.n, r.violations, r.severity) == (20, 10, 3)
    feed = spark.range(60).select(F.lit("f").alias("feed_id"), F.col("id").alias("row_id"), F.timestamp_seconds(F.col("id") * 30 + F.when(F.col("id") == 30, -100).otherwise(0)).alias("ts"))
    assert process.timestamp_integrity(feed, 30).first().backward == 1
    ramp = spark.range(80).select(F.lit("f").alias("feed_id"), F.col("id").alias("row_id"), (F.col("id") * 0.5).alias("x"))
    assert process.oversmooth(ramp).first().severity == 4


def test_network(spark):
    edges = spark.createDataFrame([(1, a, b) for a in range(4) for b in range(4) if a != b] + [(1, a, r) for a in range(4) for r in (10, 11, 12)] + [(1, 10, 13)] + [(3, 0, 1), (3, 1, 0)] + [(2, k, k + 1) for k in range(8)], "graph_id long, src long, dst long")
    assert {r.graph_id: r.severity for r in network.reciprocal(edges).collect()} == {1: 3, 2: 0}
    cycles = {r.graph_id: (r.n3, r.n4) for r in network.short_cycles(edges).collect()}
    assert cycles == {1: (8, 6), 2: (0, 0)}
    found = network.cliques(edges).collect()
    assert any(set(r.members) >= {0, 1, 2, 3} for r in found)


def test_cliques_of_graphs_of_any_size(spark):
    rng = random.Random(7)
    ring = [(1, k, (k + 1) % 250) for k in range(250)] + [(1, a, b) for a in range(100, 104) for b in range(100, a)] + [(1, a, r) for a in range(100, 104) for r in (200, 201)]
    drawn = [(2, a, b) for a in range(14) for b in range(14) if rng.random() < 0.4]
    got = {(r.graph_id, tuple(r.members)) for r in network.cliques(spark.createDataFrame(ring + drawn, "graph_id long, src long, dst long")).collect()}
    linked = {frozenset(x[1:]) for x in drawn}
    whole = [c for k in range(4, 15) for c in itertools.combinations(range(14), k) if all(frozenset(x) in linked for x in itertools.combinations(c, 2))]
    want = sorted(c for c in whole if not any(set(c) < set(d) for d in whole))[:5]
    assert len(want) > 2 and {m for g, m in got if g == 2} == set(want)
    assert {m for g, m in got if g == 1} == {(100, 101, 102, 103, 200, 201)}


def test_cliques_of_small_and_large_graphs_alike(spark, monkeypatch):
    rng = random.Random(5)
    edges = spark.createDataFrame([(g, a, b) for g in range(3) for a in range(16) for b in range(16) if a != b and rng.random() < 0.3], "graph_id long, src long, dst long")
    found = lambda: sorted(map(str, network.cliques(edges).collect()))
    want = found()
    monkeypatch.setattr(network, "TOGETHER", 0)
    assert found() == want and len(want) > 5
    joins = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Join")
    assert joins(network.reciprocal(edges)) == 1 and joins(network.short_cycles(edges)) == 3
    linked = {tuple(r) for r in edges.collect()}
    for r in network.short_cycles(edges).collect():
        cycle = lambda *n: n[0] == min(n) and len(set(n)) == len(n) and all((r.graph_id, x, y) in linked for x, y in zip(n, (*n[1:], n[0]), strict=True))
        assert (r.n3, r.n4) == tuple(sum(cycle(*n) for n in itertools.permutations(range(16), k)) for k in (3, 4))


def test_mill_findings_of_a_graph(spark):
    edges = spark.createDataFrame([(1, a, b) for a in range(4) for b in range(4) if a != b] + [(1, a, r) for a in range(4) for r in (10, 11, 12)] + [(1, 10, 13)] + [(2, 0, 1), (2, 1, 0)], "graph_id long, src long, dst long")
    authors = spark.createDataFrame([(1, k, name) for k in range(4) for name in ("Y", "X")] + [(2, 0, "X")], "graph_id long, node long, author string")
    got = {(r.graph_id, r.rule): (r.detail, r.severity) for r in network.mill_findings(edges, authors).collect()}
    assert {k[1] for k in got} == {"reciprocal citations", "short cycles", "author cluster"} | ({"shared references"} if (1, "shared references") in got else set()) and {k[0] for k in got} == {1}
    assert got[1, "author cluster"] == ("author X at a density of 100.0%", 3) and got[1, "short cycles"][1] == 3


def test_hashes(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(63) for _ in range(12)]
    rows = [(1, 20 * k + d, h ^ ((1 << d) - 1)) for k, h in enumerate(base) for d in (0, 2, 5, 8, 9)]
    images = spark.createDataFrame(rows, "doc_id long, image_id long, phash long")
    got = {(r.image_a, r.image_b): r.distance for r in hashes.hamming_pairs(images).collect()}
    want = {(a, b): (x ^ y).bit_count() for _, a, x in rows for _, b, y in rows if a < b and (x ^ y).bit_count() <= 8}
    assert got == want


def test_hash_store_keeps_the_last(spark):
    store = spark.createDataFrame([("a", 1, 0), ("b", 2, 0)], "paper_id string, phash long, k int")
    new = spark.createDataFrame([("c", 2, 2), ("d", 2, 3), ("e", 3, 1), ("z", 2, 1)], "paper_id string, phash long, k int")
    assert sorted(map(tuple, hashes.upserted(store, new, "k").collect())) == [("a", 1, 0), ("d", 2, 3), ("e", 3, 1)]


def test_hidden_numbers(spark):
    df = spark.createDataFrame([(x,) for x in ("1", " -2.5e3 ", "1d", "0x1p3", "NaN", ".5", None, "1.", "Infinity")], "x string")
    assert [r[0] for r in df.select(process.number("x")).collect()] == [1.0, -2500.0, None, None, None, 0.5, None, 1.0, None]


def test_evidence(spark):
    ps = [0.01, 0.04, 0.03, 0.005, 0.9, 0.04]
    f = spark.createDataFrame([("d", k, "A1", 2, p) for k, p in enumerate(ps)] + [("d", 9, "T4", 3, None), ("e", 10, "LLM_REVIEW", 2, None)], "doc_key string, finding_id long, detector_id string, severity int, p_value double")
    q = {r.finding_id: r.p_adjusted for r in evidence.adjusted(f).collect()}
    assert [q[k] for k in range(6)] == pytest.approx([0.03, 0.048, 0.048, 0.03, 0.9, 0.048]) and q[9] is None
    over = {r.doc_key: (r.overall, r.n_clusters) for r in evidence.escalated(f).collect()}
    assert over == {"d": (3, 2), "e": (2, 0)}
    score = {r.doc_key: r.integrity_score for r in evidence.integrity(f).collect()}
    assert 0 < score["d"] < 0.05 and score["e"] is None


def test_difference_is_one_aggregation(spark):
    side = lambda *rows: spark.createDataFrame(list(rows), "detector_id string, summary string")
    found = evidence.difference(side(("A1", "x"), ("A1", "y"), ("A1", "y"), (None, "z")), side(("A1", "x"), ("A2", "w"), (None, "z")))
    assert sorted(map(tuple, found.collect()), key=str) == [("A1", "y", "removed"), ("A2", "w", "added"), (None, "z", "added"), (None, "z", "removed")]
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()


def test_scan_leaves_no_detector_out(spark):
    from sievemark.operators import registry
    from sievemark.plans.evidence import _relations

    have = _relations(spark, "/root/testdata/sf0.001")
    assert len(registry.select(have=have)) == len(registry.select())


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 60
    assert entry.entry(spark).columns[0] == "doc_key"
