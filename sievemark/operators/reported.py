"""Consistency of reported statistics and of randomised groups: rows of summary statistics in, severities out."""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemark.functions.ladder import CONCERN, CRITICAL, NOTE, SUSPICIOUS, ladder, weakened


def grim(items: DataFrame) -> DataFrame:
    """B1 over (label, mean, n, decimal_places, scale_items): can whole numbers have this mean?"""
    total = F.col("n") * F.col("scale_items")
    rows = items.withColumn("error", F.abs(F.col("mean") * total - F.rint(F.col("mean") * total))).withColumn("tolerance", 0.5 * F.pow(F.lit(10.0), -F.col("decimal_places")) * total)
    off = F.col("error") > F.col("tolerance")
    return rows.withColumn("severity", ladder((off & (F.col("error") > 10 * F.col("tolerance")), SUSPICIOUS), (off, CONCERN)))


def grimmer(items: DataFrame) -> DataFrame:
    """B6 over (label, mean, sd, n, mean_decimals, sd_decimals, scale_min, scale_max): mean and standard deviation of whole numbers.

    The sum of squares has to be a whole number within what rounding allows, and the sum has to lie
    within the scale, where the bounds aren't null.
    """
    n, mean, sd = F.col("n"), F.col("mean"), F.col("sd")
    mt, st = 0.5 * F.pow(F.lit(10.0), -F.col("mean_decimals")), 0.5 * F.pow(F.lit(10.0), -F.col("sd_decimals"))
    rows = items.where("n > 1 and sd > 0").withColumn("grim_ok", F.abs(mean * n - F.rint(mean * n)) <= mt * n)
    squares = n * (sd * sd + mean * mean)
    slack = n * (2 * F.abs(mean) * mt + 2 * sd * st) + 1
    total = F.rint(mean * n)
    rows = rows.withColumn("squares_ok", F.abs(squares - F.rint(squares)) <= slack).withColumn("scale_ok", F.coalesce(total.between(F.col("scale_min") * n, F.col("scale_max") * n), F.lit(True)))
    return rows.withColumn("severity", ladder((~F.col("grim_ok"), SUSPICIOUS), (~F.col("squares_ok") | ~F.col("scale_ok"), CONCERN)))


#: Members from which on a sample is kept as counts of its values.
MANY = 60


def samples(mean: float, sd: float, n: int, low: int, high: int, slack: float, rng: random.Random, wanted: int = 1, attempts: int = 50, steps: int = 800) -> list[list[int]]:
    """Up to `wanted` distinct samples of n whole numbers within the scale, of the mean's total and of a deviation within slack of sd.

    Each attempt starts from a random sample of that total and moves one unit at a time between two
    members, outwards while the deviation is too small and inwards while it is too large.
    """
    total, found = round(mean * n), []
    if not low * n <= total <= high * n or high <= low:
        return found
    if n > MANY:
        return _counted_samples(total, sd, n, low, high, slack, np.random.default_rng(rng.getrandbits(64)), wanted, attempts, steps)
    seen: set[tuple[int, ...]] = set()
    for _ in range(attempts):
        xs = [low] * n
        for _ in range(total - low * n):
            k = rng.randrange(n)
            while xs[k] >= high:
                k = (k + 1) % n
            xs[k] += 1
        squares = sum(x * x for x in xs)
        for _ in range(steps):
            var = (squares - total * total / n) / (n - 1)
            if abs(max(0.0, var) ** 0.5 - sd) <= slack + 1e-9:
                key = tuple(sorted(xs))
                if key not in seen:
                    seen.add(key)
                    found.append(list(key))
                break
            i, j = rng.randrange(n), rng.randrange(n)
            if i != j and xs[i] < high and xs[j] > low:
                change = 2 * (xs[i] - xs[j]) + 2
                if (change > 0) == (var < sd * sd):
                    xs[i] += 1
                    xs[j] -= 1
                    squares += change
        if len(found) >= wanted:
            break
    return found


def _counted_samples(total: int, sd: float, n: int, low: int, high: int, slack: float, rng: np.random.Generator, wanted: int, attempts: int, steps: int) -> list[list[int]]:
    """samples() of many members: as many of them move at once as bring the squares about half the way, so that the number of steps doesn't grow with n."""
    values, top, found = np.arange(low, high + 1), high - low, {}
    for _ in range(attempts):
        xs = rng.multinomial(total - low * n, np.full(n, 1 / n))
        while over := int((xs - top).clip(0).sum()):
            xs = np.minimum(xs, top)
            room = np.flatnonzero(xs < top)
            xs[room] += rng.multinomial(over, np.full(len(room), 1 / len(room)))
        h = np.bincount(xs, minlength=top + 1)
        squares = int((h * values * values).sum())
        for _ in range(steps):
            var = (squares - total * total / n) / (n - 1)
            if abs(max(0.0, var) ** 0.5 - sd) <= slack + 1e-9:
                found.setdefault(tuple(h.tolist()), np.repeat(values, h).tolist())
                break
            up, down = (int(np.searchsorted(np.cumsum(h), k, "right")) for k in rng.integers(0, n, 2))
            change, members = 2 * (up - down) + 2, min(h[up], h[down]) if up != down else h[up] // 2
            if up < top and down > 0 and members and (change > 0) == (var < sd * sd):
                k = int(max(1, min(members, abs(sd * sd - var) * (n - 1) / max(1, abs(change)) / 2)))
                for v, by in ((up, -k), (up + 1, k), (down, -k), (down - 1, k)):
                    h[v] += by
                squares += k * change
        if len(found) >= wanted:
            break
    return list(found.values())


@lru_cache(maxsize=64)
def _sums(n: int, top: int) -> list[int]:
    """Of n whole numbers from 0 to top, by their sum: the sums of squares that occur, as bits."""
    out = [1]
    for k in range(n):
        new = [0] * ((k + 1) * top + 1)
        for total, squares in enumerate(out):
            for v in range(top + 1):
                new[total + v] |= squares << v * v
        out = new
    return out


@lru_cache(maxsize=100_000)
def possible(mean: float, sd: float, n: int, low: int, high: int, slack: float) -> bool | None:
    """Is there a sample as in samples()? Exact; None where neither way tells it in reasonable time.

    From the most even sample to the most uneven one, moves of one unit change the sum of squares by
    2 * (high - low) - 2 at most, so an interval as long between both is met; a shorter one is looked up
    among all sums.
    """
    total, top = round(mean * n), high - low
    if not low * n <= total <= high * n or high <= low or sd != sd:
        return False
    rest = total - low * n
    own = lambda squares: squares + 2 * low * rest + n * low * low
    fits = lambda squares: abs(max(0.0, (own(squares) - total * total / n) / (n - 1)) ** 0.5 - sd) <= slack + 1e-9
    even, odd = divmod(rest, n)
    least, most = (n - odd) * even * even + odd * (even + 1) ** 2, rest // top * top * top + (rest % top) ** 2
    below = lambda squares: not fits(squares) and (own(squares) - total * total / n) / (n - 1) < sd * sd

    def first(start: int, test) -> int:
        """The first of start.. most + 1 that the test, true and then false, doesn't hold for."""
        end = most + 1
        while start < end:
            middle = (start + end) // 2
            start, end = (middle + 1, end) if test(middle) else (start, middle)
        return start

    a = first(least, below)
    b = first(a, fits)
    if a == b:
        return False
    if a == least or b == most + 1 or b - 1 - a >= 2 * top - 2:
        return True
    if (n * top) ** 2 <= 4_000_000:
        return bool(_sums(n, top)[rest] >> a & (1 << b - a) - 1)
    return None


def reconstructed(items: DataFrame, seed: int = 42, wanted: int = 50) -> DataFrame:
    """B6's reverse reconstruction over grimmer()'s items with reported_median, reported_min and reported_max: are they within what samples of the mean and deviation have?

    Items that pass grimmer() with both bounds of the scale and one of the three. A row has its own seed,
    so that results don't depend on the rows' order. severity: CRITICAL where one is outside; none found: 0.
    """

    def judge(r) -> tuple:
        found = samples(r.mean, r.sd, int(r.n), int(r.scale_min), int(r.scale_max), 0.5 * 10.0 ** -int(r.sd_decimals), random.Random(f"{seed}:{r.label}"), wanted, 5 * wanted)
        n = int(r.n)
        middle = [(x[(n - 1) // 2] + x[n // 2]) / 2 for x in found]
        ranges = ((r.reported_median, middle), (r.reported_min, [x[0] for x in found]), (r.reported_max, [x[-1] for x in found]))
        out = [name for name, (value, xs) in zip(("median", "min", "max"), ranges, strict=True) if xs and value is not None and value == value and not min(xs) <= value <= max(xs)]
        return r.label, len(found), ", ".join(out), CRITICAL if out else 0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([judge(r) for r in b.itertuples()], columns=["label", "n_samples", "outside", "severity"])

    reported = ["reported_median", "reported_min", "reported_max"]
    fit = grimmer(items).where("severity = 0 and scale_min is not null and scale_max is not null and coalesce(reported_median, reported_min, reported_max) is not null")
    return fit.select(F.col("label").cast("string").alias("label"), "mean", "sd", "n", "sd_decimals", "scale_min", "scale_max", *[F.col(c).cast("double") for c in reported]).mapInPandas(run, "label string, n_samples int, outside string, severity int")


def p_curve(values: DataFrame) -> DataFrame:
    """B7 over (label, p): significant p-values near 0.05 rather than near 0."""
    from sievemark.functions.special import binomial_cdf

    p = F.col("p")
    g = values.where((p > 0) & (p < 0.05)).groupBy("label").agg(F.count("*").alias("n"), F.count_if(p <= 0.025).alias("low"), F.count_if(p >= 0.045).alias("near"), F.count_if((p >= 0.04) & (p < 0.045)).alias("far")).where("n >= 10")
    g = g.withColumn("p_low", binomial_cdf(F.col("low"), F.col("n"), F.lit(0.5)))
    pile = (F.col("far") >= 3) & (F.col("near") >= 2.5 * F.col("far"))
    return g.withColumn("severity", weakened(ladder((F.col("p_low") < 0.001, SUSPICIOUS), ((F.col("p_low") < 0.05) | pile, CONCERN)), F.col("n")))


def insufficient_variance(values: DataFrame) -> DataFrame:
    """B5 over (label, p): variance of the z-scores of p-values, too small a one against chi-square; Stouffer's z, replicability index and heterogeneity.

    The success rate counts every p below 0.05 over the number of p strictly between 0 and 1. severity is
    0 where neither the variance nor one of the two indices stands out.
    """
    from sievemark.functions.special import chi2_sf, z_ppf, z_sf

    inner = (F.col("p") > 0) & (F.col("p") < 1)
    rows = values.withColumn("z", z_ppf(1 - F.when(inner, F.greatest("p", F.lit(1e-12))) / 2))
    k, z = F.col("k"), F.col("z")
    # The upper median of the powers is the power of the upper median of |z|, as it grows with it.
    g = rows.groupBy("label").agg(F.count("z").alias("k"), F.var_samp("z").alias("var_z"), (F.sum("z") / F.sqrt(F.count("z").cast("double"))).alias("stouffer_z"), (F.count_if(F.col("p") < 0.05) / F.count("z")).alias("success"), (-F.expr("percentile_disc(0.5) within group (order by -abs(z))")).alias("middle")).where(k >= 10)
    g = g.withColumn("q", (k - 1) * F.col("var_z"))
    g = g.withColumn("p_left", 1 - chi2_sf(F.col("q"), k - 1)).withColumn("stouffer_p", 2 * z_sf(F.abs("stouffer_z"))).withColumn("r_index", F.col("success") - z_sf(1.645 - F.col("middle")))
    g = g.withColumn("i2", F.when(F.col("q") > 0, F.greatest(F.lit(0.0), (F.col("q") - (k - 1)) / F.col("q"))).otherwise(0.0))
    meta = (F.col("r_index") < -0.35) | (F.col("i2") < 0.02)
    severity = ladder(((F.col("p_left") > 0.10) & ~meta, 0), ((F.col("p_left") < 0.001) | ((F.col("p_left") < 0.01) & meta), SUSPICIOUS), (F.col("p_left") < 0.01, CONCERN), otherwise=NOTE)
    return g.drop("q", "middle").withColumn("severity", weakened(severity, k))


def sprite(items: DataFrame, seed: int = 42) -> DataFrame:
    """B8 over (label, mean, sd, sd_decimals, n, scale_min, scale_max): is there any sample of whole numbers with these? Told exactly; a search with a seed per row where that would take too long."""

    def judge(r) -> bool:
        given = r.mean, r.sd, int(r.n), int(r.scale_min), int(r.scale_max), 0.5 * 10.0 ** -int(r.sd_decimals)
        told = possible(*given)
        return bool(samples(*given, random.Random(f"{seed}:{r.label}"))) if told is None else told

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [judge(r) for r in b.itertuples()]
            yield pd.DataFrame({"label": b["label"], "possible": found, "severity": [0 if x else SUSPICIOUS for x in found]})

    return items.where("n > 1").select("label", "mean", "sd", "sd_decimals", "n", "scale_min", "scale_max").mapInPandas(run, "label string, possible boolean, severity int")


def welch_pairs(arms: DataFrame) -> DataFrame:
    """C1 over (trial_id, variable, arms array of (arm, n, mean, sd)): t and degrees of freedom of every pair of arms."""
    pairs = F.flatten(F.transform("arms", lambda x, i: F.transform(F.filter("arms", lambda y, j: j > i), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    rows = arms.select("trial_id", "variable", F.explode(pairs).alias("p"))
    va, vb = [F.pow(F.col(f"p.{s}.sd"), F.lit(2)) / F.col(f"p.{s}.n") for s in "xy"]
    se = va + vb
    t = F.when(se > 0, (F.col("p.x.mean") - F.col("p.y.mean")) / F.sqrt(se))
    df = F.when(se > 0, se * se / (va * va / (F.col("p.x.n") - 1) + vb * vb / (F.col("p.y.n") - 1)))
    return rows.select("trial_id", "variable", F.col("p.x.arm").alias("arm_a"), F.col("p.y.arm").alias("arm_b"), t.alias("t"), df.alias("df"), (F.col("p.x.mean") == F.col("p.y.mean")).alias("equal"))


def carlisle(arms: DataFrame) -> DataFrame:
    """Are the groups of a trial too alike, or too unlike? Upper median p per variable, Stouffer over five variables or more."""
    from sievemark.functions.special import t_sf, z_ppf, z_sf

    p = F.when(F.col("t").isNull(), F.col("equal").cast("double")).otherwise(2 * t_sf(F.coalesce(F.abs("t"), F.lit(0.0)), F.coalesce("df", F.lit(1.0))))
    v = welch_pairs(arms).withColumn("p", p).groupBy("trial_id", "variable").agg(F.sort_array(F.collect_list("p")).alias("ps"))
    v = v.select("trial_id", F.element_at("ps", (F.floor(F.size("ps") / 2) + 1).cast("int")).alias("p"))
    v = v.withColumn("z", z_ppf(1 - F.greatest(F.least("p", F.lit(1 - 1e-12)), F.lit(1e-12))))
    g = v.groupBy("trial_id").agg(F.count("*").alias("n_variables"), (F.sum("z") / F.sqrt(F.count("*").cast("double"))).alias("z"), F.avg((F.col("p") < 0.5).cast("int")).alias("below_half")).where("n_variables >= 5")
    g = g.withColumn("p_value", 2 * z_sf(F.abs("z")))
    g = g.withColumn("log10_bf", F.greatest(F.lit(-10.0), F.least(F.lit(10.0), (-2 * F.log(F.greatest("p_value", F.lit(1e-300))) - F.col("n_variables")) / (2 * math.log(10)))))
    reading = F.when(F.col("below_half") < 0.25, "too alike").when(F.col("below_half") > 0.75, "too unlike").otherwise("not uniform")
    tail = F.when(F.col("p_value") >= 1e-3, "borderline").when(F.col("below_half") >= 0.7, "low").otherwise("high")
    g = g.withColumn("severity", ladder((F.col("p_value") > 0.05, 0), (F.col("p_value") < 1e-6, SUSPICIOUS), (F.col("p_value") < 1e-3, CONCERN), otherwise=NOTE))
    flagged = F.col("severity") > 0
    return g.withColumn("reading", F.when(flagged, reading)).withColumn("tail", F.when(flagged, tail))


def outcome_overlap(reported: DataFrame, registry: DataFrame) -> DataFrame:
    """T2 over reported(nct_id, outcome) and registry(nct_id, measure): best overlap of words of a reported outcome; below 0.4 it isn't the registered one."""
    words = lambda c: F.array_distinct(F.filter(F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0)), lambda x: F.length(x) > 2))
    a = reported.select("nct_id", "outcome", words("outcome").alias("a"))
    b = registry.select("nct_id", words("measure").alias("b"))
    least = F.least(F.size("a"), F.size("b"))
    m = a.join(b, "nct_id").withColumn("overlap", F.when(least > 0, F.size(F.array_intersect("a", "b")) / least).otherwise(0.0))
    g = m.groupBy("nct_id", "outcome").agg(F.max("overlap").alias("best"))
    return g.withColumn("severity", ladder((F.col("best") < 0.4, SUSPICIOUS)))


def unregistered(claimed: DataFrame, registry: DataFrame) -> DataFrame:
    """Claimed identifiers that the registry doesn't have."""
    return claimed.join(registry.select("nct_id").distinct(), "nct_id", "left_anti").withColumn("severity", F.lit(SUSPICIOUS).cast("int"))
