"""Queries of the numeric detectors: each supplier's lines are a file, its numeric columns the cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemark.operators import numeric as N
from sievemark.sources.tables import table

ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_shipdate"]
COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _cells(spark: SparkSession, sf_dir: str, columns: list[str] = COLUMNS) -> DataFrame:
    return N.cells(table(spark, sf_dir, "lineitem"), F.col("l_suppkey"), ORDER, columns)


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def a1_terminal_digit(spark, sf_dir):
    return _rounded(N.terminal_digit(_cells(spark, sf_dir)), "chi2", "cramers_v")


def a1_lag1(spark, sf_dir):
    return _rounded(N.lag1_digits(_cells(spark, sf_dir)), "z")


def a1_joint_entropy(spark, sf_dir):
    return _rounded(N.joint_entropy(_cells(spark, sf_dir)), "mean_h").select("file_id", "cols", "n_rows", "mean_h")


def a2_benford(spark, sf_dir):
    return _rounded(N.benford(_cells(spark, sf_dir)), "chi2")


def a2_segments(spark, sf_dir):
    return _rounded(N.benford_segments(_cells(spark, sf_dir)), "mean_chi2", "var_chi2", digits=4)


def _related(spark, sf_dir):
    """Lines with columns that are functions of others for every third supplier."""
    odd = F.col("l_suppkey") % 3 == 0
    return table(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity", "l_extendedprice", "l_tax", F.when(odd, F.col("l_quantity") + 7.5).otherwise(F.col("l_discount")).alias("shifted"), F.when(odd, F.col("l_extendedprice") * 0.25).otherwise(F.col("l_discount")).alias("scaled"))


def a3_constant_difference(spark, sf_dir):
    found = N.column_pairs(_related(spark, sf_dir), "l_suppkey", ["l_quantity", "l_extendedprice", "l_tax", "shifted", "scaled"])
    return _rounded(found.where("kind = 'difference'"), "centre", "share").select("file_id", "a", "b", "n", "centre", "share", "severity")


def a3_constant_ratio(spark, sf_dir):
    found = N.column_pairs(_related(spark, sf_dir), "l_suppkey", ["l_quantity", "l_extendedprice", "l_tax", "shifted", "scaled"])
    return _rounded(found.where("kind = 'ratio'"), "centre", "share").select("file_id", "a", "b", "n", "centre", "share", "severity")


def a3_multivariate(spark, sf_dir):
    found = N.multivariate(_related(spark, sf_dir), "l_suppkey", ["l_quantity", "l_extendedprice", "l_tax", "shifted", "scaled"])
    return _rounded(found, "r2", digits=4).select("file_id", "col", "n", "r2", "severity")


def a5_decimal_consistency(spark, sf_dir):
    return _rounded(N.decimal_consistency(_cells(spark, sf_dir)), "unique_ratio", "top_ratio")


def a6_implausible(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", *ORDER, (F.col("l_quantity") * 3).alias("age"), (F.col("l_discount") * 1100).alias("zero_percent"), F.when(F.col("l_linenumber") == 7, 999.0).otherwise(F.col("l_extendedprice") / 190).alias("weight_kg"), F.col("l_tax").alias("p_value"))
    return N.implausible(N.cells(lines, F.col("l_suppkey"), ORDER, ["age", "zero_percent", "weight_kg", "p_value"]))


def a7_zero_five(spark, sf_dir):
    return _rounded(N.zero_five(_cells(spark, sf_dir)), "ratio", "p_value").select("file_id", "col", "n", "hits", "ratio", "more", "p_value", "severity")


def d1_block_variance(spark, sf_dir):
    return _rounded(N.block_variance(_cells(spark, sf_dir)), "rel_std")


def d1_hurst(spark, sf_dir):
    return _rounded(N.hurst(_cells(spark, sf_dir)), "hurst", digits=4)


def d2_missing_pattern(spark, sf_dir):
    return _rounded(N.missing_pattern(table(spark, sf_dir, "lineitem"), "l_suppkey", COLUMNS), "cv")


def e1_icc(spark, sf_dir):
    values = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("file_id"), (F.col("l_orderkey") % 20).alias("subject_id"), F.col("l_quantity").alias("value"))
    return _rounded(N.icc(values), "icc")


QUERIES = {f.__name__: f for f in (a1_terminal_digit, a1_lag1, a1_joint_entropy, a2_benford, a2_segments, a3_constant_difference, a3_constant_ratio, a3_multivariate, a5_decimal_consistency, a6_implausible, a7_zero_five, d1_block_variance, d1_hurst, d2_missing_pattern, e1_icc)}

_BY = "l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_shipdate"


def _cells_sql(columns=tuple((c, c) for c in COLUMNS)) -> str:
    parts = " union all ".join(f"select cast(l_suppkey as varchar) as file_id, '{name}' as col, row_number() over (partition by l_suppkey order by {_BY}) as rn, cast({e} as double) as val from lineitem where {e} is not null" for name, e in columns)
    return f"cells as ({parts})"


_DIGIT = r"cast(right(regexp_replace(regexp_replace(cast(val as varchar), '0+$', ''), '\.$', ''), 1) as int)"
_FIRST = "try_cast(regexp_extract(cast(abs(val) as varchar), '[1-9]') as int)"


def _severity(chi2: str, cuts) -> str:
    return f"case when {chi2} < {cuts[0]} then 0 when {chi2} < {cuts[1]} then case when n < 50 then 1 else 2 end when {chi2} < {cuts[2]} then case when n < 50 then 1 else 3 end else case when n < 50 then 1 else 4 end end"


_BENFORD = f"""{_cells_sql()}, d as (select file_id, col, rn, val, {_FIRST} as d from cells where val <> 0),
    ex as (select d, log10(1 + 1.0 / d) as e from range(1, 10) t(d)),
    g as (select file_id, col, count(*) as n from d group by all
          having count(*) >= 10 and count_if(val > 0) >= 2 and log10(max(case when val > 0 then val end) / min(case when val > 0 then val end)) >= 2),
    chi as (select g.file_id, g.col, g.n, sum(pow(coalesce(k, 0) - g.n * e, 2) / (g.n * e)) as chi2
            from g cross join ex left join (select file_id, col, d, count(*) as k from d group by all) c on c.file_id = g.file_id and c.col = g.col and c.d = ex.d group by all)"""

_PAIRS = """rel as (select cast(l_suppkey as varchar) as file_id, l_quantity, l_extendedprice, l_tax,
        case when l_suppkey % 3 = 0 then l_quantity + 7.5 else l_discount end as shifted, case when l_suppkey % 3 = 0 then l_extendedprice * 0.25 else l_discount end as scaled from lineitem),
    names as (select unnest(['l_quantity', 'l_extendedprice', 'l_tax', 'shifted', 'scaled']) as c, unnest([1, 2, 3, 4, 5]) as k),
    long as (select row_number() over () as r, * from rel),
    p as (select file_id, x.c as a, y.c as b,
                 case x.k when 1 then l_quantity when 2 then l_extendedprice when 3 then l_tax when 4 then shifted else scaled end as x,
                 case y.k when 1 then l_quantity when 2 then l_extendedprice when 3 then l_tax when 4 then shifted else scaled end as y
          from long, names x, names y where x.k < y.k),
    q as (select *, x - y as d, case when abs(y) > 1e-12 then x / y end as r from p where x is not null and y is not null),
    m as (select file_id, a, b, count(*) as n, avg(x) as mx, avg(d) as md, stddev_samp(d) as sd, avg(r) as mr, stddev_samp(r) as sr, min(abs(y)) as least from q group by all having count(*) >= 10)"""

ORACLE_SQL = {
    "a1_terminal_digit": f"""with {_cells_sql()}, d as (select file_id, col, {_DIGIT} as d, count(*) as k from cells group by all),
        g as (select file_id, col, sum(k) as n, sum(k * k) * 10.0 / sum(k) - sum(k) as chi2 from d group by all having sum(k) >= 10)
        select file_id, col, cast(n as bigint) as n, round(chi2, 6) as chi2, round(sqrt(greatest(chi2, 0) / (9 * n)), 6) as cramers_v, cast({_severity('chi2', (21.665994, 44.810938, 97.29))} as int) as severity from g""",
    "a1_lag1": f"""with {_cells_sql()}, d as (select file_id, col, rn, {_DIGIT} as d from cells),
        l as (select *, lag(d) over (partition by file_id, col order by rn) as p from d),
        g as (select file_id, col, count(*) as n, count_if(d = p) as matches from l group by all having count(*) >= 50),
        z as (select *, (matches - (n - 1) * 0.1) / sqrt((n - 1) * 0.09) as z from g)
        select file_id, col, n, cast(matches as bigint) as matches, round(z, 6) as z, cast(case when abs(z) > 3.890592 then 3 when abs(z) > 2.575829 then 2 else 0 end as int) as severity from z""",
    "a1_joint_entropy": f"""with {_cells_sql()}, d as (select file_id, col, rn, {_DIGIT} as d from cells),
        f as (select file_id, rn, d, count(*) as k, 4.0 as c from d group by all),
        h as (select file_id, rn, sum(-(k / c) * log2(k / c)) as h from f group by all)
        select file_id, cast(4 as bigint) as cols, cast(count(*) as int) as n_rows, round(avg(h), 6) as mean_h from h group by file_id having count(*) >= 30""",
    "a2_benford": f"with {_BENFORD} select file_id, col, n, round(chi2, 6) as chi2, cast({_severity('chi2', (20.090235, 42.700914, 94.54))} as int) as severity from chi",
    "a2_segments": f"""with {_BENFORD}, bad as (select * from chi where chi2 >= 20.090235 and n >= 45),
        s as (select d.file_id, d.col, d.d, least((row_number() over (partition by d.file_id, d.col order by rn) - 1) // (bad.n // 3), 2) as seg from d join bad on d.file_id = bad.file_id and d.col = bad.col),
        sn as (select file_id, col, seg, count(*) as n from s group by all),
        sc as (select sn.file_id, sn.col, sn.seg, sum(pow(coalesce(k, 0) - sn.n * e, 2) / (sn.n * e)) as chi2 from sn cross join ex
               left join (select file_id, col, seg, d, count(*) as k from s group by all) c on c.file_id = sn.file_id and c.col = sn.col and c.seg = sn.seg and c.d = ex.d group by all),
        gs as (select file_id, col, avg(chi2) as m, var_samp(chi2) as v from sc group by all)
        select file_id, col, round(m, 4) as mean_chi2, round(v, 4) as var_chi2, cast(case when v < 0.5 and m > 5 then 2 else 0 end as int) as severity from gs""",
    "a3_constant_difference": f"""with {_PAIRS}, s as (select m.file_id, m.a, m.b, m.n, m.md, avg(cast(abs(q.d - m.md) < 1e-9 as int)) as share from m join q on q.file_id = m.file_id and q.a = m.a and q.b = m.b
            where m.sd < greatest(1e-9, 1e-3 * greatest(abs(md), abs(mx), 1.0)) group by all)
        select file_id, a, b, n, round(md, 6) as centre, round(share, 6) as share, cast(case when share >= 1 then 4 when share >= 0.95 then 3 else 2 end as int) as severity from s""",
    "a3_constant_ratio": f"""with {_PAIRS}, s as (select m.file_id, m.a, m.b, m.n, m.mr, avg(cast(abs(q.r - m.mr) < 1e-9 as int)) as share from m join q on q.file_id = m.file_id and q.a = m.a and q.b = m.b
            where m.least > 1e-12 and m.sr < greatest(1e-9, 1e-3 * abs(mr)) and abs(mr - 1) > 1e-9 group by all)
        select file_id, a, b, n, round(mr, 6) as centre, round(share, 6) as share, cast(case when share >= 0.95 then 3 else 2 end as int) as severity from s""",
    # In this input a column that is linear in the others is linear in one of them.
    "a3_multivariate": f"""with {_PAIRS}, c as (select file_id, a as col, count(*) as n, regr_r2(x, y) as r2 from q group by file_id, a, b union all select file_id, b, count(*), regr_r2(y, x) from q group by file_id, a, b)
        select file_id, col, max(n) as n, round(max(r2), 4) as r2, cast(4 as int) as severity from c group by all having max(n) >= 20 and max(r2) >= 0.999""",
    "a5_decimal_consistency": rf"""with {_cells_sql()}, f as (select file_id, col, val, case when p = '' then '0' else p end as f
            from (select *, regexp_replace(split_part(cast(val as varchar), '.', 2), '0+$', '') as p from cells)),
        k as (select file_id, col, f, count(*) as k, bool_and(val = floor(val)) as whole from f group by all),
        g as (select file_id, col, sum(k) as n, count(*) as n_unique, max(k) as top, bool_and(whole) as whole from k group by all having sum(k) >= 20)
        select file_id, col, cast(n as bigint) as n, n_unique, cast(top as bigint) as top, round(n_unique / n, 6) as unique_ratio, round(top / n, 6) as top_ratio,
               cast(case when top / n >= 1 then 4 when top / n >= 0.5 then 3 when n_unique / n < 0.15 then 2 else 0 end as int) as severity from g where not whole and n_unique / n <= 0.3""",
    "a6_implausible": f"""with {_cells_sql((("age", "l_quantity * 3"), ("zero_percent", "l_discount * 1100"), ("weight_kg", "(case when l_linenumber = 7 then 999.0 else l_extendedprice / 190 end)"), ("p_value", "l_tax")))},
        r as (select * from (values ('age', 0, 130, 'age'), ('zero_percent', 0, 100, 'percentage'), ('weight_kg', 0, 500, 'weight'), ('p_value', 0, 1, 'p-value')) t(col, lo, hi, rule)),
        g as (select file_id, c.col, rule, count(*) as n, count_if(val in (999, -999, 9999, -9999, 99999, 88888, 77777) or abs(val) >= 1e10) as s, count_if(val < lo or val > hi) as o from cells c join r on c.col = r.col group by all)
        select file_id, col, n, 'sentinel' as rule, cast(s as bigint) as n_hit, cast(2 as int) as severity from g where s > 0
        union all select file_id, col, n, rule, cast(o as bigint), cast(case when o / n >= 0.05 then 2 else 1 end as int) from g where o > 0""",
    "a7_zero_five": f"""with {_cells_sql()}, g as (select file_id, col, count(*) as n, cast(count_if({_DIGIT} in (0, 5)) as bigint) as hits from cells group by all having count(*) >= 10),
        s as (select *, hits / n >= 0.2 as more from g),
        t as (select file_id, col, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.2) + (n - i) * ln(0.8))) as p from (select *, unnest(case when more then range(hits, n + 1) else range(hits + 1) end) as i from s) group by all)
        select s.file_id, s.col, n, cast(hits as bigint) as hits, round(hits / n, 6) as ratio, more, round(least(1, p), 6) as p_value, cast(case when p > 0.005 then 0 when n < 50 then 1 when p < 1e-15 then 4 when p < 1e-5 then 3 else 2 end as int) as severity from s join t on t.file_id = s.file_id and t.col = s.col""",
    "d1_block_variance": f"""with {_cells_sql()}, g as (select file_id, col, count(*) as n, count(distinct val) as u from cells group by all having count(*) >= 30 and stddev_samp(val) > 0),
        st as (select file_id, col, max(step) = min(step) as even from (select *, val - lag(val) over (partition by file_id, col order by rn) as step from cells) group by all),
        b as (select c.file_id, c.col, g.n, (rn - 1) // (g.n // greatest(3, g.n // 10)) as block, greatest(3, g.n // 10) as nb, var_samp(val) as v
              from cells c join g on c.file_id = g.file_id and c.col = g.col join st on st.file_id = g.file_id and st.col = g.col
              where not (even and u = n) and g.n // greatest(3, g.n // 10) >= 5 and (rn - 1) // (g.n // greatest(3, g.n // 10)) < greatest(3, g.n // 10) group by all),
        r as (select file_id, col, max(n) as n, count(*) as n_blocks, stddev_samp(v) / nullif(avg(v), 0) as rel from b group by all)
        select file_id, col, n, n_blocks, round(rel, 6) as rel_std, cast(case when rel >= 0.05 then 0 when rel < 0.005 then 4 when rel < 0.02 then 3 else 2 end as int) as severity from r where rel is not null""",
    "d1_hurst": f"""with {_cells_sql()}, n as (select file_id, col, count(*) as n from cells group by all), sz as (select unnest([16, 32, 64, 128, 256, 512]) as size),
        d as (select c.file_id, c.col, size, (rn - 1) // size as chunk, rn, val from cells c join n on c.file_id = n.file_id and c.col = n.col cross join sz where n >= 20 and size <= n // 2 and rn - 1 < (n // size) * size),
        m as (select *, val - avg(val) over (partition by file_id, col, size, chunk) as dev from d),
        cu as (select *, sum(dev) over (partition by file_id, col, size, chunk order by rn rows unbounded preceding) as cum from m),
        r as (select file_id, col, size, chunk, max(cum) - min(cum) as r, stddev_samp(val) as s from cu group by all having stddev_samp(val) > 0),
        q as (select file_id, col, size, avg(r / s) as rs from r group by all),
        h as (select file_id, col, count(*) as k, regr_slope(ln(rs), ln(size)) as slope from q group by all)
        select n.file_id, n.col, n.n, round(case when k >= 2 then slope else 0.5 end, 4) as hurst from n left join h on h.file_id = n.file_id and h.col = n.col""",
    "d2_missing_pattern": """with g as (select cast(l_suppkey as varchar) as file_id, count(*) as n, [stddev_samp(l_quantity), stddev_samp(l_extendedprice), stddev_samp(l_discount), stddev_samp(l_tax)] as sds
            from lineitem group by l_suppkey having count(*) >= 50 and count_if(l_quantity is null or l_extendedprice is null or l_discount is null or l_tax is null) = 0)
        select file_id, n, round(list_stddev_samp(sds) / nullif(list_avg(sds), 0), 6) as cv, cast(1 as int) as severity from g""",
    "e1_icc": """with g as (select cast(l_suppkey as varchar) as file_id, l_orderkey % 20 as s, count(*) as k, avg(l_quantity) as m, var_samp(l_quantity) as v from lineitem where l_quantity is not null group by all having count(*) >= 2),
        t as (select file_id, count(*) as n_subjects, sum(k) as n, sum(k * m) / sum(k) as gm, sum((k - 1) * v) as ssw, round_even(avg(k), 0) as k0 from g group by all having count(*) >= 5),
        b as (select t.file_id, n_subjects, n, ssw / (n - n_subjects) as msw, k0, sum(k * pow(m - gm, 2)) / (n_subjects - 1) as msb from t join g on g.file_id = t.file_id where k0 >= 3 group by t.file_id, n_subjects, n, ssw, k0),
        i as (select *, (msb - msw) / nullif(msb + (k0 - 1) * msw, 0) as icc from b)
        select file_id, n_subjects, cast(n as bigint) as n, round(icc, 6) as icc, cast(case when icc >= 0.05 then 0 when icc < 0.01 then 4 when icc is not null then 3 else 0 end as int) as severity from i""",
}
