"""Baseline tables of trials: from cells (table_id, page_text, row, cells array) to arms with n, mean and sd."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What tells a baseline table, an arm, and how its numbers are written.
TABLE_WORDS = r"(?i)(baseline|characteristics|demographics|study\s+population|table\s+s?1|table\s+i\b)"
ARM_WORDS = r"(?i)(treatment|control|placebo|intervention|active|arm|group|comparator|sham|usual\s+care)"
MEAN_SD = r"(-?\d+\.?\d*)\s*(?:±|\+/?\-|\(|\[)\s*(\d+\.?\d*)\s*[\)\]]?"
HEADER_N = r"[Nn]\s*=\s*(\d+)"
SHARE = r"(\d+)\s*\(\s*(\d+\.?\d*)\s*%\s*\)"


def _baseline_rows(cells: DataFrame) -> DataFrame:
    """The rows of baseline tables below their header: table_id, variable, cells, head, and the page's numbers of subjects."""
    head = cells.where("row = 0").select("table_id", F.col("cells").alias("head"), F.coalesce("page_text", F.lit("")).alias("page"))
    body = cells.where("row > 0").join(head, "table_id")
    title = F.concat_ws(" ", "head", "page")
    continuous = F.size(F.regexp_extract_all(F.array_join("cells", " "), F.lit(MEAN_SD), F.lit(0)))
    likely = body.groupBy("table_id").agg(F.max(title.rlike(TABLE_WORDS)).alias("named"), F.max(F.array_join("head", " ").rlike(ARM_WORDS)).alias("armed"), F.sum(continuous).alias("k")).where("named or (armed and k >= 3)").select("table_id")
    rows = body.join(likely, "table_id", "left_semi").withColumn("variable", F.trim(F.get("cells", F.lit(0)))).where("variable <> ''")
    return rows.select("table_id", "variable", "cells", "head", F.regexp_extract_all("page", F.lit(r"\b" + HEADER_N), F.lit(1)).alias("counts"))


def _later_cells(of):
    return F.transform(F.slice("cells", 2, F.greatest(F.size("cells") - 1, F.lit(0))), lambda c, i: of(c, i + 1))


def baseline_arms(cells: DataFrame, default_n: tuple[int, ...] = ()) -> DataFrame:
    """table_id, variable, arms (arm, n, mean, sd) of the continuous rows of baseline tables; row 0 is the header.

    Numbers of subjects come from the header's cells, else from the page's text in order, else from
    default_n; arms of fewer than two subjects are left out, and so are rows of counts with percentages.
    """
    given = F.array(*[F.lit(str(n)) for n in default_n]).cast("array<string>")

    def arm(cell, i):
        own = F.regexp_extract(F.get("head", i), HEADER_N, 1)
        n = F.coalesce(F.when(own != "", own), F.get("counts", i - 1), F.get(given, i - 1), F.lit("0")).try_cast("int")
        part = lambda g: F.when(~cell.rlike(SHARE), F.regexp_extract(cell, MEAN_SD, g)).try_cast("double")
        return F.struct(F.get("head", i).alias("arm"), n.alias("n"), part(1).alias("mean"), part(2).alias("sd"))

    arms = F.filter(_later_cells(arm), lambda a: a["mean"].isNotNull() & a["sd"].isNotNull() & (a["n"] >= 2))
    return _baseline_rows(cells).select("table_id", "variable", arms.alias("arms")).where("size(arms) >= 2")


def baseline_shares(cells: DataFrame) -> DataFrame:
    """table_id, variable, arms (arm, count, percent) of the rows of counts with percentages of baseline tables, of two arms or more."""

    def arm(cell, i):
        part = lambda g: F.regexp_extract(cell, SHARE, g)
        return F.struct(F.get("head", i).alias("arm"), part(1).try_cast("long").alias("count"), part(2).try_cast("double").alias("percent"))

    arms = F.filter(_later_cells(arm), lambda a: a["count"].isNotNull() & a["percent"].isNotNull())
    return _baseline_rows(cells).select("table_id", "variable", arms.alias("arms")).where("size(arms) >= 2")
