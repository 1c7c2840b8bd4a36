"""Severity ladders as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PASS, NOTE, CONCERN, SUSPICIOUS, CRITICAL = range(5)
LABELS = ("PASS", "NOTE", "CONCERN", "SUSPICIOUS", "CRITICAL")


def ladder(*steps: tuple[Column, int], otherwise: int = PASS) -> Column:
    """Severity of the first condition that holds."""
    out = None
    for condition, severity in steps:
        out = F.when(condition, F.lit(severity)) if out is None else out.when(condition, F.lit(severity))
    return out.otherwise(F.lit(otherwise)).cast("int")


def weakened(severity: Column, n: Column, least: int = 50) -> Column:
    """A finding from fewer than `least` values is no more than a note."""
    return F.when((severity > NOTE) & (n < least), F.lit(NOTE)).otherwise(severity).cast("int")


def label(severity: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, LABELS)), severity + 1)
