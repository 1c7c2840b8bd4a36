"""The shortest decimal text of a double, and digits read from it; all within code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number_text(value: Column) -> Column:
    """Positional text for magnitudes in [1e-4, 1e16), scientific text beyond: 12345678.5, 0.0001, 1e+16, 1e-05."""
    v = value.cast("double")
    size, text = F.abs(v), v.cast("string")
    positional = F.regexp_replace(v.cast("decimal(38,20)").cast("string"), "(\\.[0-9]+?)0+$", "$1")
    mantissa = F.regexp_replace(F.regexp_extract(text, "^(-?[0-9.]+)E", 1), "\\.0$", "")
    power = F.regexp_extract(text, "E(-?[0-9]+)$", 1)
    exponent = F.concat(F.when(power.startswith("-"), "-").otherwise("+"), F.lpad(F.regexp_replace(power, "-", ""), 2, "0"))
    scientific = F.concat(mantissa, F.lit("e"), exponent)
    return F.when((size == 0) | (size >= 1e-3) & (size < 1e7) | ~text.contains("E"), text).when((size >= 1e-4) & (size < 1e16), positional).otherwise(scientific)


def last_digit(value: Column, is_int: bool = False) -> Column:
    """Last significant digit; of 2.50: 5, of 3.0: 3, of the double 100.0: 0, of the integer 100: 1."""
    if is_int:
        text = F.regexp_replace(value.cast("string"), "(?<=.)0+$", "")
        return F.right(F.when(F.regexp_replace(text, "-", "") == "", "0").otherwise(text), F.lit(1)).cast("int")
    text = number_text(value)
    whole = F.regexp_replace(text, "0+$", "")
    return F.right(F.regexp_replace(whole, "\\.$", ""), F.lit(1)).cast("int")


def first_digit(value: Column) -> Column:
    """Leading digit of the magnitude; null for 0 and what is not finite. It is the same in positional and scientific text."""
    return F.nullif(F.regexp_extract(F.abs(value.cast("double")).cast("string"), "[1-9]", 0), F.lit("")).cast("int")


def fraction_text(value: Column) -> Column:
    """Digits after the point without final zeros; "0" for none."""
    text = number_text(value)
    part = F.when(text.contains(".") & ~text.contains("e"), F.regexp_replace(F.substring_index(text, ".", -1), "0+$", "")).otherwise(F.lit(""))
    return F.when(part == "", "0").otherwise(part)


def decimal_places(value: Column) -> Column:
    """Digits after the point without final zeros."""
    part = fraction_text(value)
    return F.when(part == "0", 0).otherwise(F.length(part)).cast("int")


def safe_equal(a: Column, b: Column, relative: float = 1e-9, absolute: float = 1e-12) -> Column:
    """Whether two numbers differ by no more than either tolerance; infinities equal themselves alone."""
    return (a == b) | ((F.abs(a) < float("inf")) & (F.abs(b) < float("inf")) & (F.abs(a - b) <= F.greatest(relative * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute))))
