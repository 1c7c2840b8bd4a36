"""Tokens, shingles, phrases and set similarities as expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, also where body uses it within a lambda of its own."""
    return F.element_at(F.transform(F.array(value), body), 1)


def runs(words: Column, n: int) -> Column:
    """Runs of n words, repeats included; none of fewer words."""
    none = F.array().cast("array<string>")
    return let(words, lambda w: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.concat_ws(" ", *[F.get(w, i + k) for k in range(n)]))).otherwise(none))


def shingles(words: Column, n: int) -> Column:
    """Distinct runs of n words; none of fewer words."""
    return F.array_distinct(runs(words, n))


def phrase_pattern(phrase: str, loose: bool) -> str:
    """A phrase as a pattern between word boundaries, without regard to case; loose: any white space between words."""
    body = re.escape(phrase).replace("\\ ", r"\s+" if loose else " ").replace("\\-", "-").replace("\\'", "'")
    return rf"(?i)\b{body}\b"


def letter_words(text: Column) -> Column:
    """Distinct runs of the letters a-z, without regard to case."""
    return F.array_distinct(F.split(F.lower(text), "[^a-z]+"))


def phrase_counts(text: Column, words: Column, phrases: tuple[str, ...], loose: bool) -> Column:
    """array of (phrase, n) of the phrases that the text has; words: its letter_words().

    One hash look-up of the phrases' longest words among the text's tells which phrases can occur at
    all; only their patterns are counted.
    """
    key = {p: max(re.findall("[a-z]+", p.lower()), key=len) for p in phrases}
    there = F.array_intersect(words, F.array(*map(F.lit, dict.fromkeys(key.values()))))
    listed = F.array(*[F.struct(F.lit(p).alias("phrase"), F.lit(k).alias("key"), F.lit(phrase_pattern(p, loose)).alias("pattern")) for p, k in key.items()])
    none = F.array().cast("array<struct<phrase:string,n:int>>")

    def counted(keys: Column) -> Column:
        found = F.transform(F.filter(listed, lambda x: F.array_contains(keys, x["key"])), lambda x: F.struct(x["phrase"].alias("phrase"), F.regexp_count(text, x["pattern"]).alias("n")))
        return F.when(F.size(keys) > 0, F.filter(found, lambda x: x["n"] > 0)).otherwise(none)

    return let(there, counted)


def contexts(text: Column, pattern: str, reach: int = 40) -> Column:
    """array of (position, match, context) of the pattern's matches in order: each with up to `reach` characters on either side."""
    at = F.transform(F.regexp_extract_all(text, F.lit(f"(?s)(.*?)({pattern})"), F.lit(1)), lambda x: F.length(x))
    found = F.regexp_extract_all(text, F.lit(f"(?s)(.*?)({pattern})"), F.lit(2))
    both = F.arrays_zip(at.alias("gap"), found.alias("match"))
    start = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<position:int,match:string,context:string>>").alias("out"))

    def add(acc: Column, x: Column) -> Column:
        position = acc["end"] + x["gap"]
        low = F.greatest(position - reach, F.lit(0))
        context = F.substring(text, low + 1, position + F.length(x["match"]) + reach - low)
        return F.struct((position + F.length(x["match"])).alias("end"), F.array_append(acc["out"], F.struct(position.alias("position"), x["match"].alias("match"), context.alias("context"))).alias("out"))

    return F.aggregate(both, start, add, lambda acc: acc["out"])


def sentences(text: Column) -> Column:
    return F.split(text, r"(?<=[.!?])\s+")


def packed_segments(text: Column, limit: int) -> Column:
    """Sentences joined greedily into segments of `limit` characters at most; a longer sentence is a segment of its own."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc: Column, s: Column) -> Column:
        fits = F.length(acc["open"]) + F.length(s) + 1 <= limit
        return F.when(acc["open"] == "", F.struct(acc["done"].alias("done"), s.alias("open"))).when(fits, F.struct(acc["done"].alias("done"), F.concat_ws(" ", acc["open"], s).alias("open"))).otherwise(F.struct(F.array_append(acc["done"], acc["open"]).alias("done"), s.alias("open")))

    return F.aggregate(sentences(text), start, step, lambda acc: F.filter(F.array_append(acc["done"], acc["open"]), lambda x: x != ""))


def strip_markup(text: Column) -> Column:
    """Super- and subscript tags vanish, other tags become a space, then entities are decoded and white space collapsed: in this order."""
    from sievemark.functions.entities import unescape

    plain = F.regexp_replace(F.regexp_replace(text, r"(?i)</?(?:sup|sub)\b[^>]*>", ""), "<[^>]+>", " ")
    return F.trim(F.regexp_replace(F.when(plain.contains("&"), unescape(plain)).otherwise(plain), r"\s+", " "))
