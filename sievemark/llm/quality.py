"""Quality rules, line first, in DataFrame functions only.

Each line of a text is held against rules for punctuation, navigation and boilerplate. Lines that fail
are removed; a document that loses more than a given share of its characters is rejected, and so is one
that fails the basic counts (too few words, or mostly repeated three-word windows). All of it is computed
within the row: nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemark.functions.text import let
from sievemark.llm.common import own_name

MIN_WORDS = 50
#: Percent of words in windows found twice or more, above which a document fails.
MAX_REPEATED = 50
#: Share of the characters of non-blank lines that a document may lose.
MAX_LOST = 0.5
_SPACE = " \t\n\x0b\f\r"
_SYMBOLS = "#*$%&|<>"
_MARKS = _SYMBOLS + "!{}[]=~^\\"
_NAVIGATION = "|»›·•"
#: Marks of a line per word, above which it is no prose.
MARKS_PER_WORD = 0.3
# Phrases of boilerplate lines, in lower case.
BOILERPLATE = (
    "all rights reserved",
    "licensed under",
    "terms of use",
    "terms of service",
    "privacy policy",
    "cookie policy",
    "use cookies",
    "enable javascript",
    "javascript is disabled",
    "sign up for our newsletter",
    "click here",
    "share this",
    "powered by",
    "lorem ipsum",
    "without warranty",
    "warranties or conditions",
    "redistribution and use",
    "permission is hereby granted",
    "spdx-license-identifier",
    "copyright (c)",
)
_ENDS = "[.!?:;…。！？][\"'’”»)\\]]*$"


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda a, x: a + x)


def _boilerplate(lower: Column) -> Column:
    found = F.lit(False)
    for phrase in BOILERPLATE:
        found = found | F.contains(lower, F.lit(phrase))
    return found


def _line(line: Column) -> Column:
    """What the rules need of a line: computed once, as expressions within a lambda aren't shared."""
    bare = _without(line, _MARKS + _NAVIGATION)
    return F.struct(
        line.alias("line"),
        F.length(line).alias("size"),
        (F.length(line) - F.length(bare)).alias("signs"),
        F.size(F.array_remove(F.split(line, " "), "")).alias("n"),
    )


def line_fails(x: Column, suspect: Column) -> Column:
    """Whether a line, as _line() gives it, is to be removed; suspect: whether its text has a phrase of boilerplate at all."""
    line, n = x["line"], x["n"]
    count = lambda characters: F.when(x["signs"] > 0, x["size"] - F.length(_without(line, characters))).otherwise(0)
    shouted = (n >= 3) & ~line.rlike("[a-z]") & (line == F.upper(line)) & (line != F.lower(line))
    navigation = (x["signs"] >= 2) & (count(_NAVIGATION) >= F.greatest(F.lit(2), n * 0.2))
    punctuation = ((x["signs"] > n * MARKS_PER_WORD + 1) & (count(_MARKS) > n * MARKS_PER_WORD + 1)) | ((n < 4) & ~line.rlike(_ENDS))
    return punctuation | navigation | shouted | (suspect & _boilerplate(F.lower(line)))


def _windows(w: Column) -> Column:
    """64-bit hashes of the three-word windows of w; they are only compared within a text."""
    return F.slice(F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))), 1, F.greatest(F.size(w) - 2, F.lit(0)))


def judged(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lost_chars, base_failed, kept and clean_text.

    A null text has no words and no lines: its counts are 0, base_failed is true, kept false, clean_text
    empty. Rows are judged one by one, so repeats and ties don't matter; an empty table gives no rows.
    Columns of docs that have one of these names are replaced, all others stay. Windows are found again
    by their hashes, and where two of one hash have other words, by their words.
    """
    taken = docs.columns
    t, w, h, o, p, lines, j, total = (own_name(x, taken) for x in ("text_", "words_", "hashes_", "ordered_", "places_", "lines_", "judged_", "total_"))
    step = docs.withColumn(t, F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    step = step.withColumn(w, F.array_remove(F.split(F.translate(t, _SPACE[1:], " " * 5), " "), ""))
    step = step.withColumn(h, _windows(F.col(w)))
    place = lambda x, i: F.struct(x.alias("h"), i.alias("i"))
    step = step.withColumn(o, F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(F.transform(h, place))))
    word = lambda i, k: F.get(F.col(w), i + k)
    alike = lambda a, b: (word(a, 0) == word(b, 0)) & (word(a, 1) == word(b, 1)) & (word(a, 2) == word(b, 2))
    mixed = F.exists(F.transform(o, lambda x, k: F.struct(x.alias("x"), F.get(F.col(o), k + 1).alias("y"))), lambda q: F.coalesce((q["x"]["h"] == q["y"]["h"]) & ~alike(q["x"]["i"], q["y"]["i"]), F.lit(False)))
    by_words = F.transform(F.sort_array(F.transform(h, lambda x, i: F.struct(word(i, 0).alias("a"), word(i, 1).alias("b"), word(i, 2).alias("c"), i.alias("i")))), lambda x: F.struct(F.sha2(F.concat_ws(" ", x["a"], x["b"], x["c"]), 256).alias("h"), x["i"].alias("i")))
    again = lambda of: F.array_compact(F.transform(of, lambda x, k: F.when((x["h"] == F.get(of, k - 1)["h"]) | (x["h"] == F.get(of, k + 1)["h"]), x["i"])))
    step = step.withColumn(p, F.sort_array(F.when(F.col(o).isNull(), F.lit(None)).when(mixed, again(by_words)).otherwise(again(F.col(o)))))
    covered = F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(F.col(p), k + 1) - x, F.lit(3))).cast("long"))
    step = step.withColumn(lines, F.filter(F.split(t, "\n"), lambda x: F.length(F.btrim(x, F.lit(_SPACE))) > 0))
    shown = F.transform(F.transform(lines, lambda x: F.btrim(x, F.lit(_SPACE))), _line)
    judge = lambda suspect: F.transform(shown, lambda x: F.struct(x["line"].alias("line"), x["size"].cast("long").alias("size"), line_fails(x, suspect).alias("fails")))
    step = step.withColumn(j, let(_boilerplate(F.lower(t)), judge))
    lost = _sum(F.transform(j, lambda x: F.when(x["fails"], x["size"]).otherwise(0)))
    rest = F.transform(F.filter(j, lambda x: ~x["fails"]), lambda x: x["line"])
    step = step.withColumns(
        {
            "n_words": F.size(w).cast("long"),
            "word_chars": F.length(_without(F.col(t), _SPACE)).cast("long"),
            "n_symbols": (F.length(t) - F.length(_without(F.col(t), _SYMBOLS))).cast("long"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            "n_repeat_words": F.coalesce(_sum(covered), F.lit(0).cast("long")),
            "lost_chars": lost,
            total: _sum(F.transform(j, lambda x: x["size"])),
            "clean_text": F.array_join(rest, "\n"),
        }
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    step = step.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("lost_chars") <= F.col(total) * MAX_LOST))
    return step.drop(t, w, h, o, p, lines, j, total)


def cleaned(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that are kept, without their failing lines; columns stay as they are."""
    names = docs.columns
    return judged(docs, text_col).where("kept").withColumn(text_col, F.col("clean_text")).select(names)
