"""Statistics of whole texts as column expressions; a null text counts as empty."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SPACE = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once a row."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE, -1), lambda w: w != "")


def chars_in(text: Column, negated_class: str) -> Column:
    """Characters of a class, given the pattern of what to leave out."""
    return F.length(F.regexp_replace(text, negated_class, ""))


def dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(NOT_SPACE))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def repeat_words(ws: Column, width: int = 8) -> Column:
    """Words inside windows of ``width`` words that occur twice or more in the text, the first included.

    Windows are compared by 64-bit hash, sorted with their places; each repeated
    one adds the words that the one before it doesn't cover.
    """

    def covered(pairs: Column) -> Column:
        same = lambda i, j: pairs[i]["h"] == pairs[j]["h"]
        twice = F.filter(pairs, lambda p, i: ((i > 0) & same(F.greatest(i - 1, F.lit(0)), i)) | ((i < F.size(pairs) - 1) & same(F.least(i + 1, F.size(pairs) - 1), i)))
        places = F.array_sort(F.transform(twice, lambda p: p["i"]))
        start = F.struct(F.lit(0).alias("n"), F.lit(-width).alias("last"))
        return F.aggregate(places, start, lambda a, i: F.struct((a["n"] + F.least(F.lit(width), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])

    hashes = F.transform(ws, lambda w: F.xxhash64(w))
    windows = let(hashes, lambda h: F.when(F.size(h) >= width, F.transform(F.sequence(F.lit(1), F.greatest(F.size(h) - (width - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(h, i, width)))).otherwise(F.array().cast("array<bigint>")))
    pairs = lambda w: F.array_sort(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.cast("int").alias("i"))))
    return let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(let(pairs(w), covered)))


def stutter(ws: Column) -> Column:
    """Words that equal the word before them."""
    return F.size(F.filter(ws, lambda w, i: (i > 0) & (w == ws[F.greatest(i - 1, F.lit(0))])))


def base_counts(text: Column) -> dict[str, Column]:
    """Struct of n words, r words in repeated windows and s words like the one before; and word_chars, n_symbols and n_dup_lines."""
    text = F.coalesce(text, F.lit(""))
    both = let(words(text), lambda w: F.struct(F.size(w).alias("n"), repeat_words(w).alias("r"), stutter(w).alias("s")))
    return {
        "__words": both,
        "word_chars": F.length(F.regexp_replace(text, SPACE, "")).cast("long"),
        "n_symbols": chars_in(text, r"[^#*$%&|<>]+").cast("long"),
        "n_dup_lines": dup_lines(text).cast("long"),
    }
