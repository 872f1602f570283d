"""Spelling variants of a corpus' words, by one-edit neighbourhoods over a reduced alphabet.

1. Words are counted over all texts, with partial sums before the shuffle.
2. ``reduced`` maps every letter to one of a few symbols, so that many words share a
   reduced word. Words that are one edit apart have reduced words that are equal or one
   edit apart.
3. Each distinct reduced word generates its one-edit neighbourhood, as hashes. Being
   neighbours is mutual, so of two neighbours one is generated from the other: the
   shorter from the longer (deletions, whose reverse are the insertions), and of two
   equally long ones the one with the later symbol (replacements). Together with the
   reduced word itself these are the full neighbourhoods of both.
4. The generated hashes are joined with the reduced vocabulary, and the pairs of reduced
   words that are found with the words on either side. Each pair of words is verified on
   the strings themselves: exactly one code point inserted, deleted or replaced.
5. A word's form is its most frequent near word (ties: the first in code-point order), if
   that is ``ratio`` times as frequent. Forms are followed to the last one, the root.

Hashes only propose pairs, so a collision costs a comparison and no result. Rows of a
reduced word are only joined, never gathered. A long word's neighbourhood is made in
slices of bounded size and grows with its length, not with its square.

Nulls: a null text has no words. Repeated rows count each. An empty table, or one
without frequent words, gives no rows. Only the columns that are named are read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from voxmill.llm.common import LOWER, UPPER, Scratch, mix

LETTERS = LOWER + "".join(map(chr, range(0xC0, 0x100)))
DIGITS = "0123456789"
_BASE = 0x9E3779B97F4A7C15
_SYMBOL = np.random.default_rng(23).integers(1, 2**63, len(DIGITS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def lower_ascii(word: Column) -> Column:
    """A-Z lower-cased; the quick way for words of ASCII letters."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def runs(docs: DataFrame, shortest: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, word): every maximal run of Latin letters of ``shortest`` code points or more, A-Z lower-cased."""
    pattern = F.lit(f"[A-Za-zÀ-ÿ]{{{shortest},}}")
    found = docs.select(docs[doc_id].alias("doc_id"), F.explode(F.regexp_extract_all(docs[text], pattern, F.lit(0))).alias("word"))
    return found.select("doc_id", lower_ascii(F.col("word")).alias("word"))


def vocabulary(words: DataFrame, shortest: int = 7, least: int = 2) -> DataFrame:
    """(word, n) of words of ``shortest`` code points that occur ``least`` times or more. words: word."""
    return words.where(F.char_length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def reduced(word: Column, symbols: int) -> Column:
    """The word over an alphabet of ``symbols`` digits, letters dealt out by a hash; other characters are the first digit."""
    known = F.translate(word, LETTERS, "".join(DIGITS[zlib.crc32(c.encode()) % symbols] for c in LETTERS))
    return F.regexp_replace(known, "[^0-9]", DIGITS[0])


def _powers(n: int) -> tuple[np.ndarray, np.uint64]:
    up = np.full(n + 1, _BASE, np.uint64)
    up[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.uint64(pow(_BASE, -1, 1 << 64))


def neighbourhood(codes: np.ndarray, symbols: int, room: int = 1 << 20):
    """Yields (rows, hashes): for the words of one length in ``codes``, one a row, their own hash first and then their neighbours', about ``room`` at a time."""
    m, n = codes.shape
    up, down = _powers(n)
    values = _SYMBOL[codes]
    before = np.zeros((m, n + 1), np.uint64)
    np.cumsum(values * up[:n], axis=1, out=before[:, 1:])
    whole = before[:, n]
    rows = np.arange(m)
    yield rows, mix(whole.copy())
    wide = max(1, room // max(m, 1))
    for a in range(0, n, wide):
        b = min(n, a + wide)
        again = np.repeat(rows, b - a)
        yield again, mix((before[:, a:b] + (whole[:, None] - before[:, a + 1 : b + 1]) * down).ravel())
        for t in range(1, symbols):
            later = (codes[:, a:b] < t).ravel()
            yield again[later], mix((whole[:, None] + (_SYMBOL[t] - values[:, a:b]) * up[a:b]).ravel()[later])


def neighbours(words: DataFrame, symbols: int) -> DataFrame:
    """(own, near): hashes of each reduced word and of itself and its neighbours. words: r, text of digits."""

    def run(batches):
        for batch in batches:
            by_length: dict[int, list[str]] = {}
            for r in batch.column(0).to_pylist():
                by_length.setdefault(len(r), []).append(r)
            for n, same in by_length.items():
                most = max(1, (1 << 18) // max(n, 1))
                for at in range(0, len(same), most):
                    some = same[at : at + most]
                    codes = (np.frombuffer("".join(some).encode(), np.uint8) - 48).reshape(len(some), n)
                    own = None
                    for rows, hashes in neighbourhood(codes, symbols):
                        own = hashes if own is None else own
                        yield pa.RecordBatch.from_arrays([pa.array(own[rows].view(np.int64)), pa.array(hashes.view(np.int64))], ["own", "near"])

    return words.select("r").mapInArrow(run, "own bigint, near bigint")


def named(words: DataFrame) -> DataFrame:
    """(own, r): the hash of each reduced word."""

    def run(batches):
        for batch in batches:
            made = []
            for r in batch.column(0).to_pylist():
                codes = (np.frombuffer(r.encode(), np.uint8) - 48)[None, :]
                made.append(next(neighbourhood(codes, len(DIGITS)))[1][0])
            yield pa.RecordBatch.from_arrays([pa.array(np.array(made, np.uint64).view(np.int64)), batch.column(0)], ["own", "r"])

    return words.select("r").mapInArrow(run, "own bigint, r string")


def near_pairs(vocab: DataFrame, symbols: int, scratch: Scratch) -> DataFrame:
    """(word, n, near, near_n): both ways, every pair of words of ``vocab`` (word, n) that are exactly one edit apart."""
    keyed = scratch.table(vocab.withColumn("r", reduced(F.col("word"), symbols)), "keyed")
    owns = scratch.table(named(keyed.select("r").distinct()), "owns")
    words = scratch.table(keyed.join(owns, "r").select("own", "word", "n"), "words")
    met = neighbours(owns, symbols).join(owns.select(F.col("own").alias("near")), "near").distinct()
    met = scratch.table(met, "met")
    left = met.join(words.withColumnRenamed("word", "a").withColumnRenamed("n", "a_n"), "own")
    right = words.select(F.col("own").alias("near"), F.col("word").alias("b"), F.col("n").alias("b_n"))
    one = (F.col("own") != F.col("near")) | (F.col("a") < F.col("b"))
    pairs = left.join(right, "near").where(one & (F.levenshtein("a", "b", 1) == 1))
    ways = F.array(F.struct(F.col("a").alias("word"), F.col("a_n").alias("n"), F.col("b").alias("near"), F.col("b_n").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("b_n").alias("n"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
    return pairs.select(F.inline(ways))


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root) of every word that has a form. A form is more frequent by the ratio each time, so a chain has under 64 links, and six doublings reach its end. forms: word, form."""
    now = forms.select("word", F.col("form").alias("root"))
    for turn in range(6):
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        now = scratch.table(now.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root")), f"roots{turn}")
    return now


def variants(vocab: DataFrame, ratio: int = 10, symbols: int = 8, scratch: Scratch | None = None) -> DataFrame:
    """Per word of ``vocab`` (word, n; n positive): word, form, root, n, n_near, form_n. ``ratio`` is 2 or more."""
    scratch = scratch or Scratch(vocab.sparkSession)
    vocab = scratch.table(vocab, "vocab")
    best = near_pairs(vocab, symbols, scratch).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), "near")).alias("best"))
    whole = vocab.join(best, "word", "left")
    is_form = -F.col("best")["n"] >= F.col("n") * ratio
    whole = scratch.table(whole.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best")["near"]).alias("form"), F.when(is_form, -F.col("best")["n"]).alias("form_n")), "forms")
    scratch.drop("keyed", "owns", "words", "met")
    last = roots(whole.where("form is not null"), scratch)
    return whole.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
