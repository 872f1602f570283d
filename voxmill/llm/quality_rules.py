"""Quality rules with thresholds that the data set themselves.

Every text gets its base counts. For each metric a quantile sketch is kept per
language and source, over the documents that pass the fixed base rules: a histogram of
high dynamic range, exact to 1024 thousandths and to one part in 512 above, so it has a
few hundred bins at most, two sketches merge by adding, and the same rows give the same
sketch in any order. A document fails when a metric lies above its group's fence, the
upper quartile plus ``reach`` interquartile ranges, or fails the base rules.

A group that is too small takes the quartiles of its language, or of everything. One
without a spread (its quartiles are equal) takes its language's spread, or that of
everything. Where not even that has one, a value of none is the rule there and the fence
stands ``floor`` above it, the same small distance for all metrics. Ratios of lines have
``LINES`` lines added below, so that one repeated line of three is not a third.

All on the DataFrame side. Sketches are aggregated partially, so a source that
holds a third of all rows is summed up where its rows are. The counts are written
once to the shared folder and read for the sketches and for the join.

Nulls: a null text has no words and fails the base rules; null languages and
sources are groups of their own. A group whose documents all fail the base rules has no
fence, and nothing else fails there. Repeated rows are counted and judged each. Only the
four named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from voxmill.llm import text_stats
from voxmill.llm.common import Scratch

METRICS = ("symbols", "capitals", "dup_lines", "word_length", "bangs", "stutter")
LINES = 50


def counted(docs: DataFrame, text: str, doc_id: str, lang: str, source: str) -> DataFrame:
    body = F.coalesce(docs[text].cast("string"), F.lit(""))
    counts = text_stats.base_counts(body)
    rows = docs.select(
        docs[doc_id].alias("doc_id"),
        docs[lang].cast("string").alias("lang"),
        docs[source].cast("string").alias("source"),
        *(c.alias(n) for n, c in counts.items()),
        F.size(F.split(body, "\n", -1)).alias("lines"),
        text_stats.chars_in(body, r"\P{Lu}+").alias("upper"),
        text_stats.chars_in(body, r"[^!]+").alias("bang"),
    )
    return rows.select("doc_id", "lang", "source", F.col("__words.n").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", F.col("__words.r").cast("long").alias("n_repeat_words"), "lines", "upper", "bang", F.col("__words.s").alias("same_as_before"))


def metrics() -> dict[str, Column]:
    """Bins: thousandths of each ratio, of those above 1024 the leading ten bits."""
    parts = {
        "symbols": ("n_symbols", "word_chars"),
        "capitals": ("upper", "word_chars"),
        "dup_lines": ("n_dup_lines", f"(lines + {LINES})"),
        "word_length": ("word_chars", "n_words"),
        "bangs": ("bang", "n_words"),
        "stutter": ("same_as_before", "n_words"),
    }
    value = lambda a, b: F.expr(f"cast({a} as bigint) * 1000 div greatest({b}, 1)")

    def bin_of(v: Column) -> Column:
        low = F.pow(F.lit(2), F.greatest(F.length(F.bin(v)) - 10, F.lit(0))).cast("long")
        return v - F.pmod(v, low)

    return {n: text_stats.let(value(*ab), bin_of) for n, ab in parts.items()}


def quartiles(sketch: DataFrame, *keys: str) -> DataFrame:
    """(keys, metric, rows, low, high) of histograms (keys, metric, bin, n): the bins of the nearest ranks."""
    total = W.partitionBy(*keys, "metric")
    so_far, all_ = F.sum("n").over(total.orderBy("bin")), F.sum("n").over(total)
    rows = sketch.select(*keys, "metric", "bin", so_far.alias("so_far"), all_.alias("rows"))
    at = lambda q: F.min(F.when(F.col("so_far") * 4 >= F.col("rows") * q, F.col("bin")))
    return rows.groupBy(*keys, "metric").agg(F.max("rows").alias("rows"), at(1).alias("low"), at(3).alias("high"))


def fences(sketches: DataFrame, reach: int, floor: int, least_rows: int) -> DataFrame:
    """(lang, source, one fence a metric), from the sketches (lang, source, metric, bin, n)."""
    merged = lambda *keys: sketches.groupBy(*keys, "metric", "bin").agg(F.sum("n").alias("n"))
    spread = F.nullif(F.col("high") - F.col("low"), F.lit(0))  # null: none
    named = lambda q, name, *keys: q.select(*keys, "metric", F.struct("rows", "high", spread.alias("spread")).alias(name))
    own = named(quartiles(sketches, "lang", "source"), "own", "lang", "source")
    of_lang = named(quartiles(merged("lang"), "lang"), "of_lang", "lang")
    whole = named(quartiles(merged()), "whole")

    def fence(*levels: str) -> Column:
        return F.col(levels[0])["high"] + F.greatest(F.lit(floor), reach * F.coalesce(*(F.col(x)["spread"] for x in levels), F.lit(0)))

    chosen = F.when(F.col("own")["rows"] >= least_rows, fence("own", "of_lang", "whole")).when(F.col("of_lang")["rows"] >= least_rows, fence("of_lang", "whole")).otherwise(fence("whole"))
    rows = own.join(of_lang, ["lang", "metric"]).join(F.broadcast(whole), "metric").withColumn("fence", chosen)  # a row for each metric
    return rows.groupBy("lang", "source").agg(*(F.max(F.when(F.col("metric") == n, F.col("fence"))).alias(f"max_{n}") for n in METRICS))


def judge(docs: DataFrame, reach: int = 5, floor: int = 50, least_rows: int = 100, text: str = "text", doc_id: str = "doc_id", lang: str = "lang", source: str = "source", scratch: Scratch | None = None) -> DataFrame:
    """One row per document: the counts, ``base_failed``, ``failed`` (metrics above their fence) and ``kept``."""
    scratch = scratch or Scratch(docs.sparkSession)
    rows = scratch.table(counted(docs, text, doc_id, lang, source), "counts")
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit(""))  # noqa: E731  nulls are a group of their own
    rows = rows.select("*", *(m.alias(f"m_{n}") for n, m in metrics().items())).withColumns({"lang": key("lang"), "source": key("source")})
    bins = F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(f"m_{n}").alias("bin")) for n in METRICS)))
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    sketches = scratch.table(rows.where(~base).select("lang", "source", bins.alias("x")).groupBy("lang", "source", "x.metric", "x.bin").agg(F.count("*").alias("n")), "sketches")
    limits = scratch.table(fences(sketches, reach, floor, least_rows), "fences")
    scratch.drop("sketches")
    failed = F.array_compact(F.array(*(F.when(F.col(f"m_{n}") > F.col(f"max_{n}"), F.lit(n)) for n in METRICS)))
    out = rows.join(limits, ["lang", "source"], "left")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), failed.alias("failed"), (~base & (F.size(failed) == 0)).alias("kept"))
