"""Quality classifier: a sparse rule ensemble over text statistics.

Spark computes the statistics; shallow boosted trees on a bounded sample of
labelled documents give conjunctive rules (every path from a root), a lasso
logistic fit keeps few of them, and the rules that stay are compiled to one column
expression, so that scoring is a native pass over the texts.

Sample: at most ``most_rows`` labelled documents, those whose hashed ids come first.
Labels with a null id or value are left out; an id with several labels counts by
their mean. Nulls: a null text is scored as an empty one. With no usable label, or
labels of one value only, every score is the smoothed share of ones. Repeated rows are
scored each; ``scored`` replaces a column that already has the score's name.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from voxmill.llm import text_stats
from voxmill.llm.common import free_name

FEATURES = ("log_words", "word_length", "symbols", "capitals", "bangs", "pipes", "distinct", "dup_lines", "short_lines", "digits", "stops", "longest_share")


def features(text: Column) -> Column:
    """Struct of FEATURES over the whole text."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    lower = text_stats.chars_in
    parts = F.struct(
        text_stats.let(text_stats.words(text), lambda w: F.struct(F.size(w).cast("double").alias("n"), F.size(F.array_distinct(w)).cast("double").alias("d"), F.coalesce(F.array_max(F.transform(w, lambda x: F.length(x))), F.lit(0)).cast("double").alias("longest"))).alias("w"),
        F.length(F.regexp_replace(text, text_stats.SPACE, "")).cast("double").alias("c"),
        lower(text, r"[^#*$%&<>]+").alias("symbols"),
        lower(text, r"\P{Lu}+").alias("capitals"),
        lower(text, r"[^!]+").alias("bangs"),
        lower(text, r"[^|]+").alias("pipes"),
        lower(text, r"[^0-9]+").alias("digits"),
        lower(text, r"[^.?;:]+").alias("stops"),
        text_stats.let(F.filter(F.split(text, "\n", -1), lambda x: x.rlike(text_stats.NOT_SPACE)), lambda x: F.struct(F.size(x).cast("double").alias("n"), F.size(F.array_distinct(x)).cast("double").alias("d"), F.size(F.filter(x, lambda y: F.length(y) < 40)).cast("double").alias("short"))).alias("l"),
    )

    def finished(p: Column) -> Column:
        words, chars, lines = F.greatest(p["w"]["n"], F.lit(1.0)), F.greatest(p["c"], F.lit(1.0)), F.greatest(p["l"]["n"], F.lit(1.0))
        made = {
            "log_words": F.log1p(p["w"]["n"]),
            "word_length": p["c"] / words,
            "symbols": p["symbols"] / chars,
            "capitals": p["capitals"] / chars,
            "bangs": p["bangs"] / words,
            "pipes": p["pipes"] / words,
            "distinct": p["w"]["d"] / words,
            "dup_lines": (p["l"]["n"] - p["l"]["d"]) / lines,
            "short_lines": p["l"]["short"] / lines,
            "digits": p["digits"] / chars,
            "stops": p["stops"] / words,
            "longest_share": p["w"]["longest"] / chars,
        }
        return F.struct(*(made[f].cast("double").alias(f) for f in FEATURES))

    return text_stats.let(parts, finished)


@dataclass(frozen=True)
class Rule:
    """All of ``terms`` hold: (feature, above, cut), above: value > cut, else value <= cut."""

    terms: tuple[tuple[str, bool, float], ...]
    weight: float = 0.0


@dataclass(frozen=True)
class RuleModel:
    rules: tuple[Rule, ...]
    bias: float

    def column(self, f: Column) -> Column:
        """The score as an expression over the struct of features."""
        total = F.lit(self.bias)
        for r in self.rules:
            holds = F.lit(True)
            for name, above, cut in r.terms:
                holds = holds & ((f[name] > cut) if above else (f[name] <= cut))
            total = total + F.when(holds, F.lit(r.weight)).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-total))

    def score(self, x: dict[str, float]) -> float:
        total = self.bias + sum(r.weight for r in self.rules if all((x[n] > c) == above for n, above, c in r.terms))
        return 1.0 / (1.0 + math.exp(-total))


def _tree(x: np.ndarray, bins: np.ndarray, cuts: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, depth: int, least: int, path: tuple, out: list) -> np.ndarray:
    """Grows one node; appends the paths below it and returns the step of each row."""
    step = np.full(len(rows), -grad[rows].sum() / (hess[rows].sum() + 1.0))
    if depth == 0 or len(rows) < 2 * least:
        return step
    best, n_bins = (1e-6, -1, -1), max(len(c) for c in cuts) + 1
    g_all, h_all = grad[rows].sum(), hess[rows].sum()
    for j in range(x.shape[1]):
        b = bins[rows, j]
        g, h, n = (np.bincount(b, w, n_bins).cumsum() for w in (grad[rows], hess[rows], np.ones(len(rows))))
        ok = (n >= least) & (len(rows) - n >= least)
        gain = np.where(ok, g**2 / (h + 1.0) + (g_all - g) ** 2 / (h_all - h + 1.0) - g_all**2 / (h_all + 1.0), -1.0)
        at = int(gain.argmax())
        if gain[at] > best[0] and at < len(cuts[j]):
            best = (float(gain[at]), j, at)
    if best[1] < 0:
        return step
    _, j, at = best
    left = bins[rows, j] <= at
    for side, above in ((left, False), (~left, True)):
        below = (*path, (FEATURES[j], above, float(cuts[j][at])))
        out.append(below)
        step[side] = _tree(x, bins, cuts, grad, hess, rows[side], depth - 1, least, below, out)
    return step


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = 25, depth: int = 3, shrink: float = 0.3, penalty: float = 0.002, turns: int = 400) -> RuleModel:
    """Trees, their paths as rules, and lasso logistic weights by accelerated proximal gradient."""
    prior = (y.sum() + 0.5) / (len(y) + 1.0)
    if not len(y) or y.min() == y.max():
        return RuleModel((), math.log(prior / (1 - prior)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0.02, 0.98, 49))) for j in range(x.shape[1])]
    bins = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1)
    total, paths, rng = np.full(len(y), math.log(prior / (1 - prior))), [], np.random.default_rng(5)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        rows = np.flatnonzero(rng.random(len(y)) < 0.7)
        found: list = []
        step = _tree(x, bins, cuts, p - y, p * (1 - p), rows, depth, max(5, len(y) // 1000), (), found)
        total[rows] += shrink * step
        paths += found
    rules = list(dict.fromkeys(tuple(sorted(p)) for p in paths))
    name = {f: j for j, f in enumerate(FEATURES)}
    hold = np.stack([np.logical_and.reduce([(x[:, name[n]] > c) == above for n, above, c in r]) for r in rules], axis=1) if rules else np.zeros((len(y), 0), bool)
    _, first = np.unique(hold, axis=1, return_index=True)
    rules, a = [rules[i] for i in sorted(first)], hold[:, sorted(first)].astype(np.float64)
    mean = a.mean(axis=0)
    w, z, b, bz, t = np.zeros(a.shape[1]), np.zeros(a.shape[1]), math.log(prior / (1 - prior)), math.log(prior / (1 - prior)), 1.0
    rate = 4.0 * len(y) / max(1.0, float(np.linalg.norm((a - mean).T @ (a - mean), 2)))
    for _ in range(turns):
        e = 1 / (1 + np.exp(-((a - mean) @ z + bz))) - y
        w2 = z - rate * ((a - mean).T @ e) / len(y)
        w2 = np.sign(w2) * np.maximum(np.abs(w2) - rate * penalty, 0)
        b2 = bz - 2.0 * e.mean()
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        z, bz = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    kept = np.flatnonzero(np.abs(w) > 1e-4)
    return RuleModel(tuple(Rule(rules[i], float(w[i])) for i in kept), float(b - (w[kept] * mean[kept]).sum()))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most_rows: int = 20_000, text: str = "text", doc_id: str = "doc_id", **how) -> RuleModel:
    """Fits on at most ``most_rows`` labelled documents."""
    known = labels.select(labels[doc_id].alias("__id"), labels[label].cast("double").alias("__y")).where("__id is not null and __y is not null")
    known = known.groupBy("__id").agg(F.avg("__y").alias("__y")).orderBy(F.xxhash64("__id"), "__id").limit(most_rows)
    rows = docs.select(docs[doc_id].alias("__id"), docs[text].alias("__t")).join(F.broadcast(known), "__id")  # bounded: most_rows ids
    rows = rows.select("__id", "__y", features(F.col("__t")).alias("f")).select("__y", "f.*").orderBy("__id").limit(2 * most_rows).collect()
    data = np.array([tuple(r) for r in rows], np.float64).reshape(len(rows), len(FEATURES) + 1)
    return fit_rules(data[:, 1:], (data[:, 0] >= 0.5).astype(np.float64), **how)


def scored(docs: DataFrame, model: RuleModel, text: str = "text", name: str = "score") -> DataFrame:
    """The documents with their score (0 to 1; higher: label 1 likelier) added."""
    return docs.withColumn(name, text_stats.let(features(docs[text]), model.column))


def keep_good(docs: DataFrame, model: RuleModel, least: float = 0.3, text: str = "text") -> DataFrame:
    """The documents whose score reaches ``least``; all columns stay."""
    name = free_name(docs, "__vx_score")
    return scored(docs, model, text, name).where(F.col(name) >= least).drop(name)
