"""Toxicity: a classifier chain over sparse word features.

Categories are predicted one after another; the model of a category gets the
probabilities of the earlier ones as features. In training those are out-of-fold
predictions, so that a later model doesn't lean on what an earlier one has learnt by
heart. The categories are columns of the label table, in the caller's order; the last
one is what the features are chosen for.

Features are presence of hashed words and word beginnings (4, 5 and 6 bytes) over
the whole text, A-Z lower-cased; the ``most_features`` with the highest chi-square
against the label are kept, and each linear model is logistic with an L1 penalty.

Sample: at most ``most_toxic`` labelled documents of the last category and
``most_clean`` others, those whose hashed ids come first. Nulls: labels with a null id
or a null value are left out, an id with several labels has a category if one of them
says so; a null text is scored as empty. Rows are scored each for itself; columns other
than the id and the text are not read. Ties of chi-square go to the smaller feature
number. With no label of the last category or none other, or an empty table,
probabilities are the smoothed shares of the labels.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from voxmill.llm.common import LOWER_BYTES, chunks, hash_words, small_batches, words

CHAIN = ("quality", "toxic")
SIZE = 1 << 18
_SEP = np.array([not (b >= 128 or 48 <= b <= 57 or 97 <= b <= 122) for b in range(256)])


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hashed feature) of every word and word beginning."""
    data = LOWER_BYTES[data]
    starts, ends, first = words(data, offs, _SEP)
    row = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    whole = hash_words(data, starts, ends)
    rows, made = [row], [whole]
    for n in (4, 5, 6):
        long = ends - starts > n
        rows.append(row[long])
        made.append(hash_words(data, starts[long], starts[long] + n) + np.uint64(n))
    return np.concatenate(rows), (np.concatenate(made) & np.uint64(SIZE - 1)).astype(np.int64)


@dataclass
class Linear:
    weights: np.ndarray
    earlier: np.ndarray
    bias: float


@dataclass
class Chain:
    column: np.ndarray  # hashed feature -> kept feature or -1
    models: list[Linear]
    names: tuple[str, ...] = CHAIN

    def probabilities(self, rows: np.ndarray, cols: np.ndarray, n: int) -> np.ndarray:
        """n x categories, from distinct (row, kept feature) pairs."""
        p = np.zeros((n, len(self.models)))
        for j, m in enumerate(self.models):
            z = np.bincount(rows, m.weights[cols], n) + p[:, :j] @ m.earlier + m.bias
            p[:, j] = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        return p


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.001, turns: int = 150) -> tuple[np.ndarray, float]:
    """L1 logistic regression by accelerated proximal gradient."""
    prior = (y.sum() + 0.5) / (len(y) + 1.0)
    w, b = np.zeros(x.shape[1]), float(np.log(prior / (1 - prior)))
    if not len(y) or y.min() == y.max():
        return w, b
    v, power = np.ones(x.shape[1]), 1.0
    for _ in range(12):
        v = x.T @ (x @ v)
        power = float(np.linalg.norm(v))
        v /= max(power, 1e-12)
    rate, z, bz, t = 2.0 * len(y) / max(power, 1.0), w, b, 1.0
    for _ in range(turns):
        e = 1 / (1 + np.exp(-np.clip(x @ z + bz, -40, 40))) - y
        w2 = z - rate * (x.T @ e) / len(y)
        w2, b2 = np.sign(w2) * np.maximum(np.abs(w2) - rate * penalty, 0), bz - e.mean()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, bz = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    return w, float(b)


def fit_chain(x: np.ndarray, labels: np.ndarray, folds: int = 3) -> list[Linear]:
    """labels: one column a category, in order."""
    models, before, fold = [], np.zeros((len(x), 0)), np.arange(len(x)) % folds
    for j in range(labels.shape[1]):
        both, y, out = np.hstack([x, before]), labels[:, j], np.zeros(len(x))
        for f in range(folds):
            w, b = logistic(both[fold != f], y[fold != f])
            out[fold == f] = 1 / (1 + np.exp(-np.clip(both[fold == f] @ w + b, -40, 40)))
        w, b = logistic(both, y)
        models.append(Linear(w[: x.shape[1]], w[x.shape[1] :], b))
        before = np.hstack([before, out[:, None]])
    return models


def train(docs: DataFrame, labels: DataFrame, most_toxic: int = 2000, most_clean: int = 4000, most_features: int = 768, text: str = "text", doc_id: str = "doc_id", chain: tuple[str, ...] = CHAIN) -> Chain:
    """``chain``: label columns (0 or above 0), each predicted with the probabilities of those before it."""
    small_batches(docs.sparkSession)
    flags = [F.max(F.when(F.col(f"__y{j}") > 0, 1).otherwise(0)).alias(f"__y{j}") for j in range(len(chain))]
    known = labels.select(labels[doc_id].alias("__id"), *(labels[c].cast("int").alias(f"__y{j}") for j, c in enumerate(chain))).dropna()
    known = known.groupBy("__id").agg(*flags).select("__id", F.array(*(f"__y{j}" for j in range(len(chain)))).alias("__y"))
    pick = lambda y, n: known.where(F.element_at("__y", -1) == y).orderBy(F.xxhash64("__id"), "__id").limit(n)
    wanted = pick(1, most_toxic).unionByName(pick(0, most_clean))

    def run(batches):
        for b in batches:
            sets = [b""] * b.num_rows
            for at, data, offs in chunks(b.column(2)):
                row, feature = features(data, offs)
                order = np.argsort(row, kind="stable")
                begin = np.searchsorted(row[order], np.arange(len(offs)))
                for i in range(len(offs) - 1):
                    sets[at + i] = np.unique(feature[order][begin[i] : begin[i + 1]]).astype(np.int32).tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sets, pa.binary())], ["o", "y", "features"])

    rows = docs.select(docs[doc_id].alias("__id"), docs[text].cast("string").alias("__t")).join(F.broadcast(wanted), "__id")  # bounded: most_toxic + most_clean ids
    rows = rows.select(F.xxhash64("__id", F.lit(1)).alias("o"), "__y", "__t").mapInArrow(run, "o bigint, y array<int>, features binary").orderBy("o").limit(2 * (most_toxic + most_clean)).collect()
    labelled = np.array([r[1] for r in rows], np.float64).reshape(len(rows), len(chain))
    y, sets = labelled[:, -1], [np.frombuffer(r[2], np.int32) for r in rows]
    with_it, toxic = np.zeros(SIZE), np.zeros(SIZE)
    for s, v in zip(sets, y):
        with_it[s] += 1
        toxic[s] += v
    n, pos = max(1, len(y)), y.sum()
    expected = with_it * pos / n
    chi = np.where(with_it >= 3, (toxic - expected) ** 2 / np.maximum(expected * (1 - pos / n) * (1 - with_it / n), 1e-9), 0.0)
    best = np.sort(np.argsort(-chi, kind="stable")[: min(most_features, int((chi > 0).sum()))])
    column = np.full(SIZE, -1, np.int32)
    column[best] = np.arange(len(best))
    x = np.zeros((len(rows), len(best)))
    for i, s in enumerate(sets):
        c = column[s]
        x[i, c[c >= 0]] = 1.0
    return Chain(column, fit_chain(x, labelled), chain)


def score(docs: DataFrame, chain: Chain, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and one probability a category, ``p_<category>``."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(chain)  # SIZE numbers and most_features weights a category

    def run(batches):
        model = shared.value
        for b in batches:
            parts = [np.zeros((0, len(chain.names)))]
            for _, data, offs in chunks(b.column(1)):
                n = len(offs) - 1
                row, feature = features(data, offs)
                kept = model.column[feature]
                hit = kept >= 0
                width = max(1, int(model.column.max()) + 1)
                pairs = np.unique(row[hit] * width + kept[hit])
                parts.append(model.probabilities(pairs // width, pairs % width, n))
            p = np.concatenate(parts)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(np.ascontiguousarray(p[:, j])) for j in range(len(chain.names)))], ["doc_id", *(f"p_{c}" for c in chain.names)])

    id_type = docs.schema[doc_id].dataType.simpleString()
    return docs.select(docs[doc_id], docs[text].cast("string")).mapInArrow(run, f"doc_id {id_type}, " + ", ".join(f"p_{c} double" for c in chain.names))
