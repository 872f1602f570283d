"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

Features are hashed n-grams of 1 to 3 characters of the lower-cased text, weighted by
log(1 + count) times the inverse document frequency over all training documents
(counted by Spark) and scaled to length 1. Weights are learned example by example
by follow-the-regularised-leader with an L1 and an L2 penalty, so most stay exactly
zero. A temperature fitted on examples left out of training calibrates the
probabilities.

Sample: about ``per_language`` documents of each language, by order of their hashed
ids; with many languages fewer of each, so that they share about ``most_rows``, and
with long texts fewer too, so that their n-grams take about ``most_bytes`` (by the mean
over all training rows); at least one of each. All languages are learned. The weights are kept and sent as their nonzeros. Nulls: rows with a null language
don't train; rows without an id share one place in the sample, all of them in it or none, within its bound; a null text, or one without a letter, is ``und`` with score 0. With no
training row every text is ``und``. Repeated rows are predicted each. Prediction reads
the id and the text only, so other columns may have any name.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from voxmill.llm.common import mix, small_batches

SIZE = 1 << 15
_LETTER = re.compile(r"[^\W\d_]")


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(hashed n-gram, count) of a whole text."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    mul = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
    parts, h = [], np.zeros(len(c), np.uint64)
    for n in range(1, 4):
        if len(c) < n:
            break
        h = h[: len(c) - n + 1] + c[n - 1 :] * mul[n - 1]
        parts.append((mix(h + np.uint64(n)) & np.uint64(SIZE - 1)).astype(np.int64))
    counts = np.bincount(np.concatenate(parts), minlength=SIZE) if parts else np.zeros(SIZE, np.int64)
    at = np.flatnonzero(counts)
    return at.astype(np.int32), counts[at]


def tfidf(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts) * idf[at]
    norm = np.sqrt((v * v).sum())
    return v / norm if norm else v


@dataclass
class Model:
    labels: list[str]
    idf: np.ndarray
    bias: np.ndarray
    begin: np.ndarray  # of each bucket's nonzero weights; one more at the end
    column: np.ndarray  # their languages
    value: np.ndarray
    temperature: float = 1.0

    @property
    def weights(self) -> np.ndarray:
        """SIZE x languages, mostly zero."""
        out = np.zeros((SIZE, len(self.labels)))
        out[np.repeat(np.arange(SIZE), np.diff(self.begin)), self.column] = self.value
        return out

    def logits(self, at: np.ndarray, v: np.ndarray) -> np.ndarray:
        start, n = self.begin[at], self.begin[at + 1] - self.begin[at]
        place = np.arange(n.sum()) + np.repeat(start - np.cumsum(n) + n, n)
        return np.bincount(self.column[place], np.repeat(v, n) * self.value[place], len(self.bias)) + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.labels or not text or not _LETTER.search(text):
            return "und", 0.0
        at, counts = ngram_counts(text)
        z = self.logits(at, tfidf(at, counts, self.idf)) / self.temperature
        p = np.exp(z - z.max())
        best = int(p.argmax())
        return self.labels[best], float(p[best] / p.sum())


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], idf: np.ndarray, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01, left_out: float = 0.2) -> Model:
    """rows: (language, n-grams, counts) in an order that is not by language."""
    labels = sorted({r[0] for r in rows})
    k = len(labels)
    model = Model(labels, idf, np.zeros(k), np.zeros(SIZE + 1, np.int64), np.zeros(0, np.int32), np.zeros(0))
    if k < 2:
        return model
    index = {x: i for i, x in enumerate(labels)}
    data = [(index[x], at, tfidf(at, counts, idf)) for x, at, counts in rows]
    cut = int(len(data) * (1 - left_out))
    early = {y for y, _, _ in data[:cut]}
    learned = data[:cut] + [r for r in data[cut:] if r[0] not in early]  # each language at least once
    z, n, zb, nb = np.zeros((SIZE, k)), np.zeros((SIZE, k)), np.zeros(k), np.zeros(k)

    def lazy(z, n, l1):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    for _ in range(epochs):
        for y, at, v in learned:
            w, b = lazy(z[at], n[at], l1), lazy(zb, nb, 0.0)
            s = v @ w + b
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1.0
            g = v[:, None] * p
            n2 = n[at] + g * g
            z[at] += g - (np.sqrt(n2) - np.sqrt(n[at])) / alpha * w
            n[at] = n2
            nb2 = nb + p * p
            zb += p - (np.sqrt(nb2) - np.sqrt(nb)) / alpha * b
            nb = nb2
    weights, model.bias = lazy(z, n, l1), lazy(zb, nb, 0.0)
    bucket, column = np.nonzero(weights)
    model.begin, model.column, model.value = np.searchsorted(bucket, np.arange(SIZE + 1)), column.astype(np.int32), weights[bucket, column]
    held = data[cut:] or data
    scores, truth = np.array([model.logits(at, v) for _, at, v in held]), np.array([y for y, _, _ in held])

    def loss(t: float) -> float:
        s = scores / t
        top = s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s - top).sum(axis=1)) + top[:, 0] - s[np.arange(len(s)), truth]).mean())

    model.temperature = float(min(np.geomspace(0.05, 5.0, 60), key=loss))
    return model


def document_frequency(docs: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """For each hashed n-gram the number of texts that have it, over all rows; and the number of rows. At most SIZE rows reach the driver."""

    def run(batches):
        total, rows = np.zeros(SIZE + 1, np.int64), 0
        for b in batches:
            for t in b.column(0).to_pylist():
                rows += 1
                if t:
                    total[ngram_counts(t)[0]] += 1
        total[SIZE] = rows
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    out = np.zeros(SIZE + 1, np.int64)
    for bucket, n in docs.select(docs[text].cast("string")).mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out[:SIZE], int(out[SIZE])


def train(docs: DataFrame, per_language: int = 1500, most_rows: int = 96_000, most_bytes: int = 256 << 20, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", **how) -> Model:
    """Learns from the rows given; hold out by filtering them."""
    spark = docs.sparkSession
    small_batches(spark)
    known = docs.select(docs[doc_id].cast("string").alias("i"), docs[lang].cast("string").alias("y"), docs[text].cast("string").alias("t")).where("y is not null and t is not null")
    df, n = document_frequency(known, "t")
    idf = np.log((1.0 + n) / (1.0 + df)) + 1.0
    place = F.pmod(F.xxhash64("i", F.lit(3)), F.lit(1 << 30))
    known = known.withColumn("place", place)
    sizes = [(r[0], r[1], r[2]) for r in known.groupBy("y").agg(F.count("*"), F.min("place")).collect()]
    usual = 8 * max(1.0, df.sum() / max(1, n))  # bytes of a row's n-grams and counts
    each = min(per_language, max(1, int(min(most_rows, most_bytes / usual)) // max(1, len(sizes))))
    # a share of each language's rows by hashed id: about as many as each may have, and exactly bounded below
    below = spark.createDataFrame([(y, max(int(min(1.0, each / n) * (1 << 30)), first + 1)) for y, n, first in sizes], "y string, below long")
    sample = known.join(F.broadcast(below), "y").where("place < below")

    def run(batches):
        for b in batches:
            got = [ngram_counts(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([g[0].tobytes() for g in got], pa.binary()), pa.array([g[1].astype(np.int32).tobytes() for g in got], pa.binary())], ["y", "o", "at", "counts"])

    rows = sample.select("y", F.xxhash64("i", F.lit(9)).alias("o"), "t").mapInArrow(run, "y string, o bigint, at binary, counts binary").orderBy("o").limit(2 * each * len(sizes)).collect()
    return fit([(r[0], np.frombuffer(r[2], np.int32), np.frombuffer(r[3], np.int32)) for r in rows], idf, **how)


def predict(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, ``lang_pred`` and ``score`` (its calibrated probability) of every whole text."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # its nonzero weights

    def run(batches):
        m = shared.value
        for b in batches:
            got = [m.predict(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["doc_id", "lang_pred", "score"])

    id_type = docs.schema[doc_id].dataType.simpleString()
    return docs.select(docs[doc_id], docs[text].cast("string")).mapInArrow(run, f"doc_id {id_type}, lang_pred string, score double")
