"""Shared pieces of the corpus operators: shared-folder tables, text kernels.

The kernels work on Arrow string buffers with numpy: words of a whole chunk of
documents are found and hashed at once, without a Python object per word. Spark
deals out the documents; a kernel only ever sees one Arrow batch, cut into
chunks of about ``CHUNK`` bytes (a longer document is a chunk of its own).
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

CHUNK = 1 << 20
WORD_SPLIT = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


# ---------------------------------------------------------------- Spark side


def crc_mod(col: Column, n: int) -> Column:
    """crc32 of the id written as text, modulo ``n`` (null id: null)."""
    return F.crc32(col.cast("string").cast("binary")) % n


def ascii_lower(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, longer where the table has such a column."""
    have = {c.lower() for c in docs.columns}
    while name.lower() in have:
        name += "_"
    return name


class Scratch:
    """Intermediate tables in the folder that driver and executors share.

    The folder is the session's ``spark.checkpoint.dir``. Where that is unset, a
    local master gets a temporary folder; on a cluster it is an error, as a
    machine-local folder would not be seen by other executors. A written table
    cuts lineage and outlives lost executors. What is left of the tables goes when the
    driver ends.
    """

    def __init__(self, spark: SparkSession):
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not base:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
            spark.conf.set("spark.checkpoint.dir", base)
        self.spark, self.base, self.paths = spark, f"{base.rstrip('/')}/voxmill-{uuid.uuid4().hex}", {}
        path = spark._jvm.org.apache.hadoop.fs.Path(self.base)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Writes the table; the shuffle files of the write go when it is done."""
        path, cleanup = f"{self.base}/{name}-{uuid.uuid4().hex[:8]}", "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = self.spark.conf.get(cleanup, None)
        self.spark.conf.set(cleanup, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.unset(cleanup) if before is None else self.spark.conf.set(cleanup, before)
        self.paths.setdefault(name, []).append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Deletes tables that no later step reads."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            for path in self.paths.pop(name, []):
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(conf).delete(p, True)


# -------------------------------------------------------------- numpy kernels

_TABLE = np.random.default_rng(20240131).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE, _FOLD = 0x9E3779B97F4A7C15, np.random.default_rng(7).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POW: list[np.ndarray] = []
LOWER_BYTES = np.arange(256, dtype=np.uint8)
LOWER_BYTES[65:91] += 32
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, at least ``n``."""
    if not _POW or len(_POW[0]) < n:
        size = max(CHUNK + 1, 1 << n.bit_length())
        _POW[:] = [np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)]).cumprod(dtype=np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _POW[0], _POW[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(col) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; null rows are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offs


def chunks(col, size: int = CHUNK):
    """(first row, bytes, offsets from 0) for runs of rows of about ``size`` bytes."""
    if not len(col):
        return
    data, offs = buffers(col)
    row, n = 0, len(offs) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offs, offs[row] + size, "right")) - 1)
        yield row, data[offs[row] : offs[end]], offs[row : end + 1] - offs[row]
        row = end


def words(data: np.ndarray, offs: np.ndarray, sep: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and for each row the index of its first word (one more at the end)."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    inside = ~sep[data]
    left, right = np.empty_like(inside), np.empty_like(inside)
    left[0], right[-1] = False, False
    left[1:], right[:-1] = inside[:-1], inside[1:]
    left[offs[:-1][offs[:-1] < len(data)]] = False
    right[offs[1:][offs[1:] > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~left), np.flatnonzero(inside & ~right) + 1
    return starts, ends, np.searchsorted(starts, offs)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word's bytes, the same wherever the word stands."""
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def fold(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` consecutive hashes."""
    out = h[: len(h) - k + 1] * _FOLD[0]
    for j in range(1, k):
        out += h[j : len(h) - k + 1 + j] * _FOLD[j]
    return mix(out + np.uint64(k))


def hash_text(word: str) -> int:
    """hash_words of one word."""
    b = np.frombuffer(word.encode(), np.uint8)
    return int(hash_words(b, np.array([0]), np.array([len(b)]))[0])


def small_batches(spark: SparkSession, rows: int = 512, size: int = 8 << 20) -> None:
    """Keeps the Arrow batches of whole texts small, by rows and by bytes; a smaller setting of the session stays."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = spark.conf.get(key)
        if not now.isdigit() or int(now) > most or int(now) <= 0:
            spark.conf.set(key, str(most))
