"""SentencePiece encoding and decoding with a unigram model.

The pieces of a public vocabulary file and their log scores go into a double-array
trie over UTF-8 bytes, with a space in place of the whitespace marker. Viterbi
finds the best-scoring segmentation. Every byte has a piece (byte fallback), so any
text can be encoded, and decoding gives it back exactly, the marker character
itself included: in a text it goes through the byte pieces.

No piece goes on over a space after other characters, so the best segmentation of
a text is that of its units (spaces and what follows up to the next space), and
equal units of a chunk are segmented once, all in step; a unit of over ``LONG`` bytes
(a text without spaces, base64) by itself, in time proportional to its length.

A vocabulary whose scores are only ranks (0, -1, -2, ...: merges in order) gets log
scores by Zipf's law, score = -log(rank + 1) - log(sum of 1/rank). Ties: of two
segmentations with equal scores the one whose last differing piece is longer.

Nulls: a null text gives null ids; an empty text an empty list; a null id in a
list of ids is skipped on decoding. Rows are encoded each for itself; other columns
are not read.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from voxmill.llm.common import chunks, hash_words, small_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
FALLBACK_PENALTY = 10.0
LONG = 512


class Vocabulary:
    """Piece bytes and log scores by id; ids of control pieces have no bytes."""

    def __init__(self, pieces: list[tuple[bytes, float, int]], size: int):
        """pieces: (bytes, score, id); single bytes that no piece has are byte pieces with id given separately."""
        self.size = size
        self.bytes: list[bytes] = [b""] * size
        self.scores = np.zeros(size)
        self.fallback = np.zeros(size, bool)
        for b, score, i in pieces:
            self.bytes[i], self.scores[i] = b, score

    @classmethod
    def from_file(cls, path: str) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        normal = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
        raw = {i: sp.get_score(i) for i in normal}
        if [raw[i] for i in normal] == [-float(k) for k in range(len(normal))]:
            total = np.log((1.0 / np.arange(1, len(normal) + 1)).sum())
            raw = {i: float(-np.log(k + 1) - total) for k, i in enumerate(normal)}
        pieces = [(sp.id_to_piece(i).replace("▁", " ").encode(), raw[i], i) for i in normal]
        out = cls(pieces, n)
        out.add_bytes({i: int(sp.id_to_piece(i)[3:5], 16) for i in range(n) if sp.is_byte(i)})
        return out

    def add_bytes(self, ids: dict[int, int]) -> None:
        """Byte pieces (id -> byte), scored below every other piece."""
        low = min((self.scores[i] for i in range(self.size) if self.bytes[i]), default=0.0) - FALLBACK_PENALTY
        have = {b for b in self.bytes if len(b) == 1}
        for i, value in ids.items():
            self.bytes[i], self.scores[i], self.fallback[i] = bytes([value]), low, True
        self.entries = [(b, i) for i, b in enumerate(self.bytes) if b and not (self.fallback[i] and b in have)]


class DoubleArray:
    """Trie with a transition from state s by byte c to base[s] + c, valid where check there is s; value: piece id or -1. ``size``: states at first; the arrays double when they are full."""

    def __init__(self, entries: list[tuple[bytes, int]], size: int = 1 << 20):
        tree: dict = {}
        for word, value in entries:
            node = tree
            for c in word:
                node = node.setdefault(c, {})
            node[-1] = value
        size = max(size, 512)
        base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        used = bytearray(size)
        used[0], free, self.size = 1, 1, 1
        todo = [(0, tree)]
        for state, node in todo:
            arcs = sorted(c for c in node if c >= 0)
            if -1 in node:
                value[state] = node[-1]
            if not arcs:
                base[state] = -1
                continue
            if len(used) - self.size < 1024:
                more = len(used)
                used.extend(bytes(more))
                base, check, value = (np.concatenate([x, np.full(more, fill, np.int32)]) for x, fill in ((base, 0), (check, -1), (value, -1)))
            while used[free]:
                free += 1
            at = max(free, arcs[0] + 1)
            while True:
                at = used.find(0, at)  # at most one past the last used state, which has room for a byte above it
                start = at - arcs[0]
                if not any(used[start + c] for c in arcs):
                    break
                at += 1
            base[state] = start
            for c in arcs:
                used[start + c], check[start + c] = 1, state
                self.size = max(self.size, start + c + 1)
                todo.append((start + c, node[c]))
        end = self.size + 256
        self.base, self.check, self.value = base[:end], check[:end], value[:end]


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.trie = DoubleArray(vocabulary.entries)
        self.longest = max(len(b) for b, _ in vocabulary.entries)
        if any(b" " in b.lstrip(b" ") for b, _ in vocabulary.entries):
            raise ValueError("a piece has a space after other characters; units can't be segmented apart")
        inner = {c for b, _ in vocabulary.entries if len(b) > 1 for c in b}
        self.alone = np.array([c not in inner for c in range(256)])  # bytes that only stand as a piece of their own
        flat = np.frombuffer(b"".join(vocabulary.bytes), np.uint8)
        self.flat, self.at = flat, np.concatenate([[0], np.cumsum([len(b) for b in vocabulary.bytes])])
        self.lists: tuple | None = None

    def units(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Start bytes of the units."""
        space, alone = data == 32, self.alone[data]
        cut = alone.copy()
        cut[1:] |= space[1:] & ~space[:-1] | alone[:-1]
        cut[offs[:-1][offs[:-1] < len(data)]] = True
        return np.flatnonzero(cut)

    def best(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all units, one after another, and the number of each."""
        n, longest = len(starts), int(lengths.max())
        base, check, value, scores = self.trie.base, self.trie.check, self.trie.value, self.v.scores
        score = np.full((n, longest + 1), -np.inf)
        score[:, 0] = 0
        back, piece = np.zeros((n, longest + 1), np.int32), np.full((n, longest + 1), -1, np.int32)
        for p in range(longest):
            row = np.flatnonzero(lengths > p)
            row = row[score[row, p] > -np.inf]
            state = np.zeros(len(row), np.int32)
            for d in range(min(self.longest, longest - p)):
                more = lengths[row] > p + d
                if not more.all():
                    row, state = row[more], state[more]
                to = base[state] + data[starts[row] + p + d]
                good = (base[state] >= 0) & (check[to] == state)
                row, state = row[good], to[good]
                if not len(row):
                    break
                found = value[state]
                some = found >= 0
                r, f = row[some], found[some]
                new = score[r, p] + scores[f]
                better = new > score[r, p + d + 1]
                r, f = r[better], f[better]
                score[r, p + d + 1], back[r, p + d + 1], piece[r, p + d + 1] = new[better], p, f
        at, counts, steps = lengths.astype(np.int64), np.zeros(n, np.int64), []
        row = np.arange(n)
        while len(row):
            steps.append((row, piece[row, at[row]]))
            counts[row] += 1
            at[row] = back[row, at[row]]
            row = row[at[row] > 0]
        ids, begin = np.empty(int(counts.sum()), np.int32), np.concatenate([[0], np.cumsum(counts)[:-1]])
        for k, (row, f) in enumerate(steps):
            ids[begin[row] + counts[row] - 1 - k] = f
        return ids, counts

    def best_of_long(self, unit: bytes) -> list[int]:
        """Piece ids of one unit."""
        if self.lists is None:
            self.lists = tuple(x.tolist() for x in (self.trie.base, self.trie.check, self.trie.value, self.v.scores))
        base, check, value, scores = self.lists
        n = len(unit)
        score, back, piece = [-np.inf] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        score[0] = 0.0
        for p in range(n):
            here, state = score[p], 0
            if here == -np.inf:
                continue
            for q in range(p, n):
                b = base[state]
                if b < 0 or check[b + unit[q]] != state:
                    break
                state = b + unit[q]
                found = value[state]
                if found >= 0 and here + scores[found] > score[q + 1]:
                    score[q + 1], back[q + 1], piece[q + 1] = here + scores[found], p, found
        out = []
        while n:
            out.append(piece[n])
            n = back[n]
        return out[::-1]

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all rows and the offsets of each row's."""
        filled = np.flatnonzero(offs[1:] > offs[:-1])
        if not len(filled):
            return np.zeros(0, np.int32), np.zeros(len(offs), np.int64)
        data = np.insert(data, offs[filled], 32)
        offs = offs + np.concatenate([[0], np.cumsum(offs[1:] > offs[:-1])])
        starts = self.units(data, offs)
        ends = np.append(starts[1:], len(data))
        _, where, which = np.unique(hash_words(data, starts, ends), return_index=True, return_inverse=True)
        s, lengths = starts[where], (ends - starts)[where]
        order = np.argsort(lengths, kind="stable")
        ids_of, counts_of, lo = [], np.zeros(len(where), np.int64), 0
        while lo < len(order):  # units of like length together, so that the tables stay small
            if lengths[order[lo]] > LONG:
                at = order[lo]
                ids_of.append(np.array(self.best_of_long(data[s[at] : s[at] + lengths[at]].tobytes()), np.int32))
                counts_of[at] = len(ids_of[-1])
                lo += 1
                continue
            hi = int(np.searchsorted(lengths[order], max(16, 2 * lengths[order[lo]]), "right"))
            hi = min(hi, int(np.searchsorted(lengths[order], LONG, "right")), lo + max(1, 2_000_000 // int(lengths[order[hi - 1]] + 1)))
            part = order[lo:hi]
            ids, counts = self.best(data, s[part], lengths[part])
            ids_of.append(ids)
            counts_of[part] = counts
            lo = hi
        ids_of = np.concatenate(ids_of)
        begin = np.empty(len(where), np.int64)
        begin[order] = np.concatenate([[0], np.cumsum(counts_of[order])[:-1]])
        counts = counts_of[which]
        total = np.concatenate([[0], np.cumsum(counts)])
        ids = ids_of[np.repeat(begin[which] - total[:-1], counts) + np.arange(total[-1])]
        return ids, total[np.searchsorted(starts, offs)]

    def decode_flat(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of the pieces, one after another."""
        begin, length = self.at[ids], self.at[ids + 1] - self.at[ids]
        total = np.concatenate([[0], np.cumsum(length)])
        return self.flat[np.repeat(begin - total[:-1], length) + np.arange(total[-1])]

    def decode(self, ids: list[int]) -> str:
        data = b"".join(self.v.bytes[i] for i in ids if i is not None)
        return data.removeprefix(b" ").decode(errors="replace")


@lru_cache(maxsize=2)
def encoder(model: str) -> Encoder:
    return Encoder(Vocabulary.from_file(model))


def encode(docs: DataFrame, model: str = MODEL, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: its id, ``n_pieces``, ``n_fallback`` (byte pieces), ``ids`` and ``exact`` (decoding the ids gives the text)."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(encoder(model))  # bounded by the vocabulary

    def run(batches):
        enc = shared.value
        for b in batches:
            parts, ends, exact, back = [], [np.zeros(1, np.int64)], [], []
            for _, data, offs in chunks(b.column(1)):
                ids, at = enc.encode(data, offs)
                given, sizes = enc.decode_flat(ids), np.concatenate([[0], np.cumsum(enc.at[ids + 1] - enc.at[ids])])
                parts.append(ids)
                ends.append(at[1:] + ends[-1][-1])
                back.append(np.add.reduceat(np.append(enc.v.fallback[ids], False).astype(np.int64), at[:-1]) * (at[1:] > at[:-1]))
                for i in range(len(offs) - 1):
                    exact.append(np.array_equal(given[sizes[at[i]] + (at[i] < at[i + 1]) : sizes[at[i + 1]]], data[offs[i] : offs[i + 1]]))
            ends = np.concatenate(ends)
            mask = b.column(1).is_null() if b.column(1).null_count else None
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int32)), mask=mask)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(ends)), pa.array(np.concatenate(back) if back else np.zeros(0, np.int64)), lists, pa.array(exact, pa.bool_())], ["doc_id", "n_pieces", "n_fallback", "ids", "exact"])

    id_type = docs.schema[doc_id].dataType.simpleString()
    return docs.select(docs[doc_id], docs[text].cast("string")).mapInArrow(run, f"doc_id {id_type}, n_pieces bigint, n_fallback bigint, ids array<int>, exact boolean")


def decode(rows: DataFrame, model: str = MODEL, ids: str = "ids", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and ``text`` of each list of ids; ids outside the vocabulary raise, null lists give null."""
    shared = rows.sparkSession.sparkContext.broadcast(encoder(model))

    def run(batches):
        enc = shared.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x is None else enc.decode(x) for x in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    id_type = rows.schema[doc_id].dataType.simpleString()
    return rows.select(rows[doc_id], rows[ids].cast("array<int>")).mapInArrow(run, f"doc_id {id_type}, text string")
