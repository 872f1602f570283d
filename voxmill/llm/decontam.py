"""Benchmark decontamination with one Aho-Corasick automaton over word numbers.

Items (test questions and answers) and documents are normalised alike: A-Z
lower-cased, words are runs of ASCII digits and letters and of non-ASCII
characters. The benchmark's distinct words are numbered. Every window of ``width``
consecutive item words is one pattern (an item of fewer words is one window as a
whole), a sequence of numbers, so that matches begin and end at words. A document is
scanned once; each match marks its words, and marked words are mapped back to offsets
of the original text.

The automaton is a trie in arrays: one 64-bit arc a node (parent and word, in order, so
that a node's number is its arc's place), a failure arc, and the next shorter window
that ends there. A word that no item has leads to the root, so only runs of numbered
words are gone through. Runs are cut into pieces that are gone through side by side;
as the state depends on the last ``width`` words only, a piece begins ``width`` - 1
words early and is exact.

One automaton has at most about ``most_nodes`` nodes of 17 bytes (13 for each item word
at most, fewer as windows share beginnings), so that its broadcast and its memory are
bounded. A larger benchmark is scanned in as many blocks of items as it needs, one
after another, with the results written between them; none is dropped. The default, 16
million, has room for 8 MB of item text; with 3.5 GB for a worker, 200 million nodes
take 100 MB in one pass.

Nulls: a null text has no words, and its row is returned with empty results; an
item whose text is null or has no word has no window; an item with a null id marks
words, but has no id to name. Ids of any type are named as strings. Repeated rows are
judged each for itself; an item id that occurs twice counts once. An empty table
gives no rows, an empty benchmark no hits. Only the id and the text columns are read,
and other columns may have any name.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from voxmill.llm.common import LOWER_BYTES, Scratch, chunks, free_name, hash_words, small_batches, words

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_RAW = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_GAP = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LANE = 256


def word_hashes(col):
    """Yields (first row, hashes, index of each row's first word and one more) of a column of texts."""
    for row, data, offs in chunks(col):
        data = LOWER_BYTES[data]
        starts, ends, first = words(data, offs, _GAP)
        yield row, hash_words(data, starts, ends), first


def _numbers(sorted_keys: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Place of each asked key among ascending keys, or -1."""
    if not len(sorted_keys):
        return np.full(len(asked), -1, np.int64)
    at = np.minimum(np.searchsorted(sorted_keys, asked), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == asked, at, -1)


class Automaton:
    """Aho-Corasick automaton of windows of word numbers, with the ids of the items that have them."""

    def __init__(self, items: list[tuple], width: int):
        """items: (id as text or None, text)."""
        texts = [t for _, t in items]
        hashes, sizes = [np.zeros(0, np.uint64)], []
        for _, h, first in word_hashes(pa.array(texts, pa.large_string())):
            hashes.append(h)
            sizes.append(np.diff(first))
        seq, sizes = np.concatenate(hashes), np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
        self.words = np.unique(seq)
        seq = np.searchsorted(self.words, seq).astype(np.int64)
        begin = np.cumsum(sizes) - sizes
        windows = np.where(sizes > 0, np.maximum(sizes - width + 1, 1), 0)
        item = np.repeat(np.arange(len(items)), windows)
        start = begin[item] + np.arange(len(item)) - np.repeat(np.cumsum(windows) - windows, windows)
        length = np.minimum(sizes[item], width)
        self.shortest = int(length.min()) if len(length) else 0
        self.width = width
        self._trie(seq, start, length)
        self._fail()
        # the items of each node that ends a window
        names = sorted({i for i, _ in items if i is not None})
        number = {n: k for k, n in enumerate(names)}
        own = np.array([number.get(i, -1) for i, _ in items], np.int64)[item]
        pairs = np.unique(np.stack([self.at, own])[:, own >= 0], axis=1)
        self.names, self.of_node, self.item = names, pairs[0], pairs[1]
        del self.at

    def _trie(self, seq, start, length):
        """Arcs level by level; ``depth`` of each node; ``at``: the node that each window ends in."""
        node, arcs, levels = np.zeros(len(start), np.int64), [], [0]
        made = 0
        for d in range(int(length.max()) if len(length) else 0):
            open_ = np.flatnonzero(length > d)
            key, which = np.unique((node[open_] << 32) | seq[start[open_] + d], return_inverse=True)
            node[open_] = made + 1 + which.ravel()
            arcs.append(key)
            made += len(key)
            levels.append(made)
        self.arcs = np.concatenate(arcs) if arcs else np.zeros(0, np.int64)
        self.levels = np.array(levels)  # last node of each depth
        self.at = node
        self.depth = np.zeros(made + 1, np.int8)
        self.depth[1:] = np.repeat(np.arange(1, len(levels)), np.diff(levels))
        self.first = np.zeros(len(self.words) + 1, np.int32)  # the root's children, by word
        top = self.arcs[: levels[1]] if len(levels) > 1 else self.arcs
        self.first[top] = np.arange(1, len(top) + 1)

    def _fail(self):
        n = len(self.arcs) + 1
        self.fail, self.told = np.zeros(n, np.int32), np.zeros(n, np.int32)
        ends = np.zeros(n, bool)
        ends[self.at] = True
        ends[0] = False
        for d in range(1, len(self.levels)):
            nodes = np.arange(self.levels[d - 1] + 1, self.levels[d] + 1)
            if d > 1:
                arc = self.arcs[nodes - 1]
                self.fail[nodes] = self.step(self.fail[arc >> 32].astype(np.int64), arc & 0xFFFFFFFF)
            # the node itself if it ends a window, else the longest one that ends there
            self.told[nodes] = np.where(ends[nodes], nodes, self.told[self.fail[nodes]])

    def step(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """States after reading the words: along arcs, after failure arcs where there is none."""
        out, todo = np.zeros(len(state), np.int64), np.arange(len(state))
        state = state.copy()
        while len(todo):
            root = state[todo] == 0
            done = todo[root]
            out[done] = self.first[word[done]]
            todo = todo[~root]
            if not len(todo):
                break
            to = _numbers(self.arcs, (state[todo] << 32) | word[todo])
            hit = to >= 0
            out[todo[hit]] = to[hit] + 1
            todo = todo[~hit]
            state[todo] = self.fail[state[todo]]
        return out

    def matches(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the last word, node) of every window that occurs in these words; ``first``: where each text begins."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(h) or not len(self.arcs):
            return none
        number = _numbers(self.words, h)
        known = number >= 0
        edge = known.copy()
        edge[1:] &= ~known[:-1]
        edge[first[:-1][first[:-1] < len(h)]] |= known[first[:-1][first[:-1] < len(h)]]
        begin = np.flatnonzero(edge)
        # a run ends before an unknown word or another text
        stop = np.append(begin[1:], len(h))
        gaps = np.flatnonzero(~known)
        if len(gaps):
            nxt = np.searchsorted(gaps, begin)
            stop = np.minimum(stop, np.where(nxt < len(gaps), gaps[np.minimum(nxt, len(gaps) - 1)], len(h)))
        long = stop - begin >= self.shortest
        begin, stop = begin[long], stop[long]
        pieces = -(-(stop - begin) // LANE)
        run = np.repeat(np.arange(len(begin)), pieces)
        own = begin[run] + (np.arange(len(run)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * LANE
        lead = np.maximum(own - (self.width - 1), begin[run])
        end = np.minimum(own + LANE, stop[run])
        order = np.argsort(lead - end, kind="stable")  # longest first
        own, lead, end = own[order], lead[order], end[order]
        size = end - lead
        state, places, nodes = np.zeros(len(lead), np.int64), [], []
        for t in range(int(size[0]) if len(size) else 0):
            n = int(np.searchsorted(-size, -t))  # pieces of more than t words
            at = lead[:n] + t
            state[:n] = self.step(state[:n], number[at])
            told = self.told[state[:n]].astype(np.int64)
            told[at < own[:n]] = 0  # of the piece before
            there = np.flatnonzero(told)
            while len(there):
                places.append(at[there])
                nodes.append(told[there])
                told[there] = self.told[self.fail[told[there]]]
                there = there[told[there] > 0]
        return (np.concatenate(places), np.concatenate(nodes)) if places else none


def judged(auto: Automaton, col) -> list[tuple[int, list[tuple[int, int]], list]]:
    """Per text (words, word ranges that windows cover, ids of the items found)."""
    out = []
    for _, h, first in word_hashes(col):
        place, node = auto.matches(h, first)
        text = np.searchsorted(first, place, "right") - 1
        order = np.argsort(text, kind="stable")
        place, node, text = place[order], node[order], text[order]
        cuts = np.searchsorted(text, np.arange(len(first)))
        for i in range(len(first) - 1):
            a, b = cuts[i], cuts[i + 1]
            ranges, found = [], []
            if b > a:
                last = place[a:b] + 1 - first[i]
                ranges = merged(list(zip((last - auto.depth[node[a:b]]).tolist(), last.tolist())))
                own = np.unique(node[a:b])
                left, right = np.searchsorted(auto.of_node, own), np.searchsorted(auto.of_node, own, "right")
                found = sorted({auto.names[k] for x, y in zip(left, right) for k in auto.item[x:y].tolist()})
            out.append((int(first[i + 1] - first[i]), ranges, found))
    return out


def original_spans(text: str, ranges: list[tuple[int, int]]) -> list[dict]:
    """Word ranges as code-point offsets of the original text."""
    at = [m.span() for m in _RAW.finditer(text)]
    return [{"start": at[a][0], "end": at[b - 1][1]} for a, b in ranges]


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _passes(docs: DataFrame, items: DataFrame, text: str, width: int, most_nodes: int, item_id: str, item_text: str) -> tuple[DataFrame, list[str]]:
    """``docs`` with the results added, and the names of these: words, hits, ranges, items, spans. One map over the rows for each block of items, no shuffle."""
    spark = docs.sparkSession
    small_batches(spark)
    tests = items.select(items[item_id].cast("string").alias("item"), items[item_text].cast("string").alias("t")).where("t is not null")
    # every word of an item begins at most one window, of ``width`` nodes
    size = tests.agg(F.sum(F.size(F.regexp_extract_all("t", F.lit(_RAW.pattern), F.lit(0))).cast("long"))).head()[0] or 0
    blocks = max(1, -(-size * width // most_nodes))
    scratch = Scratch(spark) if blocks > 1 else None
    names, out = docs.columns, docs
    at, kept = names.index(text), len(names)
    pair = lambda t, a, b: pa.list_(pa.struct([(a, t), (b, t)]))
    added_names = [free_name(docs, f"__vx_{x}") for x in ("n_words", "n_hit", "ranges", "items", "spans")]
    types = ("bigint", "bigint", "array<struct<a:int,b:int>>", "array<string>", "array<struct<start:bigint,end:bigint>>")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), *map(" ".join, zip(added_names, types))])
    for k in range(blocks):
        part = tests if blocks == 1 else tests.where(F.pmod(F.xxhash64("item", "t"), F.lit(blocks)) == k)
        shared = spark.sparkContext.broadcast(Automaton([(r[0], r[1]) for r in part.collect()], width))  # bounded by most_nodes

        def run(batches, shared=shared, first=k == 0, last=k == blocks - 1):
            for b in batches:
                got = judged(shared.value, b.column(at))
                if not first:
                    before = zip(b.column(kept + 2).to_pylist(), b.column(kept + 3).to_pylist())
                    got = [(n, merged(r + [(x["a"], x["b"]) for x in r0]), sorted({*i, *i0})) for (n, r, i), (r0, i0) in zip(got, before)]
                spans = [original_spans(b.column(at)[i].as_py(), g[1]) if last and g[1] else [] for i, g in enumerate(got)]
                added = [
                    pa.array([g[0] for g in got], pa.int64()),
                    pa.array([sum(y - x for x, y in g[1]) for g in got], pa.int64()),
                    pa.array([[{"a": x, "b": y} for x, y in g[1]] for g in got], pair(pa.int32(), "a", "b")),
                    pa.array([g[2] for g in got], pa.list_(pa.string())),
                    pa.array(spans, pair(pa.int64(), "start", "end")),
                ]
                yield pa.RecordBatch.from_arrays([*b.columns[:kept], *added], [*names, *added_names])

        out = out.mapInArrow(run, schema)
        if k < blocks - 1:
            out = scratch.table(out, f"block{k}")  # so that one automaton at a time is in memory
    return out, added_names


def scan(docs: DataFrame, items: DataFrame, width: int = 13, most_nodes: int = 1 << 24, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document: its id, ``n_words``, ``n_hit`` (words inside any occurrence of a window), ``items`` (ids found, in the order of strings), ``spans`` (original offsets) and ``contaminated``.

    The items come to the driver in blocks whose automaton has at most about
    ``most_nodes`` nodes, by a number of words that Spark works out first.
    """
    rows, (n, hit, _, found, spans) = _passes(docs.select(docs[doc_id].alias("doc_id"), docs[text].cast("string").alias("__vx_text")), items, "__vx_text", width, most_nodes, item_id, item_text)
    return rows.select("doc_id", F.col(n).alias("n_words"), F.col(hit).alias("n_hit"), F.col(found).alias("items"), F.col(spans).alias("spans"), _contaminated(n, hit).alias("contaminated"))


def _contaminated(n: str, hit: str):
    """One word in twenty or more lies inside a window."""
    return (F.col(hit) > 0) & (F.col(hit) * 20 >= F.col(n))


def clean(docs: DataFrame, items: DataFrame, width: int = 13, most_nodes: int = 1 << 24, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents without the contaminated ones; all their columns stay as they are."""
    rows, (n, hit, *_) = _passes(docs, items, text, width, most_nodes, item_id, item_text)
    return rows.where(~_contaminated(n, hit)).select(*(F.col(f"`{c}`") for c in docs.columns))
