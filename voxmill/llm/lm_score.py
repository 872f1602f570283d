"""Language-model scores with a weighted backoff automaton.

States are contexts of up to two words, smoothed hierarchically: a context that was
seen c times adds ``prior`` times the probabilities of the next shorter context to
its own counts (MacKay and Peto's Dirichlet smoothing), so

    p(w | s) = (c(s w) + prior p(w | shorter s)) / (c(s) + prior).

A failure arc leads from each state to the next shorter context, with the weight
log(prior / (c(s) + prior)); an arc exists for every word seen after the context. It
carries what it gains over failing, log(1 + c(s w) / (prior p(w | shorter s))), so the
weight of a step is the sum of the failure weights of the states that end at its
place, of the gains of the arcs there are, and of the word's own log-probability. An
n-gram that isn't in the model adds nothing. That makes the weight of a text a plain
sum, over one left-to-right pass that carries the state along.

The model has every word, pair and triple of the training texts; none is cut off by
count or rank. Its n-grams are dealt out by hash, and so is what a text needs of them:
a bucket gets the counts and the questions about the same n-grams, works out the
weights and answers. This is done in ``parts`` parts by hash, one after another, so
that only that share is on disk at a time. N-grams that look frequent in a sample of
the text (a relative frequency of ``often`` or more, so at most 1 / ``often`` of each
order) are not asked for: a bucket only says their weights, which are broadcast, and
the pass over the texts adds them up itself. So no key is hot, whatever the sample
missed costs time only, and what it holds is bounded at any corpus size.

Words: every word has its exact count. Those of a relative frequency of ``often_words``
(one in a million) or more are broadcast; the counts of all others are joined to the
rows that have them, once, and stand beside the texts for the passes that follow. So
``often_words``, ``often``, ``parts`` and ``bucket_tokens`` change what is held where,
and no score. All unseen words together have the probability of those seen once
(Good-Turing). The end of a text counts as a word.

Nulls: a null text is read as empty (one end token). Repeated rows count and are
scored each. Rows with a null training flag don't train. An empty training table
gives scores of 0. Columns besides the text and those to keep are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from voxmill.llm.common import LOWER_BYTES, Scratch, chunks, fold, hash_words, mix, small_batches, words

END = np.uint64(0x5EED0000E11D0001)
PRIORS = (3000.0, 3.0)  # of one word of context and of two; by the held-out scores at sf0.01 and sf0.1
_DEALT = np.uint64(0xA0761D6478BD642F)
FILE = 33  # bits of a row's number within the task that gave it


def token_hashes(col):
    """Yields (first row, hashes, offsets): the words of each row, then one end."""
    for at, data, offs in chunks(col):
        data = LOWER_BYTES[data]
        starts, ends, first = words(data, offs)
        out = np.full(len(starts) + len(offs) - 1, END, np.uint64)
        places = np.arange(len(starts)) + np.repeat(np.arange(len(offs) - 1), np.diff(first))
        out[places] = hash_words(data, starts, ends)
        yield at, out, first + np.arange(len(offs))


class Counter:
    """Sums counts by 64-bit key and gives them out when there are many."""

    def __init__(self, most: int = 1 << 21):
        self.parts, self.size, self.most = [], 0, most

    def add(self, keys: np.ndarray):
        found, counts = np.unique(keys, return_counts=True)
        self.parts.append((found, counts))
        self.size += len(found)
        if self.size > self.most:
            self.parts = [self._merged()]
            self.size = len(self.parts[0][0])
            if self.size > self.most // 2:
                yield self.take()

    def _merged(self):
        keys, counts = (np.concatenate(x) for x in zip(*self.parts))
        found, which = np.unique(keys, return_inverse=True)
        return found, np.bincount(which, counts).astype(np.int64)

    def take(self):
        keys, counts = self._merged() if self.parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        self.parts, self.size = [], 0
        return keys, counts


def counted_words(texts: DataFrame, often: float, each: int = 8) -> DataFrame:
    """(kind, h, c): how often each word occurs (kind 1), and n-grams that are frequent in a task's share of the sample, every ``each``-th batch (kind 2); and the size of the sample (kind 0)."""

    def rows(kind, keys, counts):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)), pa.array(counts.astype(np.int64))], ["kind", "h", "c"])

    def run(batches):
        counter, seen, sampled = Counter(), [], 0
        for k, b in enumerate(batches):
            for _, h, offs in token_hashes(b.column(0)):
                for full in counter.add(h):
                    yield rows(1, *full)
                if k % each == 0 and sampled < 1 << 20:
                    sampled += len(h)
                    seen += ngrams(h, offs)[1:]
        yield rows(1, *counter.take())
        keys, counts = np.unique(np.concatenate(seen), return_counts=True) if seen else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        top = (counts >= max(2, often * sampled)) & (keys > 0)
        yield rows(2, keys[top], counts[top])
        yield rows(0, np.zeros(1, np.uint64), np.array([sampled]))

    return texts.mapInArrow(run, "kind int, h bigint, c bigint").groupBy("kind", "h").agg(F.sum("c").alias("c"))


def found_at(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each asked key its place among ``keys`` (ascending), and whether it is there."""
    if not len(keys):
        return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return at, keys[at] == asked


class Index:
    """Places of a bounded number of 64-bit keys: a table by their first bits, and a search for the few that share them."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.sort(keys)
        self.shift = np.uint64(64 - max(10, len(keys).bit_length() + 3))
        slot = (self.keys >> self.shift).astype(np.int64)
        self.table = np.full(1 << (64 - int(self.shift)), -1, np.int32)
        self.table[slot[::-1]] = np.arange(len(keys), dtype=np.int32)[::-1]  # the first of a slot
        self.many = np.zeros(len(self.table), bool)
        self.many[slot[1:][slot[1:] == slot[:-1]]] = True

    def find(self, asked: np.ndarray) -> np.ndarray:
        """Place among the ascending keys, or -1."""
        slot = (asked >> self.shift).astype(np.int64)
        at = self.table[slot]
        at = np.where((at >= 0) & (self.keys[at] == asked), at, -1) if len(self.keys) else at
        rest = np.flatnonzero(self.many[slot] & (at < 0))
        if len(rest):
            place, there = found_at(self.keys, asked[rest])
            at[rest] = np.where(there, place, -1)
        return at


@dataclass
class Unigrams:
    """Counts of the broadcast words, in the order of the index, and what is common to all."""

    index: Index
    counts: np.ndarray
    tokens: int
    words: int
    discount: float

    @property
    def unseen(self) -> float:
        return self.discount * self.words / self.tokens

    def of(self, h: np.ndarray, offs: np.ndarray, others: np.ndarray) -> np.ndarray:
        """Counts of the words; ``others`` has those of each text's words that aren't broadcast, as ``others_of`` lists them."""
        at = self.index.find(h)
        c = np.where(at >= 0, self.counts[at], 0) if len(self.counts) else np.zeros(len(h), np.int64)
        rest, slot, _, _ = others_of(h, offs, at)
        c[rest] = others[slot]
        return c

    def chance(self, c: np.ndarray) -> np.ndarray:
        """Probability of words with these counts."""
        return np.where(c > 0, (c - self.discount) / self.tokens, self.unseen)


def others_of(h: np.ndarray, offs: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words that aren't broadcast (``at`` below 0): their places, and for each its number in the list of all texts' distinct ones, by text and hash; the text and the hash of each in that list."""
    rest = np.flatnonzero(at < 0)
    owner, key = np.repeat(np.arange(len(offs) - 1), np.diff(offs))[rest], h[rest].view(np.int64)
    order = np.lexsort((key, owner))
    new = np.ones(len(rest), bool)
    new[1:] = (np.diff(owner[order]) > 0) | (key[order][1:] != key[order][:-1])
    slot = np.empty(len(rest), np.int64)
    slot[order] = np.cumsum(new) - 1
    return rest, slot, owner[order[new]], key[order[new]]


def ngrams(h: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, hash of the last two words, hash of the last three, 0 where there are but two) of each word but a text's first."""
    first = np.repeat(offs[:-1], np.diff(offs))
    at = np.flatnonzero(np.arange(len(h)) > first)
    three = np.zeros(len(h), np.uint64)
    if len(h) > 2:
        three[2:] = fold(h, 3)
    two = fold(h, 2)[at - 1] if len(at) else h[:0]
    return at, two, np.where(at - first[at] > 1, three[at], np.uint64(0))


def placed(two: np.ndarray, parts: int, dealt: int) -> tuple[np.ndarray, np.ndarray]:
    """Part and bucket of each place, by its last two words."""
    way = mix(two ^ _DEALT) % np.uint64(parts * dealt)
    return way % np.uint64(parts), (way // np.uint64(parts)).astype(np.int64)


def beside(batch: pa.RecordBatch, column: int, at: int, n: int) -> np.ndarray:
    """The word counts that stand beside n rows from ``at`` on."""
    return batch.column(column).slice(at, n).flatten().to_numpy(zero_copy_only=False)


def cut(*columns: np.ndarray, at: np.ndarray) -> list[pa.ListArray]:
    """Each column as lists that end where the next one begins."""
    return [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(c)) for c in columns]


def starts_of(sorted_keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(sorted_keys) else np.zeros(0, np.int64)


MET = "bucket bigint, base bigint, two array<bigint>, count array<bigint>, last array<bigint>, size array<int>, three array<bigint>, c array<int>, asked array<int>, row array<int>"


def of_file(batch: pa.RecordBatch):
    """Pieces of the batch whose row numbers were given by one task, so that their distances are short."""
    cuts = np.flatnonzero(np.diff(batch.column(0).to_numpy() >> FILE)) + 1
    for begin, end in zip([0, *cuts], [*cuts, batch.num_rows]):
        if end > begin:
            yield batch.slice(begin, end - begin)


def by_bucket(bucket: np.ndarray) -> np.ndarray:
    """A stable order by bucket; short numbers are sorted by radix."""
    return np.argsort(bucket.astype(np.uint16) if len(bucket) and bucket.max() < 1 << 16 else bucket, kind="stable")


def met(rows: DataFrame, shared, parts: int, dealt: int, part: int, most: int = 1 << 20) -> DataFrame:
    """What the pass over rows (__row, __train, __t, __c) meets in one part, a row for each bucket and run of about ``most`` tokens.

    By pair: its hash; the count of the first word; the count of the second (its
    complement if it is the end); the number of its triples.
    By triple: its hash (0: the pair begins a text), how often training texts have
    it, and the rows of all texts that ask for it or its pair, as distances from
    ``base``. Nobody asks where both are taken for frequent.
    """
    names = [c.split(" ")[0] for c in MET.split(", ")]

    def of_run(h, known, n, row, train):
        frequent = shared.value[1]
        offs = np.concatenate([[0], np.cumsum(n)])
        at, two, three = ngrams(h, offs)
        its_part, bucket = placed(two, parts, dealt)
        mine = its_part == part
        at, two, three, bucket = at[mine], two[mine], three[mine], bucket[mine]
        if not len(at):
            return
        text = np.searchsorted(offs, at, "right") - 1
        # places in order of their triple, and where each triple begins there
        key = np.where(three > 0, three, ~two)
        place = np.argsort(key)
        begin = starts_of(key[place])
        times, asked = np.add.reduceat(train[text[place]].astype(np.int32), begin), np.diff(np.append(begin, len(place)))
        order = np.argsort(two[place[begin]])
        order = order[by_bucket(bucket[place[begin[order]]])]
        one = place[begin[order]]
        at, two, three, bucket = at[one], two[one], three[one], bucket[one]
        begin, times, asked = begin[order], times[order], asked[order]
        pair = starts_of(two)
        often = np.repeat(frequent.find(two[pair]) >= 0, np.diff(np.append(pair, len(two)))) & ((three == 0) | (frequent.find(three) >= 0))
        asked = np.where(often, 0, asked)
        ends = np.cumsum(asked)
        base = int(row[0])
        who = (row[text[place[np.repeat(begin - (ends - asked), asked) + np.arange(ends[-1])]]] - base).astype(np.int32)
        c, last = known[at[pair] - 1], known[at[pair]]
        of_bucket = starts_of(bucket)
        by_pair, by_triple = np.append(np.searchsorted(pair, of_bucket), len(pair)), np.append(of_bucket, len(two))
        by_row = np.concatenate([[0], ends])[by_triple]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(bucket[of_bucket]),
                pa.array(np.full(len(of_bucket), base)),
                *cut(two[pair].view(np.int64), c, np.where(h[at[pair]] == END, ~last, last), np.diff(np.append(pair, len(two))).astype(np.int32), at=by_pair),
                *cut(three.view(np.int64), times.astype(np.int32), asked.astype(np.int32), at=by_triple),
                *cut(who, at=by_row),
            ],
            names,
        )

    def run(batches):
        held, size = [], 0
        for b in (piece for whole in batches for piece in of_file(whole)):
            row, train = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            if held and row[0] >> FILE != held[0][3][0] >> FILE:
                yield from of_run(*(np.concatenate(x) for x in zip(*held)))
                held, size = [], 0
            for at, h, offs in token_hashes(b.column(2)):
                n = len(offs) - 1
                held.append((h, shared.value[0].of(h, offs, beside(b, 3, at, n)), np.diff(offs), row[at : at + n], train[at : at + n]))
                size += len(h)
                if size >= most:
                    yield from of_run(*(np.concatenate(x) for x in zip(*held)))
                    held, size = [], 0
        if held:
            yield from of_run(*(np.concatenate(x) for x in zip(*held)))

    return rows.select("__row", "__train", "__t", "__c").mapInArrow(run, MET)


def flat(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)


def weights(table: pa.Table, uni: Unigrams, priors: tuple[float, float]) -> tuple:
    """The bucket's pairs (hashes, weights) and triples (hashes, weights), each once; and of each triple as listed the places of its pair and of itself (-1: none). A pair's weight has its gain and, as it is a state as well, its failure weight."""
    two, which = np.unique(flat(table, "two").view(np.uint64), return_inverse=True)
    pair_of, times = np.repeat(which, flat(table, "size")), flat(table, "c").astype(np.int64)
    c2 = np.bincount(pair_of, times, len(two))
    last, given = np.zeros(len(two), np.int64), np.zeros(len(two))
    last[which], given[which] = flat(table, "last"), flat(table, "count")
    ends = last < 0
    c1 = np.where(ends, ~last, last)
    one = uni.chance(c1)
    three = flat(table, "three").view(np.uint64)
    seen = three > 0
    keys, first, inverse = np.unique(three[seen], return_index=True, return_inverse=True)
    triple_of = np.full(len(three), -1)
    triple_of[seen] = inverse
    c3 = np.bincount(inverse, times[seen], len(keys))
    after = (c2 + priors[0] * one) / (given + priors[0])
    of_two = np.log10(1 + c2 / (priors[0] * one)) + np.where(ends, 0.0, np.log10(priors[1] / (c2 + priors[1])))
    of_three = np.log10(1 + c3 / (priors[1] * after[pair_of[seen][first]]))
    return (two, of_two), (keys, of_three), pair_of, triple_of


def answered(found: DataFrame, shared, priors: tuple[float, float]) -> DataFrame:
    """(frequent, id, more): for each row what its n-grams of this part weigh; and the weight of each frequent n-gram, by hash.

    A bucket answers in lists, one for each 256 rows with consecutive numbers, and
    those are summed up: what leaves the buckets is a list a bucket and block, not a
    row for every bucket that a text has n-grams in.
    """

    def of(table: pa.Table) -> pa.Table:
        uni, frequent = shared.value
        (two, of_two), (three, of_three), pair_of, triple_of = weights(table, uni, priors)
        often = [frequent.find(keys) >= 0 for keys in (two, three)]
        # a frequent n-gram is added by the reader
        of_triple = np.append(np.where(often[1], 0.0, of_three), 0.0)[triple_of]
        value = np.repeat(np.where(often[0], 0.0, of_two)[pair_of] + of_triple, flat(table, "asked"))
        lengths = np.diff(table.column("row").combine_chunks().offsets.to_numpy())
        row = np.repeat(table.column("base").to_numpy(), lengths) + flat(table, "row")
        rows, which = np.unique(row, return_inverse=True)
        sums = np.bincount(which, value, len(rows)).astype(np.float64)
        hashes, weight = (np.concatenate([x[0][often[0]], x[1][often[1]]]) for x in ((two, three), (of_two, of_three)))
        ids, more = np.concatenate([hashes.view(np.int64), rows]), np.concatenate([weight, sums])
        block = np.concatenate([np.full(len(hashes), -1), rows >> 8])
        begin = starts_of(block)
        return pa.table([pa.array(block[begin], pa.int64()), *cut(ids, more, at=np.append(begin, len(ids)))], names=["block", "id", "more"])

    def summed(table: pa.Table) -> pa.Table:
        ids, which = np.unique(flat(table, "id"), return_inverse=True)
        often = table.column("block")[0].as_py() < 0
        return pa.table([np.full(len(ids), often), ids, np.bincount(which, flat(table, "more"), len(ids))], names=["frequent", "id", "more"])

    lists = found.groupBy("bucket").applyInArrow(of, "block bigint, id array<bigint>, more array<double>")
    return lists.groupBy("block").applyInArrow(summed, "frequent boolean, id bigint, more double")


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """The rows with a number before them, that of the task first."""

    def number(batches):
        row = TaskContext.get().partitionId() << FILE
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + b.num_rows)), *b.columns], [name, *b.schema.names])
            row += b.num_rows

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(number, f"{name} bigint, {schema}")


def with_counts(rows: DataFrame, table: DataFrame, uni: Unigrams, scratch: Scratch) -> DataFrame:
    """The rows with the counts (__c) of their words that aren't broadcast, in the order of ``others_of``; 0 for those that the table of counts (h, c) hasn't. Such words are rare, so no key of the join is hot."""
    shared = rows.sparkSession.sparkContext.broadcast(uni)

    def run(batches):
        for b in batches:
            row = b.column(0).to_numpy()
            for at, h, offs in token_hashes(b.column(1)):
                _, _, owner, key = others_of(h, offs, shared.value.index.find(h))
                yield pa.RecordBatch.from_arrays([pa.array(row[at + owner]), pa.array(key)], ["__key", "h"])

    asked = rows.select("__key", "__t").mapInArrow(run, "__key bigint, h bigint").join(table, "h", "left")
    lists = asked.groupBy("__key").agg(F.sort_array(F.collect_list(F.struct("h", F.coalesce("c", F.lit(0)).alias("c"))))["c"].alias("__c"))
    lists = scratch.table(lists, "lists")  # so that what was shuffled for them is gone when the texts are
    kept = [c for c in rows.columns if c != "__key"]
    return rows.join(lists, "__key", "left").select(*kept, F.coalesce("__c", F.array().cast("array<bigint>")).alias("__c"))


def score(docs: DataFrame, scratch: Scratch, train: str = "train", keep: tuple[str, ...] = ("doc_id",), text: str = "text", often_words: float = 1e-6, often: float = 1e-5, parts: int = 4, bucket_tokens: int = 1 << 19, priors: tuple[float, float] = PRIORS) -> DataFrame:
    """Trains on the rows whose ``train`` is true and scores all: the kept columns, ``n_tokens``, ``n_known`` (tokens seen in training), ``train_tokens``, ``base_score`` (add-0.1 unigrams) and ``score`` (the automaton) of every whole text."""
    spark = docs.sparkSession
    small_batches(spark)
    n_keep = len(keep)

    rows = docs.select(*(docs[c] for c in keep), F.coalesce(docs[train], F.lit(False)).alias("__train"), docs[text].cast("string").alias("__t"))
    rows = scratch.table(numbered(rows, "__key"), "rows")

    table = scratch.table(counted_words(rows.where("__train").select("__t"), often), "words")
    total, size, once, sampled = table.agg(F.coalesce(F.sum(F.when(F.col("kind") == 1, F.col("c"))), F.lit(0)), F.count_if(F.col("kind") == 1), F.count_if((F.col("kind") == 1) & (F.col("c") == 1)), F.coalesce(F.sum(F.when(F.col("kind") == 0, F.col("c"))), F.lit(0))).head()
    tokens, size, discount = int(total), int(size), min(max(once / size, 0.05), 0.95) if size else 0.0
    # relative frequencies bound both: at most 1 / often_words words, 1 / often n-grams of each order
    top = table.where((F.col("kind") == 1) & (F.col("c") >= often_words * tokens) | (F.col("kind") == 2) & (F.col("c") >= often * int(sampled))).toPandas()
    of_kind = lambda k: (top["h"].to_numpy(np.int64).view(np.uint64)[top["kind"] == k], top["c"].to_numpy(np.int64)[top["kind"] == k])
    (hashes, counts), table = of_kind(1), table.where("kind = 1").drop("kind")
    uni = Unigrams(Index(hashes), counts[np.argsort(hashes)], tokens, size, discount)
    shared = spark.sparkContext.broadcast((uni, Index(of_kind(2)[0])))
    # written, as every part goes over the same rows with the same numbers; numbered anew, so that a task's follow each other
    rows = scratch.table(numbered(with_counts(rows, table, uni, scratch), "__row"), "counted")
    scratch.drop("rows", "words", "lists")
    dealt = max(1, -(-tokens // (parts * bucket_tokens)))
    sums = [scratch.table(answered(met(rows, shared, parts, dealt, part), shared, priors), f"sums{part}") for part in range(parts if tokens else 0)]
    sums = reduce(DataFrame.unionByName, sums) if sums else spark.createDataFrame([], "frequent boolean, id bigint, more double")

    arcs = sums.where("frequent").toPandas()
    keys = arcs["id"].to_numpy(np.int64).view(np.uint64)
    below, prior = tokens + 0.1 * (size + 1), priors[0]
    machine = spark.sparkContext.broadcast((uni, Index(keys), arcs["more"].to_numpy(np.float64)[np.argsort(keys)]))
    at_text = n_keep + 2  # after the row's number, what is kept, and the flag

    def run(batches):
        uni, index, weight = machine.value
        for b in batches:
            n, known, base, total = (np.zeros(b.num_rows, t) for t in (np.int64, np.int64, np.float64, np.float64))
            for at, h, offs in token_hashes(b.column(at_text)):
                rows = np.arange(at, at + len(offs) - 1)
                n[rows] = np.diff(offs)
                if not tokens:
                    continue
                c = uni.of(h, offs, beside(b, at_text + 1, at, len(rows)))
                gain = np.log10(uni.chance(c)) + np.where((h == END) | (c == 0), 0.0, np.log10(prior / (c + prior)))
                places, two, three = ngrams(h, offs)
                for key in (two, three):
                    arc = index.find(key)
                    gain[places] += np.where(arc >= 0, weight[arc], 0.0) if len(weight) else 0.0
                by_row = lambda x: np.add.reduceat(x, offs[:-1])  # noqa: E731  every row has its end token
                known[rows], base[rows], total[rows] = by_row((c > 0).astype(np.int64)), by_row(np.log10((c + 0.1) / below)), by_row(gain)
            yield pa.RecordBatch.from_arrays([*b.columns[: n_keep + 1], pa.array(n), pa.array(known), pa.array(base), pa.array(total)], ["__row", *keep, "__n", "__known", "__base", "__score"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1 : n_keep + 1])
    read = rows.mapInArrow(run, f"__row bigint, {kept + ', ' if kept else ''}__n bigint, __known bigint, __base double, __score double")
    more = sums.where("not frequent").groupBy(F.col("id").alias("__row")).agg(F.sum("more").alias("more"))
    return read.join(more, "__row", "left").select(
        *keep,
        F.col("__n").alias("n_tokens"),
        F.col("__known").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        F.col("__base").alias("base_score"),
        (F.col("__score") + F.coalesce("more", F.lit(0))).alias("score"),
    )
