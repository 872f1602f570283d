"""Near duplicates: Jaccard self-join of word n-grams by banded MinHash.

1. Each document becomes the set of its ``k``-word shingles (64-bit hashes; A-Z
   lower-cased, words split at white space; a text of fewer words is one
   shingle). Equal sets form one *class*, and only its smallest id goes on:
   thousands of copies cost one row each.
2. ``band_plan`` picks bands and rows for the target recall at the threshold.
   Classes are dealt out by band hash; those that share one are candidates.
3. Every class with candidates takes the smallest key among its bands' members as
   its label. Classes of one label are a *block*; a large one is split by hash into
   blocks of about ``block`` members. Two blocks whose members share a band are a
   piece of work, and so is a block by itself: a pair of candidates falls into one
   piece, and unrelated texts that candidates chain together do not meet.
4. Inside a piece, pairs are verified on the full shingle sets. A piece gives one
   row per member, not per pair: the weight of its verified links, and the smallest
   member that it is linked with through them.
5. Verified links give the final components.

Nulls: a row with a null id, or with a null text or one without a word, is never
linked; its class is its own id and it has no links. Repeated rows count as
copies; an id with several texts has a row for each, and each is judged by its own
text. An empty table gives no rows. Only the id and the text columns are read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from voxmill.llm.common import LOWER_BYTES, Scratch, chunks, fold, free_name, hash_words, mix, small_batches, words

def band_plan(threshold: float, recall: float, most: int = 256) -> tuple[int, int]:
    """(bands, rows): the most rows a band, so the fewest false candidates, that give the recall at the threshold with at most ``most`` hashes."""
    best = (most, 1)
    for rows in range(1, 33):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows <= most:
            best = (bands, rows)
    return best


def shingles(data: np.ndarray, offs: np.ndarray, k: int):
    """Yields (row, sorted distinct shingle hashes) for every row with a word."""
    data = LOWER_BYTES[data]
    starts, ends, first = words(data, offs)
    h = hash_words(data, starts, ends)
    runs = fold(h, k) if len(h) >= k else np.zeros(0, np.uint64)
    for i in range(len(offs) - 1):
        a, b = int(first[i]), int(first[i + 1])
        if b - a >= k:
            yield i, np.unique(runs[a : b - k + 1])
        elif b > a:
            yield i, mix(np.array([int(fold(h[a:b], b - a)[0]) ^ (b - a)], np.uint64))


def set_of(text: str, k: int) -> np.ndarray | None:
    data = np.frombuffer(text.encode(), np.uint8)
    return next((s for _, s in shingles(data, np.array([0, len(data)]), k)), None)


def key_of(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def signature_rows(docs: DataFrame, k: int, bands: int, rows: int, text: str, doc_id: str) -> DataFrame:
    """doc_id, two hashes of the text, key (of the shingle set; null: no word), bytes, bands."""
    small_batches(docs.sparkSession)
    n = bands * rows
    rng = np.random.default_rng(11)
    mul = rng.integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(1, 2**63, n, dtype=np.uint64)
    band_mul = rng.integers(1, 2**63, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    band_add = rng.integers(1, 2**63, bands, dtype=np.uint64)

    def run(batches):
        for b in batches:
            size = b.num_rows
            keys, sizes, sigs = [None] * size, np.zeros(size, np.int64), [None] * size
            for row, data, offs in chunks(b.column(3)):
                for i, found in shingles(data, offs, k):
                    keys[row + i], sizes[row + i] = key_of(found), offs[i + 1] - offs[i]
                    low = np.full(n, np.iinfo(np.uint64).max, np.uint64)
                    for part in range(0, len(found), 512):
                        np.minimum(low, (found[part : part + 512, None] * mul + add).min(axis=0), out=low)
                    sigs[row + i] = mix((mix(low).reshape(bands, rows) * band_mul).sum(axis=1, dtype=np.uint64) + band_add).view(np.int64)
            flat = [s for s in sigs if s is not None]
            offsets = np.zeros(size + 1, np.int32)
            np.cumsum([0 if s is None else bands for s in sigs], out=offsets[1:])
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:3], pa.array(keys, pa.binary()), pa.array(sizes), pa.ListArray.from_arrays(offsets, np.concatenate(flat) if flat else np.zeros(0, np.int64))],
                ["doc_id", "t1", "t2", "key", "bytes", "bands"],
            )

    id_type = docs.schema[doc_id].dataType.simpleString()
    return docs.select(docs[doc_id], *text_hashes(docs[text]), docs[text].cast("string")).mapInArrow(run, f"doc_id {id_type}, t1 bigint, t2 bigint, key binary, bytes bigint, bands array<bigint>")


def text_hashes(text: Column) -> tuple[Column, Column]:
    """Two hashes that tell a text from all others."""
    return F.xxhash64(text.cast("string")), F.xxhash64(text.cast("string"), F.lit(17))


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(v, root): the smallest vertex of each vertex's component, for edges (u, v) of any comparable type.

    Large-star and small-star by turns: every vertex points to the smallest of its
    neighbours until all edges point to roots. Each turn is written to the shared
    folder; the driver sees a count and a checksum.
    """
    now = scratch.table(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}0")
    seen, turn = None, 0
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written first: both sides of the join are then plain shuffles, and a vertex with very many neighbours can be split
        low = scratch.table(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{name}low")
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = scratch.table(large, f"{name}large")
        low = scratch.table(large.groupBy("u").agg(F.min("v").alias("m")), f"{name}low")
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        now = scratch.table(small, f"{name}{turn + 1}")
        scratch.drop(f"{name}{turn}", f"{name}low", f"{name}large")
        turn += 1
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head())
        if state == seen:
            return now.select(F.col("u").alias("v"), F.col("v").alias("root"))
        seen = state


def verify(members: list[tuple], threshold: float, row_block: int = 256):
    """Links among the members of one piece.

    members: (key, weight, side, shingle set). Pairs are members of different sides, or
    any two of them where only one side is present. Gives for each member the
    summed weight of its links and the smallest key linked with it through them.
    """
    sets = [m[3] for m in members]
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.float64)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, ids, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts[ids] > 1  # a shingle of one member is in no intersection
    owner, ids = owner[shared], ids[shared]
    side = np.array([m[2] for m in members])
    weight = np.array([m[1] for m in members], np.int64)
    links, root = np.zeros(n, np.int64), list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    first = np.searchsorted(owner, np.arange(n + 1))
    one_side = len(set(side.tolist())) == 1
    for a in range(0, n, row_block):
        a2 = min(a + row_block, n)
        own = ids[first[a] : first[a2]]
        cols, local = np.unique(own, return_inverse=True)
        if not len(cols):
            continue
        left = np.zeros((a2 - a, len(cols)), np.float32)
        left[owner[first[a] : first[a2]] - a, local] = 1
        for b in range(a, n, row_block):
            b2 = min(b + row_block, n)
            right = np.zeros((b2 - b, len(cols)), np.float32)
            other = ids[first[b] : first[b2]]
            at = np.minimum(np.searchsorted(cols, other), len(cols) - 1)
            hit = cols[at] == other
            right[owner[first[b] : first[b2]][hit] - b, at[hit]] = 1
            both = (left @ right.T).astype(np.float64)
            total = sizes[a:a2, None] + sizes[None, b:b2] - both
            linked = both >= threshold * total - 1e-9
            linked &= np.arange(a, a2)[:, None] < np.arange(b, b2)[None, :]
            if not one_side:
                linked &= side[a:a2, None] != side[None, b:b2]
            links[a:a2] += linked @ weight[b:b2]
            links[b:b2] += weight[a:a2] @ linked
            for i, j in np.argwhere(linked):
                x, y = find(a + int(i)), find(b + int(j))
                if x != y:
                    root[y] = x
    least: dict[int, bytes] = {}
    for i in range(n):
        r = find(i)
        least[r] = min(least.get(r, members[i][0]), members[i][0])
    return [(members[i][0], int(links[i]), least[find(i)]) for i in range(n)]


def linked(docs: DataFrame, threshold: float, k: int, recall: float, block: int, block_bytes: int, text: str, doc_id: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(signed, classes): the rows with the key of their shingle set; and (key, rep, copies, class_id, root, links) of each set, the last three null without links."""
    bands, rows = band_plan(threshold, recall)
    signed = scratch.table(signature_rows(docs, k, bands, rows, text, doc_id), "signed")
    known = signed.where("key is not null and doc_id is not null")
    classes = scratch.table(known.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("bytes").alias("bytes"), F.first("bands").alias("bands")), "classes")

    dealt = classes.select("key", "bytes", F.explode("bands").alias("band"))
    # written first, so that the joins below have a plain shuffle on both sides and a band that very many classes share can be split
    shared = scratch.table(dealt.groupBy("band").agg(F.count("*").alias("n"), F.min("key").alias("low")).where("n > 1").drop("n"), "shared")
    met = scratch.table(dealt.join(shared, "band"), "met")
    labels = scratch.table(met.groupBy("key").agg(F.min("low").alias("label"), F.first("bytes").alias("bytes")), "labels")
    parts = labels.groupBy("label").agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("bytes") / block_bytes)).cast("int").alias("parts"))
    members = scratch.table(labels.join(parts, "label").select("key", F.xxhash64("label", F.pmod(F.xxhash64("key"), F.col("parts"))).alias("block")), "members")
    blocks = scratch.table(met.select("key", "band").join(members, "key").select("band", "block").distinct(), "blocks")
    # blocks of a band by themselves and with each other; most bands have one
    pairs = blocks.join(blocks.select("band", F.col("block").alias("other")), "band").where("block <= other").select(F.col("block").alias("a"), F.col("other").alias("b")).distinct()
    pairs = scratch.table(pairs, "pieces")
    sides = pairs.select("a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("block"))

    texts = docs.select(docs[doc_id].alias("rep"), docs[text].cast("string").alias("text")).where("text is not null")
    full = members.join(classes.select("key", "rep", "copies"), "key").join(texts, "rep")
    work = full.join(sides, "block").select("a", "b", "key", F.col("copies").alias("weight"), F.col("block").alias("side"), "text")

    def run(batches):
        now, found, seen = None, [], set()

        def flush():
            # two members at least; where two sides are due, both must be there
            out = verify(found, threshold) if len(found) > 1 and (now[0] == now[1] or len({m[2] for m in found}) == 2) else []
            return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.binary())], ["key", "links", "least"])

        for batch in batches:
            for a, b, key, weight, side, body in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if (a, b) != now:
                    if found:
                        yield flush()
                    now, found, seen = (a, b), [], set()
                its = None if key in seen else set_of(body, k)
                if its is not None and key_of(its) == key:  # an id may stand for two texts
                    seen.add(key)
                    found.append((key, weight, side, its))
        if found:
            yield flush()

    piece = work.repartition("a", "b").sortWithinPartitions("a", "b", "key")
    found = scratch.table(piece.mapInArrow(run, "key binary, links bigint, least binary").where("links > 0"), "found")
    final = components(found.select(F.col("key").alias("u"), F.col("least").alias("v")), scratch, "final")
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    final = final.unionByName(final.select(F.col("root").alias("v"), "root").distinct()).withColumnRenamed("v", "key")
    named = final.join(classes.select("key", "rep"), "key")
    # written, so that the join by root has a plain shuffle on both sides and a large component can be split
    lowest = scratch.table(named.groupBy("root").agg(F.min("rep").alias("class_id")), "lowest")
    table = classes.select("key", "rep", "copies").join(named.join(lowest, "root").join(links, "key").select("key", "class_id", "root", "links"), "key", "left")
    table = scratch.table(table, "result")
    scratch.drop("classes", "shared", "met", "labels", "members", "blocks", "pieces", "found")
    return signed, table


def similar(docs: DataFrame, threshold: float = 0.8, k: int = 5, recall: float = 0.9995, block: int = 192, block_bytes: int = 8 << 20, text: str = "text", doc_id: str = "doc_id", scratch: Scratch | None = None) -> DataFrame:
    """One row per document: its id, ``class_id`` (smallest id of its connected component), ``copy_of`` (smallest id with the same shingle set) and ``n_links`` (other documents at or above the threshold, copies included)."""
    signed, table = linked(docs, threshold, k, recall, block, block_bytes, text, doc_id, scratch or Scratch(docs.sparkSession))
    return signed.select("doc_id", "key").join(table, "key", "left").select(
        "doc_id",
        F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("class_id", "rep", "doc_id")).alias("class_id"),
        F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("rep", "doc_id")).alias("copy_of"),
        F.when(F.col("doc_id").isNull() | F.col("key").isNull(), F.lit(0)).otherwise(F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"),
    )


def keep_one(docs: DataFrame, threshold: float = 0.8, k: int = 5, recall: float = 0.9995, block: int = 192, block_bytes: int = 8 << 20, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Of the documents of each connected component the one with the smallest id (of its texts there, if several, the one with the smallest hash). All columns stay.

    Rows are judged by id and text together, so an id's other texts stay. Of rows
    with the same id and text one stays, the first by a hash of its columns. Rows
    without an id stay, and so do those without a word.
    """
    scratch = Scratch(docs.sparkSession)
    signed, table = linked(docs, threshold, k, recall, block, block_bytes, text, doc_id, scratch)
    place = F.struct("doc_id", "t1", "t2")
    rows = signed.where("key is not null and doc_id is not null").join(table.select("key", F.coalesce("root", "key").alias("root")), "key").select("root", place.alias("place")).distinct()
    rows = scratch.table(rows, "places")
    best = scratch.table(rows.groupBy("root").agg(F.min("place").alias("best")), "best")  # so that a large component can be split
    lost = rows.join(best, "root").where("place != best").select("place.*")
    t1, t2, n = (free_name(docs, f"__vx_{x}") for x in ("t1", "t2", "n"))
    marked = docs.withColumns(dict(zip((t1, t2), text_hashes(docs[text]))))
    rest = marked.join(lost.select(F.col("doc_id").alias(doc_id), F.col("t1").alias(t1), F.col("t2").alias(t2)), [doc_id, t1, t2], "left_anti")
    plain = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    again = W.partitionBy(doc_id, t1, t2).orderBy(F.xxhash64(*plain))
    return rest.withColumn(n, F.row_number().over(again)).where((F.col(n) == 1) | F.col(doc_id).isNull()).select(*(F.col(f"`{c}`") for c in docs.columns))
