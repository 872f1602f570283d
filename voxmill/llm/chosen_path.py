"""Near duplicates: Jaccard self-join of word shingles by chosen paths.

1. Each document becomes the set of its ``k``-word shingles; equal sets are one class, of
   which only the smallest id goes on (see ``ngram_join``, which also verifies pairs).
2. Every class has a place in the root of each of some independent trees. A node picks
   ``branch`` coordinates of the minwise signatures, the same for all of its members, and
   a member goes to one child for each: the child of its minwise token there. So members
   of a child share a token, and similar ones take the same path often.
3. Nodes are handled by size, level by level. One member: dropped. At most ``small``
   members: compared exhaustively. More: all are compared with a pivot of the node, by
   blocks, and what is linked with it is one component with it. A node whose members are
   all linked with its pivot is done. One of which half or more are does not fall apart
   by branching: its other members are compared with all, in pairs of blocks, and so is
   one of at most ``medium`` members. Any larger node branches. On the last level it is
   compared in blocks too, so that nothing is left out or capped.
4. Pairs are verified on the full shingle sets, and verified links give the components.

Recall: two sets of similarity s both go to a given child with probability s. A tree loses
a pair on its way down with the probability q that solves q = (1 - s + s q)^branch, or
less if the nodes are small at once; ``trees_for`` takes as many trees as the target needs
at the threshold. Links between members that are both linked with a pivot are not looked
for: they change no component.

Skew: a node that very many share (a common passage, a template) is many blocks of
``block`` members, each with the pivot, and work then grows with its members; only what
the pivot is not linked with meets in pairs of blocks.

Nulls: a row with a null id, or with a null text or one without a word, is linked with
nothing; its component is its own id. Repeated rows are copies; an id with several texts
has a row for each, judged by its own text. An empty table gives no rows. Only the id and
the text columns are read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from voxmill.llm.common import Scratch, chunks, mix, small_batches
from voxmill.llm.ngram_join import components, key_of, set_of, shingles, verify


def trees_for(threshold: float, recall: float, branch: int) -> int:
    """Trees that find a pair at the threshold with probability ``recall`` or more, however deep the nodes are."""
    lost = 0.0
    for _ in range(1000):
        lost = (1 - threshold + threshold * lost) ** branch
    return math.ceil(math.log(1 - recall) / math.log(lost))


def signatures(docs: DataFrame, k: int, width: int, text: str, doc_id: str) -> DataFrame:
    """doc_id, key (of the shingle set; null: no word), n_shingles, bytes, minwise tokens (``width`` of them)."""
    small_batches(docs.sparkSession)
    rng = np.random.default_rng(29)
    mul = rng.integers(1, 2**63, width, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(1, 2**63, width, dtype=np.uint64)

    def run(batches):
        for b in batches:
            size = b.num_rows
            keys, counts, sizes, tokens = [None] * size, np.zeros(size, np.int64), np.zeros(size, np.int64), [None] * size
            for row, data, offs in chunks(b.column(1)):
                for i, found in shingles(data, offs, k):
                    keys[row + i], counts[row + i], sizes[row + i] = key_of(found), len(found), offs[i + 1] - offs[i]
                    low = np.full(width, np.iinfo(np.uint64).max, np.uint64)
                    for part in range(0, len(found), 512):
                        np.minimum(low, (found[part : part + 512, None] * mul + add).min(axis=0), out=low)
                    tokens[row + i] = mix(low).view(np.int64)
            offsets = np.zeros(size + 1, np.int32)
            np.cumsum([0 if t is None else width for t in tokens], out=offsets[1:])
            flat = [t for t in tokens if t is not None]
            lists = pa.ListArray.from_arrays(offsets, np.concatenate(flat) if flat else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.binary()), pa.array(counts), pa.array(sizes), lists], ["doc_id", "key", "n_shingles", "bytes", "tokens"])

    id_type = docs.schema[doc_id].dataType.simpleString()
    return docs.select(docs[doc_id], docs[text].cast("string")).mapInArrow(run, f"doc_id {id_type}, key binary, n_shingles bigint, bytes bigint, tokens array<bigint>")


def children(at: DataFrame, level: int, branch: int, choice: int) -> DataFrame:
    """(tree, node, key) one level down. at: tree, node, key, tokens. A level has ``choice`` coordinates of its own in each tree, of which a node picks ``branch``."""
    first = F.pmod(F.xxhash64("node", F.lit(level)), F.lit(choice))
    base = (F.col("tree") * choice).cast("int")

    def child(j: int):
        place = base + F.pmod(first + j, F.lit(choice)).cast("int")
        return F.xxhash64("node", place, F.get("tokens", place))

    return at.select("tree", F.explode(F.array(*(child(j) for j in range(branch)))).alias("node"), "key")


def linked(pieces: DataFrame, classes: DataFrame, texts: DataFrame, k: int, threshold: float) -> DataFrame:
    """(u, v) verified links inside pieces of work, v the smallest key linked with u through them.

    pieces: piece, key, side. Members of different sides are compared, or all with each
    other where a piece has one side. With a block's pivot, the one member of side 0 and
    the smallest key, v is the pivot.
    """
    full = pieces.join(classes.select("key", "rep"), "key").join(texts, "rep").select("piece", "key", "side", "text")

    def run(batches):
        now, found, seen = None, [], set()

        def flush():
            made = verify(found, threshold) if len(found) > 1 else []
            made = [m for m in made if m[0] != m[2]]
            return pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.binary()), pa.array([m[2] for m in made], pa.binary())], ["u", "v"])

        for batch in batches:
            for piece, key, side, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if piece != now:
                    if found:
                        yield flush()
                    now, found, seen = piece, [], set()
                its = None if key in seen else set_of(text, k)
                if its is not None and key_of(its) == key:  # an id may stand for two texts
                    seen.add(key)
                    found.append((key, 1, side, its))
        if found:
            yield flush()

    return full.repartition("piece").sortWithinPartitions("piece", "side", "key").mapInArrow(run, "u binary, v binary")


def small_pieces(places: DataFrame, nodes: DataFrame, small: int, small_bytes: int) -> DataFrame:
    """Nodes that are compared exhaustively; of those with the same members one is enough."""
    few = nodes.where((F.col("n") <= small) & (F.col("bytes") <= small_bytes))
    one = few.groupBy("n", "members").agg(F.min("node").alias("node")).select("node")
    return places.join(one, "node").select(F.col("node").alias("piece"), "key", F.lit(0).cast("long").alias("side"))


def pivot_pieces(large: DataFrame) -> DataFrame:
    """Every member of a large node with the node's pivot, in blocks. large: node, key, low, parts."""
    members = large.where("key != low").select(F.xxhash64("node", F.pmod(F.xxhash64("key"), F.col("parts"))).alias("piece"), "key", F.lit(1).cast("long").alias("side"))
    pivots = large.where("key = low").select("node", "key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    return members.unionByName(pivots.select(F.xxhash64("node", "part").alias("piece"), "key", F.lit(0).cast("long").alias("side")))


def rest_pieces(rest: DataFrame, block: int, block_bytes: int, scratch: Scratch, name: str) -> DataFrame:
    """Pairs of blocks of a large node, but for those of members that are all linked with the pivot. rest: node, key, bytes, inside (linked with the pivot, or the pivot itself)."""
    parts = rest.groupBy("node", "inside").agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("bytes") / block_bytes)).alias("parts"))
    dealt = scratch.table(rest.join(parts, ["node", "inside"]).select("node", "key", "inside", F.xxhash64("inside", F.pmod(F.xxhash64("key"), F.col("parts"))).alias("id")), f"{name}dealt")
    blocks = scratch.table(dealt.select("node", "inside", "id").distinct(), f"{name}blocks")
    outside = blocks.where(~F.col("inside")).select("node", F.col("id").alias("a"))
    met = outside.join(blocks.select("node", "inside", F.col("id").alias("b")), "node").where(F.col("inside") | (F.col("a") <= F.col("b")))
    sides = met.select(F.xxhash64("node", "a", "b").alias("piece"), "node", F.explode(F.array_distinct(F.array("a", "b"))).alias("id"))
    return dealt.join(scratch.table(sides, f"{name}sides"), ["node", "id"]).select("piece", "key", F.col("id").alias("side"))


def joined(docs: DataFrame, threshold: float, k: int, recall: float, branch: int, depth: int, small: int, medium: int, block: int, block_bytes: int, text: str, doc_id: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(signed, table): rows with the key and size of their shingle set; and (key, rep, class_id) of each set, class_id null without links."""
    trees, choice = trees_for(threshold, recall, branch), 2 * branch
    signed = scratch.table(signatures(docs, k, trees * depth * choice, text, doc_id), "signed")
    known = signed.where("key is not null and doc_id is not null")
    classes = scratch.table(known.groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("bytes").alias("bytes"), F.first("tokens").alias("tokens")), "classes")
    texts = docs.select(docs[doc_id].alias("rep"), docs[text].cast("string").alias("text")).where("text is not null")
    at = classes.select(F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"), "key", "tokens").withColumn("node", F.xxhash64("tree"))
    links, rest = [], None  # pieces of the rest of large nodes are compared with those of the next level, so that texts are dealt out once a level

    for level in range(depth):
        own = at.withColumn("tokens", F.slice("tokens", level * trees * choice + 1, trees * choice))
        places = scratch.table(children(own, level, branch, choice).join(classes.select("key", "bytes"), "key"), f"places{level}")
        nodes = places.groupBy("node").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.sum(F.xxhash64("key").cast("decimal(38,0)")).alias("members"), F.min("key").alias("low")).where("n > 1")
        nodes = scratch.table(nodes, f"nodes{level}")
        big = nodes.where((F.col("n") > small) | (F.col("bytes") > block_bytes)).select("node", "low", F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("bytes") / block_bytes)).alias("parts"))
        large = scratch.table(places.join(big, "node"), f"large{level}")
        pieces = small_pieces(places, nodes, small, block_bytes).unionByName(pivot_pieces(large))
        pieces, rest = pieces if rest is None else pieces.unionByName(rest), None
        links.append(scratch.table(linked(scratch.table(pieces, f"pieces{level}"), classes, texts, k, threshold), f"links{level}"))
        scratch.drop(f"at{level - 1}", f"places{level}", f"nodes{level}", f"pieces{level}")
        if large.isEmpty():
            break
        if level == 0:
            # all that is compared from here on is in large nodes; only these texts are dealt out again
            needed = large.select("key").distinct().join(classes.select("key", "rep"), "key").select("rep").distinct()
            texts = scratch.table(texts.join(needed, "rep", "left_semi"), "texts")
        to_pivot = links[-1].select(F.col("u").alias("key"), F.col("v").alias("low"), F.lit(True).alias("met")).distinct()
        marked = large.join(to_pivot, ["key", "low"], "left").select("tree", "node", "key", "bytes", ((F.col("key") == F.col("low")) | F.col("met").isNotNull()).alias("inside"))
        marked = scratch.table(marked, f"marked{level}")
        state = marked.groupBy("node").agg(F.count("*").alias("n"), F.count_if("inside").alias("m")).where("m < n")
        state = scratch.table(state.select("node", (F.lit(level == depth - 1) | (F.col("m") * 2 >= F.col("n")) | (F.col("n") <= medium)).alias("due")), f"state{level}")
        rest = marked.join(state.where("due").select("node"), "node").select("node", "key", "bytes", "inside")
        rest = scratch.table(rest_pieces(rest, block, block_bytes, scratch, f"rest{level}"), f"rest{level}")
        if state.where("not due").isEmpty():
            break
        sparse = marked.join(state.where("not due").select("node"), "node")
        at = scratch.table(sparse.join(classes.select("key", "tokens"), "key").select("tree", "node", "key", "tokens"), f"at{level}")
        scratch.drop(f"large{level}", f"marked{level}", f"state{level}", f"rest{level}dealt", f"rest{level}blocks", f"rest{level}sides")
    if rest is not None:
        links.append(scratch.table(linked(rest, classes, texts, k, threshold), "rest_links"))
    comps = rooted(links, scratch, "final")
    named = comps.join(classes.select("key", "rep"), "key")
    # written, so that the join by root has a plain shuffle on both sides and a large component can be split
    lowest = scratch.table(named.groupBy("root").agg(F.min("rep").alias("class_id")), "lowest")
    table = classes.select("key", "rep").join(named.join(lowest, "root").select("key", "class_id"), "key", "left")
    return signed, scratch.table(table, "result")


def rooted(links: list[DataFrame], scratch: Scratch, name: str) -> DataFrame:
    """(key, root) of all keys with links."""
    every = links[0]
    for more in links[1:]:
        every = every.unionByName(more)
    final = components(every, scratch, name)
    return final.unionByName(final.select(F.col("root").alias("v"), "root").distinct()).withColumnRenamed("v", "key")


def near_duplicates(docs: DataFrame, threshold: float = 0.8, k: int = 4, recall: float = 0.9995, branch: int = 2, depth: int = 6, small: int = 64, medium: int = 2048, block: int = 512, block_bytes: int = 8 << 20, text: str = "text", doc_id: str = "doc_id", scratch: Scratch | None = None) -> DataFrame:
    """One row per document: its id, n_shingles, ``component_id`` (the smallest id reachable by links; null for a null id) and ``kept`` (that is its own id; a row without an id is kept)."""
    signed, table = joined(docs, threshold, k, recall, branch, depth, small, medium, block, block_bytes, text, doc_id, scratch or Scratch(docs.sparkSession))
    lowest = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("class_id", "rep", "doc_id"))
    rows = signed.select("doc_id", "key", "n_shingles").join(table, "key", "left").select("doc_id", "n_shingles", lowest.alias("component_id"))
    return rows.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
