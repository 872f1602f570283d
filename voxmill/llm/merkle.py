"""Merkle manifest of a dataset: one tree a group, and one over the groups' roots.

1. A row's leaf is the digest of its fields. Leaves of a group ascend by the order
   column and have places from 0 on. Places come from one sort by ranges: a row's
   place in its range plus the rows of all ranges before it.
2. Every level is a self-join of nodes with their siblings: a node is sent to the
   computed places of its siblings (place XOR 1 in a binary tree, else the other
   slots of its run) and met there by an equijoin on group and place. Each node then
   holds what stands left and right of it in its run.
3. Rows in slot zero put out the run's parent. A group is done when one node is left;
   its digest is the group's root. The groups' roots are leaves of a tree of the same
   kind, by group in order.
4. Proofs come back down: a node's steps are its own siblings and its parent's steps.

Digests are SHA-256 in lower-case hex, and a parent is the digest of its children's
hex digests joined together. No key is hot: every node has a place of its own, and a
group of any size is many places.

Nulls: a null field is ``-`` in its leaf; a null group is a group, and comes first; a
null order value comes first in its group. Rows with the same order value are placed by
leaf. Repeated rows are leaves each, and have the same leaf but proofs of their own
places. Empty texts and very long ones are fields like others. An empty table gives no
rows. Columns that are not named are not read, so that they may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from voxmill.llm.common import Scratch, ascii_lower

STEPS = "array<struct<left:binary,right:binary>>"


@dataclass
class Manifest:
    """rows: (key, group, place, leaf, changed, subroot, root, steps), one a row of the dataset; nodes: (group, level, place, digest) below the roots; groups: (group, n, subroot, root)."""

    rows: DataFrame
    nodes: DataFrame
    groups: DataFrame


def field(col: Column) -> Column:
    """A value as it enters a leaf: ``-`` if null, else its length in bytes, a colon, and it."""
    text = col.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*fields: Column) -> Column:
    """Digest of a row's fields, in their order."""
    return F.unhex(F.sha2(F.concat(*(field(f) for f in fields)), 256))


def text_of(digests: Column) -> Column:
    """Digests as hex text."""
    return F.lower(F.hex(digests))


def lowered(text: Column) -> Column:
    """A text with A-Z lower-cased: a change that a manifest has to show."""
    return ascii_lower(text)


def siblings(place: Column, fanout: int) -> Column:
    """Places of the other nodes of a node's run, as if it were full."""
    if fanout == 2:
        return F.array(place.bitwiseXOR(F.lit(1).cast("long")))
    slot = F.pmod(place, F.lit(fanout))
    return F.transform(F.sequence(F.lit(1), F.lit(fanout - 1)), lambda o: place - slot + F.pmod(slot + o, F.lit(fanout)))


def numbered(rows: DataFrame, order: list[str], scratch: Scratch, name: str) -> DataFrame:
    """The rows with ``i``, their place from 0 on in the order of all, nulls first. Rows that tie throughout should be told apart by a last column of the order, or they share a range."""
    local = F.monotonically_increasing_id()
    placed = scratch.table(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", local), name)
    part = F.shiftright("__at", 33)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("n"))  # a row for each partition of the sort
    first = sizes.select("__part", (F.sum("n").over(W.orderBy("__part")) - F.col("n")).alias("__start"))
    return placed.join(F.broadcast(first), part == F.col("__part")).withColumn("i", F.col("__start") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).drop("__at", "__part", "__start")


def level(nodes: DataFrame, fanout: int, keep: list[str]) -> DataFrame:
    """Nodes (g, place, n, digest) of one level met by their siblings: left and right are the digests on either side in the run, joined."""
    sent = nodes.select("g", "n", "digest", F.pmod("place", F.lit(fanout)).alias("slot"), F.explode(siblings(F.col("place"), fanout)).alias("place")).where("place < n").drop("n")
    met = nodes.join(sent.withColumnRenamed("digest", "other"), ["g", "place"], "left")
    own = F.pmod("place", F.lit(fanout))
    gathered = met.groupBy("g", "place").agg(*(F.first(c).alias(c) for c in ("n", "digest", *keep)), F.sort_array(F.collect_list(F.when(F.col("slot").isNotNull(), F.struct("slot", "other")))).alias("others"))
    side = lambda pick: F.aggregate(F.filter("others", pick), F.lit(b""), lambda s, x: F.concat(s, x["other"]))
    return gathered.select("g", "place", "n", "digest", *keep, side(lambda x: x["slot"] < own).alias("left"), side(lambda x: x["slot"] > own).alias("right"))


def parents(met: DataFrame, fanout: int) -> DataFrame:
    digest = F.unhex(F.sha2(text_of(F.concat("digest", "right")), 256))
    return met.where(F.pmod("place", F.lit(fanout)) == 0).select("g", F.expr(f"place div {fanout}").alias("place"), F.expr(f"(n + {fanout - 1}) div {fanout}").alias("n"), digest.alias("digest"))


def climb(nodes: DataFrame, most: int, fanout: int, scratch: Scratch, name: str, keep: list[str]) -> tuple[list[DataFrame], list[DataFrame]]:
    """(levels, tops) from the leaves up: the nodes of each level with their siblings, and the groups whose one last node is on that level. ``most``: leaves of the largest group."""
    levels, tops = [], []
    while True:
        tops.append(nodes.where("n = 1").select("g", "digest", *(keep if not levels else [])))
        if most <= 1:
            return levels, tops
        levels.append(scratch.table(level(nodes.where("n > 1"), fanout, keep if not levels else []), f"{name}{len(levels)}"))
        nodes, most = parents(levels[-1], fanout), -(-most // fanout)


def descend(levels: list[DataFrame], tops: list[DataFrame], fanout: int) -> DataFrame:
    """Leaves with their steps up to the root. levels: see ``climb``; tops: (g, place, steps, subroot, root) of the nodes that are a group's last one, by level, and what the leaves keep on the lowest."""
    above = tops[-1]
    step = F.array(F.struct("left", "right"))
    for at in range(len(levels) - 1, -1, -1):
        up = above.select("g", F.col("place").alias("up"), "steps", "subroot", "root")
        joined = levels[at].withColumn("up", F.expr(f"place div {fanout}")).join(up, ["g", "up"]).withColumn("steps", F.concat(step, "steps")).drop("up", "n", "left", "right")
        above = joined.unionByName(tops[at], allowMissingColumns=True)
    return above


def build(docs: DataFrame, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), group: str = "lang", key: str = "doc_id", changed: Column | None = None, fanout: int = 8, scratch: Scratch | None = None) -> Manifest:
    """The manifest of a table. ``changed``: another leaf (or null) that is carried beside a row's own, to be held against the tree with ``fold``."""
    scratch = scratch or Scratch(docs.sparkSession)
    rows = docs.select(
        docs[key].alias("key"),
        docs[group].alias("group"),
        leaf_digest(*(docs[f] for f in fields)).alias("digest"),
        (F.lit(None).cast("binary") if changed is None else changed).alias("changed"),
        F.rand(5).alias("salt"),  # kept in the table; tells equal rows apart, so that they don't fill one range
    )
    leaves = numbered(scratch.table(rows, "leaves"), ["group", "key", "digest", "salt"], scratch, "sorted").drop("salt")
    sizes = scratch.table(leaves.groupBy("group").agg(F.count("*").alias("n"), F.min("i").alias("start")), "sizes")
    groups = scratch.table(numbered(sizes, ["start"], scratch, "groups").withColumnRenamed("i", "g"), "groups")
    most = groups.agg(F.max("n")).head()[0] or 0
    known = groups.select(F.col("group").alias("its"), "g", "n", "start")
    nodes = scratch.table(leaves.join(known, F.col("group").eqNullSafe(F.col("its"))).select("g", (F.col("i") - F.col("start")).alias("place"), "n", "digest", "key", "group", "changed"), "nodes")
    scratch.drop("leaves", "sorted", "sizes")
    keep = ["key", "group", "changed"]
    levels, tops = climb(nodes, most, fanout, scratch, "level", keep)

    zero = F.lit(0).cast("long")
    subroots = tops[0].select("g", "digest")
    for t in tops[1:]:
        subroots = subroots.unionByName(t)
    subroots = scratch.table(subroots, "subroots")
    n_groups = subroots.count()
    above, top = climb(subroots.select(zero.alias("g"), F.col("g").alias("place"), F.lit(n_groups).cast("long").alias("n"), "digest", F.col("digest").alias("subroot")), n_groups, fanout, scratch, "top", ["subroot"])
    none = F.array().cast(STEPS)
    ends = [t.select("g", zero.alias("place"), "digest", *(["subroot"] if not k else []), none.alias("steps"), F.col("digest").alias("root")) for k, t in enumerate(top)]
    # on the lowest level of the upper tree a place is a group, and its digest that group's root
    ends = [e if "subroot" in e.columns else e.withColumn("subroot", F.lit(None).cast("binary")) for e in ends]
    over = descend([a.drop("subroot") for a in above], ends, fanout) if above else ends[0]
    over = scratch.table(over.select(F.col("place").alias("g"), F.col("digest").alias("subroot"), "steps", "root"), "over")

    tops = [t.join(over, "g").select("g", zero.alias("place"), "steps", "subroot", "root", *(["digest", *keep] if not k else [])) for k, t in enumerate(tops)]
    rows = descend(levels, tops, fanout).select("key", "group", "place", F.col("digest").alias("leaf"), "changed", "subroot", "root", "steps")
    below = nodes.select("group", F.lit(0).alias("level"), "place", "digest")
    for k, met in enumerate(levels[1:], 1):
        below = below.unionByName(met.join(groups.select("g", "group"), "g").select("group", F.lit(k).alias("level"), "place", "digest"))
    return Manifest(rows, below, groups.join(over, "g").select("group", "n", "subroot", "root"))


def proof_text(steps: Column) -> Column:
    """The digests of a proof, leaf to root and left to right, as hex text."""
    return F.array_join(F.transform(steps, lambda s: F.concat(text_of(s["left"]), text_of(s["right"]))), "")


def fold(leaf: Column, steps: Column) -> Column:
    """The root, as hex text, that a leaf and a proof give."""
    return F.aggregate(steps, text_of(leaf), lambda d, s: F.sha2(F.concat(text_of(s["left"]), d, text_of(s["right"])), 256))


def verified(rows: DataFrame) -> DataFrame:
    """Per row of a manifest: its digests and proof as hex text, and whether the leaf in hand (``changed``, where it has one) folds to the root."""
    again = fold(F.coalesce("changed", "leaf"), F.col("steps"))
    out = rows.select("key", text_of(F.col("leaf")).alias("leaf"), text_of(F.col("subroot")).alias("subroot"), text_of(F.col("root")).alias("root"), F.sha2(proof_text(F.col("steps")), 256).alias("proof_sha256"), again.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
