"""Places in an order over all rows, without a task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from voxmill.sources.files import shared_folder


def numbered(rows: DataFrame, name: str, *order: Column) -> DataFrame:
    """The rows with ``name``, their place from 1 on in the order.

    Rows are dealt out by ranges of the order and sorted there. A row's place is its
    place in its range plus the rows of the ranges before, of which there are as many
    as partitions. Rows that tie in the whole order share a range, so it should end in
    a key. The sorted rows are written to the shared folder, as they are read twice.
    """
    to = shared_folder(rows.sparkSession, "ranks")
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    placed.write.parquet(to)
    placed = rows.sparkSession.read.schema(placed.schema).parquet(to)
    part = F.shiftright("__at", 33)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    first = sizes.select("__part", (F.sum("__n").over(W.orderBy("__part")) - F.col("__n")).alias("__before"))
    local = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(first), part == F.col("__part")).withColumn(name, F.col("__before") + local + 1).drop("__at", "__part", "__before")
