"""A large table's segments come in pieces of bounded size, and the rows stay the same."""

from pyspark.sql import functions as F

from voxmill.plans import domain

SF = "/root/testdata/sf0.01"


def test_segments_of_a_large_table(spark, monkeypatch):
    plain = domain.Domain(spark, SF)
    want = plain.segments.join(plain.tasks.select("task_id", F.col("status").alias("parent")), "task_id")
    monkeypatch.setattr(domain, "PIECE_BYTES", 20_000, raising=False)
    d = domain.Domain(spark, SF)
    pieces = d.segments.groupBy(F.spark_partition_id().alias("piece")).agg(F.count("*").alias("n"), F.count_distinct("task_id").alias("tasks")).collect()
    rows = sum(p.n for p in pieces)
    assert len(pieces) > 30 and max(p.n for p in pieces) < rows / 15
    assert sum(p.tasks for p in pieces) == d.segments.select("task_id").distinct().count(), "a task lies in one piece"
    got = d.segments.join(d.tasks.select("task_id", F.col("status").alias("parent")), "task_id")
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()
    assert "REPARTITION(l_orderkey)" in domain.oracle("SELECT * FROM d_segments")


def test_a_small_table_is_dealt_out_as_before(spark):
    assert domain.Domain(spark, SF)._dealt("lineitem") == ""
