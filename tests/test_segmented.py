"""Replays cut into chunks give the rows of one walk, and no task sees a whole key."""

import random

import pytest
from pyspark.sql import functions as F

from voxmill.operators import replay


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def near(a, b):
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert len(x) == len(y)
        for u, v in zip(x, y):
            assert u == v or (isinstance(u, float) and isinstance(v, float) and u == pytest.approx(v, rel=1e-9)), (x, y)


@pytest.mark.parametrize(("failures", "probes", "timeout_s", "bad"), [(5, 3, 60, 0.5), (2, 1, 5, 0.8), (1, 3, 1000, 0.3), (3, 2, 0, 0.6), (2, 3, 30.5, 0.05)])
def test_breaker(spark, failures, probes, timeout_s, bad):
    rng = random.Random(failures)
    calls, at = [], 0
    for i in range(3000):
        at += rng.choice([0, 0, 1, 1, 2, 7, 90])
        calls.append((1 if i % 3 else rng.choice([2, 3, None]), at, i, rng.choice([None, False]) if rng.random() < bad else True))
    df = spark.createDataFrame(calls, "server_id long, at_s long, event_id long, ok boolean").repartition(6)
    how = {"failures": failures, "probes": probes, "timeout_s": timeout_s}
    assert rows_of(replay.breaker(df, **how)) == rows_of(replay.breaker(df, split=False, **how))
    assert replay.breaker(df.limit(0), **how).count() == 0


def test_calibration(spark):
    rng = random.Random(8)
    done = [(1 if i % 4 else rng.choice([2, None]), "task", i // 3, i, rng.choice([0, 5, 60, None]), rng.choice([None, 0, 1]) if rng.random() < 0.1 else rng.randrange(1, 900), rng.choice([None, 0, -4]) if rng.random() < 0.1 else rng.randrange(50, 700)) for i in range(3000)]
    df = spark.createDataFrame(done, "server_id long, work_kind string, ts_us long, event_id long, audio_sec long, actual_cs long, predicted_cs long").repartition(6)
    near(rows_of(replay.calibrate(df)), rows_of(replay.calibrate(df, split=False)))
    fast = df.withColumns({"actual_cs": F.col("event_id") % 50 + 1, "predicted_cs": F.lit(100)})
    near(rows_of(replay.calibrate(fast)), rows_of(replay.calibrate(fast, split=False)))


def test_a_busy_server_is_spread_over_tasks(spark):
    """One server with a third of all rows: each chunk is walked from its own entry, and none is much larger than the others."""
    df = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 5000).alias("server_id"), F.col("id").alias("at_s"), F.col("id").alias("event_id"), (F.hash("id") % 3 != 0).alias("ok"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    sizes = []
    real = replay.shared_folder
    try:
        replay.shared_folder = lambda s, name: sizes.append(real(s, name)) or sizes[-1]
        got = rows_of(replay.breaker(df))
        chunks = sorted(r["count"] for r in spark.read.parquet(sizes[0]).groupBy("server_id", "__chunk").count().collect())
    finally:
        replay.shared_folder = real
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == rows_of(replay.breaker(df, split=False))
    assert chunks[-1] < 60_000 / 16 * 2 and sum(chunks) == 60_000


def test_maps_are_few_however_many_keys(spark, monkeypatch):
    """Most keys lie in one chunk: only those that go on in the next one have a map, and chunks are small."""
    monkeypatch.setattr(replay, "CHUNK_BITS", 9, raising=False)
    walked, real = [], replay.walk
    monkeypatch.setattr(replay, "walk", lambda rows, *a: walked.append(rows) or real(rows, *a))
    df = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 5000).alias("server_id"), F.col("id").alias("at_s"), F.col("id").alias("event_id"), (F.hash("id") % 3 != 0).alias("ok"), F.lit("task").alias("work_kind"), F.col("id").alias("ts_us"), F.lit(60).alias("audio_sec"), (F.col("id") % 500 + 1).alias("actual_cs"), F.lit(250).alias("predicted_cs"))
    for run in (replay.breaker, replay.calibrate):
        walked.clear()
        got = rows_of(run(df))
        assert 13 <= walked[0].count() <= 60, "a map for each key"
        assert walked[1].groupBy("server_id", "__chunk").count().agg({"count": "max"}).head()[0] <= 512
        near(got, rows_of(run(df, split=False)))
