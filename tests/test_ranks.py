"""Quotas, rebalancing and ranks against plain loops, and their plans."""

import random
import re

import pytest
from pyspark.sql import functions as F

from voxmill.operators import aggregates, jobs, ranks, windows


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def plain_quotas(n, servers):
    """servers: [(id, speed)]; shares half to even, the rest to the fastest, the excess from the slowest upward."""
    total = sum(s for _, s in servers)
    quota = {i: round(n * s / total) for i, s in servers}
    diff = n - sum(quota.values())
    if diff > 0:
        quota[min(servers, key=lambda x: (-x[1], x[0]))[0]] += diff
    for i, _ in sorted(servers, key=lambda x: (x[1], x[0])):
        take = min(quota[i], max(0, -diff))
        quota[i] -= take
        diff += take
    return quota


@pytest.mark.parametrize("speeds", [[1.0] * 40, [0.25 * (i % 9 + 1) for i in range(60)], [3.0], []])
def test_quotas(spark, speeds):
    servers = [(100 + i, s) for i, s in enumerate(speeds)]
    sizes = [0, 1, 2, 3, 7, 20, 61, 500]
    batches = spark.createDataFrame(list(enumerate(sizes)), "batch long, n long")
    fleet = spark.createDataFrame([*servers, (1, 0.0), (2, None)], "server_id long, speed double")
    want = {(b, i): q for b, n in enumerate(sizes) if n and servers for i, q in plain_quotas(n, servers).items()}
    got = jobs.quotas(batches, fleet)
    assert {(r.batch, r.server_id): r.quota for r in got.collect()} == {k: q for k, q in want.items() if q}
    assert "CartesianProduct" not in plan_of(got) and "NestedLoop" not in plan_of(got)
    assert {(r.batch, r.server_id): r.quota for r in jobs.quotas(batches, fleet, zeros=True).collect()} == want


def test_rows_of_zeros_are_not_dealt_out(spark):
    """Batches by servers are many: they are made where they are returned, by many tasks."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the tables were large
    batches = spark.range(50).select(F.col("id").alias("batch"), (F.col("id") % 3 + 1).alias("n"))
    fleet = spark.range(200).select(F.col("id").alias("server_id"), (F.col("id") % 5 + 1.0).alias("speed"))
    got = jobs.quotas(batches, fleet, zeros=True)
    plan = plan_of(got)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert not [keys for keys in re.findall(r"hashpartitioning\(([^)]*)\)", plan) if "server_id" in keys]
    row = got.agg(F.count("*"), F.count_distinct("batch", "server_id"), F.sum("quota")).head()
    assert tuple(row) == (10_000, 10_000, sum(i % 3 + 1 for i in range(50)))


def test_quotas_of_many_blocks_and_racks(spark):
    """More batches than a block in each task and more servers than a rack: a batch of n items gets what n items get."""
    servers = [(100 + i, 0.25 * (i % 9 + 1)) for i in range(130)]
    assert len(servers) > 2 * jobs.RACK
    many = 4 * spark.sparkContext.defaultParallelism * jobs.BLOCK + 1000
    batches = spark.range(many).select(F.col("id").alias("batch"), (F.col("id") % 80).alias("n"))
    got = jobs.quotas(batches, spark.createDataFrame(servers, "server_id long, speed double"), zeros=True)
    same = got.join(batches, "batch").groupBy("n", "server_id").agg(F.min("quota"), F.max("quota"), F.count("*"), F.count_distinct("batch"))
    times = {n: len(range(n, many, 80)) for n in range(1, 80)}
    want = {(n, i): (q, q, times[n], times[n]) for n in times for i, q in plain_quotas(n, servers).items()}
    assert {tuple(r[:2]): tuple(r[2:]) for r in same.collect()} == want


def test_rows_of_zeros_are_small_where_written(spark, tmp_path):
    """Batches by servers are written by columns in a fraction of a byte a row, and are all there."""
    batches = spark.range(1600).select(F.col("id").alias("batch"), (F.col("id") % 3 + 1).alias("n"))
    fleet = spark.range(3000).select(F.col("id").alias("server_id"), (F.col("id") % 5 + 1.0).alias("speed"))
    got = jobs.quotas(batches, fleet, zeros=True)
    assert "NestedLoop" not in plan_of(got)
    got.write.parquet(to := str(tmp_path / "quotas"))
    pair = F.sum(F.xxhash64("batch", "server_id").cast("decimal(20)"))
    want = batches.select("batch").crossJoin(fleet.select("server_id")).agg(F.count("*"), pair).head()
    assert tuple(spark.read.parquet(to).agg(F.count("*"), pair).head()) == tuple(want)
    assert sum(p.stat().st_size for p in (tmp_path / "quotas").glob("*.parquet")) < 0.25 * want[0]


def plain_rebalance(items, idle, tail=3):
    by = {}
    for s, i, audio, finish in items:
        by.setdefault(s, []).append((finish, i, audio))
    ends = [x for v in by.values() for x in sorted(v, reverse=True)[:tail]]
    out = {}
    for sid, rtf in idle:
        gains = [(f - (a * rtf + 5), i) for f, i, a in ends if f - (a * rtf + 5) >= max(3.0, 0.05 * f)]
        if gains:
            out[sid] = (max(gains)[1], round(max(gains)[0], 3))
    return out


SERVER = "server_id long, rtf_baseline double, enabled boolean, status string, max_concurrency int"


def test_rebalance(spark):
    rng = random.Random(3)
    items = [(s, s * 100 + k, rng.randrange(10, 4000), float(rng.randrange(1, 3000))) for s in range(60) for k in range(5)]
    idle = [(1000 + i, rng.choice([None, 0.05, 0.1, 0.3, 0.7, 1.5, 9.0])) for i in range(40)]
    plan = spark.createDataFrame(items, "server_id long, item long, audio_s long, finish_s double")
    servers = spark.createDataFrame([(i, r, True, "ONLINE", 2) for i, r in idle] + [(5, 0.1, True, "ONLINE", 2), (2000, 0.1, False, "ONLINE", 2)], SERVER)
    want = plain_rebalance(items, [(i, 0.3 if r is None else r) for i, r in idle])
    for block in (1, 2, 256):
        got = windows.rebalance(plan, servers, block=block)
        assert {r.idle_id: (r.item, r.gain) for r in got.collect()} == want and want
        assert "CartesianProduct" not in plan_of(got) and "NestedLoop" not in plan_of(got)
    assert windows.rebalance(plan.limit(0), servers).count() == 0
    few = windows.undominated(plan.select("item", "audio_s", "finish_s")).count()
    assert few == sum(not any((f2 >= f and a2 <= a and (f2, -a2) != (f, -a)) or ((f2, a2) == (f, a) and j > i) for _, j, a2, f2 in items) for _, i, a, f in items)


def test_rebalance_with_many_speeds(spark):
    items = [(s, s, 10 * s + 1, 1000.0 + 9 * s) for s in range(300)]
    plan = spark.createDataFrame(items, "server_id long, item long, audio_s long, finish_s double")
    servers = spark.range(1000, 101_000).select(F.col("id").alias("server_id"), (F.col("id") / 50_000).alias("rtf_baseline"), F.lit(True).alias("enabled"), F.lit("ONLINE").alias("status"), F.lit(1).alias("max_concurrency"))
    got = {r.idle_id: (r.item, r.gain) for r in windows.rebalance(plan, servers).where("idle_id % 9973 = 0").collect()}
    assert got == plain_rebalance(items, [(i, i / 50_000) for i in range(1000, 101_000) if i % 9973 == 0])


def test_numbered_with_ties(spark):
    rows = spark.range(0, 3000, 1, 7).select("id", (F.col("id") % 2).alias("x"))
    got = ranks.numbered(rows, "place", F.desc("x"), F.asc("id")).collect()
    want = sorted(((i % 2, i) for i in range(3000)), key=lambda t: (-t[0], t[1]))
    assert [i for _, i in want] == [r.id for r in sorted(got, key=lambda r: r.place)] and sorted(r.place for r in got) == list(range(1, 3001))
    same = spark.createDataFrame([(i, 4, 0.5) for i in range(50)], "server_id long, max_concurrency int, rtf_baseline double")
    assert [(r.server_id, r.rank) for r in sorted(aggregates.capacity_ranking(same).collect(), key=lambda r: r.rank)] == [(i, i + 1) for i in range(50)]
