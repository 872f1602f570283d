"""Registries of more than 10,000 rows."""

from voxmill.operators import jobs, joins, windows


def fleet(spark, n):
    return spark.range(1, n + 1).selectExpr("id as server_id", "true as enabled", "'ONLINE' as status", "1L as max_concurrency", "0.2D as rtf_baseline")


def test_quotas(spark):
    batches = spark.createDataFrame([(1, 24_000), (2, 12_005)], "batch long, n long")
    servers = fleet(spark, 12_000).selectExpr("server_id", "1.0D as speed")
    got = jobs.quotas(batches, servers).groupBy("batch").agg({"quota": "sum", "*": "count"}).collect()
    assert {(r.batch, r["sum(quota)"], r["count(1)"]) for r in got} == {(1, 24_000, 12_000), (2, 12_005, 12_000)}


def test_best_server(spark):
    items = spark.createDataFrame([(1, 10.0), (2, 0.0)], "item long, audio_s double")
    got = joins.best_server(items, fleet(spark, 12_000)).collect()
    assert {tuple(r) for r in got} == {(1, 1, 7.0), (2, 1, 5.0)}


def test_rebalance(spark):
    plan = spark.createDataFrame([(1, 7, 10.0, 100.0), (1, 8, 10.0, 90.0)], "server_id long, item long, audio_s double, finish_s double")
    got = windows.rebalance(plan, fleet(spark, 12_000)).collect()
    assert len(got) == 11_999 and {(r.item, r.gain) for r in got} == {(7, 93.0)}
