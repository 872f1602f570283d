"""Registered streams: each is run over the events as they are, to their end."""

from pyspark.sql import functions as F

from voxmill.plans.aggregates import FAILURES
from voxmill.plans.registry import add
from voxmill.plans.jobs import MERGED, digested, results
from voxmill.plans.replay import BREAKER, CALIBRATION, emitted_sql, spaced_sql
from voxmill.streaming import streams as op

_STATUS = lambda: F.when(F.col("event_type") == "signup", "PREPROCESSING").when(F.col("event_type") == "view", "QUEUED").when(F.col("event_type") == "click", "DISPATCHED").when(F.col("event_type") == "purchase", "SUCCEEDED").otherwise("FAILED")


def _events(d):
    e = op.event_stream(d.spark, f"{d.sf_dir}/events.parquet")
    ts = F.col("ts").cast("timestamp")
    return e.select("event_id", ts.alias("ts"), F.col("user_id").alias("task_id"), F.unix_micros(ts).alias("ts_us"), F.unix_seconds(ts).alias("at_s"), _STATUS().alias("status"), F.round(F.col("value") * 100).cast("long").alias("value"))


def _completions(d):
    kind = F.when(F.col("event_id") % 3 == 0, "segment").otherwise("task")
    return _events(d).where("value > 0").select("event_id", F.col("task_id").alias("server_id"), kind.alias("work_kind"), "ts_us", F.lit(300).cast("long").alias("audio_sec"), F.col("value").alias("actual_cs"), (4000 + (F.col("event_id") * 37) % 6000).alias("predicted_cs"))


def _segment_ends(d):
    return _events(d).select("ts", "at_s", "task_id", (F.col("event_id") % 3).alias("segment_index"), F.lit(3).alias("n_segments"), "status", "event_id")


WATERMARK_S = "(SELECT floor(epoch_us(max(ts)) / 1e3) / 1e3 FROM events)"  # where the stream ends


def _latest(stream, name: str, keys: list[str]):
    return op.drain_latest(stream, name, keys, keys[0])


add(
    "t01_progress_changes",
    lambda d: op.drain(op.progress_changes(_events(d).select("ts", "task_id", "at_s", "event_id", F.when(F.col("status") == "FAILED", "DISPATCHED").otherwise(F.col("status")).alias("status"), ((F.col("event_id") % 50) / 50.0).alias("progress"))), "t01"),
    emitted_sql("c.at_s - w.opened > 3600"),
)
add("t02_window_counts", lambda d: _latest(op.window_counts(_events(d)), "t02", ["window_s"]), f"SELECT window_s, failed, ended FROM {FAILURES}")
add(
    "t03_sliding_bytes",
    lambda d: _latest(op.sliding_bytes(_events(d).select("ts", (F.col("task_id") % 5).alias("user_id"), F.col("value").alias("bytes"))), "t03", ["user_id", "window_s"]),
    "SELECT user_id, w AS window_s, sum(bytes)::BIGINT AS bytes FROM (SELECT user_id % 5 AS user_id, cast(round(value * 100) AS BIGINT) AS bytes, unnest(range(s - s % 10 - 50, s - s % 10 + 1, 10)) AS w FROM (SELECT *, epoch_us(ts) // 1000000 AS s FROM events)) GROUP BY 1, 2",
)
add(
    "t04_first_submissions",
    lambda d: op.drain(op.first_submissions(_events(d).select("ts", "at_s", "event_id", (F.col("task_id") % 5).alias("user_id"), (F.col("event_id") % 7).alias("fingerprint"))), "t04"),
    spaced_sql("user_id, fingerprint", "SELECT user_id % 5 AS user_id, event_id % 7 AS fingerprint, epoch_us(ts) // 1000000 AS at_s, event_id FROM events", "1800"),
)
add(
    "t05_rolling_p90",
    lambda d: op.drain(op.rolling_p90(_events(d).where("value > 0").select("event_id", F.col("task_id").alias("server_id"), F.when(F.col("event_id") % 3 == 0, "segment").otherwise("task").alias("work_kind"), "ts_us", "value")), "t05"),
    "SELECT event_id, server_id, work_kind, CASE WHEN n >= 3 THEN s[(9 * n + 9) // 10] END AS p90 FROM (SELECT *, count(*) OVER w AS n, list_sort(list(actual_cs) OVER w) AS s FROM d_completions WHERE actual_cs > 0 WINDOW w AS (PARTITION BY server_id, work_kind ORDER BY ts_us, event_id ROWS 49 PRECEDING))",
)
add(
    "t05_calibration",
    lambda d: op.drain(op.calibration(_completions(d)), "t05c"),
    CALIBRATION,
)
add(
    "t06_breaker",
    lambda d: op.drain(op.breaker(_events(d).select("ts", F.col("task_id").alias("server_id"), "at_s", "event_id", (F.col("status") != "FAILED").alias("ok")), failures=2, timeout_s=3600), "t06"),
    f"WITH {BREAKER.strip()} SELECT server_id, event_id, let_through, state FROM calls UNION ALL SELECT server_id, NULL, NULL, 'HALF_OPEN' FROM (SELECT server_id, max_by(state, rn) AS state, max_by(since, rn) AS since FROM calls GROUP BY 1) WHERE state = 'OPEN' AND since + 3600 < {WATERMARK_S}",
)
add(
    "t07_heartbeat_timeouts",
    lambda d: op.drain(op.heartbeat_timeouts(_events(d).select(F.col("task_id").alias("server_id"), "ts"), 3600), "t07"),
    f"SELECT user_id AS server_id, epoch_us(max(ts)) // 1000000 AS last_s, 'OFFLINE' AS state FROM events GROUP BY 1 HAVING epoch_us(max(ts)) // 1000000 + 3600 < {WATERMARK_S}",
)
add(
    "t08_activity_sessions",
    lambda d: op.drain_to_end(_events(d).select(F.col("task_id").alias("server_id"), "ts"), op.activity_sessions, "t08", 3600),
    """SELECT server_id, min(us) // 1000000 AS start_s, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY server_id ORDER BY us, event_id) AS session FROM (
      SELECT user_id AS server_id, event_id, epoch_us(ts) AS us, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) < 300000000 THEN 0 ELSE 1 END AS new FROM events))
    GROUP BY server_id, session""",
)
COMPLETED = """
WITH r AS (SELECT *, sum(new) OVER (PARTITION BY task_id ORDER BY at_s, event_id) AS run FROM (SELECT *, CASE WHEN at_s - lag(at_s) OVER (PARTITION BY task_id ORDER BY at_s, event_id) <= 604800 THEN 0 ELSE 1 END AS new
    FROM (SELECT task_id, event_id, ts_us // 1000000 AS at_s, event_id % 3 AS seg, to_status AS status FROM d_events))),
e AS (SELECT *, row_number() OVER (PARTITION BY task_id, run ORDER BY at_s, event_id) AS rn FROM r WHERE status IN ('SUCCEEDED', 'FAILED')),
done AS (SELECT task_id, run, max(rn) AS rn FROM (SELECT task_id, run, seg, min(rn) AS rn FROM e GROUP BY 1, 2, 3) GROUP BY 1, 2 HAVING count(*) = 3),
last AS (SELECT e.task_id, e.run, e.seg, max_by(status, e.rn) AS status FROM e JOIN done d ON d.task_id = e.task_id AND d.run = e.run AND e.rn <= d.rn GROUP BY 1, 2, 3)
SELECT d.task_id, e.event_id, l.succeeded FROM done d JOIN e USING (task_id, run, rn) JOIN (SELECT task_id, run, bool_and(status = 'SUCCEEDED') AS succeeded FROM last GROUP BY 1, 2) l USING (task_id, run)"""
add("t09_completed_tasks", lambda d: op.drain(op.completed_tasks(_segment_ends(d)), "t09"), COMPLETED)


def _merged_once(d):
    to = op.folder(d.spark, "t09m")
    op.merged_once(op.completed_tasks(_segment_ends(d)), results(d), to).awaitTermination()
    return digested(d.spark.read.parquet(f"{to}/out"))


add("t09_merged_transcripts", _merged_once, f"SELECT * FROM ({MERGED}) WHERE task_id IN (SELECT task_id FROM ({COMPLETED}) WHERE succeeded)")
add(
    "t10_fresh_results",
    lambda d: op.drain(op.fresh_results(_events(d).select("task_id", "event_id", (F.col("event_id") % 3).alias("generation")), d.tasks.select("task_id", (F.col("retry_count") % 3).alias("run_generation"))).select("event_id", "stale"), "t10"),
    "SELECT event_id, (event_id % 3) IS DISTINCT FROM t.retry_count % 3 AS stale FROM events LEFT JOIN d_tasks t ON t.task_id = events.user_id",
)
add("t11_latest_by_server", lambda d: op.drain_latest(op.latest_state(_events(d), "task_id", "status", ["ts_us", "event_id"]), "t11", ["task_id"], "version").select("task_id", "status"), "SELECT task_id, to_status AS status FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY ts_us DESC, event_id DESC) AS rn FROM d_events) WHERE rn = 1")
add("t12_current_tasks", lambda d: op.drain_latest(op.latest_state(_events(d).withColumn("progress", F.col("event_id") % 100), "task_id", "progress", ["ts_us", "event_id"]), "t12", ["task_id"], "version").select("task_id", "progress"), "SELECT task_id, event_id % 100 AS progress FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY ts_us DESC, event_id DESC) AS rn FROM d_events) WHERE rn = 1")
