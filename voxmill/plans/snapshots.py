"""Registered snapshot changes."""

from pyspark.sql import functions as F

from voxmill import constants as C
from voxmill.operators import snapshots as op
from voxmill.operators.windows import best_level
from voxmill.operators.aggregates import benchmark_levels, lower_median
from voxmill.plans.aggregates import _runs
from voxmill.plans.registry import add
from voxmill.plans.windows import BEST

_LEGAL = ", ".join(f"('{a}','{b}')" for a, to in C.TRANSITIONS.items() for b in to)
_TO = "CASE task_id % 4 WHEN 0 THEN 'CANCELED' WHEN 1 THEN 'QUEUED' WHEN 2 THEN 'TRANSCRIBING' ELSE 'SUCCEEDED' END"
_ENDED = "('SUCCEEDED','FAILED','CANCELED')"


def _moves(d):
    return d.tasks.select("task_id", F.expr(_TO).alias("to_status"), (F.col("created_s") + 999).alias("at_s"))


add(
    "m01_transitions",
    lambda d: op.apply_transitions(d.tasks, _moves(d))[0].select("task_id", "status", "progress_bp", "completed_s"),
    f"""SELECT task_id, CASE WHEN ok THEN t ELSE status END AS status, CASE WHEN ok THEN greatest(progress_bp, CASE t WHEN 'QUEUED' THEN 1500 WHEN 'TRANSCRIBING' THEN 2000 WHEN 'SUCCEEDED' THEN 10000 ELSE 0 END) ELSE progress_bp END AS progress_bp,
CASE WHEN ok THEN CASE WHEN t IN {_ENDED} THEN created_s + 999 END ELSE completed_s END AS completed_s FROM (SELECT *, {_TO} AS t, (status, {_TO}) IN ({_LEGAL}) AS ok FROM d_tasks)""",
)
add("m01_rejected_moves", lambda d: op.apply_transitions(d.tasks, _moves(d))[1], f"SELECT task_id, status AS from_status, {_TO} AS to_status FROM d_tasks WHERE (status, {_TO}) NOT IN ({_LEGAL})")


def _cancel(d, wanted):
    return op.cancel(d.tasks, d.segments.withColumn("generation", F.col("retry_count")), wanted)


add("m02_cancel_tasks", lambda d: _cancel(d, F.col("user_id") == 4)[0].select("task_id", "status"), f"SELECT task_id, CASE WHEN user_id = 4 AND status NOT IN {_ENDED} THEN 'CANCELED' ELSE status END AS status FROM d_tasks")
_CANCELED = "SELECT segment_id, CASE WHEN h THEN 'FAILED' ELSE status END AS status, retry_count + h::INT AS generation FROM (SELECT s.*, coalesce(t.hit, false) AND s.status IN ('PENDING','DISPATCHED','TRANSCRIBING') AS h FROM d_segments s LEFT JOIN (SELECT task_id, {w} AND status NOT IN ('SUCCEEDED','FAILED','CANCELED') AS hit FROM d_tasks) t USING (task_id))"
add("m02_cancel_segments", lambda d: _cancel(d, F.col("user_id") == 4)[1].select("segment_id", "status", "generation"), _CANCELED.format(w="user_id = 4"))
add("m03_cancel_batches", lambda d: _cancel(d, F.coalesce(F.col("task_group_id") % 2 == 0, F.lit(False)))[1].select("segment_id", "status", "generation"), _CANCELED.format(w="coalesce(task_group_id % 2 = 0, false)"))
add(
    "m04_bulk_delete",
    lambda d: op.bulk_delete(d.tasks, d.task_events, d.segments, F.col("user_id") < 10),
    f"WITH a AS (SELECT task_id, status IN {_ENDED} AS gone FROM d_tasks WHERE user_id < 10) SELECT 'deleted' AS what, count(*) AS n FROM a WHERE gone UNION ALL SELECT 'skipped', count(*) FROM a WHERE NOT gone UNION ALL SELECT 'events', count(*) FROM d_events WHERE task_id IN (SELECT task_id FROM a WHERE gone) UNION ALL SELECT 'segments', count(*) FROM d_segments WHERE task_id IN (SELECT task_id FROM a WHERE gone)",
)
add(
    "m05_reset_segments",
    lambda d: op.reset_segments(d.segments, F.repeat(F.concat(F.lit("error "), F.col("segment_id").cast("string"), F.lit(";")), F.lit(200))).select("segment_id", "status", "retry_count", "assigned_server_id", F.md5("error_message").alias("history")),
    "SELECT segment_id, CASE WHEN f THEN 'PENDING' ELSE status END AS status, retry_count + f::INT AS retry_count, CASE WHEN NOT f THEN assigned_server_id END AS assigned_server_id, CASE WHEN f THEN md5(right('[retry#' || (retry_count + 1) || '] ' || repeat('error ' || segment_id || ';', 200), 2000)) END AS history FROM (SELECT *, status = 'FAILED' AS f FROM d_segments)",
)
add("m06_fail_orphans", lambda d: op.fail_orphans(d.segments, d.tasks).select("segment_id", "status"), "SELECT segment_id, CASE WHEN t.status = 'FAILED' AND s.status IN ('PENDING','DISPATCHED','TRANSCRIBING') THEN 'FAILED' ELSE s.status END AS status FROM d_segments s LEFT JOIN d_tasks t USING (task_id)")
add("m07_unbind", lambda d: op.unbind(d.tasks.where("assigned_server_id is not null"), F.col("assigned_server_id") % 2 == 0), "SELECT assigned_server_id AS server_id, a AS active, a > 0 AS refused, CASE WHEN a > 0 THEN 0 ELSE n END AS unbound FROM (SELECT assigned_server_id, count(*) FILTER (WHERE status IN ('DISPATCHED','TRANSCRIBING')) AS a, count(*) AS n FROM d_tasks WHERE assigned_server_id % 2 = 0 GROUP BY 1)")


def applied(d):
    best = best_level(lower_median(benchmark_levels(_runs(d)), "throughput_ppm"))
    return op.apply_benchmark(d.servers, best.select("server_id", "level", (F.col("throughput_ppm") / 1e6).alias("rtf"), (F.col("server_id") % 2 == 0).alias("complete")))


APPLIED = f"(SELECT s.server_id, CASE WHEN b.level IS NULL OR (s.server_id % 2 = 1 AND b.level < max_concurrency) THEN max_concurrency ELSE b.level END AS max_concurrency, coalesce(b.throughput_ppm / 1e6::DOUBLE, rtf_baseline) AS rtf_baseline, status, enabled FROM d_servers s LEFT JOIN {BEST} b USING (server_id))"
add("m08_apply_benchmark", lambda d: applied(d).select("server_id", "max_concurrency", F.round("rtf_baseline", 6).alias("rtf_baseline")), f"SELECT server_id, max_concurrency, round(rtf_baseline, 6) AS rtf_baseline FROM {APPLIED}")
add(
    "m09_backfill",
    lambda d: op.backfill(d.tasks.where("completed_s is not null").select(F.when(F.col("task_id") % 2 == 0, F.col("task_id").cast("string")).alias("outbox_id"), "task_id", "created_s", F.when(F.col("task_id") % 3 == 0, F.col("completed_s")).alias("updated_s")), "outbox_id", ["task_id", "created_s"]),
    "SELECT CASE WHEN task_id % 2 = 0 THEN task_id::VARCHAR ELSE left(sha256(task_id || ':' || created_s), 26) END AS outbox_id, task_id, created_s, CASE WHEN task_id % 3 = 0 THEN completed_s ELSE created_s END AS updated_s FROM d_tasks WHERE completed_s IS NOT NULL",
)
add(
    "m10_expired",
    lambda d: op.expired(d.files.select("file_id", F.when(F.col("file_id") % 3 == 0, "uploads").when(F.col("file_id") % 3 == 1, "results").otherwise("temp").alias("area"), (F.lit(1706659200) - F.col("file_id") % 120 * 86400).alias("mtime_s")), d.tasks.where(~F.col("status").isin(*C.TERMINAL)), 1706659200, {"uploads": 30, "results": 90, "temp": 1}).select("file_id", "area"),
    f"SELECT file_id, area FROM (SELECT file_id, CASE file_id % 3 WHEN 0 THEN 'uploads' WHEN 1 THEN 'results' ELSE 'temp' END AS area, file_id % 120 AS age FROM d_files) WHERE age > CASE area WHEN 'uploads' THEN 30 WHEN 'results' THEN 90 ELSE 1 END AND file_id NOT IN (SELECT file_id FROM d_tasks WHERE status NOT IN {_ENDED} AND file_id IS NOT NULL)",
)
add("m11_late_results", lambda d: op.reconcile_late(d.tasks, d.segments.where("status = 'SUCCEEDED'"))[1], f"SELECT task_id, status AS from_status, 'SUCCEEDED' AS to_status, 'late_result_recovered' AS event FROM d_tasks WHERE status NOT IN {_ENDED} AND task_id IN (SELECT task_id FROM d_segments WHERE status = 'SUCCEEDED')")
