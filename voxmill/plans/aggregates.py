"""Registered aggregations."""

from pyspark.sql import functions as F

from voxmill import constants as C
from voxmill.operators import aggregates as op
from voxmill.plans.registry import add

AS_OF = "(SELECT max(created_s) + 43200 FROM d_tasks)"
_COUNTS = """count(*) FILTER (WHERE status IN ('DISPATCHED','TRANSCRIBING')) AS slots_used, count(*) FILTER (WHERE status IN ('PENDING','PREPROCESSING','QUEUED')) AS queue_depth,
  count(*) FILTER (WHERE status = 'SUCCEEDED' AND completed_s >= m - m % 86400) AS done_today{more}, count(*) FILTER (WHERE status IN ('SUCCEEDED','FAILED') AND completed_s >= m - 86400) AS finished_24h"""
_AT = f"(SELECT *, {AS_OF} AS m FROM d_tasks)"
add(
    "a01_work_counts",
    lambda d: op.work_counts(d.tasks, d.as_of_s),
    f"SELECT {_COUNTS.format(more=', count(*) FILTER (WHERE status = ' + chr(39) + 'FAILED' + chr(39) + ' AND completed_s >= m - m % 86400) AS failed_today')}, count(*) FILTER (WHERE status = 'SUCCEEDED' AND completed_s >= m - 86400) AS succeeded_24h FROM {_AT}",
)
add("a02_work_counts_by_user", lambda d: op.work_counts_by_user(d.tasks, d.as_of_s), f"SELECT user_id, grouping(user_id)::INT AS is_total, {_COUNTS.format(more='')} FROM {_AT} GROUP BY GROUPING SETS ((user_id), ())")
add("a03_success_rate", lambda d: op.success_rate(d.tasks, d.as_of_s), f"SELECT user_id, CASE WHEN f > 0 THEN round(s * 100.0::DOUBLE / f, 1) ELSE 0.0 END::DOUBLE AS success_rate FROM (SELECT user_id, count(*) FILTER (WHERE status = 'SUCCEEDED' AND completed_s >= m - 86400) AS s, count(*) FILTER (WHERE status IN ('SUCCEEDED','FAILED') AND completed_s >= m - 86400) AS f FROM {_AT} GROUP BY 1)")
add("a04_fleet_summary", lambda d: op.fleet_summary(d.servers), "SELECT count(*) AS total, count(*) FILTER (WHERE status = 'ONLINE') AS online, coalesce(sum(max_concurrency), 0)::BIGINT AS slots, round(avg(CASE WHEN status = 'ONLINE' AND rtf_baseline <> 0 THEN rtf_baseline END), 4) AS avg_rtf FROM d_servers")
add(
    "a05_batch_overview",
    lambda d: op.batch_overview(d.tasks),
    """SELECT task_group_id, total, succeeded, failed, canceled, total - succeeded - failed - canceled AS in_progress, round(bp::DOUBLE / total)::BIGINT AS progress_bp, succeeded + failed + canceled = total AS is_complete FROM (
SELECT task_group_id, count(*) AS total, count(*) FILTER (WHERE status = 'SUCCEEDED') AS succeeded, count(*) FILTER (WHERE status = 'FAILED') AS failed, count(*) FILTER (WHERE status = 'CANCELED') AS canceled, sum(progress_bp) AS bp FROM d_tasks WHERE task_group_id IS NOT NULL GROUP BY 1)""",
)
for _name, _df, _view, _key, _states in (("a06_status_by_batch", "tasks", "d_tasks", "task_group_id", C.TASK_STATES), ("a06_status_by_task", "segments", "d_segments", "task_id", ("PENDING", "DISPATCHED", "TRANSCRIBING", "SUCCEEDED", "FAILED")), ("a06_status_by_server", "segments", "d_segments", "assigned_server_id", ("DISPATCHED", "TRANSCRIBING", "SUCCEEDED", "FAILED"))):
    add(_name, lambda d, _df=_df, _key=_key, _states=_states: op.status_pivot(getattr(d, _df), _key, _states), f"SELECT {_key}, " + ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s.lower()}" for s in _states) + f" FROM {_view} GROUP BY 1")
add(
    "a07_segment_summary",
    lambda d: op.segment_summary(d.segments),
    "SELECT task_id, count(*) AS total, count(*) FILTER (WHERE status = 'SUCCEEDED') AS succeeded, count(*) FILTER (WHERE status = 'FAILED') AS failed, count(*) FILTER (WHERE status = 'PENDING') AS pending, count(*) FILTER (WHERE status IN ('DISPATCHED','TRANSCRIBING')) AS active, coalesce(array_to_string(list_sort(list(DISTINCT assigned_server_id) FILTER (WHERE assigned_server_id IS NOT NULL)), ','), '') AS servers FROM d_segments GROUP BY 1",
)
add("a08_batches_of_size", lambda d: op.batches_of_size(d.tasks, 24), "SELECT task_group_id, count(*) AS n FROM d_tasks WHERE task_group_id IS NOT NULL GROUP BY 1 HAVING count(*) = 24")
add("a09_cross_server", lambda d: op.cross_server(d.segments), "SELECT task_id, count(DISTINCT assigned_server_id) AS servers FROM d_segments GROUP BY 1 HAVING count(DISTINCT assigned_server_id) > 1")


def _steal_events(d):
    kind = F.when(F.col("event_id") % 5 == 0, F.lit("{broken work_steal")).when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"event_type": "work_steal", "estimated_gain_sec": '), (F.col("event_id") % 40).cast("string"), F.lit(', "est_stolen_sec": "'), (F.col("event_id") % 7).cast("string"), F.lit('"}'))).otherwise(F.col("payload_json"))
    return d.task_events.withColumn("payload_json", kind)


add("a10_steals", lambda d: op.steals(_steal_events(d)), "SELECT task_id, count(*) AS steals, round(sum(event_id % 40)::DOUBLE, 1) AS gain, round(sum(event_id % 7)::DOUBLE, 1) AS stolen FROM d_events WHERE event_id % 5 <> 0 AND event_id % 2 = 0 GROUP BY 1")
IDLE = """idle_work AS (SELECT t.task_group_id, t.started_s AS a, t.completed_s AS b, CASE WHEN t.task_id IN (SELECT task_id FROM d_segments WHERE started_s IS NOT NULL AND completed_s IS NOT NULL) THEN 0 ELSE t.completed_s - t.started_s END AS busy
  FROM d_tasks t WHERE task_group_id IS NOT NULL AND started_s IS NOT NULL AND completed_s IS NOT NULL
  UNION ALL SELECT t.task_group_id, s.started_s, s.completed_s, s.completed_s - s.started_s FROM d_segments s JOIN d_tasks t USING (task_id) WHERE t.task_group_id IS NOT NULL AND s.started_s IS NOT NULL AND s.completed_s IS NOT NULL),
idle_spans AS (SELECT task_group_id, max(b) - min(a) AS wall, sum(busy)::BIGINT AS busy FROM idle_work GROUP BY 1),
idle AS (SELECT g.task_group_id, wall, busy, CASE WHEN wall <= 0 THEN 0 ELSE greatest(0, wall * (SELECT sum(max_concurrency) FROM d_servers WHERE enabled AND status = 'ONLINE') - busy) END::BIGINT AS idle_slot_seconds
  FROM (SELECT DISTINCT task_group_id FROM d_tasks WHERE task_group_id IS NOT NULL) g LEFT JOIN idle_spans USING (task_group_id))"""
add("a11_idle_slots", lambda d: op.idle_slots(d.tasks, d.segments, d.servers), f"WITH {IDLE} SELECT task_group_id, wall, busy, idle_slot_seconds FROM idle")
add("a12_segment_progress", lambda d: op.segment_progress(d.segments), "SELECT task_id, total_ms, done_ms, round(least(0.95::DOUBLE, 0.2::DOUBLE + 0.75::DOUBLE * done_ms / total_ms), 4) AS progress FROM (SELECT task_id, sum(keep_end_ms - keep_start_ms)::BIGINT AS total_ms, sum(CASE WHEN status = 'SUCCEEDED' THEN keep_end_ms - keep_start_ms ELSE 0 END)::BIGINT AS done_ms FROM d_segments GROUP BY 1)")
add(
    "a13_slot_use",
    lambda d: op.slot_use(d.tasks, d.segments, d.servers),
    """SELECT server_id, max_concurrency, coalesce(n, 0) AS used, coalesce(n, 0) > max_concurrency AS over FROM d_servers LEFT JOIN (SELECT assigned_server_id AS server_id, count(*) AS n FROM (
  SELECT assigned_server_id FROM d_tasks WHERE status IN ('DISPATCHED','TRANSCRIBING') AND task_id NOT IN (SELECT task_id FROM d_segments) UNION ALL SELECT assigned_server_id FROM d_segments WHERE status IN ('DISPATCHED','TRANSCRIBING')) GROUP BY 1) USING (server_id)""",
)
add(
    "a14_slot_report",
    lambda d: op.slot_report(d.tasks, d.segments),
    """SELECT *, count(*) OVER (PARTITION BY assigned_server_id) AS n, sum(zombie) OVER (PARTITION BY assigned_server_id)::BIGINT AS zombies FROM (
  SELECT assigned_server_id, 't' || task_id AS work, 0 AS zombie FROM d_tasks WHERE status IN ('DISPATCHED','TRANSCRIBING') AND task_id NOT IN (SELECT task_id FROM d_segments)
  UNION ALL SELECT s.assigned_server_id, 's' || s.segment_id, (t.status IN ('SUCCEEDED','FAILED','CANCELED'))::INT FROM d_segments s JOIN d_tasks t USING (task_id) WHERE s.status IN ('DISPATCHED','TRANSCRIBING')) WHERE assigned_server_id IS NOT NULL""",
)
add("a15_cancel_preview", lambda d: op.cancel_preview(d.tasks, d.segments), "SELECT task_group_id, count(*) AS tasks, coalesce(sum(n), 0)::BIGINT AS segments FROM d_tasks LEFT JOIN (SELECT task_id, count(*) AS n FROM d_segments WHERE status IN ('PENDING','DISPATCHED','TRANSCRIBING') GROUP BY 1) USING (task_id) WHERE status NOT IN ('SUCCEEDED','FAILED','CANCELED') GROUP BY 1")


def _runs(d):
    return d.completions.select("server_id", (F.col("event_id") % 4 + 1).alias("level"), (F.expr("event_id div 4") % 3).alias("repeat"), (F.col("actual_cs") % 997).alias("upload_ms"), F.col("actual_cs").alias("final_ms"), (F.col("audio_sec") * 1000).alias("audio_ms"))


RUNS = "(SELECT server_id, event_id % 4 + 1 AS level, (event_id // 4) % 3 AS repeat, actual_cs % 997 AS upload_ms, actual_cs AS final_ms, audio_sec * 1000 AS audio_ms FROM d_completions)"
LEVELS = f"""(SELECT server_id, level, repeat, count(*) AS n, round(sum(final_ms)::DOUBLE / count(*), 3) AS mean_ms, max(final_ms) AS max_ms, max(final_ms) - min(final_ms) AS spread_ms, max(final_ms) - max(upload_ms) AS tail_ms,
  (max(final_ms) * 1000000 // sum(audio_ms))::BIGINT AS throughput_ppm, (sum(final_ms) * 1000000 // sum(audio_ms))::BIGINT AS per_file_ppm FROM {RUNS} GROUP BY 1, 2, 3)"""
add("a16_benchmark_levels", lambda d: op.benchmark_levels(_runs(d)), f"SELECT * FROM {LEVELS}")
add(
    "a17_lower_median",
    lambda d: op.lower_median(op.benchmark_levels(_runs(d)), "throughput_ppm"),
    f"SELECT * EXCLUDE (rn, c) FROM (SELECT *, row_number() OVER (PARTITION BY server_id, level ORDER BY throughput_ppm, repeat) AS rn, count(*) OVER (PARTITION BY server_id, level) AS c FROM {LEVELS}) WHERE rn = (c + 1) // 2",
)
add(
    "a18_extremes",
    lambda d: op.extremes(d.completions.select((F.col("event_id") % 211).alias("file_id"), "server_id", F.col("actual_cs").alias("ms"))),
    "SELECT file_id, (list(server_id ORDER BY ms, server_id))[1] AS fastest, (list(server_id ORDER BY ms DESC, server_id DESC))[1] AS slowest, CASE WHEN min(ms) > 0 THEN round(max(ms) / min(ms)::DOUBLE, 3) END AS ratio FROM (SELECT event_id % 211 AS file_id, server_id, actual_cs AS ms FROM d_completions) GROUP BY 1",
)
SPEED = "max_concurrency / greatest(coalesce(rtf_baseline, 0.3::DOUBLE), 0.01::DOUBLE)"
add("a19_capacity_ranking", lambda d: op.capacity_ranking(d.servers), f"SELECT server_id, round(s, 4) AS speed, CASE WHEN max(s) OVER () > 0 THEN round(s / max(s) OVER (), 4) ELSE 0.0 END::DOUBLE AS relative, row_number() OVER (ORDER BY s DESC, server_id)::INT AS rank FROM (SELECT server_id, {SPEED} AS s FROM d_servers)")


def plan_table(d):
    """Planned work, from the tasks that wait or run: batch, server, item, estimate and planned start and finish."""
    t = d.tasks.where("task_group_id is not null and assigned_server_id is not null")
    return t.select(F.col("task_group_id").alias("batch"), F.col("assigned_server_id").alias("server_id"), (F.col("task_id") % 3).alias("slot"), F.col("task_id").alias("item"), (F.col("task_id") % 97 + 1).alias("est_s"), ((F.col("task_id") * 13) % 300).alias("start_s"), ((F.col("task_id") * 13) % 300 + F.col("task_id") % 97 + 1).alias("finish_s"))


PLAN = "(SELECT task_group_id AS batch, assigned_server_id AS server_id, task_id % 3 AS slot, task_id AS item, task_id % 97 + 1 AS est_s, (task_id * 13) % 300 AS start_s, (task_id * 13) % 300 + task_id % 97 + 1 AS finish_s FROM d_tasks WHERE task_group_id IS NOT NULL AND assigned_server_id IS NOT NULL)"
CROWDED = f"(SELECT * REPLACE (server_id - server_id % 3 AS server_id) FROM {PLAN})"


def crowded(plan):
    """The plan with all work on every third server, so that others are idle."""
    return plan.withColumn("server_id", F.col("server_id") - F.col("server_id") % 3)


add("a20_plan_load", lambda d: op.plan_load(plan_table(d)), f"SELECT *, max(finish_s) OVER (PARTITION BY batch) AS makespan_s FROM (SELECT batch, server_id, count(*) AS items, max(finish_s) AS finish_s FROM {PLAN} GROUP BY 1, 2)")
add("a21_queue_left", lambda d: op.queue_left(plan_table(d)), f"SELECT server_id, sum(est_s)::BIGINT AS left_s, max(finish_s) AS last_finish_s, (list(item ORDER BY finish_s DESC, item DESC))[1] AS last_item FROM {PLAN} GROUP BY 1")
add(
    "a22_imbalance",
    lambda d: op.imbalance(plan_table(d), d.servers),
    f"""SELECT *, CASE WHEN idle > 0 AND most >= 30 THEN 'exhausted' WHEN least > 0 AND most > 1.5 * least THEN 'imbalanced' ELSE 'balanced' END AS verdict FROM (SELECT count(*) FILTER (WHERE l = 0) AS idle, max(l) AS most, coalesce(min(CASE WHEN l > 0 THEN l END), 0) AS least FROM (
  SELECT coalesce(left_s, 0)::BIGINT AS l FROM d_servers LEFT JOIN (SELECT server_id, sum(est_s) AS left_s FROM {PLAN} GROUP BY 1) USING (server_id) WHERE enabled AND status = 'ONLINE' AND max_concurrency > 0))""",
)
add("a23_task_summary", lambda d: op.task_summary(d.tasks, F.when(F.col("task_id") % 3 == 0, " ").when(F.col("status") == "SUCCEEDED", "x/y.json")), "SELECT status, count(*) AS n, count(*) FILTER (WHERE task_id % 3 <> 0 AND status = 'SUCCEEDED') AS with_result FROM d_tasks GROUP BY 1")
add(
    "a24_folder_summary",
    lambda d: op.folder_summary(d.files.withColumn("mtime", (F.col("file_id") * 31) % 1009), F.col("user_id"), 3),
    "SELECT user_id AS folder, count(*) AS n, sum(size_bytes)::BIGINT AS bytes, string_agg(file_id, ',' ORDER BY rn) FILTER (WHERE rn <= 3) AS newest FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY (file_id * 31) % 1009 DESC, file_id) AS rn FROM d_files) GROUP BY 1",
)
add(
    "a25_reconcile",
    lambda d: op.reconcile({"tasks": d.tasks, "files": d.files, "servers": d.servers}, d.orders.agg(F.count("*").alias("expected")).select(F.lit("tasks").alias("table"), "expected").unionByName(d.orders.agg(F.count("*").alias("expected")).select(F.lit("files").alias("table"), "expected"))),
    "SELECT \"table\", expected, actual FROM (SELECT 'tasks' AS \"table\", count(*) AS expected FROM orders UNION ALL SELECT 'files', count(*) FROM orders) e FULL JOIN (SELECT 'tasks' AS \"table\", count(*) AS actual FROM d_tasks UNION ALL SELECT 'files', count(*) FROM d_files UNION ALL SELECT 'servers', count(*) FROM d_servers) a USING (\"table\") WHERE expected IS DISTINCT FROM actual",
)
add(
    "a26_reclaimable",
    lambda d: op.reclaimable(d.files, F.when(F.col("file_id") % 3 == 0, "uploads").when(F.col("file_id") % 3 == 1, "results").otherwise("temp")),
    "SELECT area, sum(size_bytes)::BIGINT AS bytes, CASE WHEN area = 'uploads' THEN 0 ELSE sum(size_bytes) END::BIGINT AS bytes_without_uploads FROM (SELECT *, CASE file_id % 3 WHEN 0 THEN 'uploads' WHEN 1 THEN 'results' ELSE 'temp' END AS area FROM d_files) GROUP BY 1",
)
add("a27_manifest_totals", lambda d: op.manifest_totals(d.files, "user_id", 8), "SELECT user_id, count(*) AS files, sum(size_bytes)::BIGINT AS bytes, coalesce(sum(duration_sec), 0)::BIGINT AS seconds, ((count(*) + 7) // 8)::BIGINT AS chunks FROM d_files GROUP BY 1")
add(
    "a28_submit_summary",
    lambda d: op.submit_summary(d.tasks, "user_id", F.when(F.col("status") == "FAILED", "failed").when(F.col("retry_count") > 2, "deduplicated").otherwise("submitted")),
    "SELECT user_id, count(*) FILTER (WHERE status <> 'FAILED' AND retry_count <= 2) AS submitted, count(*) FILTER (WHERE status <> 'FAILED' AND retry_count > 2) AS deduplicated, count(*) FILTER (WHERE status = 'FAILED') AS failed FROM d_tasks GROUP BY 1",
)
_BOUNDS = [10.0, 30.0, 60.0, 120.0, 300.0, 600.0, 1800.0]
_HIST = "(SELECT user_id, le, count(*) FILTER (WHERE le IS NULL OR v <= le) AS n FROM (SELECT user_id, completed_s - started_s AS v FROM d_tasks WHERE completed_s IS NOT NULL AND started_s IS NOT NULL), (SELECT unnest([10.0, 30.0, 60.0, 120.0, 300.0, 600.0, 1800.0, NULL])::DOUBLE AS le) GROUP BY 1, 2)"


def _hist(d):
    return op.histogram(d.tasks.where("completed_s is not null and started_s is not null"), ["user_id"], F.col("completed_s") - F.col("started_s"), _BOUNDS)


add("a29_histogram", _hist, f"SELECT * FROM {_HIST}")
add(
    "a30_histogram_quantile",
    lambda d: op.histogram_quantile(_hist(d), ["user_id"], 0.95),
    f"SELECT user_id, round(CASE WHEN le IS NULL THEN low ELSE low + (le - low) * (0.95::DOUBLE * total - before) / (n - before) END, 4) AS quantile FROM (SELECT *, max(n) OVER (PARTITION BY user_id) AS total, coalesce(lag(n) OVER w, 0) AS before, coalesce(lag(le) OVER w, 0::DOUBLE) AS low FROM {_HIST} WINDOW w AS (PARTITION BY user_id ORDER BY le NULLS LAST)) WHERE n >= 0.95::DOUBLE * total AND before < 0.95::DOUBLE * total",
)
FAILURES = "(SELECT *, CASE WHEN ended > 0 THEN round(failed / ended::DOUBLE, 6) ELSE 0.0 END::DOUBLE AS ratio FROM (SELECT (ts_us // 1000000) - (ts_us // 1000000) % 300 AS window_s, count(*) FILTER (WHERE to_status = 'FAILED') AS failed, count(*) FILTER (WHERE to_status IN ('FAILED','SUCCEEDED')) AS ended FROM d_events GROUP BY 1))"
add("a31_failure_windows", lambda d: op.failure_windows(d.task_events), f"SELECT * FROM {FAILURES}")
add("a32_fleet_verdict", lambda d: op.fleet_verdict(d.servers, "port"), "SELECT port, n, online, CASE WHEN online = 0 THEN 'error' WHEN online < n THEN 'warning' ELSE 'ok' END AS verdict FROM (SELECT port, count(*) AS n, count(*) FILTER (WHERE status = 'ONLINE') AS online FROM d_servers GROUP BY 1)")
add("a33_quality_report", lambda d: op.quality_report(d.tasks), "SELECT *, normal + warning + error = total AS consistent FROM (SELECT task_group_id, count(*) FILTER (WHERE status = 'SUCCEEDED' AND retry_count = 0) AS normal, count(*) FILTER (WHERE status = 'SUCCEEDED' AND retry_count > 0) AS warning, count(*) FILTER (WHERE status = 'FAILED') AS error, count(*) AS total FROM d_tasks WHERE task_group_id IS NOT NULL GROUP BY 1)")
add("a34_monitor", lambda d: op.monitor(d.tasks, d.as_of_s), f"SELECT task_group_id, total, succeeded, total - ended AS left, elapsed_s, CASE WHEN succeeded > 0 THEN floor(elapsed_s * (total - ended) / succeeded::DOUBLE) END::BIGINT AS remaining_s FROM (SELECT task_group_id, count(*) AS total, count(*) FILTER (WHERE status = 'SUCCEEDED') AS succeeded, count(*) FILTER (WHERE status IN ('SUCCEEDED','FAILED','CANCELED')) AS ended, {AS_OF} - min(created_s) AS elapsed_s FROM d_tasks WHERE task_group_id IS NOT NULL GROUP BY 1)".replace(" AS left,", ' AS "left",'))
add(
    "a35_deliveries",
    lambda d: op.deliveries(d.tasks.withColumn("status", F.when(F.col("task_id") % 3 == 0, "SENT").otherwise("PENDING")), "user_id"),
    "SELECT user_id, count(*) AS notices, count(*) FILTER (WHERE task_id % 3 = 0) AS delivered FROM d_tasks GROUP BY 1",
)
add("a37_batch_estimate", lambda d: op.batch_estimate(d.files, d.servers, "user_id"), "SELECT user_id, coalesce(sum(duration_sec), 0)::BIGINT AS audio_s, round(coalesce(sum(duration_sec), 0) * (SELECT avg(rtf_baseline) FROM d_servers WHERE enabled AND status = 'ONLINE' AND max_concurrency > 0) / (SELECT count(*) FROM d_servers WHERE enabled AND status = 'ONLINE' AND max_concurrency > 0) / (SELECT avg(max_concurrency) FROM d_servers WHERE enabled AND status = 'ONLINE' AND max_concurrency > 0), 2) AS estimate_s FROM d_files GROUP BY 1")
add("a38_blocking", lambda d: op.blocking(d.tasks, "user_id", F.when(F.col("error_code") == "MERGE_FAILED", "error").otherwise("warning")), "SELECT user_id, bool_or(coalesce(error_code = 'MERGE_FAILED', false)) AS has_blocking_errors FROM d_tasks GROUP BY 1")
