"""Registered joins, top rows and set operations."""

from pyspark.sql import functions as F

from voxmill.operators import joins as op
from voxmill.plans.aggregates import CROWDED, PLAN, crowded, plan_table
from voxmill.plans.registry import add

add("j01_tasks_files", lambda d: op.with_files(d.tasks, d.files.select("file_id", "original_name", "size_bytes")).select("task_id", "file_id", "original_name", "size_bytes"), "SELECT task_id, file_id, original_name, size_bytes FROM d_tasks JOIN d_files USING (file_id)")
add("j02_zombies", lambda d: op.segments_with_parent(d.segments, d.tasks).select("segment_id", "status", "parent_status", "zombie"), "SELECT segment_id, s.status, t.status AS parent_status, s.status IN ('DISPATCHED','TRANSCRIBING') AND t.status IN ('SUCCEEDED','FAILED','CANCELED') AS zombie FROM d_segments s JOIN d_tasks t USING (task_id)")
add(
    "j03_work_registry",
    lambda d: op.work_against_registry(d.segments.where("status = 'TRANSCRIBING'"), d.servers.where("enabled")),
    "SELECT server_id, coalesce(n, 0) AS n, coalesce(status, 'UNKNOWN') AS status, coalesce(max_concurrency, 0) AS slots FROM (SELECT assigned_server_id AS server_id, count(*) AS n FROM d_segments WHERE status = 'TRANSCRIBING' AND assigned_server_id IS NOT NULL GROUP BY 1) FULL JOIN (SELECT * FROM d_servers WHERE enabled) USING (server_id)",
)
add("j04_semi_batches", lambda d: op.in_batches(d.segments, d.tasks, F.col("task_group_id").isNotNull()).select("segment_id", "task_id"), "SELECT segment_id, task_id FROM d_segments WHERE task_id IN (SELECT task_id FROM d_tasks WHERE task_group_id IS NOT NULL)")
add("j05_whole_tasks", lambda d: op.whole_tasks(d.tasks, d.segments).select("task_id", "status"), "SELECT task_id, status FROM d_tasks t WHERE NOT EXISTS (SELECT 1 FROM d_segments s WHERE s.task_id = t.task_id)")
add("j06_orphaned_files", lambda d: op.orphaned_files(d.tasks.where("status = 'CANCELED'"), d.tasks.where("status <> 'CANCELED'")), "SELECT DISTINCT file_id FROM d_tasks WHERE status = 'CANCELED' AND file_id IS NOT NULL AND file_id NOT IN (SELECT file_id FROM d_tasks WHERE status <> 'CANCELED' AND file_id IS NOT NULL)")
KEPT = "(SELECT task_id, segment_index, pos, start_ms + source_start_ms AS start_ms, end_ms + source_start_ms AS end_ms, text FROM d_utterances WHERE start_ms + source_start_ms >= keep_start_ms AND start_ms + source_start_ms < keep_end_ms)"
add("j07_kept_utterances", lambda d: op.kept_utterances(d.utterances), f"SELECT * FROM {KEPT}")


def silences(d):
    """Silence intervals of files, from completions: file, start and end in milliseconds."""
    return d.completions.select((F.col("event_id") % 101).alias("file_id"), ((F.col("event_id") * 7919) % 3_600_000).alias("start_ms"), ((F.col("event_id") * 7919) % 3_600_000 + 200 + F.col("predicted_cs") % 1500).alias("end_ms"))


SILENCES = "(SELECT event_id % 101 AS file_id, (event_id * 7919) % 3600000 AS start_ms, (event_id * 7919) % 3600000 + 200 + predicted_cs % 1500 AS end_ms FROM d_completions)"


def _windows(d):
    return silences(d).select("file_id").distinct().select("file_id", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("window")).select("file_id", "window", (F.col("window") * 600_000 - 60_000).alias("low_ms"), (F.col("window") * 600_000 + 60_000).alias("high_ms"))


add(
    "j08_cut_candidates",
    lambda d: op.cut_candidates(silences(d), _windows(d), 800),
    f"SELECT file_id, \"window\", (list(mid ORDER BY start_ms - end_ms, start_ms))[1] AS cut_ms, max(end_ms - start_ms) AS silence_ms FROM (SELECT *, (start_ms + end_ms) // 2 AS mid FROM {SILENCES}) JOIN (SELECT DISTINCT file_id, w AS \"window\" FROM {SILENCES}, (SELECT unnest(range(1, 6))::INT AS w)) USING (file_id) WHERE end_ms - start_ms >= 800 AND mid BETWEEN \"window\" * 600000 - 60000 AND \"window\" * 600000 + 60000 GROUP BY 1, 2",
)
add(
    "j09_dispatch_lookup",
    lambda d: op.dispatch_lookup(d.segments.select((F.col("task_id") + F.when(F.col("segment_id") % 50 == 0, 10_000_000).otherwise(0)).alias("task_id"), "segment_id"), d.tasks, d.servers.where("enabled"), d.files.where("size_bytes > 0")).select("segment_id", "reason"),
    "SELECT segment_id, CASE WHEN t.task_id IS NULL THEN 'task_missing' WHEN f.file_id IS NULL THEN 'file_missing' WHEN v.server_id IS NULL THEN 'server_missing' ELSE 'ok' END AS reason FROM d_segments s LEFT JOIN d_tasks t ON t.task_id = s.task_id + CASE WHEN segment_id % 50 = 0 THEN 10000000 ELSE 0 END LEFT JOIN (SELECT * FROM d_files WHERE size_bytes > 0) f ON f.file_id = t.file_id LEFT JOIN (SELECT * FROM d_servers WHERE enabled) v ON v.server_id = t.assigned_server_id",
)
add(
    "j11_resume",
    lambda d: op.resume(d.files.select("file_id", F.concat_ws(":", "original_name", F.col("size_bytes").cast("string")).alias("fingerprint")), d.files.join(d.tasks.where("status = 'SUCCEEDED'").select("file_id"), "file_id", "left_semi").select(F.concat_ws(":", "original_name", F.col("size_bytes").cast("string")).alias("fingerprint"))).select("file_id"),
    "SELECT file_id FROM d_files WHERE file_id NOT IN (SELECT file_id FROM d_tasks WHERE status = 'SUCCEEDED' AND file_id IS NOT NULL)",
)
add("j12_stalled_finalisation", lambda d: op.stalled_finalisation(d.tasks, d.segments), "SELECT task_id, status, n FROM d_tasks JOIN (SELECT task_id, count(*) AS n FROM d_segments GROUP BY 1 HAVING count(*) = count(*) FILTER (WHERE status = 'SUCCEEDED')) USING (task_id) WHERE status NOT IN ('SUCCEEDED','FAILED','CANCELED')")
add(
    "j13_best_server",
    lambda d: op.best_server(d.files.where("duration_sec is not null").select(F.col("file_id").alias("item"), F.col("duration_sec").alias("audio_s")), d.servers),
    "SELECT item, (list(server_id ORDER BY e, server_id))[1] AS server_id, round(min(e), 3) AS estimate_s FROM (SELECT file_id AS item, server_id, duration_sec * coalesce(rtf_baseline, 0.3::DOUBLE) * (1 + 0.1::DOUBLE * (server_id % max_concurrency)) + 5 AS e FROM d_files, d_servers WHERE duration_sec IS NOT NULL AND enabled AND status = 'ONLINE' AND max_concurrency > 0) GROUP BY 1",
)


def alerts(d):
    """Firing alerts by server from the event log: name and severity."""
    return d.task_events.where("to_status = 'FAILED'").select("event_id", F.concat(F.lit("work_failed_"), F.col("task_id").cast("string")).alias("alertname"), F.when(F.col("event_id") % 9 == 0, "critical").otherwise("warning").alias("severity"))


add(
    "j14_inhibited",
    lambda d: op.inhibited(alerts(d)),
    "WITH a AS (SELECT event_id, 'work_failed_' || task_id AS alertname, CASE WHEN event_id % 9 = 0 THEN 'critical' ELSE 'warning' END AS severity FROM d_events WHERE to_status = 'FAILED') SELECT alertname, severity, event_id FROM a WHERE NOT (severity = 'warning' AND alertname IN (SELECT alertname FROM a WHERE severity = 'critical'))",
)

add("l01_newest_page", lambda d: op.page(d.tasks.select("task_id", "created_s"), [F.desc("created_s"), F.col("task_id")], 40, 20), "SELECT task_id, created_s, (SELECT count(*) FROM d_tasks) AS total FROM d_tasks ORDER BY created_s DESC, task_id LIMIT 20 OFFSET 40")
add("l02_batch_page", lambda d: op.page(d.tasks.where("task_group_id = 7").select("task_id", "created_s"), [F.col("created_s"), F.col("task_id")], 5, 10), "SELECT task_id, created_s, (SELECT count(*) FROM d_tasks WHERE task_group_id = 7) AS total FROM d_tasks WHERE task_group_id = 7 ORDER BY created_s, task_id LIMIT 10 OFFSET 5")
add("l03_fifo", lambda d: op.fifo(d.tasks, 25).select("task_id", "created_s"), "SELECT task_id, created_s FROM d_tasks WHERE status = 'QUEUED' ORDER BY created_s, task_id LIMIT 25")
add("l04_newest", lambda d: op.newest(d.tasks, 30).select("task_id", "status"), "SELECT task_id, status FROM d_tasks ORDER BY coalesce(completed_s, created_s) DESC, task_id LIMIT 30")
add(
    "l05_next_segments",
    lambda d: op.next_segments(d.segments, 2),
    "SELECT task_id, segment_id, rn::INT AS rn FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY segment_index, segment_id) AS rn FROM d_segments WHERE status = 'PENDING') LEFT JOIN (SELECT task_id, count(*) AS active FROM d_segments WHERE status IN ('DISPATCHED','TRANSCRIBING') GROUP BY 1) USING (task_id) WHERE rn <= 2 - coalesce(active, 0)",
)
add("l06_smallest", lambda d: op.smallest(d.files, 15).select("file_id", "size_bytes"), "SELECT file_id, size_bytes FROM d_files ORDER BY size_bytes, file_id LIMIT 15")
add("l07_slot_order", lambda d: d.segments.where("status = 'TRANSCRIBING'").select("assigned_server_id", "task_id", "segment_index").orderBy("assigned_server_id", "task_id", "segment_index"), "SELECT assigned_server_id, task_id, segment_index FROM d_segments WHERE status = 'TRANSCRIBING'")

add("u01_busy_intervals", lambda d: op.busy_intervals(d.tasks, d.segments), "SELECT 'task' AS kind, task_id AS work_id, started_s, completed_s FROM d_tasks WHERE started_s IS NOT NULL AND completed_s IS NOT NULL UNION ALL SELECT 'segment', segment_id, started_s, completed_s FROM d_segments WHERE started_s IS NOT NULL AND completed_s IS NOT NULL")
add("u02_unqueued_parents", lambda d: op.unqueued_parents(d.segments, d.tasks), "SELECT DISTINCT task_id FROM d_segments WHERE status = 'PENDING' AND task_id NOT IN (SELECT task_id FROM d_tasks WHERE status = 'QUEUED')")
add("u03_exhausted_available", lambda d: op.exhausted_and_available(crowded(plan_table(d)), d.servers), f"SELECT server_id FROM d_servers WHERE enabled AND status = 'ONLINE' AND max_concurrency > 0 AND server_id NOT IN (SELECT server_id FROM {CROWDED})")
add("u04_endpoints", lambda d: op.endpoints(d.servers.withColumn("host", F.concat(F.lit(" 10.0.0."), (F.col("server_id") % 40).cast("string")))), "SELECT server_id, '10.0.0.' || (server_id % 40) || ':' || port AS endpoint, row_number() OVER (PARTITION BY server_id % 40, port ORDER BY server_id) > 1 AS duplicate FROM d_servers")
add("u05_task_servers", lambda d: op.task_servers(d.segments), "SELECT DISTINCT task_id, assigned_server_id FROM d_segments WHERE assigned_server_id IS NOT NULL")
add("u06_plan_difference", lambda d: op.plan_difference(plan_table(d).select("item"), d.tasks.where("status in ('QUEUED', 'DISPATCHED')").select(F.col("task_id").alias("item"))), f"SELECT DISTINCT item, 'stale_plan' AS side FROM {PLAN} WHERE item NOT IN (SELECT task_id FROM d_tasks WHERE status IN ('QUEUED','DISPATCHED')) UNION ALL SELECT DISTINCT task_id, 'unplanned' FROM d_tasks WHERE status IN ('QUEUED','DISPATCHED') AND task_id NOT IN (SELECT item FROM {PLAN})")


def _batches(d):
    g = d.tasks.where("task_group_id is not null").groupBy(F.col("task_group_id").alias("batch")).agg(F.min("user_id").alias("user_id"), F.count("*").alias("n"), F.min("created_s").alias("created_s"), F.count_if(~F.col("status").isin("SUCCEEDED", "FAILED", "CANCELED")).alias("active"))
    return g.withColumn("fingerprint", F.col("batch") % 2)


def newest_earlier(batches: str, same: str, window_s: int) -> str:
    """Of each batch a of ``batches`` the newest active one before it that is the ``same`` and at most ``window_s`` older."""
    return f"SELECT batch, earlier, user_id, n FROM (SELECT a.batch, e.batch AS earlier, a.user_id, a.n, row_number() OVER (PARTITION BY a.batch ORDER BY e.created_s DESC, e.batch DESC) AS rn FROM {batches} a JOIN {batches} e ON a.user_id = e.user_id AND a.n = e.n AND {same} WHERE e.active > 0 AND (e.created_s, e.batch) < (a.created_s, a.batch) AND a.created_s - e.created_s <= {window_s}) WHERE rn = 1"


add(
    "j10_duplicate_batches",
    lambda d: op.duplicate_batches(_batches(d), 86400 * 100),
    "WITH b AS (SELECT task_group_id AS batch, min(user_id) AS user_id, count(*) AS n, min(created_s) AS created_s, count(*) FILTER (WHERE status NOT IN ('SUCCEEDED','FAILED','CANCELED')) AS active FROM d_tasks WHERE task_group_id IS NOT NULL GROUP BY 1) " + newest_earlier("b", "a.batch % 2 = e.batch % 2", 8_640_000),
)
