"""Registered composite jobs and sinks."""

from pyspark.sql import functions as F

from voxmill import constants as C
from voxmill.functions import scalars as fn
from voxmill.operators import aggregates, jobs as op, windows as win
from voxmill.operators.filters import extension
from voxmill.plans.aggregates import FAILURES, IDLE, SPEED, _HIST, _hist
from voxmill.plans.joins import newest_earlier
from voxmill.plans.registry import add
from voxmill.plans.scalars import FINGERPRINTS, SIMILARITY, fingerprints
from voxmill.plans.snapshots import APPLIED, applied


def results(d):
    """Result documents of segments: timed sentences, or for every fifth conversation plain text."""
    s = d.utterances.groupBy("task_id", "segment_index", "source_start_ms", "keep_start_ms", "keep_end_ms").agg(F.array_sort(F.collect_list(F.struct("pos", "start_ms", "end_ms", "text"))).alias("u"))
    sents = F.transform("u", lambda x: F.struct(x["text"].alias("text_seg"), F.lit("").alias("punc"), F.array(x["start_ms"], x["end_ms"]).alias("ts")))
    text = F.array_join(F.transform("u", lambda x: x["text"]), "")
    doc = F.when(F.col("task_id") % 5 == 0, F.to_json(F.struct(text.alias("text")))).otherwise(F.to_json(F.struct(F.lit("").alias("text"), sents.alias("stamp_sents"), F.lit("offline").alias("mode"))))
    return s.select("task_id", "segment_index", "source_start_ms", "keep_start_ms", "keep_end_ms", doc.alias("raw_result_json"))


def digested(merged):
    return merged.select("task_id", F.md5("text").alias("text_md5"), F.size("sentences").alias("sentences"), "mode", "status")


_SPACED = "CASE WHEN contains(text, ' ') AND len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: length(x) > 1)) = 0 AND trim(text) <> '' THEN regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', '', 'g') ELSE text END"
MERGED = f"""SELECT task_id, md5(coalesce(string_agg(t, '' ORDER BY segment_index, pos), '')) AS text_md5, count(*) FILTER (WHERE task_id % 5 <> 0 AND keep)::INT AS sentences, CASE WHEN task_id % 5 = 0 THEN '' ELSE 'offline' END AS mode, CASE WHEN task_id % 5 = 0 THEN 'TEXT_ONLY_FALLBACK' ELSE 'OK' END AS status
FROM (SELECT *, CASE WHEN task_id % 5 = 0 THEN text WHEN keep THEN {_SPACED} ELSE '' END AS t FROM (SELECT *, start_ms + source_start_ms >= keep_start_ms AND start_ms + source_start_ms < keep_end_ms AS keep FROM d_utterances)) GROUP BY task_id"""
add("c01_merge_segments", lambda d: digested(op.merge_segments(results(d))), MERGED)


def _plan(d):
    last = F.expr("segment_index = max(segment_index) over (partition by task_id)")
    return d.segments.withColumn("last", last).select(F.col("task_id").alias("file_id"), "segment_index", "keep_start_ms", "keep_end_ms", "source_start_ms", F.when(F.col("last"), F.col("keep_end_ms")).otherwise(F.col("source_end_ms")).alias("source_end_ms"))


add(
    "c03_plan_violations",
    lambda d: op.plan_violations(_plan(d), F.expr("max(keep_end_ms) over (partition by file_id)")),
    """SELECT file_id, segment_index, array_to_string(list_filter([CASE WHEN CASE WHEN before IS NULL THEN keep_start_ms <> 0 ELSE before <> keep_start_ms END THEN 'gap' END, CASE WHEN src THEN 'overlap' END], lambda x: x IS NOT NULL), ',') AS why FROM (
SELECT *, source_start_ms <> CASE WHEN before IS NULL THEN 0 ELSE greatest(0, keep_start_ms - 400) END OR source_end_ms <> CASE WHEN after IS NULL THEN total ELSE least(total, keep_end_ms + 400) END AS src FROM (
SELECT task_id AS file_id, segment_index, keep_start_ms, keep_end_ms, source_start_ms, CASE WHEN segment_index = max(segment_index) OVER (PARTITION BY task_id) THEN keep_end_ms ELSE source_end_ms END AS source_end_ms, max(keep_end_ms) OVER (PARTITION BY task_id) AS total, lag(keep_end_ms) OVER w AS before, lead(keep_start_ms) OVER w AS after FROM d_segments WINDOW w AS (PARTITION BY task_id ORDER BY segment_index))) WHERE src OR CASE WHEN before IS NULL THEN keep_start_ms <> 0 ELSE before <> keep_start_ms END""",
)


def _quotas(d, zeros=False):
    n = d.tasks.where("task_group_id is not null").groupBy(F.col("task_group_id").alias("batch")).agg(F.count("*").alias("n"))
    return op.quotas(n, d.servers.where("enabled and status = 'ONLINE' and max_concurrency > 0").select("server_id", aggregates.speed().alias("speed")), zeros)


QUOTAS = f"""WITH b AS (SELECT task_group_id AS batch, count(*) AS n FROM d_tasks WHERE task_group_id IS NOT NULL GROUP BY 1), s AS (SELECT server_id, {SPEED} AS speed FROM d_servers WHERE enabled AND status = 'ONLINE' AND max_concurrency > 0),
q AS (SELECT *, round_even(n * speed / sum(speed) OVER (PARTITION BY batch), 0)::BIGINT AS quota FROM b, s),
r AS (SELECT *, n - sum(quota) OVER (PARTITION BY batch) AS diff, row_number() OVER (PARTITION BY batch ORDER BY speed DESC, server_id) = 1 AS fastest, coalesce(sum(quota) OVER (PARTITION BY batch ORDER BY speed, server_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS slower FROM q)
SELECT batch, server_id, (CASE WHEN diff > 0 AND fastest THEN quota + diff WHEN diff < 0 THEN quota - least(quota, greatest(0, -diff - slower)) ELSE quota END)::BIGINT AS quota FROM r"""
add("c05_quotas", lambda d: _quotas(d, True), QUOTAS)
add("c05_assigned_quotas", _quotas, f"SELECT * FROM ({QUOTAS}) WHERE quota > 0")
_BATCH = "(SELECT task_group_id AS batch, min(user_id) AS user_id, count(*) AS n, min(created_s) AS created_s, count(*) FILTER (WHERE status NOT IN ('SUCCEEDED','FAILED','CANCELED')) AS active FROM d_tasks WHERE task_group_id IS NOT NULL GROUP BY 1)"


def _coarse(d):
    """Fingerprints by size class, so that batches do meet."""
    return fingerprints(d).select("batch", F.concat(F.lit("k"), (F.col("batch") % 3).cast("string")).alias("fingerprint"))


add("c06_duplicate_batches", lambda d: op.duplicate_report(d.tasks, _coarse(d), 86400 * 400), f"WITH b AS (SELECT * FROM {_BATCH} WHERE batch IN (SELECT batch FROM {FINGERPRINTS})) " + newest_earlier("b", "a.batch % 3 = e.batch % 3", 34_560_000))
add("c07_benchmark_report", lambda d: aggregates.capacity_ranking(applied(d)), f"SELECT server_id, round(s, 4) AS speed, CASE WHEN max(s) OVER () > 0 THEN round(s / max(s) OVER (), 4) ELSE 0.0 END::DOUBLE AS relative, row_number() OVER (ORDER BY s DESC, server_id)::INT AS rank FROM (SELECT server_id, {SPEED} AS s FROM {APPLIED})")


def _evaluation(d):
    clean = lambda c: F.regexp_replace(c, r"[^\x00-\x7F]", "")
    pairs = d.transcript_pairs.withColumns({c: clean(c) for c in ("baseline_text", "experiment_text")})
    dist, _ = fn.edit_similarity(F.col("baseline_text"), F.col("experiment_text"))
    n = F.greatest(F.length(fn.squeezed(F.col("baseline_text"))), F.length(fn.squeezed(F.col("experiment_text"))), F.lit(1)).cast("long")
    rows = pairs.withColumns({"dist": dist.cast("long"), "n": n}).select((F.col("pair_id") % 7).alias("key"), (F.lit(1_000_000) - F.expr("dist * 1000000 div n")).alias("ppm"))
    return rows.groupBy("key").agg(F.count("*").alias("pairs"), F.expr("sum(ppm) div count(*)").alias("similarity_ppm")).withColumn("verdict", F.when(F.col("similarity_ppm") >= 950_000, "good").when(F.col("similarity_ppm") >= 850_000, "fair").otherwise("poor"))


_CLEAN = "regexp_replace(regexp_replace({c}, '[^\\x00-\\x7F]', '', 'g'), '[ \\t\\n\\x0B\\f\\r]+', '', 'g')"
add(
    "c08_evaluation",
    _evaluation,
    f"SELECT *, CASE WHEN similarity_ppm >= 950000 THEN 'good' WHEN similarity_ppm >= 850000 THEN 'fair' ELSE 'poor' END AS verdict FROM (SELECT pair_id % 7 AS key, count(*) AS pairs, (sum(1000000 - levenshtein(a, b) * 1000000 // greatest(length(a), length(b), 1)) // count(*))::BIGINT AS similarity_ppm FROM (SELECT pair_id, {_CLEAN.format(c='baseline_text')} AS a, {_CLEAN.format(c='experiment_text')} AS b FROM d_transcript_pairs) GROUP BY 1)",
)
add("a36_evaluation_summary", lambda d: aggregates.evaluation_summary(d.transcript_pairs.select((F.col("pair_id") % 9).alias("key"), ((F.length("baseline_text") % 100) / 100.0).alias("similarity"), ((F.length("experiment_text") % 50) / 100.0).alias("diff_ratio"), (F.col("pair_id") % 2).alias("violations"))), "SELECT *, CASE WHEN similarity >= 0.95 AND violations = 0 THEN 'good' WHEN similarity >= 0.85 THEN 'fair' ELSE 'poor' END AS verdict FROM (SELECT pair_id % 9 AS key, count(*) AS pairs, round(avg(length(baseline_text) % 100 / 100.0::DOUBLE), 4) AS similarity, round(avg(length(experiment_text) % 50 / 100.0::DOUBLE), 4) AS diff_ratio, sum(pair_id % 2)::BIGINT AS violations FROM d_transcript_pairs GROUP BY 1)")


def _moving(d):
    return d.task_events.withColumn("payload_json", F.when(F.col("event_id") % 2 == 0, F.lit('{"event_type": "work_steal", "estimated_gain_sec": 2}')).otherwise(F.col("payload_json")))


add(
    "c09_batch_report",
    lambda d: op.batch_report(d.tasks, d.segments, d.servers, _moving(d)),
    f"""WITH {IDLE},
o AS (SELECT task_group_id, count(*) AS total, count(*) FILTER (WHERE status = 'SUCCEEDED') AS succeeded, count(*) FILTER (WHERE status = 'FAILED') AS failed, count(*) FILTER (WHERE status = 'CANCELED') AS canceled, sum(progress_bp) AS bp FROM d_tasks WHERE task_group_id IS NOT NULL GROUP BY 1),
x AS (SELECT task_group_id, count(*) AS c FROM (SELECT task_id FROM d_segments GROUP BY 1 HAVING count(DISTINCT assigned_server_id) > 1) JOIN d_tasks USING (task_id) GROUP BY 1),
m AS (SELECT task_group_id, count(*) AS s FROM d_events JOIN d_tasks USING (task_id) WHERE event_id % 2 = 0 GROUP BY 1)
SELECT task_group_id, total, succeeded, failed, canceled, total - succeeded - failed - canceled AS in_progress, round(bp::DOUBLE / total)::BIGINT AS progress_bp, succeeded + failed + canceled = total AS is_complete, coalesce(c, 0) AS cross_server_tasks, coalesce(s, 0) AS steals, (coalesce(s, 0) * 2)::DOUBLE AS gain, idle_slot_seconds FROM o LEFT JOIN x USING (task_group_id) LEFT JOIN m USING (task_group_id) LEFT JOIN idle USING (task_group_id)""",
)


def _scan_manifest(d):
    from voxmill.operators.filters import scan_skip
    from voxmill.operators.joins import resume

    fp = fn.file_fingerprint(F.col("original_name"), F.col("size_bytes"), F.col("file_id"))
    f = d.files.withColumn("fingerprint", fp).where(extension(F.col("original_name")).isin(".wav", ".mp3", ".mp4", ".flac", ".ogg", ".webm", ".m4a", ".aac", ".wma", ".mkv", ".avi", ".mov", ".pcm"))
    f = f.where(scan_skip(F.col("original_name"), F.col("size_bytes"), F.lit(100)).isNull())
    done = f.join(d.tasks.where("status = 'SUCCEEDED'").select("file_id"), "file_id", "left_semi")
    left = resume(f, done)
    return win.chunk_bounds(left, "user_id", "file_id", 8).groupBy("user_id").agg(F.sum("n").alias("files"), F.count("*").alias("chunks"))


add(
    "c10_scan_manifest",
    _scan_manifest,
    "SELECT user_id, count(*)::BIGINT AS files, (count(*) + 7) // 8 AS chunks FROM d_files WHERE lower(regexp_extract(original_name, '\\.[^.]+$', 0)) IN ('.wav','.mp3','.mp4','.flac','.ogg','.webm','.m4a','.aac','.wma','.mkv','.avi','.mov','.pcm') AND size_bytes > 0 AND file_id NOT IN (SELECT file_id FROM d_tasks WHERE status = 'SUCCEEDED' AND file_id IS NOT NULL) GROUP BY 1",
)
add(
    "c12_heartbeats",
    lambda d: op.heartbeat_states(d.task_events.select("event_id", F.col("task_id").alias("server_id"), F.expr("ts_us div 1000000").alias("at_s"), (F.col("to_status") != "FAILED").alias("ok")), 3600),
    "SELECT event_id, server_id, at_s, CASE WHEN ok THEN 'ONLINE' WHEN at_s - last <= 3600 THEN 'DEGRADED' ELSE 'OFFLINE' END AS state FROM (SELECT *, last_value(CASE WHEN ok THEN at_s END IGNORE NULLS) OVER (PARTITION BY server_id ORDER BY at_s, event_id ROWS UNBOUNDED PRECEDING) AS last FROM (SELECT event_id, task_id AS server_id, ts_us // 1000000 AS at_s, to_status <> 'FAILED' AS ok FROM d_events))",
)
_P95 = f"(SELECT user_id, round(CASE WHEN le IS NULL THEN low ELSE low + (le - low) * (0.95::DOUBLE * total - before) / (n - before) END, 4) AS quantile FROM (SELECT *, max(n) OVER (PARTITION BY user_id) AS total, coalesce(lag(n) OVER w, 0) AS before, coalesce(lag(le) OVER w, 0::DOUBLE) AS low FROM {_HIST} WINDOW w AS (PARTITION BY user_id ORDER BY le NULLS LAST)) WHERE n >= 0.95::DOUBLE * total AND before < 0.95::DOUBLE * total)"
add(
    "c13_alerts",
    lambda d: op.alert_rules(d.tasks, d.servers, aggregates.failure_windows(d.task_events, 3600), aggregates.histogram_quantile(_hist(d), ["user_id"], 0.95), 0),
    f"""SELECT 'queue_backlog' AS alertname, 'warning' AS severity, user_id::VARCHAR AS subject, count(*)::DOUBLE AS value FROM d_tasks WHERE status = 'QUEUED' GROUP BY user_id HAVING count(*) > 60
UNION ALL SELECT 'failure_rate', 'critical', window_s::VARCHAR, round(ratio, 4) FROM {FAILURES.replace('% 300', '% 3600')} WHERE ratio > 0.2
UNION ALL SELECT 'server_down', 'critical', server_id::VARCHAR, 1 FROM d_servers WHERE status = 'OFFLINE' AND enabled
UNION ALL SELECT 'slow_work', 'warning', user_id::VARCHAR, quantile FROM {_P95} WHERE quantile > 1200
UNION ALL SELECT 'many_retries', 'warning', user_id::VARCHAR, sum(retry_count)::DOUBLE FROM d_tasks GROUP BY user_id HAVING sum(retry_count) > 1500
UNION ALL SELECT 'fleet_thin', 'warning', port::VARCHAR, count(*) FILTER (WHERE status = 'OFFLINE') FROM d_servers GROUP BY port HAVING count(*) FILTER (WHERE status = 'OFFLINE') > count(*) FILTER (WHERE status = 'ONLINE') / 2""",
)
add(
    "c14_integrity",
    lambda d: op.integrity(d.tasks, d.segments, d.files, d.task_events),
    "SELECT 'task_without_file' AS audit, count(*) AS n FROM d_tasks WHERE file_id IS NOT NULL AND file_id NOT IN (SELECT file_id FROM d_files) UNION ALL SELECT 'task_file_null', count(*) FROM d_tasks WHERE file_id IS NULL UNION ALL SELECT 'segment_without_task', count(*) FROM d_segments WHERE task_id NOT IN (SELECT task_id FROM d_tasks) UNION ALL SELECT 'event_without_task', count(*) FROM d_events WHERE task_id NOT IN (SELECT task_id FROM d_tasks) UNION ALL SELECT 'segment_key_twice', count(*) FROM (SELECT 1 FROM d_segments GROUP BY task_id, segment_index HAVING count(*) > 1) UNION ALL SELECT 'illegal_move', count(*) FROM d_events WHERE from_status IS NOT NULL AND (from_status, to_status) NOT IN (" + ", ".join(f"('{a}','{b}')" for a, to in C.TRANSITIONS.items() for b in to) + ")",
)
_RUN = "(SELECT task_group_id, count(*) AS n, count(*) FILTER (WHERE status = 'SUCCEEDED') AS ok, max(completed_s) - min(started_s) AS wall_s, coalesce(sum(duration_sec), 0)::BIGINT AS audio_s FROM d_tasks LEFT JOIN d_files USING (file_id) WHERE task_group_id IS NOT NULL GROUP BY 1)"
add("c15_compare_runs", lambda d: op.compare_runs(d.tasks, d.files), f"WITH g AS (SELECT *, CASE WHEN wall_s > 0 THEN round(audio_s / wall_s::DOUBLE, 4) END AS speed FROM {_RUN}) SELECT a.*, b.n AS prev_n, b.ok AS prev_ok, b.wall_s AS prev_wall_s, b.speed AS prev_speed FROM g a JOIN g b ON b.task_group_id + 1 = a.task_group_id")
add("c15_same_output", lambda d: op.same_output(d.transcript_pairs.select(F.col("pair_id").alias("key"), F.col("baseline_text").alias("text")), d.transcript_pairs.select(F.col("pair_id").alias("key"), F.when(F.col("pair_id") % 2 == 0, F.col("baseline_text")).otherwise(F.col("experiment_text")).alias("text"))), "SELECT pair_id AS key, pair_id % 2 = 0 OR baseline_text = experiment_text AS same FROM d_transcript_pairs")
add("c16_readiness", lambda d: op.readiness(d.tasks, d.segments), "SELECT task_id, CASE WHEN status IN ('SUCCEEDED','FAILED','CANCELED') THEN 'ended' WHEN w > 0 THEN 'waiting' WHEN f > 0 THEN 'failed' ELSE 'ready' END AS readiness FROM d_tasks JOIN (SELECT task_id, count(*) FILTER (WHERE status IN ('PENDING','DISPATCHED','TRANSCRIBING')) AS w, count(*) FILTER (WHERE status = 'FAILED') AS f FROM d_segments GROUP BY 1) USING (task_id)")


def _texts(d):
    return d.conversations.select(F.col("conv_id").alias("batch"), F.col("role").alias("name"), F.col("turn").alias("created_s"), F.col("turn").alias("task_id"), F.col("text").alias("content"))


add("s13_combined_text", lambda d: op.combined_text(_texts(d)).select("batch", F.md5("text").alias("text_md5")), "SELECT conv_id AS batch, md5(string_agg('--- ' || role || ' ---' || chr(10) || text || chr(10), chr(10) ORDER BY turn)) AS text_md5 FROM conversations GROUP BY 1")
add("s15_export_capped", lambda d: op.export_capped(_texts(d).withColumn("bytes", F.octet_length("content").cast("long")), 1500), "SELECT batch, task_id, running, truncated FROM (SELECT *, max((running > 1500)::INT) OVER (PARTITION BY batch) = 1 AS truncated FROM (SELECT conv_id AS batch, turn AS task_id, sum(strlen(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM conversations)) WHERE running <= 1500")
