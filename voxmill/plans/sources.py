"""Registered sources and sinks that the given tables feed."""

from pyspark.sql import functions as F

from voxmill.plans.registry import add
from voxmill.sources import files as src, tables
from voxmill.streaming import streams

add("s01_typed_scan", lambda d: d.events.select("event_id", "user_id", "event_type").where("value > 100"), "SELECT event_id, user_id, event_type FROM events WHERE value > 100")


def _webhooks(d):
    alert = F.struct(F.when(F.col("event_id") % 2 == 0, "resolved").alias("status"), F.create_map(F.lit("alertname"), F.col("to_status"), F.lit("severity"), F.lit("warning")).alias("labels"))
    doc = F.to_json(F.struct(F.lit("firing").alias("status"), F.array(alert).alias("alerts")))
    return d.task_events.select("event_id", F.explode(src.webhook_alerts(doc)).alias("a")).select("event_id", "a.status", "a.alertname", "a.severity")


add("s11_webhook_alerts", _webhooks, "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'resolved' ELSE 'firing' END AS status, to_status AS alertname, 'warning' AS severity FROM d_events")
add("s12_batch_summaries", lambda d: src.batch_summaries(d.tasks, d.files).select("task_group_id", "total", "succeeded", F.size("items").alias("items")), "SELECT task_group_id, count(*) AS total, count(*) FILTER (WHERE status = 'SUCCEEDED') AS succeeded, count(*)::INT AS items FROM d_tasks WHERE task_group_id IS NOT NULL GROUP BY 1")
add("s14_json_export", lambda d: src.json_export(d.conversations.select(F.col("conv_id").alias("batch"), F.col("turn").alias("task_id"), F.col("role").alias("name"), F.when(F.col("turn") % 2 == 0, F.to_json(F.struct("turn"))).otherwise(F.lit("plain")).alias("content"))), "SELECT conv_id AS batch, '[' || string_agg('{\"name\":\"' || role || '\",\"result\":' || CASE WHEN turn % 2 = 0 THEN '{\"turn\":' || turn || '}' ELSE '{\"_raw\":\"plain\"}' END || '}', ',' ORDER BY turn) || ']' AS document FROM conversations GROUP BY 1")


def _silence_log(d):
    """A detection log from completions, in the order of their ids: starts, ends and other lines."""
    line = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("[x] silence_start: "), F.col("event_id").cast("string"), F.lit(".5"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("[x] silence_end: "), F.col("event_id").cast("string"), F.lit(".25 | silence_duration: 1"))).otherwise("frame=1")
    return src.silence_intervals(d.completions.select((F.col("server_id") % 50).alias("file_id"), F.col("event_id").alias("line_no"), line.alias("line")))


add(
    "s10_silence_log",
    _silence_log,
    "SELECT file_id, event_id * 1000 + 500 AS start_ms, CASE WHEN n IS NULL THEN -1 ELSE n * 1000 + 250 END AS end_ms FROM (SELECT *, lead(event_id) OVER (PARTITION BY file_id ORDER BY event_id) AS n FROM (SELECT server_id % 50 AS file_id, event_id FROM d_completions WHERE event_id % 3 < 2)) WHERE event_id % 3 = 0 AND (n IS NULL OR n % 3 = 1)",
)


def _inventory(d):
    """Conversations written as text, a folder for every fortieth, then listed."""
    to = src.shared_folder(d.spark, "media")
    d.conversations.select((F.col("conv_id") % 40).alias("room"), F.coalesce("text", F.lit("")).alias("line")).repartition("room").write.partitionBy("room").text(to)
    return src.media_inventory(d.spark, [to], 5, (".txt",)).select(F.regexp_extract("path", r"room=(\d+)", 1).cast("long").alias("room"), "size_bytes", "chunk")


add("s02_media_inventory", _inventory, "SELECT conv_id % 40 AS room, sum(octet_length(encode(coalesce(text, ''))) + 1)::BIGINT AS size_bytes, 0::BIGINT AS chunk FROM conversations GROUP BY 1")


def _stored(d, fmt=None):
    """Every task's results written in three formats and read back."""
    to = src.shared_folder(d.spark, "results")
    rows = d.tasks.where("status = 'SUCCEEDED'").select(F.lpad(F.col("task_id").cast("string"), 8, "0").alias("task_id"), "created_s")
    text = {"json": F.to_json(F.struct("created_s")), "txt": F.col("created_s").cast("string"), "srt": F.concat(F.lit("1\n"), F.col("created_s").cast("string"))}
    src.write_results(rows.select("task_id", F.explode(F.create_map(*(x for f, c in text.items() for x in (F.lit(f), c)))).alias("fmt", "content")), to)
    return src.read_results(d.spark, to, fmt)


add("s03_result_read", lambda d: _stored(d, "srt").select("task_id", "content"), "SELECT lpad(task_id::VARCHAR, 8, '0') AS task_id, '1' || chr(10) || created_s AS content FROM d_tasks WHERE status = 'SUCCEEDED'")
add("s04_result_sink", lambda d: _stored(d).groupBy("fmt", "prefix").agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("chars")), "SELECT fmt, substr(lpad(task_id::VARCHAR, 8, '0'), 1, 4) AS prefix, count(*) AS n, sum(length(created_s::VARCHAR) + CASE fmt WHEN 'json' THEN 14 WHEN 'srt' THEN 2 ELSE 0 END)::BIGINT AS chars FROM d_tasks, (SELECT unnest(['json', 'txt', 'srt']) AS fmt) WHERE status = 'SUCCEEDED' GROUP BY 1, 2")

#: What the drift query expects: the tables as they are, one column and one table more; a column that should have gone.
EXPECTED = {**tables.SCHEMAS, "lineitem": tables.SCHEMAS["lineitem"] + ", l_comment string", "partsupp": "ps_partkey long"}
_COLUMNS = ", ".join(f"('{t}', '{c.split()[0]}')" for t, schema in EXPECTED.items() for c in schema.split(", "))
add(
    "s05_schema_drift",
    lambda d: src.schema_drift(d.spark, {t: d.spark.read.parquet(f"{d.sf_dir}/{t}.parquet") for t in tables.SCHEMAS}, {"events": ["props"]}, EXPECTED),
    f"""WITH e AS (SELECT t, c FROM (VALUES {_COLUMNS}) v(t, c)), h AS (SELECT table_name AS t, column_name AS c FROM duckdb_columns()),
problems AS (SELECT DISTINCT t, 'table missing' AS problem FROM e WHERE t NOT IN (SELECT t FROM h) UNION ALL SELECT t, 'column missing: ' || c FROM e WHERE t IN (SELECT t FROM h) AND (t, c) NOT IN (SELECT (t, c) FROM h) UNION ALL SELECT t, 'legacy column: ' || c FROM h WHERE t = 'events' AND c = 'props')
SELECT t AS "table", 'error' AS level, problem FROM problems UNION ALL SELECT DISTINCT t, 'ok', '' FROM e WHERE t NOT IN (SELECT t FROM problems)""",
)


def _manifests(d):
    """A manifest for each batch, some with faults, written as JSON lines and read back."""
    to, b = src.shared_folder(d.spark, "manifests"), F.col("b")
    item = F.struct(F.col("file_id").cast("string").alias("file_path"), (F.col("file_id") % 300 - 2).alias("size_bytes"), "status")
    g = d.tasks.where("task_group_id is not null").groupBy(F.col("task_group_id").alias("b")).agg(F.count("*").cast("int").alias("n"), F.collect_list(item).alias("items"))
    doc = F.struct(
        F.when(b % 7 == 0, F.concat(F.lit("batch-"), b.cast("string"))).otherwise(F.concat(F.lit("local-20240101-"), F.lpad((b % 1_000_000).cast("string"), 6, "0"))).alias("batch_id"),
        F.lit("lake").alias("source"),
        F.when(b % 11 != 0, "2024-01-01").alias("created_at"),
        F.lit("unknown").alias("agent_platform"),
        F.when(b % 5 == 0, "DONE").otherwise("COMPLETED").alias("status"),
        F.struct((b % 4).cast("int").alias("chunk_size")).alias("config"),
        F.struct((F.col("n") - 20).alias("total")).alias("progress"),
        F.struct(F.lit(1.0).alias("total_elapsed_sec")).alias("timing"),
        "items",
    )
    g.select(F.to_json(doc).alias("value")).write.text(to)
    return src.manifest_violations(src.read_manifests(d.spark, to, one_a_line=True))


add(
    "s06_manifest_violations",
    _manifests,
    """WITH g AS (SELECT task_group_id AS b, count(*) AS n, bool_or(file_id IS NULL) AS lost, bool_or(file_id % 300 < 2) AS negative FROM d_tasks WHERE task_group_id IS NOT NULL GROUP BY 1),
m AS (SELECT *, CASE WHEN b % 7 = 0 THEN 'batch-' || b ELSE 'local-20240101-' || lpad((b % 1000000)::VARCHAR, 6, '0') END AS batch_id FROM g)
SELECT batch_id, 'missing: created_at' AS problem FROM m WHERE b % 11 = 0 UNION ALL SELECT batch_id, 'batch_id' FROM m WHERE b % 7 = 0 UNION ALL SELECT batch_id, 'status' FROM m WHERE b % 5 = 0
UNION ALL SELECT batch_id, 'chunk_size' FROM m WHERE b % 4 = 0 UNION ALL SELECT batch_id, 'total' FROM m WHERE n < 20 UNION ALL SELECT batch_id, 'item without path' FROM m WHERE lost UNION ALL SELECT batch_id, 'item size' FROM m WHERE negative""",
)


def _benchmark_log(d, to):
    """Completions as lines of a benchmark log, then one line a server with what is recommended, in a newer file."""
    line = F.struct(F.when(F.col("event_id") % 4 == 0, "gradient_error").otherwise("gradient_complete").alias("type"), F.col("server_id").cast("string").alias("server_id"), (F.col("event_id") % 8).cast("int").alias("concurrency"), (F.col("actual_cs") / 100).alias("per_file_rtf"), F.when(F.col("event_id") % 4 == 0, "timeout").alias("error"))
    d.completions.select(F.to_json(line).alias("value")).write.text(to)
    last = F.struct(F.lit("benchmark_complete").alias("type"), F.col("server_id").cast("string").alias("server_id"), F.col("n").cast("int").alias("recommended_concurrency"), (F.col("n") > 60).alias("gradient_complete"))
    d.completions.groupBy("server_id").agg(F.count("*").alias("n")).select(F.to_json(last).alias("value")).coalesce(1).write.mode("append").text(to)
    return to


def _benchmark_levels(d):
    e = src.benchmark_events(d.spark, _benchmark_log(d, src.shared_folder(d.spark, "benchmark")))
    levels = e["levels"].select("server_id", "concurrency", "per_file_rtf", F.lit(None).cast("string").alias("error"))
    return levels.unionByName(e["errors"].select("server_id", "concurrency", F.lit(None).cast("double").alias("per_file_rtf"), "error"))


add("s07_benchmark_levels", _benchmark_levels, "SELECT server_id::VARCHAR AS server_id, (event_id % 8)::INT AS concurrency, CASE WHEN event_id % 4 > 0 THEN actual_cs / 100 END AS per_file_rtf, CASE WHEN event_id % 4 = 0 THEN 'timeout' END AS error FROM d_completions")
add(
    "s08_newest_benchmark",
    lambda d: src.newest_benchmark(d.spark, _benchmark_log(d, src.shared_folder(d.spark, "archive")), 4_102_444_800).select("server_id", "recommended_concurrency", "gradient_complete", (F.col("age_minutes") > 0).alias("older")),
    "SELECT server_id::VARCHAR AS server_id, count(*)::INT AS recommended_concurrency, count(*) > 60 AS gradient_complete, true AS older FROM d_completions GROUP BY server_id",
)


def _probes(d):
    """Probe output for every file, by its extension: containers with a cover picture, with video, without sound."""
    id_, name = F.col("file_id"), F.col("original_name")
    stream = lambda kind, codec, rate=None: F.struct(F.lit(kind).alias("codec_type"), F.lit(codec).alias("codec_name"), F.lit(rate).cast("string").alias("sample_rate"), F.when(F.lit(kind == "audio"), (id_ % 3).cast("int")).alias("channels"))
    kinds = [F.array(stream("audio", "pcm_s16le", "16000")), F.array(stream("video", "mjpeg"), stream("audio", "aac", "44100")), F.array(stream("video", "h264"), stream("audio", "aac", "n/a")), F.array(stream("data", "bin_data"))]
    doc = F.struct(F.struct(F.col("duration_sec").cast("string").alias("duration"), F.regexp_extract(name, r"([^.]*)$", 1).alias("format_name")).alias("format"), F.when(id_ % 4 == 0, kinds[0]).when(id_ % 4 == 1, kinds[1]).when(id_ % 4 == 2, kinds[2]).otherwise(kinds[3]).alias("streams"))
    to = src.shared_folder(d.spark, "probes")
    d.files.select("file_id", F.to_json(doc).alias("probe")).write.json(to)
    return d.spark.read.schema("file_id long, probe string").json(to).select("file_id", src.probe_metadata(F.col("probe")).alias("p")).select("file_id", "p.*")


add(
    "s09_probe_metadata",
    _probes,
    """SELECT file_id, nullif(duration_sec::DOUBLE, 0) AS duration_sec, ['audio', 'audio', 'video', 'unknown'][file_id % 4 + 1] AS media_type, ['pcm_s16le', 'aac', 'h264', NULL][file_id % 4 + 1] AS codec,
CASE file_id % 4 WHEN 0 THEN 16000 WHEN 1 THEN 44100 END::INT AS sample_rate, CASE WHEN file_id % 4 < 3 THEN file_id % 3 END::INT AS channels,
CASE regexp_extract(original_name, '([^.]*)$', 1) WHEN 'wav' THEN 'audio/wav' WHEN 'mp3' THEN 'audio/mpeg' WHEN 'flac' THEN 'audio/flac' WHEN 'ogg' THEN 'audio/ogg' WHEN 'mp4' THEN 'video/mp4' WHEN 'webm' THEN 'video/webm' END AS mime FROM d_files""",
)


def _progress_lines(d):
    """The event log as a stream into the progress sink, and what a later reader finds."""
    to = src.shared_folder(d.spark, "progress")
    e = streams.event_stream(d.spark, f"{d.sf_dir}/events.parquet").select(F.col("user_id").alias("task_id"), "event_id", F.col("event_type").alias("status"), F.col("value").alias("progress"))
    streams.progress_sink(e, f"{to}/out", f"{to}/state").awaitTermination()
    return d.spark.read.schema("task_id long, event_type string, status string, progress double, event_id long").json(f"{to}/out")


add("s16_progress_sink", _progress_lines, "SELECT user_id AS task_id, 'progress' AS event_type, event_type AS status, value AS progress, event_id FROM events")
