"""Registered selections."""

from pyspark.sql import functions as F

from voxmill import constants as C
from voxmill.functions import network as net
from voxmill.operators import filters as op
from voxmill.plans.registry import add

AS_OF = "(SELECT max(created_s) + 43200 FROM d_tasks)"
LATE = "1700000000"


def _levels(d):
    return F.when(F.col("file_id") % 4 == 0, "10m").when(F.col("file_id") % 4 == 1, "20m").when(F.col("file_id") % 4 == 2, "30m").otherwise("off")


add("f01_point_lookup", lambda d: op.point_lookup(d.tasks, 77).select("task_id", "user_id", "status"), "SELECT task_id, user_id, status FROM d_tasks WHERE task_id = 77")
add("f02_task_list", lambda d: op.task_list(d.tasks, status="FAILED", owner=3).select("task_id", "task_group_id", "error_code"), "SELECT task_id, task_group_id, error_code FROM d_tasks WHERE status = 'FAILED' AND user_id = 3")
add("f03_search", lambda d: op.search(d.tasks, d.files, "12_1").select("task_id", "original_name"), "SELECT task_id, original_name FROM d_tasks t LEFT JOIN d_files f USING (file_id) WHERE task_id::VARCHAR ILIKE '%12_1%' OR original_name ILIKE '%12_1%'")
add("f04_available_servers", lambda d: d.servers.where(op.available(d.servers)).select("server_id", "host", "port"), "SELECT server_id, host, port FROM d_servers WHERE enabled AND status = 'ONLINE' AND max_concurrency > 0")
add("f05_terminal_flag", lambda d: d.tasks.select("task_id", op.is_terminal(F.col("status"), F.col("retry_count")).alias("is_terminal")), "SELECT task_id, status IN ('SUCCEEDED','CANCELED') OR (status = 'FAILED' AND retry_count >= 3) AS is_terminal FROM d_tasks")
add(
    "f06_illegal_moves",
    lambda d: op.illegal_moves(d.task_events).select("event_id", "from_status", "to_status"),
    f"""SELECT event_id, from_status, to_status FROM d_events WHERE from_status IS NOT NULL AND (from_status, to_status) NOT IN ({", ".join(f"('{a}','{b}')" for a, to in C.TRANSITIONS.items() for b in to)})""",
)
add(
    "f07_state_sets",
    lambda d: d.tasks.groupBy(op.state_set(F.col("status")).alias("set"), "status").agg(F.count("*").alias("n")),
    "SELECT CASE WHEN status IN ('DISPATCHED','TRANSCRIBING') THEN 'active' WHEN status IN ('PENDING','PREPROCESSING','QUEUED') THEN 'queue' WHEN status IN ('SUCCEEDED','FAILED','CANCELED') THEN 'terminal' ELSE 'other' END AS \"set\", status, count(*) AS n FROM d_tasks GROUP BY 1, 2",
)
add(
    "f08_frozen_work",
    lambda d: op.frozen(d.tasks, d.segments, d.as_of_s),
    f"SELECT 'task' AS kind, task_id AS work_id, {AS_OF} - started_s AS elapsed_s FROM d_tasks WHERE status = 'TRANSCRIBING' AND started_s < {AS_OF} - 3600 UNION ALL SELECT 'segment', segment_id, {AS_OF} - started_s FROM d_segments WHERE status = 'TRANSCRIBING' AND started_s < {AS_OF} - 3600",
)
add("f09_stale_claims", lambda d: op.stale_claims(d.tasks, d.as_of_s).select("task_id", "created_s"), f"SELECT task_id, created_s FROM d_tasks WHERE status = 'PREPROCESSING' AND created_s < {AS_OF} - 300")
add("f10_recovery", lambda d: op.recovery(d.tasks, d.as_of_s), f"SELECT task_id, status, CASE WHEN started_s IS NULL OR started_s < {AS_OF} - 600 THEN 1 ELSE 0 END AS recover FROM d_tasks WHERE status IN ('DISPATCHED','TRANSCRIBING')")
add(
    "f11_needs_segmentation",
    lambda d: op.needs_segmentation(d.files, _levels(d)).select("file_id", "level", "split"),
    "SELECT file_id, level, coalesce(duration_sec > CASE level WHEN '10m' THEN 720 WHEN '20m' THEN 1440 WHEN '30m' THEN 2160 END, false) AS split FROM (SELECT *, CASE file_id % 4 WHEN 0 THEN '10m' WHEN 1 THEN '20m' WHEN 2 THEN '30m' ELSE 'off' END AS level FROM d_files)",
)
_OPTIONS = "CASE {k} % 6 WHEN 0 THEN '{{\"segment_level\": \"20m\"}}' WHEN 1 THEN '{{\"segment_level\": \"off\"}}' WHEN 2 THEN '{{\"auto_segment\": \"off\", \"segment_level\": \"30m\"}}' WHEN 3 THEN '{{\"auto_segment\": \"on\"}}' WHEN 4 THEN '{{broken' ELSE NULL END"
add(
    "f12_segment_level",
    lambda d: d.tasks.select("task_id", op.segment_level(F.expr(_OPTIONS.format(k="task_id"))).alias("level")),
    "SELECT task_id, CASE task_id % 6 WHEN 0 THEN '20m' WHEN 1 THEN 'off' WHEN 2 THEN 'off' ELSE '10m' END AS level FROM d_tasks",
)
add(
    "f13_empty_result_retry",
    lambda d: d.transcript_pairs.select("pair_id", op.retry_empty(F.when(F.col("duration_sec") % 3 == 0, F.lit("  ")).otherwise(F.col("baseline_text")), F.col("duration_sec"), C.EMPTY_RESULT_TASK_S).alias("retry_task"), op.retry_empty(F.when(F.col("duration_sec") % 3 == 0, F.lit("  ")).otherwise(F.col("baseline_text")), F.col("duration_sec"), C.EMPTY_RESULT_SEGMENT_S).alias("retry_segment")),
    "SELECT pair_id, trim(t) = '' AND duration_sec >= 30 AS retry_task, trim(t) = '' AND duration_sec >= 10 AS retry_segment FROM (SELECT *, CASE WHEN duration_sec % 3 = 0 THEN '  ' ELSE baseline_text END AS t FROM d_transcript_pairs)",
)
add(
    "f14_upload_accepted",
    lambda d: d.files.select("file_id", op.upload_accepted(F.col("original_name"), F.col("size_bytes"), 40_000_000).alias("accepted")),
    "SELECT file_id, lower(regexp_extract(original_name, '\\.[^.]+$', 0)) IN ('.wav','.mp3','.mp4','.flac','.ogg','.webm','.m4a','.aac','.wma','.mkv','.avi','.mov','.pcm') AND size_bytes <= 40000000 AS accepted FROM d_files",
)
add(
    "f15_stale_results",
    lambda d: op.stale_results(d.segments.select("task_id", "segment_id", (F.col("retry_count") % 3).alias("generation")), d.tasks.select("task_id", (F.col("retry_count") % 3).alias("run_generation"))).select("segment_id", "generation", "current"),
    "SELECT segment_id, s.retry_count % 3 AS generation, t.retry_count % 3 AS current FROM d_segments s LEFT JOIN d_tasks t USING (task_id) WHERE s.retry_count % 3 IS DISTINCT FROM t.retry_count % 3",
)


def _outbox(d):
    return d.tasks.where("completed_s is not null").select(F.col("task_id").alias("outbox_id"), F.when(F.col("task_id") % 3 == 0, "SENT").otherwise("PENDING").alias("status"), (F.col("task_id") % 7).alias("retry_count"), F.col("completed_s").alias("created_s"))


_OUTBOX = "(SELECT task_id AS outbox_id, CASE WHEN task_id % 3 = 0 THEN 'SENT' ELSE 'PENDING' END AS status, task_id % 7 AS retry_count, completed_s AS created_s FROM d_tasks WHERE completed_s IS NOT NULL)"
add("f16_outbox_due", lambda d: op.outbox_due(_outbox(d)).select("outbox_id", "retry_count"), f"SELECT outbox_id, retry_count FROM {_OUTBOX} WHERE status = 'PENDING' AND retry_count < 5 ORDER BY created_s, outbox_id LIMIT 50")
add("f16_outbox_exhausted", lambda d: op.outbox_exhausted(_outbox(d)).select("outbox_id", "retry_count"), f"SELECT outbox_id, retry_count FROM {_OUTBOX} WHERE status = 'PENDING' AND retry_count >= 5")
add(
    "f17_retry_route",
    lambda d: op.retry_route(d.tasks, d.segments),
    "SELECT task_id, error_code, CASE WHEN task_id NOT IN (SELECT task_id FROM d_segments) THEN 'plain_requeue' WHEN error_code = 'MERGE_FAILED' THEN 'merge_retry' WHEN error_code = 'SEGMENT_RETRY_EXHAUSTED' THEN 'whole_file_fallback' ELSE 'skip' END AS route FROM d_tasks WHERE status = 'FAILED' AND retry_count < 3",
)
add(
    "f19_scan_skip",
    lambda d: d.files.select("file_id", op.scan_skip(F.when(F.col("file_id") % 11 == 0, F.concat(F.lit("a/."), "original_name")).when(F.col("file_id") % 13 == 0, F.lit("b/Thumbs.db")).otherwise(F.col("original_name")), F.col("size_bytes"), F.col("file_id") % 60).alias("skip")),
    "SELECT file_id, CASE WHEN file_id % 11 = 0 THEN 'hidden' WHEN file_id % 13 = 0 THEN 'system' WHEN size_bytes = 0 THEN 'empty' WHEN file_id % 60 < 10 THEN 'unfinished' END AS skip FROM d_files",
)
add(
    "f20_server_type",
    lambda d: d.servers.select("server_id", op.server_type(F.when(F.col("server_id") % 4 == 0, " Main ").otherwise(""), F.when(F.col("server_id") % 3 == 0, "v2-main").when(F.col("server_id") % 3 == 1, "v1_old").otherwise("other")).alias("server_type")),
    "SELECT server_id, CASE WHEN server_id % 4 = 0 THEN 'main' WHEN server_id % 3 = 0 THEN 'main' WHEN server_id % 3 = 1 THEN 'legacy' END AS server_type FROM d_servers",
)


def _intake(d):
    said = F.when(F.col("turn") % 4 == 0, F.concat(F.lit("Please transcribe: "), "text")).when(F.col("turn") % 4 == 1, F.concat(F.lit("subtitle, private: "), "text")).otherwise(F.col("text"))
    name = F.when(F.col("conv_id") % 3 == 0, "a.WAV").when(F.col("conv_id") % 3 == 1, "b.png")
    level, sensitive, negative = op.intake(said, name)
    return d.conversations.select("conv_id", "turn", level.alias("confidence"), sensitive.alias("sensitive"), negative.alias("negative"))


_HAS = lambda ws: "(" + " OR ".join(f"contains(low, '{w}')" for w in ws) + ")"
add(
    "f21_intake",
    _intake,
    f"""SELECT conv_id, turn, CASE WHEN media AND ({_HAS(C.STRONG_WORDS)} OR {_HAS(C.MEDIUM_WORDS)}) THEN 'high' WHEN media OR {_HAS(C.STRONG_WORDS)} THEN 'medium' WHEN {_HAS(C.MEDIUM_WORDS)} THEN 'low' ELSE 'none' END AS confidence,
  {_HAS(C.SENSITIVE_WORDS)} AS sensitive, conv_id % 3 = 1 AS negative
FROM (SELECT conv_id, turn, conv_id % 3 = 0 AS media, lower(CASE turn % 4 WHEN 0 THEN 'Please transcribe: ' || text WHEN 1 THEN 'subtitle, private: ' || text ELSE text END) AS low FROM conversations)""",
)
add("f22_segments_of_tasks", lambda d: op.segments_of(d.segments, "FAILED"), "SELECT task_id, segment_index, segment_id, status FROM d_segments WHERE status = 'FAILED'")


def _addresses(d):
    host = F.when(F.col("server_id") % 5 == 0, F.concat(F.lit("172."), (F.col("server_id") % 40).cast("string"), F.lit(".0.1"))).when(F.col("server_id") % 5 == 1, "db.internal").when(F.col("server_id") % 5 == 2, "8.8.8.8").otherwise(F.col("host"))
    return d.servers.select("server_id", net.server_address_problem(host, F.when(F.col("server_id") % 10 == 2, 70000).otherwise(F.col("port"))).alias("problem"))


add("f18_private_addresses", _addresses, "SELECT server_id, CASE WHEN server_id % 5 = 0 AND server_id % 40 BETWEEN 16 AND 31 THEN 'private' WHEN server_id % 5 = 1 OR server_id % 5 > 2 THEN 'private' WHEN server_id % 10 = 2 THEN 'port' END AS problem FROM d_servers")


def _ipv6(d):
    id_, hex_ = F.col("server_id"), F.lower(F.hex("server_id"))
    last = F.when(id_ % 4 == 1, "1").otherwise("2")
    forms = [F.concat(F.lit("::ffff:7f00:"), hex_), F.concat(F.lit("0:0:0:0:0:0:0:"), last), F.concat(F.lit("[FD00:0:"), hex_, F.lit("::1]")), F.concat(F.lit("2001:db8::"), hex_), F.concat(F.lit("fe80::"), hex_, F.lit("%eth0")), F.concat(F.lit("::ffff:10.0.0."), (id_ % 256).cast("string"))]
    host = F.element_at(F.array(*forms), (id_ % 6 + 1).cast("int"))
    return d.servers.select("server_id", host.alias("host"), net.is_private(host).alias("private"))


add(
    "f18_ipv6_addresses",
    _ipv6,
    """SELECT server_id, CASE server_id % 6 WHEN 0 THEN '::ffff:7f00:' || h WHEN 1 THEN '0:0:0:0:0:0:0:' || CASE WHEN server_id % 4 = 1 THEN '1' ELSE '2' END WHEN 2 THEN '[FD00:0:' || h || '::1]'
  WHEN 3 THEN '2001:db8::' || h WHEN 4 THEN 'fe80::' || h || '%eth0' ELSE '::ffff:10.0.0.' || server_id % 256 END AS host,
  server_id % 6 IN (0, 2, 4) OR server_id % 12 IN (1) AS private FROM (SELECT *, lower(format('{:x}', server_id)) AS h FROM d_servers)""",
)
