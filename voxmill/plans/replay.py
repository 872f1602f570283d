"""Registered replays. Their SQL walks each key's rows one by one, by recursion."""

from pyspark.sql import functions as F

from voxmill.functions import signatures as sig, vectorised as vec
from voxmill.operators import replay as op
from voxmill.plans.registry import add


def samples(d):
    return d.task_events.select("task_id", F.expr("ts_us div 1000000").alias("at_s"), "event_id", F.when(F.col("to_status") == "FAILED", "DISPATCHED").otherwise(F.col("to_status")).alias("status"), ((F.col("event_id") % 50) / 50.0).alias("progress"))


def emitted_sql(lifetime: str) -> str:
    """``lifetime``: condition under which a new listener opens at row c after state w."""
    new = f"(({lifetime}) OR (NOT w.ended AND (c.status <> w.status OR abs(c.progress - w.progress) > 0.01)))"
    return f"""
WITH RECURSIVE s AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY at_s, event_id) AS rn FROM (SELECT task_id, ts_us // 1000000 AS at_s, event_id,
    CASE WHEN to_status = 'FAILED' THEN 'DISPATCHED' ELSE to_status END AS status, (event_id % 50) / 50.0::DOUBLE AS progress FROM d_events)),
w AS (SELECT task_id, rn, event_id, at_s AS opened, status, progress, status = 'SUCCEEDED' AS ended, true AS sent FROM s WHERE rn = 1
  UNION ALL
  SELECT c.task_id, c.rn, c.event_id, CASE WHEN {lifetime} THEN c.at_s ELSE w.opened END, CASE WHEN {new} THEN c.status ELSE w.status END, CASE WHEN {new} THEN c.progress ELSE w.progress END,
    CASE WHEN {new} THEN c.status = 'SUCCEEDED' ELSE w.ended END, {new} FROM w JOIN s c ON c.task_id = w.task_id AND c.rn = w.rn + 1)
SELECT task_id, event_id, status, progress FROM w WHERE sent"""


def spaced_sql(keys: str, rows: str, every: str) -> str:
    """Rows (keys, at_s, event_id) of ``rows``, of which one of a key comes through and then the next after ``every`` seconds."""
    same = " AND ".join(f"c.{k.strip()} = w.{k.strip()}" for k in keys.split(","))
    mine = ", ".join(f"c.{k.strip()}" for k in keys.split(","))
    return f"""
WITH RECURSIVE a AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY at_s, event_id) AS rn FROM ({rows})),
w AS (SELECT {keys}, rn, event_id, at_s, at_s AS last, true AS sent FROM a WHERE rn = 1
  UNION ALL
  SELECT {mine}, c.rn, c.event_id, c.at_s, CASE WHEN c.at_s - w.last >= {every} THEN c.at_s ELSE w.last END, c.at_s - w.last >= {every} FROM w JOIN a c ON {same} AND c.rn = w.rn + 1)
SELECT {keys}, event_id, at_s FROM w WHERE sent"""


add("w04_emitted_changes", lambda d: op.emitted_changes(samples(d)), emitted_sql("false"))
add(
    "w21_grouped_alerts",
    lambda d: op.grouped_alerts(d.task_events.where("to_status = 'FAILED'").select(F.concat(F.lit("failed_"), (F.col("task_id") % 20).cast("string")).alias("alertname"), F.when(F.col("event_id") % 9 == 0, "critical").otherwise("warning").alias("severity"), F.expr("ts_us div 1000000").alias("at_s"), "event_id")),
    spaced_sql("alertname, severity", "SELECT 'failed_' || (task_id % 20) AS alertname, CASE WHEN event_id % 9 = 0 THEN 'critical' ELSE 'warning' END AS severity, ts_us // 1000000 AS at_s, event_id FROM d_events WHERE to_status = 'FAILED'", "CASE WHEN c.severity = 'critical' THEN 3600 ELSE 14400 END"),
)


def _quiet(d):
    """Eight silences from each completion, dealt out over all files."""
    n = d.files.count()
    start = (F.col("event_id") * 7919 + F.col("j") * 450_001) % 3_600_000
    rows = d.completions.select("event_id", "predicted_cs", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("j"))
    return rows.select((F.col("event_id") % n).alias("file_id"), start.alias("start_ms"), (start + 200 + F.col("predicted_cs") % 1500).alias("end_ms"))


add(
    "c02_segment_plans",
    lambda d: op.plan_segments(d.files.where("duration_sec is not null").select("file_id", (F.col("duration_sec") * 1000).alias("total_ms")), _quiet(d)),
    """
WITH RECURSIVE f AS (SELECT file_id, duration_sec * 1000 AS total FROM d_files WHERE duration_sec IS NOT NULL),
q AS (SELECT event_id % (SELECT count(*) FROM part) AS file_id, (event_id * 7919 + j * 450001) % 3600000 AS a, 200 + predicted_cs % 1500 AS len FROM d_completions, (SELECT unnest(range(0, 8)) AS j)),
w AS (SELECT file_id, total, 0::BIGINT AS idx, 0::BIGINT AS pos FROM f
  UNION ALL
  SELECT file_id, total, idx + 1, cut FROM (
    SELECT w.file_id, w.total, w.idx, coalesce(first(m ORDER BY rank, -len, a) FILTER (WHERE rank IS NOT NULL), w.pos + 720000) AS cut FROM w LEFT JOIN (SELECT *, a + len // 2 AS m FROM q) s ON s.file_id = w.file_id,
      LATERAL (SELECT CASE WHEN m NOT BETWEEN w.pos + 120000 AND w.pos + 720000 THEN NULL
        WHEN len >= 800 AND m BETWEEN w.pos + 600000 AND w.pos + 660000 THEN 1 WHEN len >= 800 AND m BETWEEN w.pos + 540000 AND w.pos + 600000 THEN 2
        WHEN len >= 800 AND m > w.pos + 660000 THEN 3 WHEN len >= 300 AND m >= w.pos + 540000 THEN 4 END AS rank)
    WHERE w.total - w.pos > 720000 GROUP BY w.file_id, w.total, w.idx, w.pos) WHERE total - cut >= 120000)
SELECT file_id, idx AS segment_index, greatest(pos - CASE WHEN idx > 0 THEN 400 ELSE 0 END, 0) AS source_start_ms, least(coalesce(nxt + 400, total), total) AS source_end_ms, pos AS keep_start_ms, coalesce(nxt, total) AS keep_end_ms
FROM (SELECT *, lead(pos) OVER (PARTITION BY file_id ORDER BY idx) AS nxt FROM w)""",
)
CALIBRATION = """
WITH RECURSIVE s AS (SELECT *, actual_cs / 100 AS a, predicted_cs / 100 AS p, row_number() OVER v AS rn, count(*) OVER o AS n, list_sort(list(actual_cs / 100 / audio_sec) OVER o) AS seen FROM d_completions
    WINDOW v AS (PARTITION BY server_id, work_kind ORDER BY ts_us, event_id), o AS (PARTITION BY server_id, work_kind ORDER BY ts_us, event_id ROWS 49 PRECEDING)),
w AS (SELECT server_id, work_kind, 0::BIGINT AS rn, NULL::BIGINT AS event_id, NULL::DOUBLE AS before, 1.0::DOUBLE AS factor, 0.1::DOUBLE AS penalty, 0 AS fast FROM s WHERE rn = 1
  UNION ALL
  SELECT c.server_id, c.work_kind, c.rn, c.event_id, a / (p / factor),
    CASE WHEN before IS NOT NULL AND abs((before + a / (p / factor)) / 2 - 1) > 0.05 THEN least(3.0, greatest(0.5, round_even((before + a / (p / factor)) / 2 / 0.1::DOUBLE, 0) / 10)) ELSE factor END,
    CASE WHEN a / p > 1.3 THEN penalty * 1.2::DOUBLE WHEN a / p < 0.7 AND fast = 9 THEN greatest(0.01, penalty * 0.9::DOUBLE) ELSE penalty END,
    CASE WHEN a / p < 0.7 THEN (fast + 1) % 10 ELSE fast END
  FROM w JOIN s c ON c.server_id = w.server_id AND c.work_kind = w.work_kind AND c.rn = w.rn + 1)
SELECT server_id, work_kind, event_id, CASE WHEN n >= 3 THEN seen[(9 * n + 9) // 10] ELSE 0.3::DOUBLE END AS p90, a / p AS deviation, penalty, factor FROM w JOIN s USING (server_id, work_kind, event_id)"""
add("c04_calibration", lambda d: op.calibrate(d.completions), CALIBRATION)
#: failures=2, timeout 3600 s, probes=3. Places: 0, 1 closed; 2 open; 3, 4 half open.
BREAKER = """
RECURSIVE s AS (SELECT task_id AS server_id, ts_us // 1000000 AS at_s, event_id, to_status <> 'FAILED' AS ok, row_number() OVER (PARTITION BY task_id ORDER BY ts_us // 1000000, event_id) AS rn FROM d_events),
w AS (SELECT server_id, 0::BIGINT AS rn, NULL::BIGINT AS event_id, NULL::BOOLEAN AS through, 0 AS place, NULL::BIGINT AS since FROM s WHERE rn = 1
  UNION ALL
  SELECT c.server_id, c.rn, c.event_id, NOT (place = 2 AND c.at_s - since < 3600),
    CASE WHEN place = 2 AND c.at_s - since < 3600 THEN 2 WHEN c.ok THEN CASE place WHEN 2 THEN 3 WHEN 3 THEN 4 ELSE 0 END WHEN place = 0 THEN 1 ELSE 2 END,
    CASE WHEN c.ok OR place = 2 AND c.at_s - since < 3600 THEN since ELSE c.at_s END
  FROM w JOIN s c ON c.server_id = w.server_id AND c.rn = w.rn + 1),
calls AS (SELECT server_id, event_id, through AS let_through, CASE WHEN place < 2 THEN 'CLOSED' WHEN place = 2 THEN 'OPEN' ELSE 'HALF_OPEN' END AS state, since, rn FROM w WHERE rn > 0)"""
add(
    "c11_breaker",
    lambda d: op.breaker(d.task_events.select(F.col("task_id").alias("server_id"), F.expr("ts_us div 1000000").alias("at_s"), "event_id", (F.col("to_status") != "FAILED").alias("ok")), failures=2, timeout_s=3600),
    f"WITH {BREAKER.strip()} SELECT server_id, event_id, let_through, state FROM calls",
)
add("x25_block_ratio", lambda d: vec.similarity(d.transcript_pairs, "baseline_text", "experiment_text", 400).select("pair_id", F.round("similarity", 6).alias("similarity")))


def _pad(secret: str, byte: int) -> str:
    return bytes(b ^ byte for b in secret.encode().ljust(64, b"\0")).hex()


def _notices(d, *more):
    return d.tasks.where("completed_s is not null").select("task_id", "status", *more)


add(
    "s17_callbacks",
    lambda d: sig.signed(_notices(d, "error_code"), sig.callback_payload(F.col("task_id"), F.col("task_id"), F.col("status"), F.lit(None).cast("string"), F.col("error_code")), F.lit("secret")).select("task_id", "payload_json", "signature"),
    f"""SELECT task_id, payload_json, 'sha256=' || sha256(unhex('{_pad("secret", 0x5C)}') || unhex(sha256(unhex('{_pad("secret", 0x36)}') || encode(payload_json)))) AS signature
FROM (SELECT task_id, '{{"event_id":' || task_id || ',"task_id":' || task_id || ',"status":"' || status || '"' || CASE WHEN error_code IS NULL THEN '' ELSE ',"error_message":"' || error_code || '"' END || '}}' AS payload_json FROM d_tasks WHERE completed_s IS NOT NULL)""",
)
add(
    "x31_signatures",
    lambda d: sig.signed(_notices(d), sig.callback_payload(F.col("task_id"), F.col("task_id"), F.col("status"), F.lit(None).cast("string"), F.lit(None).cast("string")), F.when(F.col("task_id") % 2 == 0, "secret").otherwise("other")).select("task_id", sig.signature_valid(F.col("payload_json"), F.lit("secret"), F.col("signature")).alias("valid")),
    "SELECT task_id, task_id % 2 = 0 AS valid FROM d_tasks WHERE completed_s IS NOT NULL",
)
