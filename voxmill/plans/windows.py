"""Registered window queries."""

from pyspark.sql import functions as F

from voxmill.operators import filters, windows as op
from voxmill.operators.aggregates import benchmark_levels, lower_median
from voxmill.operators.joins import kept_utterances
from voxmill.plans.aggregates import CROWDED, LEVELS, PLAN, _runs, crowded, plan_table
from voxmill.plans.registry import add

_W = "PARTITION BY server_id, work_kind ORDER BY ts_us, event_id"
add("w01_rolling_p90", lambda d: op.rolling_p90(d.completions, F.col("actual_cs")), f"SELECT event_id, server_id, work_kind, CASE WHEN n >= 3 THEN s[(9 * n + 9) // 10] END AS p90 FROM (SELECT *, count(*) OVER w AS n, list_sort(list(actual_cs) OVER w) AS s FROM d_completions WINDOW w AS ({_W} ROWS 49 PRECEDING))")
add("w02_rolling_mean", lambda d: op.rolling_mean(d.completions, F.col("actual_cs")), f"SELECT event_id, server_id, work_kind, round(sum(actual_cs) OVER w::DOUBLE / count(*) OVER w, 4) AS mean, count(*) OVER w AS n FROM d_completions WINDOW w AS ({_W} ROWS 49 PRECEDING)")
add(
    "w03_eta_factor",
    lambda d: op.eta_factor(d.completions),
    f"SELECT event_id, server_id, work_kind, round(coalesce(last_value(c IGNORE NULLS) OVER ({_W} ROWS UNBOUNDED PRECEDING), 1.0::DOUBLE), 1) AS factor FROM (SELECT *, CASE WHEN abs(m - 1) > 0.05 THEN least(3.0::DOUBLE, greatest(0.5::DOUBLE, round(m * 10) / 10)) END AS c FROM (SELECT *, CASE WHEN count(*) OVER w = 2 THEN avg(actual_cs / predicted_cs) OVER w END AS m FROM d_completions WHERE predicted_cs > 0 AND actual_cs > 0 WINDOW w AS ({_W} ROWS 1 PRECEDING)))",
)
add("w05_dwell", lambda d: op.dwell(d.task_events), "SELECT task_id, to_status AS status, sum(stay)::BIGINT AS dwell_us, count(stay) AS stays FROM (SELECT *, lead(ts_us) OVER (PARTITION BY task_id ORDER BY ts_us, event_id) - ts_us AS stay FROM d_events) GROUP BY 1, 2")
add(
    "w06_broken_chain",
    lambda d: op.broken_chain(d.task_events.withColumn("from_status", F.when(F.col("event_id") % 97 == 0, F.when(F.col("from_status").isNotNull(), "PENDING")).otherwise(F.col("from_status")))),
    "SELECT event_id, task_id, from_status, expected FROM (SELECT * REPLACE (CASE WHEN event_id % 97 = 0 AND from_status IS NOT NULL THEN 'PENDING' ELSE from_status END AS from_status), lag(to_status) OVER (PARTITION BY task_id ORDER BY ts_us, event_id) AS expected FROM d_events) WHERE from_status IS NOT NULL AND expected IS NOT NULL AND from_status <> expected",
)
add(
    "w07_order_violations",
    lambda d: op.order_violations(d.utterances.withColumn("start_ms", F.col("start_ms") - F.col("pos") % 5 * 200)),
    "SELECT task_id, segment_index, pos, start_ms, latest, rn::INT AS rn FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY segment_index, pos) AS rn FROM (SELECT *, max(end_ms) OVER (PARTITION BY task_id ORDER BY segment_index, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM (SELECT * REPLACE (start_ms - pos % 5 * 200 AS start_ms) FROM d_utterances) WHERE start_ms > 0 OR end_ms > 0) WHERE start_ms < latest) WHERE rn <= 10",
)
MEDIAN = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY server_id, level ORDER BY throughput_ppm, repeat) AS rn, count(*) OVER (PARTITION BY server_id, level) AS c FROM {LEVELS}) WHERE rn = (c + 1) // 2)"
BEST = f"""(SELECT server_id, max(level) AS level, (list(throughput_ppm ORDER BY level DESC))[1] AS throughput_ppm FROM (SELECT *, max(bad) OVER (PARTITION BY server_id ORDER BY level) AS failed FROM (
  SELECT server_id, level, throughput_ppm, (coalesce(prev > 0 AND 1.0::DOUBLE - throughput_ppm / prev < 0.1, false) OR (prev IS NOT NULL AND single > 0 AND per_file_ppm > 2.0::DOUBLE * single))::INT AS bad
  FROM (SELECT *, lag(throughput_ppm) OVER w AS prev, first_value(per_file_ppm) OVER w AS single FROM {MEDIAN} WINDOW w AS (PARTITION BY server_id ORDER BY level)))) WHERE failed = 0 GROUP BY 1)"""
add("w08_best_level", lambda d: op.best_level(lower_median(benchmark_levels(_runs(d)), "throughput_ppm")), f"SELECT server_id, level, throughput_ppm FROM {BEST}")
add(
    "w09_numbered_names",
    lambda d: op.numbered_names(d.files, "user_id", F.regexp_replace("original_name", r"_\d+\.[^.]*$", ""), "file_id"),
    "SELECT user_id, file_id, CASE WHEN rn = 1 THEN base ELSE base || '_' || rn END AS name FROM (SELECT *, row_number() OVER (PARTITION BY user_id, base ORDER BY file_id) AS rn FROM (SELECT *, regexp_replace(original_name, '_\\d+\\.[^.]*$', '') AS base FROM d_files))",
)
add("w10_queue_position", lambda d: op.queue_position(plan_table(d)), f"SELECT batch, item, row_number() OVER (PARTITION BY batch ORDER BY est_s DESC, item)::INT AS position FROM {PLAN}")
add("w11_chunks", lambda d: op.chunk_bounds(d.files, "user_id", "file_id", 8), "SELECT user_id, i // 8 AS chunk, min(i) AS first, max(i) AS last, count(*) AS n FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY file_id) - 1 AS i FROM d_files) GROUP BY 1, 2".replace(" AS first", ' AS "first"').replace(" AS last", ' AS "last"'))
add(
    "w12_trailing_bytes",
    lambda d: op.trailing_bytes(d.task_events.select("event_id", (F.col("task_id") % 5).alias("user_id"), "ts_us", (F.col("event_id") * 37 % 1000).alias("bytes")), 900, 600_000_000),
    "SELECT event_id, user_id, t AS trailing, t > 900 AS over FROM (SELECT event_id, task_id % 5 AS user_id, sum(event_id * 37 % 1000) OVER (PARTITION BY task_id % 5 ORDER BY ts_us RANGE BETWEEN 599999999 PRECEDING AND CURRENT ROW)::BIGINT AS t FROM d_events)".replace(" AS over", ' AS "over"'),
)
add("w13_running_daily", lambda d: op.running_daily(d.tasks, 2), "SELECT task_id, user_id, n::INT AS n, n > 2 AS \"over\" FROM (SELECT *, row_number() OVER (PARTITION BY user_id, created_s // 86400 ORDER BY created_s, task_id) AS n FROM d_tasks)")
add(
    "w14_running_concurrency",
    lambda d: op.running_concurrency(d.tasks),
    "SELECT user_id, task_id, step, (s - least(0, min(s) OVER w))::BIGINT AS running FROM (SELECT *, sum(step) OVER w AS s FROM (SELECT user_id, task_id, created_s AS at_s, 1 AS step FROM d_tasks UNION ALL SELECT user_id, task_id, completed_s, -1 FROM d_tasks WHERE completed_s IS NOT NULL) WINDOW w AS (PARTITION BY user_id ORDER BY at_s, task_id, step ROWS UNBOUNDED PRECEDING)) WINDOW w AS (PARTITION BY user_id ORDER BY at_s, task_id, step ROWS UNBOUNDED PRECEDING)",
)


def _work(d):
    return d.segments.where("started_s is not null and completed_s is not null").select(F.col("assigned_server_id").alias("server_id"), F.col("segment_id").alias("work_id"), "started_s", (F.col("completed_s") + 864000).alias("completed_s"))


add(
    "w15_occupancy",
    lambda d: op.occupancy(_work(d)),
    "SELECT server_id, max(n)::BIGINT AS peak FROM (SELECT server_id, sum(step) OVER (PARTITION BY server_id ORDER BY at_s, step, work_id ROWS UNBOUNDED PRECEDING) AS n FROM (SELECT assigned_server_id AS server_id, segment_id AS work_id, started_s AS at_s, 1 AS step FROM d_segments WHERE started_s IS NOT NULL AND completed_s IS NOT NULL UNION ALL SELECT assigned_server_id, segment_id, completed_s + 864000, -1 FROM d_segments WHERE started_s IS NOT NULL AND completed_s IS NOT NULL)) GROUP BY 1",
)
add("w16_slot_queues", lambda d: op.slot_queues(plan_table(d)), f"SELECT server_id, slot, item, row_number() OVER (PARTITION BY server_id, slot ORDER BY start_s, item)::INT AS place, start_s <= 0 AS now FROM {PLAN}".replace(" AS now", ' AS "now"'))
add("w17_next_items", lambda d: op.next_items(plan_table(d), 4), f"SELECT server_id, item, rn::INT AS rn FROM (SELECT *, row_number() OVER (PARTITION BY server_id ORDER BY start_s <= 0 DESC, start_s, item) AS rn FROM {PLAN}) WHERE rn <= 4")
add(
    "w18_rebalance",
    lambda d: op.rebalance(crowded(plan_table(d)).withColumn("audio_s", F.col("est_s") * 3), d.servers),
    f"""WITH p AS (SELECT *, est_s * 3 AS audio_s FROM {CROWDED}), e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY server_id ORDER BY finish_s DESC, item DESC) AS rn FROM p) WHERE rn <= 3),
i AS (SELECT server_id AS idle_id, coalesce(rtf_baseline, 0.3::DOUBLE) AS rtf FROM d_servers WHERE enabled AND status = 'ONLINE' AND max_concurrency > 0 AND server_id NOT IN (SELECT server_id FROM p)),
t AS (SELECT idle_id, item, finish_s, finish_s - (audio_s * rtf + 5) AS gain FROM e, i)
SELECT idle_id, (list(item ORDER BY gain DESC, item DESC))[1] AS item, round(max(gain), 3) AS gain FROM t WHERE gain >= greatest(3.0::DOUBLE, 0.05::DOUBLE * finish_s) GROUP BY 1""",
)
add("w19_history", lambda d: op.history(d.completions, "server_id").select("server_id", "event_id", "rn"), "SELECT server_id, event_id, rn::INT AS rn FROM (SELECT *, row_number() OVER (PARTITION BY server_id ORDER BY ts_us DESC, event_id DESC) AS rn FROM d_completions) WHERE rn <= 60")
SAMPLES = "(SELECT task_id AS key, ts_us // 1000000 AS at_s, to_status IN ('FAILED','QUEUED') AS bad FROM d_events)"


def samples(d):
    return d.task_events.select(F.col("task_id").alias("key"), F.expr("ts_us div 1000000").alias("at_s"), F.col("to_status").isin("FAILED", "QUEUED").alias("bad"))


add("w20_sustained", lambda d: op.sustained(samples(d), 1706659200, 300), f"SELECT key, min(at_s) AS since_s FROM {SAMPLES} s WHERE bad AND at_s <= 1706659200 AND at_s > coalesce((SELECT max(at_s) FROM {SAMPLES} g WHERE g.key = s.key AND NOT bad AND at_s <= 1706659200), -1) GROUP BY 1 HAVING 1706659200 - min(at_s) >= 300")
add(
    "w22_repeated_phrases",
    lambda d: op.repeated_phrases(d.documents.select(F.col("doc_id").alias("key"), "text"), r"[a-z]{2,}"),
    "SELECT key, count(*) AS repeats FROM (SELECT key, run, lag(run) OVER (PARTITION BY key ORDER BY i) AS prev FROM (SELECT doc_id AS key, unnest(regexp_extract_all(text, '[a-z]{2,}')) AS run, unnest(range(len(regexp_extract_all(text, '[a-z]{2,}')))) AS i FROM documents)) WHERE run = prev GROUP BY 1",
)
add("w23_latest", lambda d: op.latest(d.task_events, "task_id", [F.desc("ts_us"), F.desc("event_id")]).select("task_id", "event_id", "to_status"), "SELECT task_id, event_id, to_status FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY ts_us DESC, event_id DESC) AS rn FROM d_events) WHERE rn = 1")
add(
    "w24_sample_files",
    lambda d: op.sample_files(d.files, filters.extension(F.col("original_name"))),
    """WITH m AS (SELECT * FROM (SELECT file_id, size_bytes, CASE WHEN e IN ('.wav','.flac','.pcm') THEN 'lossless' WHEN e IN ('.mp3','.ogg','.m4a','.aac','.wma') THEN 'compressed' WHEN e IN ('.mp4','.webm','.mkv','.avi','.mov') THEN 'video' END AS kind FROM (SELECT *, lower(regexp_extract(original_name, '\\.[^.]+$', 0)) AS e FROM d_files)) WHERE kind IS NOT NULL AND size_bytes > 0 AND size_bytes <= 10485760),
f AS (SELECT file_id, kind FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY size_bytes, file_id) AS rn FROM m) WHERE rn = 1)
SELECT * FROM f UNION ALL (SELECT file_id, kind FROM m WHERE file_id NOT IN (SELECT file_id FROM f) ORDER BY size_bytes, file_id LIMIT 5)""",
)
