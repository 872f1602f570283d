"""Registered scalar functions over the tables."""

from pyspark.sql import functions as F

from voxmill.functions import scalars as fn, transcripts as tr
from voxmill.plans.registry import add

AS_OF = "(SELECT max(created_s) + 43200 FROM d_tasks)"
_SRT = "printf('%02d:%02d:%02d,%03d', {c} // 3600000, ({c} // 60000) % 60, ({c} // 1000) % 60, {c} % 1000)"


def _tasks_files(d):
    return d.tasks.join(d.files.select("file_id", "duration_sec", "original_name", "size_bytes"), "file_id", "left")


_TF = "(SELECT t.*, f.duration_sec, f.original_name, f.size_bytes FROM d_tasks t LEFT JOIN d_files f USING (file_id))"
add("x01_srt_time", lambda d: d.utterances.select("task_id", "segment_index", "pos", fn.srt_time(F.col("source_start_ms") + F.col("start_ms") + F.col("task_id") * 977_777).alias("at")), f"SELECT task_id, segment_index, pos, {_SRT.format(c='x')} AS \"at\" FROM (SELECT *, source_start_ms + start_ms + task_id * 977777 AS x FROM d_utterances)")
add(
    "x02_character_spacing",
    lambda d: d.conversations.select("conv_id", "turn", fn.join_single_characters(F.when(F.col("turn") % 2 == 0, F.regexp_replace("text", r"(\S)", "$1 ")).otherwise(F.col("text")), F.lit(".")).alias("t")),
    "SELECT conv_id, turn, CASE WHEN contains(t, ' ') AND len(k) > 0 AND len(list_filter(k, lambda x: length(x) <> 1)) = 0 THEN array_to_string(k, '') ELSE t END || '.' AS t FROM (SELECT *, list_filter(regexp_split_to_array(t, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS k FROM (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN regexp_replace(text, '([^ \\t\\n\\x0B\\f\\r])', '\\1 ', 'g') ELSE text END AS t FROM conversations))",
)
_LINES = lambda: F.array_sort(F.collect_list(F.struct("start_ms", "end_ms", "text")))


def _formats(d):
    g = d.utterances.groupBy("task_id", "segment_index").agg(_LINES().alias("l"))
    return g.select("task_id", "segment_index", F.md5(tr.to_srt(F.col("l"))).alias("srt"), F.md5(tr.to_txt(F.col("l"))).alias("txt"))


add(
    "x04_formats",
    _formats,
    f"SELECT task_id, segment_index, md5(string_agg(n || chr(10) || {_SRT.format(c='start_ms')} || ' --> ' || {_SRT.format(c='end_ms')} || chr(10) || text || chr(10), chr(10) ORDER BY n)) AS srt, md5(string_agg(text, chr(10) ORDER BY n)) AS txt FROM (SELECT *, row_number() OVER (PARTITION BY task_id, segment_index ORDER BY start_ms, end_ms, text) AS n FROM d_utterances) GROUP BY 1, 2",
)


def _messages(d):
    k = F.col("conv_id") + F.col("turn")
    mode = F.when(k % 4 == 0, "offline").when(k % 4 == 1, "2pass-offline").when(k % 4 == 2, "2pass-online").otherwise("")
    doc = F.to_json(F.struct(mode.alias("mode"), F.when(k % 3 == 0, "").otherwise(F.col("role")).alias("text"), F.when(k % 5 == 0, "Yes").otherwise("no").alias("is_final"), F.col("role").alias("text_2pass_online")))
    return d.conversations.select("conv_id", "turn", tr.message(doc).alias("m")).select("conv_id", "turn", "m.*")


add(
    "x05_messages",
    _messages,
    "SELECT conv_id, turn, CASE k % 4 WHEN 0 THEN 'offline' WHEN 1 THEN '2pass-offline' WHEN 2 THEN '2pass-online' ELSE '' END AS mode, role AS text, k % 5 = 0 AS is_final, k % 5 = 0 OR k % 4 IN (0, 1) AS is_complete, CASE WHEN k % 4 = 0 THEN CASE WHEN k % 5 = 0 THEN 'legacy_true' ELSE 'always_false' END END AS final_habit FROM (SELECT *, conv_id + turn AS k FROM conversations)",
)
add(
    "x06_progress",
    lambda d: _tasks_files(d).select("task_id", F.round(fn.progress(F.col("status"), F.col("started_s"), F.col("duration_sec"), 0.3, d.as_of_s), 6).alias("progress")),
    f"SELECT task_id, round(CASE status WHEN 'TRANSCRIBING' THEN CASE WHEN started_s IS NOT NULL AND duration_sec > 0 THEN least(0.95::DOUBLE, 0.2::DOUBLE + least(1.0::DOUBLE, ({AS_OF} - started_s) / (duration_sec * 0.3::DOUBLE)) * 0.75::DOUBLE) ELSE 0.2::DOUBLE END WHEN 'PREPROCESSING' THEN 0.05::DOUBLE WHEN 'QUEUED' THEN 0.15::DOUBLE WHEN 'DISPATCHED' THEN 0.2::DOUBLE WHEN 'SUCCEEDED' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END, 6) AS progress FROM {_TF}",
)
ETA = f"CASE WHEN status IN ('SUCCEEDED','FAILED','CANCELED') THEN 0 WHEN status = 'TRANSCRIBING' AND started_s IS NOT NULL AND coalesce(duration_sec, 0) <> 0 THEN trunc(greatest(0::DOUBLE, duration_sec * 0.3::DOUBLE - ({AS_OF} - started_s)))::INT WHEN coalesce(duration_sec, 0) <> 0 THEN trunc(duration_sec * 0.3::DOUBLE + 5)::INT END"


def _eta(d):
    return fn.eta(F.col("status"), F.col("started_s"), F.col("duration_sec"), 0.3, d.as_of_s)


add("x07_eta", lambda d: _tasks_files(d).select("task_id", _eta(d).alias("eta")), f"SELECT task_id, {ETA} AS eta FROM {_TF}")


def _eta_split(d):
    q, r, s = fn.eta_split(F.col("status"), _eta(d))
    return _tasks_files(d).select("task_id", q.alias("queue_eta"), r.alias("running_eta"), s.alias("display_eta"))


add("x08_eta_split", _eta_split, f"SELECT task_id, CASE WHEN status IN ('PENDING','PREPROCESSING','QUEUED') THEN e END AS queue_eta, CASE WHEN status IN ('DISPATCHED','TRANSCRIBING') THEN e END AS running_eta, coalesce(CASE WHEN status NOT IN ('SUCCEEDED','FAILED','CANCELED') THEN e END, 0) AS display_eta FROM (SELECT *, {ETA} AS e FROM {_TF})")
add(
    "x09_progress_text",
    lambda d: d.tasks.select("task_id", fn.progress_text(F.col("status"), F.col("progress_bp") / 10000.0, F.col("retry_count")).alias("t")),
    "SELECT task_id, CASE status WHEN 'PREPROCESSING' THEN '预处理中（元信息提取/格式转换）' WHEN 'QUEUED' THEN CASE WHEN retry_count > 0 THEN '排队中（第' || retry_count || '位）' ELSE '排队中' END WHEN 'DISPATCHED' THEN '已分配服务器，准备开始转写' WHEN 'TRANSCRIBING' THEN '转写中（' || (progress_bp // 100) || '%）' WHEN 'SUCCEEDED' THEN '转写完成' WHEN 'FAILED' THEN '转写失败' ELSE '已取消' END AS t FROM d_tasks",
)
add(
    "x10_processing_time",
    lambda d: d.segments.select("segment_id", F.round(fn.processing_time(F.col("keep_end_ms") / 1000.0, F.lit(0.3), F.col("retry_count"), F.col("task_id") % 2 == 0, F.lit(1.2)), 4).alias("s")),
    "SELECT segment_id, round((keep_end_ms / 1000.0::DOUBLE * 0.3::DOUBLE * (1 + 0.1::DOUBLE * retry_count) + CASE WHEN task_id % 2 = 0 THEN 8.0::DOUBLE ELSE 5.0::DOUBLE END) * 1.2::DOUBLE, 4) AS s FROM d_segments",
)
add(
    "x11_queue_eta",
    lambda d: d.tasks.select("task_id", fn.queue_eta(F.col("retry_count"), F.col("task_id") % 90, F.col("user_id") % 5, F.lit(1), F.col("task_id") % 60 * 0.25).alias("eta")),
    "SELECT task_id, greatest(trunc(CASE WHEN retry_count > 0 THEN retry_count * (task_id % 90) / greatest(user_id % 5 - 1, 1)::DOUBLE ELSE 0.0::DOUBLE END + task_id % 60 * 0.25::DOUBLE + 5)::INT, 1) AS eta FROM d_tasks",
)
add("x12_work_timeout", lambda d: d.files.select("file_id", fn.work_timeout(F.col("duration_sec")).alias("timeout_s")), "SELECT file_id, CASE WHEN duration_sec IS NULL THEN 120.0 ELSE least(3600.0::DOUBLE, greatest(120.0::DOUBLE, duration_sec * 2.0)) END::DOUBLE AS timeout_s FROM d_files")


def _backoff(d):
    raw, low, high = fn.backoff(F.col("retry_count") * 2)
    return d.tasks.select("task_id", raw.alias("delay"), F.round(low, 4).alias("lowest"), F.round(high, 4).alias("highest"))


add("x13_backoff", _backoff, "SELECT task_id, r AS delay, round(greatest(0.1::DOUBLE, r * 0.9::DOUBLE), 4) AS lowest, round(r * 1.1::DOUBLE, 4) AS highest FROM (SELECT task_id, least(pow(2.0::DOUBLE, retry_count * 2), 60.0::DOUBLE) AS r FROM d_tasks)")
_PATHS = lambda: F.when(F.col("file_id") % 3 == 0, F.concat(F.lit("a/b/../"), "original_name")).when(F.col("file_id") % 3 == 1, F.concat(F.lit("x/..."), "original_name")).otherwise("/.../")
add(
    "x14_safe_names",
    lambda d: d.files.select("file_id", fn.safe_name(_PATHS()).alias("safe"), fn.stem(_PATHS()).alias("stem")),
    "SELECT file_id, CASE WHEN file_id % 3 = 2 THEN 'unnamed' ELSE original_name END AS safe, CASE WHEN file_id % 3 = 2 THEN 'unnamed' ELSE regexp_replace(original_name, '\\.[^.]+$', '') END AS stem FROM d_files",
)
add("x15_sharded_path", lambda d: d.files.select("file_id", fn.sharded_path("results", F.lpad(F.col("file_id").cast("string"), 8, "0"), F.lit("result.json")).alias("path")), "SELECT file_id, 'results/' || left(lpad(file_id::VARCHAR, 8, '0'), 4) || '/' || lpad(file_id::VARCHAR, 8, '0') || '/result.json' AS path FROM d_files")
_EXT = "lower(regexp_extract(original_name, '\\.[^.]+$', 0))"
_RATE = f"CASE WHEN {_EXT} IN ('.wav','.pcm') THEN 32000 WHEN {_EXT} = '.flac' THEN 24000 WHEN {_EXT} IN ('.mp3','.m4a','.aac','.ogg','.wma') THEN 16000 WHEN {_EXT} IN ('.mp4','.mkv','.webm','.avi','.mov','.wmv') THEN 20000 END"
add("x16_duration_estimate", lambda d: d.files.select("file_id", F.floor(fn.duration_estimate(F.col("original_name"), F.col("size_bytes"))).cast("long").alias("s")), f"SELECT file_id, floor(CASE WHEN size_bytes > 0 THEN size_bytes / ({_RATE})::DOUBLE END)::BIGINT AS s FROM d_files")
add(
    "x17_human",
    lambda d: d.files.select("file_id", fn.human_duration(F.coalesce("duration_sec", F.lit(0))).alias("duration"), fn.uptime(F.col("file_id") * 997).alias("uptime")),
    "SELECT file_id, CASE WHEN s >= 3600 THEN (s // 3600) || 'h ' ELSE '' END || CASE WHEN s >= 60 THEN (s // 60 % 60) || 'm ' ELSE '' END || (s % 60) || 's' AS duration, CASE WHEN u >= 86400 THEN (u // 86400) || '天' ELSE '' END || CASE WHEN u // 3600 % 24 > 0 THEN (u // 3600 % 24) || '时' ELSE '' END || (u // 60 % 60) || '分' AS uptime FROM (SELECT file_id, coalesce(duration_sec, 0) AS s, file_id * 997 AS u FROM d_files)",
)


def fingerprints(d):
    lines = F.concat_ws(":", "original_name", F.col("size_bytes").cast("string"), F.lit("auto"), F.lit("{}"))
    g = d.tasks.where("task_group_id is not null").join(d.files.select("file_id", (F.col("file_id") % 3).alias("k"), "size_bytes", "original_name"), "file_id")
    return g.groupBy(F.col("task_group_id").alias("batch")).agg(fn.batch_fingerprint(F.collect_list(lines), F.lit("10m")).alias("fingerprint"))


FINGERPRINTS = "(SELECT task_group_id AS batch, left(sha256(string_agg(original_name || ':' || size_bytes || ':auto:{}', chr(10) ORDER BY (original_name || ':' || size_bytes || ':auto:{}') COLLATE \"C\") || chr(10) || '10m'), 32) AS fingerprint FROM d_tasks JOIN d_files USING (file_id) WHERE task_group_id IS NOT NULL GROUP BY 1)".replace(' COLLATE "C"', "")
add("x18_batch_fingerprint", fingerprints, f"SELECT * FROM {FINGERPRINTS}")
add("x20_file_fingerprint", lambda d: d.files.select("file_id", fn.file_fingerprint(F.col("original_name"), F.col("size_bytes"), F.col("file_id") * 1_000_000_007).alias("f")), "SELECT file_id, original_name || ':' || size_bytes || ':' || (file_id * 1000000007) AS f FROM d_files")


def _preflight(d):
    p = fn.preflight(F.col("original_name"), F.col("size_bytes"), F.col("duration_sec").cast("double"), F.lit(None).cast("double"))
    return d.files.select("file_id", p.alias("p")).select("file_id", "p.needs_conversion", "p.conversion_s", "p.processing_s", F.array_join("p.warnings", ",").alias("warnings"), "p.ready")


add(
    "x21_preflight",
    _preflight,
    f"""SELECT file_id, e NOT IN ('.wav','.pcm') AS needs_conversion, c AS conversion_s, floor(s * 0.3::DOUBLE)::BIGINT + c AS processing_s,
array_to_string(list_filter([CASE WHEN size_bytes = 0 THEN 'empty' END, CASE WHEN NOT m THEN 'unsupported' END, CASE WHEN duration_sec IS NULL THEN 'imprecise' END, CASE WHEN s > 3600 THEN 'long' END, CASE WHEN size_bytes > 524288000 THEN 'large' END, CASE WHEN e IN ('.mp4','.webm','.mkv','.avi','.mov') THEN 'video' END], lambda x: x IS NOT NULL), ',') AS warnings, m AND size_bytes > 0 AS ready
FROM (SELECT *, {_EXT} AS e, {_EXT} IN ('.wav','.mp3','.mp4','.flac','.ogg','.webm','.m4a','.aac','.wma','.mkv','.avi','.mov','.pcm') AS m, CASE WHEN {_EXT} IN ('.wav','.pcm') THEN 0 ELSE size_bytes // 10485760 END::BIGINT AS c, coalesce(duration_sec::DOUBLE, CASE WHEN size_bytes > 0 THEN size_bytes / ({_RATE})::DOUBLE END, 0) AS s FROM d_files)""",
)
add(
    "x22_transcript_grade",
    lambda d: d.transcript_pairs.select("pair_id", fn.transcript_grade(F.when(F.col("pair_id") % 5 == 0, F.lit("ab!?!?!?cd")).when(F.col("pair_id") % 5 == 1, F.lit("short")).when(F.col("pair_id") % 5 == 2, F.lit(" ")).otherwise(F.col("baseline_text")), F.col("duration_sec")).alias("grade")),
    "SELECT pair_id, CASE WHEN pair_id % 5 = 2 OR trim(t) = '' THEN 'empty' WHEN regexp_matches(trim(t), '[^\\p{L}\\p{N} \\t\\n\\x0B\\f\\r]{6,}') THEN 'garbled' WHEN (duration_sec > 60 AND length(trim(t)) < 20) OR (duration_sec > 30 AND length(trim(t)) < 10) THEN 'short' ELSE 'ok' END AS grade FROM (SELECT *, CASE pair_id % 5 WHEN 0 THEN 'ab!?!?!?cd' WHEN 1 THEN 'short' WHEN 2 THEN ' ' ELSE baseline_text END AS t FROM d_transcript_pairs)",
)
add("x23_keyword_baseline", lambda d: d.conversations.select("conv_id", "turn", fn.keyword_baseline(F.col("text"), ["the"], ["and", "that"], "en").alias("ok")), "SELECT conv_id, turn, contains(lower(text), 'the') AND (contains(lower(text), 'and') OR contains(lower(text), 'that')) AND regexp_matches(lower(text), '[a-z]') AS ok FROM conversations")
_SQ = "regexp_replace({c}, '[ \\t\\n\\x0B\\f\\r]+', '', 'g')"
EVAL = f"(SELECT *, {_SQ.format(c='baseline_text')} AS a, {_SQ.format(c='experiment_text')} AS b FROM d_transcript_pairs)"


def evaluation(d):
    dist, sim = fn.edit_similarity(F.col("baseline_text"), F.col("experiment_text"))
    return d.transcript_pairs.select("pair_id", "duration_sec", dist.alias("distance"), F.round(sim, 6).alias("similarity"), F.round(fn.length_difference(F.col("baseline_text"), F.col("experiment_text")), 6).alias("diff_ratio"))


SIMILARITY = f"(SELECT pair_id, duration_sec, levenshtein(a, b) AS distance, CASE WHEN greatest(length(a), length(b)) = 0 THEN 1.0 ELSE round(1 - levenshtein(a, b) / greatest(length(a), length(b))::DOUBLE, 6) END::DOUBLE AS similarity, round(abs(length(a) - length(b)) / greatest(length(a), 1)::DOUBLE, 6) AS diff_ratio FROM {EVAL})"
ASCII = "regexp_replace({c}, '[^\\x00-\\x7F]', '', 'g')"


def _ascii(d):
    """Pairs in ASCII letters, as the oracle's distance counts bytes."""
    clean = lambda c: F.regexp_replace(c, r"[^\x00-\x7F]", "")
    pairs = d.transcript_pairs.withColumns({c: clean(c) for c in ("baseline_text", "experiment_text")})
    dist, sim = fn.edit_similarity(F.col("baseline_text"), F.col("experiment_text"))
    return pairs.select("pair_id", dist.cast("long").alias("distance"), F.round(sim, 6).alias("similarity"))


add("x24_edit_similarity", _ascii, f"SELECT pair_id, levenshtein(a, b) AS distance, CASE WHEN greatest(length(a), length(b)) = 0 THEN 1.0 ELSE round(1 - levenshtein(a, b) / greatest(length(a), length(b))::DOUBLE, 6) END::DOUBLE AS similarity FROM (SELECT pair_id, {_SQ.format(c=ASCII.format(c='baseline_text'))} AS a, {_SQ.format(c=ASCII.format(c='experiment_text'))} AS b FROM d_transcript_pairs)")
add("x26_length_difference", lambda d: d.transcript_pairs.select("pair_id", F.round(fn.length_difference(F.col("baseline_text"), F.col("experiment_text")), 6).alias("ratio")), f"SELECT pair_id, round(abs(length(a) - length(b)) / greatest(length(a), 1)::DOUBLE, 6) AS ratio FROM {EVAL}")
add(
    "x27_difference_contexts",
    lambda d: d.transcript_pairs.select("pair_id", F.array_join(fn.difference_contexts(F.col("baseline_text"), F.col("experiment_text")), "~").alias("contexts")),
    "WITH p AS (SELECT pair_id, replace(baseline_text, ' ', '') AS a, replace(experiment_text, ' ', '') AS b FROM d_transcript_pairs), q AS (SELECT *, unnest(range(0, least(length(a), length(b)))) AS i FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY i) AS n FROM q WHERE substr(a, i + 1, 1) <> substr(b, i + 1, 1)) SELECT p.pair_id, coalesce(c, '') AS contexts FROM p LEFT JOIN (SELECT pair_id, string_agg(i || '|' || substr(a, greatest(i - 5, 0) + 1, least(i, 5) + 6) || '|' || substr(b, greatest(i - 5, 0) + 1, least(i, 5) + 6), '~' ORDER BY i) AS c FROM r WHERE n <= 10 GROUP BY 1) USING (pair_id)",
)
add("x28_truncated", lambda d: d.documents.select("doc_id", F.md5(fn.truncated(F.col("text"))).alias("t")), "SELECT doc_id, md5(left(text, 2000)) AS t FROM documents")


def _options(d):
    o = F.to_json(F.struct(F.when(F.col("task_id") % 3 == 0, F.lit("alpha beta")).alias("hotwords"), F.when(F.col("task_id") % 4 == 0, "offline").when(F.col("task_id") % 4 == 1, "bad").alias("mode"), F.when(F.col("task_id") % 5 == 0, F.lit(True)).when(F.col("task_id") % 5 == 1, F.lit(False)).alias("use_itn")))
    return d.tasks.select("task_id", fn.recognition_options(o).alias("r")).select("task_id", "r.hotwords", "r.mode", "r.use_itn", "r.use_punc")


add("x29_recognition_options", _options, "SELECT task_id, CASE WHEN task_id % 3 = 0 THEN 'alpha beta' END AS hotwords, CASE WHEN task_id % 4 = 0 THEN 'offline' END AS mode, CASE task_id % 5 WHEN 0 THEN true WHEN 1 THEN false END AS use_itn, NULL::BOOLEAN AS use_punc FROM d_tasks")
add("x30_mode_list", lambda d: d.servers.select("server_id", fn.mode_list(F.col("server_id") % 2 == 0, F.col("server_id") % 3 == 0, F.col("server_id") % 5 == 0).alias("modes")), "SELECT server_id, array_to_string(list_filter([CASE WHEN server_id % 2 = 0 THEN 'offline' END, CASE WHEN server_id % 3 = 0 THEN '2pass' END, CASE WHEN server_id % 5 = 0 THEN 'online' END], lambda x: x IS NOT NULL), ',') AS modes FROM d_servers")


def _rtf(d):
    r, acc = fn.rtf(F.col("actual_cs") / 100.0, F.col("audio_sec"))
    return d.completions.select("event_id", F.round(r, 6).alias("rtf"), F.round(acc, 4).alias("acceleration"))


add("x32_rtf", _rtf, "SELECT event_id, round(r, 6) AS rtf, CASE WHEN r > 0 THEN round(1 / r, 4) END AS acceleration FROM (SELECT event_id, actual_cs / 100.0::DOUBLE / audio_sec AS r FROM d_completions)")
add(
    "x03_utterances",
    lambda d: d.conversations.select("conv_id", "turn", F.explode(tr.utterances(F.to_json(F.struct(F.col("role").alias("text"), F.array(F.array(F.col("turn"), F.col("turn") + 1), F.array(F.col("turn") + 1, F.col("turn") + 2)).alias("timestamp"))))).alias("u")).select("conv_id", "turn", "u.*"),
    "SELECT conv_id, turn, turn + i AS start_ms, turn + i + 1 AS end_ms, substr(role, i + 1, 1) AS text FROM (SELECT *, unnest([0, 1]) AS i FROM conversations)",
)
add("x19_canonical_json", lambda d: d.events.select("event_id", fn.canonical_json(F.concat(F.lit('{"z": 1, "a": "'), F.col("event_type"), F.lit('"}'))).alias("options")), "SELECT event_id, '{\"a\":\"' || event_type || '\",\"z\":\"1\"}' AS options FROM events")
