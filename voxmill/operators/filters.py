"""Predicates and selections over the state tables.

Every function takes tables and gives a table. Moments are arguments (epoch seconds),
never the clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from voxmill import constants as C


def point_lookup(tasks: DataFrame, task_id: int, user_id: int | None = None) -> DataFrame:
    out = tasks.where(F.col("task_id") == task_id)
    return out if user_id is None else out.where(F.col("user_id") == user_id)


def task_list(tasks: DataFrame, status: str | None = None, group: int | None = None, owner: int | None = None) -> DataFrame:
    for name, value in (("status", status), ("task_group_id", group), ("user_id", owner)):
        tasks = tasks if value is None else tasks.where(F.col(name) == value)
    return tasks


def search(tasks: DataFrame, files: DataFrame, pattern: str) -> DataFrame:
    """Substring of the id or of the file's name, any case; the user's % and _ stay wildcards."""
    like = f"%{pattern}%"
    both = tasks.join(files.select("file_id", "original_name"), "file_id", "left")
    return both.where(F.col("task_id").cast("string").ilike(like) | F.col("original_name").ilike(like))


def available(server: DataFrame) -> Column:
    return server["enabled"] & (server["status"] == "ONLINE") & (server["max_concurrency"] > 0)


def is_terminal(status: Column, retries: Column, most: int = C.MAX_RETRIES) -> Column:
    return status.isin("SUCCEEDED", "CANCELED") | ((status == "FAILED") & (retries >= most))


def transitions(spark: SparkSession) -> DataFrame:
    """The legal moves, a small table, so that a rule change is data."""
    return spark.createDataFrame([(a, b) for a, to in C.TRANSITIONS.items() for b in to], "from_status string, to_status string")


def illegal_moves(events: DataFrame) -> DataFrame:
    """Events whose move isn't among the legal ones; first events (no state before) are not moves."""
    return events.where("from_status is not null").join(F.broadcast(transitions(events.sparkSession)), ["from_status", "to_status"], "left_anti")


def state_set(status: Column) -> Column:
    return F.when(status.isin(*C.ACTIVE_SLOT), "active").when(status.isin(*C.QUEUE), "queue").when(status.isin(*C.TERMINAL), "terminal").otherwise("other")


def releasable(status: Column) -> Column:
    """Segment states that a cancel releases."""
    return status.isin("PENDING", "DISPATCHED", "TRANSCRIBING")


def frozen(tasks: DataFrame, segments: DataFrame, as_of: int, timeout: int = C.TASK_TIMEOUT_S) -> DataFrame:
    """Work that has been running for longer than the timeout, tasks and segments."""
    late = (F.col("status") == "TRANSCRIBING") & (F.col("started_s") < as_of - timeout)
    pick = lambda df, kind, key: df.where(late).select(F.lit(kind).alias("kind"), F.col(key).alias("work_id"), (F.lit(as_of) - F.col("started_s")).alias("elapsed_s"))
    return pick(tasks, "task", "task_id").unionByName(pick(segments, "segment", "segment_id"))


def stale_claims(tasks: DataFrame, as_of: int, after: int = C.STALE_CLAIM_S) -> DataFrame:
    return tasks.where((F.col("status") == "PREPROCESSING") & (F.col("created_s") < as_of - after))


def recovery(tasks: DataFrame, as_of: int, minutes: int = C.RECOVERY_MINUTES) -> DataFrame:
    """Work to recover at start-up (1) and recent work left alone (0)."""
    old = F.col("started_s").isNull() | (F.col("started_s") < as_of - 60 * minutes)
    return tasks.where(F.col("status").isin(*C.ACTIVE_SLOT)).select("task_id", "status", F.when(old, 1).otherwise(0).alias("recover"))


def presets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in C.SEGMENT_PRESETS.items()], "level string, target_s int, longest_s int, shortest_file_s int, step_s int")


def needs_segmentation(files: DataFrame, level: Column) -> DataFrame:
    """Adds ``split``: the duration is known and above the level's smallest file."""
    files = files.withColumn("level", level)
    return files.join(F.broadcast(presets(files.sparkSession).select("level", "shortest_file_s")), "level", "left").withColumn("split", F.coalesce(F.col("duration_sec") > F.col("shortest_file_s"), F.lit(False))).drop("shortest_file_s")


def segment_level(options: Column) -> Column:
    """Level of an options document; older ones say ``auto_segment``; anything unreadable is 10m."""
    value = F.get_json_object(options, "$.segment_level")
    off = (F.get_json_object(options, "$.auto_segment") == "off") | (value == "off")
    return F.when(F.coalesce(off, F.lit(False)), "off").when(value.isin(*C.SEGMENT_PRESETS), value).otherwise("10m")


def retry_empty(text: Column, duration: Column, least: int) -> Column:
    """An empty transcript of audio that is long enough is worth another try."""
    return F.coalesce((F.trim(F.coalesce(text, F.lit(""))) == "") & (duration >= least), F.lit(False))


def extension(name: Column) -> Column:
    """Last suffix with its dot, lower case; none: empty. A leading dot is no suffix."""
    return F.lower(F.regexp_extract(name, r"[^/.](\.[^./]+)$", 1))


def upload_accepted(name: Column, size: Column, cap: int = C.UPLOAD_CAP_BYTES) -> Column:
    return extension(name).isin(*C.MEDIA_EXTENSIONS) & (size <= cap)


def stale_results(results: DataFrame, tasks: DataFrame) -> DataFrame:
    """Results (task_id, generation) whose generation isn't the task's; a missing task makes it stale."""
    now = tasks.select("task_id", F.col("run_generation").alias("current"))
    return results.join(now, "task_id", "left").where(~F.col("generation").eqNullSafe(F.col("current")))


def outbox_due(outbox: DataFrame, most: int = 50, retries: int = C.OUTBOX_RETRIES) -> DataFrame:
    """The oldest pending deliveries with retries left."""
    return outbox.where((F.col("status") == "PENDING") & (F.col("retry_count") < retries)).orderBy("created_s", "outbox_id").limit(most)


def outbox_exhausted(outbox: DataFrame, retries: int = C.OUTBOX_RETRIES) -> DataFrame:
    return outbox.where((F.col("status") == "PENDING") & (F.col("retry_count") >= retries))


def retry_route(tasks: DataFrame, segments: DataFrame, retries: int = C.MAX_RETRIES) -> DataFrame:
    """Failed tasks with retries left, each with its way back."""
    have = segments.select("task_id").distinct().withColumn("split", F.lit(True))
    way = F.when(F.col("split").isNull(), "plain_requeue").when(F.col("error_code") == "MERGE_FAILED", "merge_retry").when(F.col("error_code") == "SEGMENT_RETRY_EXHAUSTED", "whole_file_fallback").otherwise("skip")
    return tasks.where((F.col("status") == "FAILED") & (F.col("retry_count") < retries)).join(have, "task_id", "left").select("task_id", "error_code", way.alias("route"))


def scan_skip(name: Column, size: Column, age_s: Column) -> Column:
    """Why a listed file isn't taken: hidden, system, empty or still being written; null: it is taken."""
    base = F.regexp_extract(name, r"[^/]*$", 0)
    return F.when(base.isin(*C.SYSTEM_FILES), "system").when(base.startswith("."), "hidden").when(size == 0, "empty").when(age_s < 10, "unfinished")


def server_type(kind: Column, protocol: Column) -> Column:
    """Declared type, else what the protocol's name says."""
    given, pv = F.lower(F.trim(F.coalesce(kind, F.lit("")))), F.replace(F.lower(F.trim(F.coalesce(protocol, F.lit("")))), F.lit("-"), F.lit("_"))
    return F.when(given != "", given).when(pv.contains("main"), "main").when(pv.contains("legacy") | pv.contains("old"), "legacy")


def intake(text: Column, file_name: Column) -> tuple[Column, Column, Column]:
    """(confidence, sensitive, negative) of a chat message with an optional file."""
    low = F.lower(F.coalesce(text, F.lit("")))
    any_of = lambda ws: F.exists(F.array(*(F.lit(w) for w in ws)), lambda w: F.contains(low, w))
    strong, medium, media = any_of(C.STRONG_WORDS), any_of(C.MEDIUM_WORDS), F.coalesce(extension(file_name).isin(*C.MEDIA_EXTENSIONS), F.lit(False))
    level = F.when(media & (strong | medium), "high").when(media, "medium").when(strong, "medium").when(medium, "low").otherwise("none")
    return level, any_of(C.SENSITIVE_WORDS), F.coalesce(extension(file_name).isin(*C.NOT_MEDIA), F.lit(False))


def segments_of(segments: DataFrame, status: str | None = None) -> DataFrame:
    out = segments if status is None else segments.where(F.col("status") == status)
    return out.select("task_id", "segment_index", "segment_id", "status").orderBy("task_id", "segment_index")
