"""Joins, set operations and top rows of the state tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from voxmill import constants as C


def with_files(tasks: DataFrame, files: DataFrame) -> DataFrame:
    return tasks.join(files, "file_id")


def segments_with_parent(segments: DataFrame, tasks: DataFrame) -> DataFrame:
    """Segments with their task's state; a zombie is at work though its task has ended."""
    parent = tasks.select("task_id", F.col("status").alias("parent_status"))
    return segments.join(parent, "task_id").withColumn("zombie", F.col("status").isin(*C.ACTIVE_SLOT) & F.col("parent_status").isin(*C.TERMINAL))


def work_against_registry(work: DataFrame, servers: DataFrame) -> DataFrame:
    """Work counts by server beside the registry; servers that it doesn't know are UNKNOWN."""
    n = work.where("assigned_server_id is not null").groupBy(F.col("assigned_server_id").alias("server_id")).agg(F.count("*").alias("n"))
    return n.join(servers.select("server_id", "status", "max_concurrency"), "server_id", "full_outer").select("server_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("status", F.lit("UNKNOWN")).alias("status"), F.coalesce("max_concurrency", F.lit(0)).alias("slots"))


def in_batches(rows: DataFrame, tasks: DataFrame, wanted: Column) -> DataFrame:
    """Rows of tasks in the wanted batches."""
    return rows.join(tasks.where(wanted).select("task_id"), "task_id", "left_semi")


def whole_tasks(tasks: DataFrame, segments: DataFrame) -> DataFrame:
    """Tasks without segments; a null id never hides one."""
    return tasks.join(segments.select("task_id"), "task_id", "left_anti")


def orphaned_files(deleted: DataFrame, remaining: DataFrame) -> DataFrame:
    """Files of deleted tasks that no other task needs."""
    return deleted.where("file_id is not null").select("file_id").distinct().join(remaining.select("file_id"), "file_id", "left_anti")


def kept_utterances(utterances: DataFrame) -> DataFrame:
    """Utterances on the global time line whose start lies in their segment's window, so each is kept once."""
    start = F.col("start_ms") + F.col("source_start_ms")
    return utterances.where((start >= F.col("keep_start_ms")) & (start < F.col("keep_end_ms"))).select("task_id", "segment_index", "pos", start.alias("start_ms"), (F.col("end_ms") + F.col("source_start_ms")).alias("end_ms"), "text")


def cut_candidates(silences: DataFrame, windows: DataFrame, least_ms: int) -> DataFrame:
    """For each search window its longest silence with the midpoint inside, ends included; ties to the first. silences: file_id, start_ms, end_ms; windows: file_id, window, low_ms, high_ms."""
    mid = F.expr("(start_ms + end_ms) div 2")
    both = silences.withColumn("mid", mid).where(F.col("end_ms") - F.col("start_ms") >= least_ms).join(windows, "file_id").where("mid between low_ms and high_ms")
    best = F.min_by("mid", F.struct((F.col("start_ms") - F.col("end_ms")).alias("d"), "start_ms")).alias("cut_ms")
    return both.groupBy("file_id", "window").agg(best, F.max(F.col("end_ms") - F.col("start_ms")).alias("silence_ms"))


def dispatch_lookup(results: DataFrame, tasks: DataFrame, servers: DataFrame, files: DataFrame) -> DataFrame:
    """Results with what they were dispatched from; the first missing reference names the reason."""
    out = results.join(tasks.select("task_id", "file_id", "assigned_server_id", F.lit(True).alias("t")), "task_id", "left")
    out = out.join(servers.select(F.col("server_id").alias("assigned_server_id"), F.lit(True).alias("s")), "assigned_server_id", "left").join(files.select("file_id", F.lit(True).alias("f")), "file_id", "left")
    return out.withColumn("reason", F.when(F.col("t").isNull(), "task_missing").when(F.col("f").isNull(), "file_missing").when(F.col("s").isNull(), "server_missing").otherwise("ok")).drop("t", "s", "f")


def duplicate_batches(batches: DataFrame, window_s: int = 1800) -> DataFrame:
    """Batches that repeat an earlier active one of the same owner, size and fingerprint, at most ``window_s`` before; with the newest such one. batches: batch, user_id, fingerprint, n, created_s, active.

    Time is cut into spans of the window: a match is in the batch's own span or the
    one before, of which only the last is needed. A fingerprint that holds a third of
    all batches is spread over its spans, and no pairs are made.
    """
    keys = ["user_id", "fingerprint", "n", "span"]
    rows = batches.withColumn("span", F.floor(F.col("created_s") / window_s))
    one = F.when(F.col("active") > 0, F.struct("created_s", "batch"))
    before = F.last(one, True).over(W.partitionBy(*keys).orderBy("created_s", "batch").rowsBetween(W.unboundedPreceding, -1))
    ends = rows.where("active > 0").groupBy(*keys).agg(F.max(one).alias("end")).withColumn("span", F.col("span") + 1)
    found = rows.withColumn("before", before).join(ends, keys, "left").withColumn("match", F.coalesce("before", "end"))
    return found.where(F.col("created_s") - F.col("match.created_s") <= window_s).select("batch", F.col("match.batch").alias("earlier"), "user_id", "n")


def resume(candidates: DataFrame, done: DataFrame) -> DataFrame:
    """Files that the last run didn't finish with the same fingerprint."""
    return candidates.join(done.select("fingerprint"), "fingerprint", "left_anti")


def stalled_finalisation(tasks: DataFrame, segments: DataFrame) -> DataFrame:
    """Tasks still open whose segments have all succeeded."""
    g = segments.groupBy("task_id").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "SUCCEEDED").alias("ok")).where("n = ok")
    return tasks.where(~F.col("status").isin(*C.TERMINAL)).join(g, "task_id").select("task_id", "status", "n")


def best_server(items: DataFrame, servers: DataFrame, penalty: float = 0.1) -> DataFrame:
    """For each item the available server with the smallest estimate; ties to the smaller id. items: item, audio_s (not negative).

    All estimates are a slope times the audio plus the same overhead, so only the
    servers of the smallest slope (to rounding) can win, or for no audio at all the
    first one; of those with equal estimates only the smallest id is tried on each item.
    """
    s = servers.where("enabled and status = 'ONLINE' and max_concurrency > 0").select("server_id", F.coalesce("rtf_baseline", F.lit(0.3)).alias("rtf"), "max_concurrency")
    slope = F.col("rtf") * (1 + penalty * (F.col("server_id") % F.col("max_concurrency")))
    low, first = s.agg(F.min(slope), F.min("server_id")).head()
    if first is None:
        return items.limit(0).select("item", F.lit(None).cast("long").alias("server_id"), F.lit(None).cast("double").alias("estimate_s"))
    load = F.col("server_id") % F.col("max_concurrency")
    can_win = s.where((slope <= low + 1e-9 * abs(low)) | (F.col("server_id") == first)).groupBy("rtf", load.alias("load")).agg(F.min("server_id").alias("server_id"))
    can_win = can_win.agg(F.collect_list(F.struct("rtf", "load", "server_id")).alias("can_win"))
    est = lambda x: F.col("audio_s") * x["rtf"] * (1 + penalty * x["load"]) + 5
    best = F.array_min(F.transform("can_win", lambda x: F.struct(est(x).alias("e"), x["server_id"].alias("server_id"))))
    return items.crossJoin(F.broadcast(can_win)).select("item", best.alias("b")).select("item", "b.server_id", F.round("b.e", 3).alias("estimate_s"))


def inhibited(alerts: DataFrame) -> DataFrame:
    """Alerts without the warnings whose name also fires as critical."""
    critical = alerts.where("severity = 'critical'").select("alertname").distinct().withColumn("severity", F.lit("warning"))
    return alerts.join(critical, ["alertname", "severity"], "left_anti")


# ------------------------------------------------------------------ top rows


def page(rows: DataFrame, order: list[Column], offset: int, size: int) -> DataFrame:
    """One page with the total number of rows."""
    total = rows.count()
    return rows.orderBy(*order).offset(offset).limit(size).withColumn("total", F.lit(total))


def fifo(tasks: DataFrame, k: int) -> DataFrame:
    return tasks.where("status = 'QUEUED'").orderBy("created_s", "task_id").limit(k)


def newest(tasks: DataFrame, n: int) -> DataFrame:
    return tasks.orderBy(F.coalesce("completed_s", "created_s").desc(), "task_id").limit(n)


def next_segments(segments: DataFrame, servers_available: int, at_once: int = C.SEGMENTS_AT_ONCE) -> DataFrame:
    """Pending segments that may start: per task as many as its limit has room beside those at work."""
    active = segments.where(F.col("status").isin(*C.ACTIVE_SLOT)).groupBy("task_id").agg(F.count("*").alias("active"))
    rn = F.row_number().over(W.partitionBy("task_id").orderBy("segment_index", "segment_id"))
    ready = segments.where("status = 'PENDING'").withColumn("rn", rn).join(active, "task_id", "left")
    return ready.where(F.col("rn") <= F.lit(min(servers_available, at_once)) - F.coalesce("active", F.lit(0))).select("task_id", "segment_id", "rn")


def smallest(files: DataFrame, n: int) -> DataFrame:
    return files.orderBy("size_bytes", "file_id").limit(n)


# ------------------------------------------------------------------- set ops


def busy_intervals(tasks: DataFrame, segments: DataFrame) -> DataFrame:
    timed = "started_s is not null and completed_s is not null"
    pick = lambda df, kind, key: df.where(timed).select(F.lit(kind).alias("kind"), F.col(key).alias("work_id"), "started_s", "completed_s")
    return pick(tasks, "task", "task_id").unionByName(pick(segments, "segment", "segment_id"))


def unqueued_parents(segments: DataFrame, tasks: DataFrame) -> DataFrame:
    return segments.where("status = 'PENDING'").select("task_id").distinct().exceptAll(tasks.where("status = 'QUEUED'").select("task_id"))


def exhausted_and_available(plan: DataFrame, servers: DataFrame) -> DataFrame:
    """Servers at the end of their plan that could take work."""
    ended = servers.select("server_id").exceptAll(plan.select("server_id").distinct())
    return ended.intersect(servers.where("enabled and status = 'ONLINE' and max_concurrency > 0").select("server_id"))


def endpoints(servers: DataFrame) -> DataFrame:
    """host:port of each server; the first by id keeps it, the others are duplicates."""
    e = F.concat(F.lower(F.trim("host")), F.lit(":"), "port")
    s = servers.withColumn("endpoint", e)
    return s.select("server_id", "endpoint", (F.row_number().over(W.partitionBy("endpoint").orderBy("server_id")) > 1).alias("duplicate"))


def task_servers(segments: DataFrame) -> DataFrame:
    return segments.where("assigned_server_id is not null").select("task_id", "assigned_server_id").distinct()


def plan_difference(plan: DataFrame, work: DataFrame) -> DataFrame:
    """Planned items that are no work any more, and work that isn't planned. Both have ``item``."""
    p, w = plan.select("item").distinct(), work.select("item").distinct()
    return p.join(w, "item", "left_anti").withColumn("side", F.lit("stale_plan")).unionByName(w.join(p, "item", "left_anti").withColumn("side", F.lit("unplanned")))
