"""Composite jobs over the state tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from voxmill import constants as C
from voxmill.functions import transcripts as tr
from voxmill.operators import aggregates, filters, joins
from voxmill.operators.ranks import numbered

#: Batches whose rows of one server follow each other, and servers whose rows of such batches are made at a time.
BLOCK, RACK = 256, 64


def merge_segments(segments: DataFrame, raw: str = "raw_result_json") -> DataFrame:
    """Transcript of each task from the results of its segments.

    segments: task_id, segment_index, source_start_ms, keep_start_ms, keep_end_ms and
    the result document. Timed utterances move to the global time line and stay
    where their start lies in the segment's window; a segment without real times
    gives its text. Gives text, sentences (array), mode and status, one row a task.
    A task's segments are gathered in one row, as its transcript is one document.
    """
    doc = F.col(raw)
    rows = segments.withColumn("u", tr.utterances(doc)).withColumn("timed", tr.has_times(F.col("u")))
    at = lambda x: x["start_ms"] + F.col("source_start_ms")
    kept = F.transform(F.filter("u", lambda x: (at(x) >= F.col("keep_start_ms")) & (at(x) < F.col("keep_end_ms"))), lambda x: F.struct(at(x).alias("start_ms"), (x["end_ms"] + F.col("source_start_ms")).alias("end_ms"), x["text"].alias("text")))
    text_of = lambda xs: F.array_join(F.transform(xs, lambda x: x["text"]), "")
    own = F.coalesce(F.get_json_object(doc, "$.text"), F.lit(""))
    fallback = F.when(own != "", own).otherwise(text_of(F.col("u")))
    none = F.array().cast(tr.UTTERANCE)
    part = F.struct("segment_index", F.when(F.col("timed"), text_of(kept)).otherwise(fallback).alias("text"), F.when(F.col("timed"), kept).otherwise(none).alias("sentences"), F.nullif(F.get_json_object(doc, "$.mode"), F.lit("")).alias("mode"), (~F.col("timed") & (fallback != "")).alias("fell_back"))
    g = rows.withColumn("part", part).groupBy("task_id").agg(F.array_sort(F.collect_list("part")).alias("p"))
    pick = lambda name: F.transform("p", lambda x: x[name])
    return g.select("task_id", F.array_join(pick("text"), "").alias("text"), F.flatten(pick("sentences")).alias("sentences"), F.coalesce(F.get(F.array_compact(pick("mode")), F.lit(0)), F.lit("")).alias("mode"), F.when(F.exists("p", lambda x: x["fell_back"]), "TEXT_ONLY_FALLBACK").otherwise("OK").alias("status"))


def plan_violations(plan: DataFrame, total: Column, overlap_ms: int = 400) -> DataFrame:
    """Rows of a segment plan that break its rules: windows tile 0 to the end without gap or overlap, and the source reaches over by the overlap at inner borders only. plan: file_id, segment_index, keep_start_ms, keep_end_ms, source_start_ms, source_end_ms."""
    w = W.partitionBy("file_id").orderBy("segment_index")
    rows = plan.withColumns({"total": total, "before": F.lag("keep_end_ms").over(w), "after": F.lead("keep_start_ms").over(w)})
    start = F.when(F.col("before").isNull(), F.col("keep_start_ms") != 0).otherwise(F.col("before") != F.col("keep_start_ms"))
    end = F.col("after").isNull() & (F.col("keep_end_ms") != F.col("total"))
    source = (F.col("source_start_ms") != F.when(F.col("before").isNull(), 0).otherwise(F.greatest(F.lit(0), F.col("keep_start_ms") - overlap_ms))) | (F.col("source_end_ms") != F.when(F.col("after").isNull(), F.col("total")).otherwise(F.least(F.col("total"), F.col("keep_end_ms") + overlap_ms)))
    why = F.array_join(F.array_compact(F.array(F.when(start, "gap"), F.when(end, "end"), F.when(source, "overlap"), F.when(F.col("keep_end_ms") <= F.col("keep_start_ms"), "empty"))), ",")
    return rows.withColumn("why", why).where("why <> ''").select("file_id", "segment_index", "why")


def quotas(batches: DataFrame, servers: DataFrame, zeros: bool = False) -> DataFrame:
    """Items of each batch apportioned to servers by speed.

    Shares are rounded half to even; what is missing goes to the fastest server, what
    is too much is taken from the slowest upward, from each at most its quota.
    batches: batch, n; servers: server_id, speed. Servers that get nothing have no row,
    but with ``zeros``, which gives a row for each batch and server.

    A share is above a half for fewer than 2 n servers, the fastest ones. So a batch
    asks for so many servers by their rank, an equijoin, and the rows grow with the
    items, not with batches by servers. The rows of ``zeros`` beyond that rank are made
    where they are returned, from the batches and the broadcast registry, and are never
    dealt out or sorted. Batches are dealt out to a fixed number of tasks: they are
    small, and what is made of them is large. So that it stays small where it is written
    by columns, a server's rows of a block of batches follow each other: the server is a
    run then, and the batches repeat after a block, which is short enough for any codec.
    """
    fleet = servers.where("speed > 0").select("server_id", "speed")
    # what is the same for every batch is worked out once, on the registry
    total, many = fleet.agg(F.sum("speed"), F.count("*")).head()
    fleet = numbered(fleet, "rank", F.desc("speed"), F.asc("server_id"))
    tasks = 4 * batches.sparkSession.sparkContext.defaultParallelism
    batches = batches.where("n > 0").repartition(tasks, "batch")
    asked = batches.select("batch", "n", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(many), 2 * F.col("n") + 1))).alias("rank")) if many else batches.select("batch", "n", F.lit(0).cast("long").alias("rank")).limit(0)
    some = asked.join(F.broadcast(fleet) if zeros else fleet, "rank").withColumn("quota", F.bround(F.col("n") * F.col("speed") / F.lit(total), 0).cast("long"))
    some = some if zeros else some.where("quota > 0 or rank = 1")
    by = W.partitionBy("batch").orderBy("speed", "server_id")
    some = some.withColumn("slower", F.coalesce(F.sum("quota").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    some = some.withColumn("diff", F.col("n") - F.sum("quota").over(by.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    taken = F.least("quota", F.greatest(F.lit(0), -F.col("diff") - F.col("slower")))
    quota = F.when((F.col("diff") > 0) & (F.col("rank") == 1), F.col("quota") + F.col("diff")).when(F.col("diff") < 0, F.col("quota") - taken).otherwise(F.col("quota"))
    some = some.select("batch", "server_id", quota.alias("quota"))
    if not zeros:
        return some.where("quota > 0")
    # sorted, so that a task that runs again makes the same blocks
    block = F.floor(F.monotonically_increasing_id() / BLOCK)
    blocks = batches.select("batch", (2 * F.col("n") + 1).alias("asked")).sortWithinPartitions("batch").withColumn("block", block)
    blocks = blocks.repartitionByRange(tasks, "block").groupBy("block").agg(F.collect_list(F.struct("batch", "asked")).alias("own"))
    # a task holds what it makes of one row up to a coalesce: here and below of a block and a rack, not of a block and all servers
    blocks = blocks.select("own", F.explode(F.sequence(F.lit(0), F.lit(many // RACK))).alias("rack")).coalesce(tasks)
    rest = blocks.join(F.broadcast(fleet.select("server_id", "rank", F.floor(F.col("rank") / RACK).cast("int").alias("rack"))), "rack")
    rest = rest.select("server_id", "rank", F.inline("own")).where("rank > asked")
    return some.unionByName(rest.select("batch", "server_id", F.lit(0).cast("long").alias("quota")))


def heartbeat_states(probes: DataFrame, timeout_s: int = C.HEARTBEAT_TIMEOUT_S) -> DataFrame:
    """State after each probe: ONLINE when it answered, DEGRADED while the last answer is recent, else OFFLINE. probes: event_id, server_id, at_s, ok."""
    w = W.partitionBy("server_id").orderBy("at_s", "event_id").rowsBetween(W.unboundedPreceding, 0)
    last = F.last(F.when(F.col("ok"), F.col("at_s")), True).over(w)
    return probes.select("event_id", "server_id", "at_s", F.when(F.col("ok"), "ONLINE").when(F.col("at_s") - last <= timeout_s, "DEGRADED").otherwise("OFFLINE").alias("state"))


def batch_report(tasks: DataFrame, segments: DataFrame, servers: DataFrame, events: DataFrame) -> DataFrame:
    """Overview, servers crossed, work moved and idle slots of every batch in one table."""
    batch = tasks.where("task_group_id is not null").select("task_group_id", "task_id")
    crossed = aggregates.cross_server(segments).join(batch, "task_id").groupBy("task_group_id").agg(F.count("*").alias("cross_server_tasks"))
    moved = aggregates.steals(events).join(batch, "task_id").groupBy("task_group_id").agg(F.sum("steals").alias("steals"), F.round(F.sum("gain"), 1).alias("gain"))
    out = aggregates.batch_overview(tasks).join(crossed, "task_group_id", "left").join(moved, "task_group_id", "left").join(aggregates.idle_slots(tasks, segments, servers).select("task_group_id", "idle_slot_seconds"), "task_group_id", "left")
    return out.fillna({"cross_server_tasks": 0, "steals": 0, "gain": 0.0})


def alert_rules(tasks: DataFrame, servers: DataFrame, windows: DataFrame, p95: DataFrame, as_of: int) -> DataFrame:
    """Firing alerts of all rules: (alertname, severity, subject, value). windows: window_s, ratio; p95: user_id, quantile."""
    row = lambda df, name, severity, subject, value: df.select(F.lit(name).alias("alertname"), F.lit(severity).alias("severity"), subject.cast("string").alias("subject"), F.round(value.cast("double"), 4).alias("value"))
    backlog = tasks.groupBy("user_id").agg(F.count_if(F.col("status") == "QUEUED").alias("n"))
    retries = tasks.groupBy("user_id").agg(F.sum("retry_count").alias("n"))
    fleet = servers.groupBy("port").agg(F.count_if(F.col("status") == "ONLINE").alias("online"), F.count_if(F.col("status") == "OFFLINE").alias("offline"))
    return (
        row(backlog.where("n > 60"), "queue_backlog", "warning", F.col("user_id"), F.col("n"))
        .unionByName(row(windows.where("ratio > 0.2"), "failure_rate", "critical", F.col("window_s"), F.col("ratio")))
        .unionByName(row(servers.where("status = 'OFFLINE' and enabled"), "server_down", "critical", F.col("server_id"), F.lit(1)))
        .unionByName(row(p95.where("quantile > 1200"), "slow_work", "warning", F.col("user_id"), F.col("quantile")))
        .unionByName(row(retries.where("n > 1500"), "many_retries", "warning", F.col("user_id"), F.col("n")))
        .unionByName(row(fleet.where("offline > online / 2"), "fleet_thin", "warning", F.col("port"), F.col("offline")))
    )


def integrity(tasks: DataFrame, segments: DataFrame, files: DataFrame, events: DataFrame) -> DataFrame:
    """(audit, n): orphans, duplicate segment keys and illegal moves."""
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("audit"), "n")
    parts = {
        "task_without_file": tasks.where("file_id is not null").join(files, "file_id", "left_anti"),
        "task_file_null": tasks.where("file_id is null"),
        "segment_without_task": segments.join(tasks, "task_id", "left_anti"),
        "event_without_task": events.join(tasks, "task_id", "left_anti"),
        "segment_key_twice": segments.groupBy("task_id", "segment_index").count().where("count > 1"),
        "illegal_move": filters.illegal_moves(events),
    }
    out = None
    for name, df in parts.items():
        out = count(df, name) if out is None else out.unionByName(count(df, name))
    return out


def compare_runs(tasks: DataFrame, files: DataFrame, shift: int = 1) -> DataFrame:
    """Each batch beside the one ``shift`` before: success, wall time and speed-up (audio seconds by wall seconds) of both."""
    timed = tasks.where("task_group_id is not null").join(files.select("file_id", "duration_sec"), "file_id", "left")
    g = timed.groupBy("task_group_id").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "SUCCEEDED").alias("ok"), (F.max("completed_s") - F.min("started_s")).alias("wall_s"), F.coalesce(F.sum("duration_sec"), F.lit(0)).alias("audio_s"))
    g = g.withColumn("speed", F.when(F.col("wall_s") > 0, F.round(F.col("audio_s") / F.col("wall_s"), 4)))
    other = g.select((F.col("task_group_id") + shift).alias("task_group_id"), *(F.col(c).alias(f"prev_{c}") for c in ("n", "ok", "wall_s", "speed")))
    return g.join(other, "task_group_id")


def same_output(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per key whether two runs gave the same text, by content hash. a, b: key, text."""
    h = lambda df, name: df.select("key", F.sha2(F.coalesce("text", F.lit("")), 256).alias(name))
    return h(a, "left").join(h(b, "right"), "key", "full_outer").select("key", F.col("left").eqNullSafe(F.col("right")).alias("same"))


def readiness(tasks: DataFrame, segments: DataFrame) -> DataFrame:
    """Per segmented task what finalisation waits for."""
    s = aggregates.segment_summary(segments).join(tasks.select("task_id", F.col("status")), "task_id")
    return s.select("task_id", F.when(F.col("status").isin(*C.TERMINAL), "ended").when(F.col("active") + F.col("pending") > 0, "waiting").when(F.col("failed") > 0, "failed").otherwise("ready").alias("readiness"))


def combined_text(results: DataFrame) -> DataFrame:
    """One text a batch: ``--- name ---`` and content of its succeeded tasks in creation order. results: batch, name, created_s, task_id, content."""
    line = F.concat(F.lit("--- "), F.col("name"), F.lit(" ---\n"), F.col("content"), F.lit("\n"))
    g = results.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("created_s", "task_id", line.alias("line")))).alias("l"))
    return g.select("batch", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))


def export_capped(results: DataFrame, cap: int = C.EXPORT_CAP_BYTES) -> DataFrame:
    """Files of each batch in order while their running size is within the cap, and whether the batch was cut. results: batch, task_id, created_s, bytes."""
    w = W.partitionBy("batch").orderBy("created_s", "task_id")
    rows = results.withColumn("running", F.sum("bytes").over(w.rowsBetween(W.unboundedPreceding, 0)))
    rows = rows.withColumn("truncated", F.max((F.col("running") > cap).cast("int")).over(W.partitionBy("batch")) == 1)
    return rows.where(F.col("running") <= cap).select("batch", "task_id", "running", "truncated")


def duplicate_report(tasks: DataFrame, fingerprints: DataFrame, window_s: int) -> DataFrame:
    g = tasks.where("task_group_id is not null").groupBy(F.col("task_group_id").alias("batch")).agg(F.min("user_id").alias("user_id"), F.count("*").alias("n"), F.min("created_s").alias("created_s"), F.count_if(~F.col("status").isin(*C.TERMINAL)).alias("active"))
    return joins.duplicate_batches(g.join(fingerprints, "batch"), window_s)
