"""Reports by aggregation: one pass where one pass is enough, sums of integers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from voxmill import constants as C
from voxmill.operators.ranks import numbered

DAY = 86400


def is_(*states: str) -> Column:
    return F.col("status").isin(*states)


def work_counts(tasks: DataFrame, as_of: int, *keys: str) -> DataFrame:
    """Slots used, queue depth, done and failed today, finished and succeeded in 24 hours."""
    today, day_ago = as_of - as_of % DAY, as_of - DAY
    done = F.col("completed_s")
    return tasks.groupBy(*keys).agg(
        F.count_if(is_(*C.ACTIVE_SLOT)).alias("slots_used"),
        F.count_if(is_(*C.QUEUE)).alias("queue_depth"),
        F.count_if(is_("SUCCEEDED") & (done >= today)).alias("done_today"),
        F.count_if(is_("FAILED") & (done >= today)).alias("failed_today"),
        F.count_if(is_("SUCCEEDED", "FAILED") & (done >= day_ago)).alias("finished_24h"),
        F.count_if(is_("SUCCEEDED") & (done >= day_ago)).alias("succeeded_24h"),
    )


def work_counts_by_user(tasks: DataFrame, as_of: int) -> DataFrame:
    """The same per user and for all (user_id null) in one aggregation."""
    today, day_ago = as_of - as_of % DAY, as_of - DAY
    return tasks.groupingSets([[F.col("user_id")], []], F.col("user_id")).agg(
        F.grouping(F.col("user_id")).cast("int").alias("is_total"),
        F.count_if(is_(*C.ACTIVE_SLOT)).alias("slots_used"),
        F.count_if(is_(*C.QUEUE)).alias("queue_depth"),
        F.count_if(is_("SUCCEEDED") & (F.col("completed_s") >= today)).alias("done_today"),
        F.count_if(is_("SUCCEEDED", "FAILED") & (F.col("completed_s") >= day_ago)).alias("finished_24h"),
    )


def percent(part: Column, whole: Column) -> Column:
    """Share in percent with one decimal, 0 of nothing."""
    return F.when(whole > 0, F.round(part * 100.0 / whole, 1)).otherwise(0.0)


def success_rate(tasks: DataFrame, as_of: int) -> DataFrame:
    """Per user, over the last 24 hours."""
    return work_counts(tasks, as_of, "user_id").select("user_id", percent(F.col("succeeded_24h"), F.col("finished_24h")).alias("success_rate"))


def fleet_summary(servers: DataFrame) -> DataFrame:
    online = F.col("status") == "ONLINE"
    return servers.agg(
        F.count("*").alias("total"),
        F.count_if(online).alias("online"),
        F.coalesce(F.sum("max_concurrency"), F.lit(0)).alias("slots"),
        F.round(F.avg(F.when(online & (F.col("rtf_baseline") != 0), F.col("rtf_baseline"))), 4).alias("avg_rtf"),
    )


def batch_overview(tasks: DataFrame) -> DataFrame:
    """Per batch: states, mean progress, whether anything is left to do."""
    g = tasks.where("task_group_id is not null").groupBy("task_group_id").agg(
        F.count("*").alias("total"),
        F.count_if(is_("SUCCEEDED")).alias("succeeded"),
        F.count_if(is_("FAILED")).alias("failed"),
        F.count_if(is_("CANCELED")).alias("canceled"),
        F.sum("progress_bp").alias("bp"),
    )
    ended = F.col("succeeded") + F.col("failed") + F.col("canceled")
    return g.select("task_group_id", "total", "succeeded", "failed", "canceled", (F.col("total") - ended).alias("in_progress"), F.round(F.col("bp") / F.col("total")).cast("long").alias("progress_bp"), (ended == F.col("total")).alias("is_complete"))


def status_pivot(rows: DataFrame, key: str, states: tuple[str, ...]) -> DataFrame:
    return rows.groupBy(key).agg(*(F.count_if(F.col("status") == s).alias(s.lower()) for s in states))


def segment_summary(segments: DataFrame) -> DataFrame:
    return segments.groupBy("task_id").agg(
        F.count("*").alias("total"),
        F.count_if(is_("SUCCEEDED")).alias("succeeded"),
        F.count_if(is_("FAILED")).alias("failed"),
        F.count_if(is_("PENDING")).alias("pending"),
        F.count_if(is_(*C.ACTIVE_SLOT)).alias("active"),
        F.array_join(F.sort_array(F.collect_set("assigned_server_id")).cast("array<string>"), ",").alias("servers"),
    )


def batches_of_size(tasks: DataFrame, n: int) -> DataFrame:
    return tasks.where("task_group_id is not null").groupBy("task_group_id").agg(F.count("*").alias("n")).where(F.col("n") == n)


def cross_server(segments: DataFrame) -> DataFrame:
    return segments.groupBy("task_id").agg(F.count_distinct("assigned_server_id").alias("servers")).where("servers > 1")


def steals(events: DataFrame) -> DataFrame:
    """Per task: moves of work between servers told in event payloads; malformed payloads don't count. The text filter before the parse is only cheap, the parsed value decides."""
    kind = F.get_json_object("payload_json", "$.event_type")
    number = lambda p: F.coalesce(F.get_json_object("payload_json", p).try_cast("double"), F.lit(0.0))
    return events.where(F.contains("payload_json", F.lit("work_steal"))).where(kind == "work_steal").groupBy("task_id").agg(F.count("*").alias("steals"), F.round(F.sum(number("$.estimated_gain_sec")), 1).alias("gain"), F.round(F.sum(number("$.est_stolen_sec")), 1).alias("stolen"))


def idle_slots(tasks: DataFrame, segments: DataFrame, servers: DataFrame) -> DataFrame:
    """Per batch: wall time times slots less busy time, at least 0; null without timed work or slots.

    A task with timed segments adds to the wall time, but its own time isn't busy
    time again. Slots are those of enabled servers online; if there are none, those
    of the servers that the batch's work was given to.
    """
    timed = "started_s is not null and completed_s is not null"
    batch = tasks.where("task_group_id is not null").select("task_group_id", "task_id")
    seg = segments.where(timed).join(batch, "task_id").select("task_group_id", "task_id", "started_s", "completed_s", "assigned_server_id")
    whole = tasks.where("task_group_id is not null").where(timed).join(seg.select("task_id", F.lit(True).alias("split")).distinct(), "task_id", "left")
    work = whole.select("task_group_id", "started_s", "completed_s", "assigned_server_id", F.when(F.col("split"), F.lit(0)).otherwise(F.col("completed_s") - F.col("started_s")).alias("busy"))
    work = work.unionByName(seg.select("task_group_id", "started_s", "completed_s", "assigned_server_id", (F.col("completed_s") - F.col("started_s")).alias("busy")))
    spans = work.groupBy("task_group_id").agg((F.max("completed_s") - F.min("started_s")).alias("wall"), F.sum("busy").alias("busy"))
    # one number: the slots that every batch shares
    online = servers.where("enabled and status = 'ONLINE'").agg(F.sum("max_concurrency")).head()[0] or 0
    if online > 0:
        slots = spans.withColumn("slots", F.lit(online))
    else:
        own = work.select("task_group_id", F.col("assigned_server_id").alias("server_id")).distinct().join(servers.select("server_id", "max_concurrency"), "server_id").groupBy("task_group_id").agg(F.sum("max_concurrency").alias("slots"))
        slots = spans.join(own, "task_group_id", "left")
    idle = F.when(F.col("wall") <= 0, 0).when(F.col("slots") > 0, F.greatest(F.lit(0), F.col("wall") * F.col("slots") - F.col("busy")))
    return batch.select("task_group_id").distinct().join(slots, "task_group_id", "left").select("task_group_id", "wall", "busy", idle.cast("long").alias("idle_slot_seconds"))


def segment_progress(segments: DataFrame) -> DataFrame:
    """Per task: kept milliseconds, those done, and the task's progress."""
    length = F.col("keep_end_ms") - F.col("keep_start_ms")
    g = segments.groupBy("task_id").agg(F.sum(length).alias("total_ms"), F.sum(F.when(is_("SUCCEEDED"), length).otherwise(0)).alias("done_ms"))
    return g.withColumn("progress", F.round(F.least(F.lit(0.95), 0.2 + 0.75 * F.when(F.col("total_ms") > 0, F.col("done_ms") / F.col("total_ms")).otherwise(0.0)), 4))


def slot_use(tasks: DataFrame, segments: DataFrame, servers: DataFrame) -> DataFrame:
    """Per server: whole tasks and segments at work, and whether that is more than it has slots."""
    parents = segments.select("task_id").distinct()
    whole = tasks.where(is_(*C.ACTIVE_SLOT)).join(parents, "task_id", "left_anti")
    used = whole.select("assigned_server_id").unionByName(segments.where(is_(*C.ACTIVE_SLOT)).select("assigned_server_id")).where("assigned_server_id is not null")
    n = used.groupBy(F.col("assigned_server_id").alias("server_id")).agg(F.count("*").alias("used"))
    return servers.select("server_id", "max_concurrency").join(n, "server_id", "left").select("server_id", "max_concurrency", F.coalesce("used", F.lit(0)).alias("used"), (F.coalesce("used", F.lit(0)) > F.col("max_concurrency")).alias("over"))


def slot_report(tasks: DataFrame, segments: DataFrame) -> DataFrame:
    """Work on each server's slots, and whether it is a zombie (a segment at work whose task has ended); beside it the server's numbers of both. A row for each piece of work, however many a server has."""
    parents = segments.select("task_id").distinct()
    whole = tasks.where(is_(*C.ACTIVE_SLOT)).join(parents, "task_id", "left_anti").select("assigned_server_id", F.concat(F.lit("t"), "task_id").alias("work"), F.lit(0).alias("zombie"))
    seg = segments.where(is_(*C.ACTIVE_SLOT)).join(tasks.select("task_id", F.col("status").alias("parent")), "task_id")
    seg = seg.select("assigned_server_id", F.concat(F.lit("s"), "segment_id").alias("work"), F.col("parent").isin(*C.TERMINAL).cast("int").alias("zombie"))
    rows = whole.unionByName(seg).where("assigned_server_id is not null")
    return rows.join(rows.groupBy("assigned_server_id").agg(F.count("*").alias("n"), F.sum("zombie").alias("zombies")), "assigned_server_id")


def cancel_preview(tasks: DataFrame, segments: DataFrame) -> DataFrame:
    """Per batch (null: outside batches): tasks that a cancel would end and segments it would release."""
    open_ = tasks.where(~is_(*C.TERMINAL)).select("task_id", "task_group_id")
    seg = segments.where(is_("PENDING", *C.ACTIVE_SLOT)).groupBy("task_id").agg(F.count("*").alias("segments"))
    return open_.join(seg, "task_id", "left").groupBy("task_group_id").agg(F.count("*").alias("tasks"), F.coalesce(F.sum("segments"), F.lit(0)).alias("segments"))


def benchmark_levels(runs: DataFrame) -> DataFrame:
    """Per server, level and repeat: means, maximum, spread, tail and ratios (in millionths). runs: server_id, level, repeat, upload_ms, final_ms, audio_ms."""
    return runs.groupBy("server_id", "level", "repeat").agg(
        F.count("*").alias("n"),
        F.round(F.avg("final_ms"), 3).alias("mean_ms"),
        F.max("final_ms").alias("max_ms"),
        (F.max("final_ms") - F.min("final_ms")).alias("spread_ms"),
        (F.max("final_ms") - F.max("upload_ms")).alias("tail_ms"),
        F.expr("max(final_ms) * 1000000 div sum(audio_ms)").alias("throughput_ppm"),
        F.expr("sum(final_ms) * 1000000 div sum(audio_ms)").alias("per_file_ppm"),
    )


def lower_median(levels: DataFrame, value: str) -> DataFrame:
    """Per server and level the repeat in the middle, the lower one of an even number."""
    from pyspark.sql import Window as W

    w = W.partitionBy("server_id", "level")
    ranked = levels.withColumn("rn", F.row_number().over(w.orderBy(value, "repeat"))).withColumn("n_all", F.count("*").over(w))
    return ranked.where("rn = (n_all + 1) div 2").drop("rn", "n_all")


def extremes(runs: DataFrame) -> DataFrame:
    """Per file the fastest and the slowest server and their ratio. runs: file_id, server_id, ms."""
    order = lambda c: F.struct(c, "server_id")
    g = runs.groupBy("file_id").agg(F.min_by("server_id", order("ms")).alias("fastest"), F.max_by("server_id", order("ms")).alias("slowest"), F.min("ms").alias("lo"), F.max("ms").alias("hi"))
    return g.select("file_id", "fastest", "slowest", F.when(F.col("lo") > 0, F.round(F.col("hi") / F.col("lo"), 3)).alias("ratio"))


def speed() -> Column:
    """Slots by seconds of work for a second of audio."""
    return F.col("max_concurrency") / F.greatest(F.coalesce("rtf_baseline", F.lit(0.3)), F.lit(0.01))


def capacity_ranking(servers: DataFrame) -> DataFrame:
    """Servers by speed, relative to the fastest; ties by id. No task sees the whole registry, also if all speeds are equal."""
    s = servers.withColumn("speed", speed())
    top = s.agg(F.max("speed")).head()[0]
    ranked = numbered(s.select("server_id", "speed"), "rank", F.desc("speed"), F.asc("server_id"))
    return ranked.select("server_id", F.round("speed", 4).alias("speed"), F.round(F.col("speed") / top, 4).alias("relative") if top else F.lit(0.0).alias("relative"), F.col("rank").cast("int"))


def plan_load(plan: DataFrame) -> DataFrame:
    """Per server: planned items and estimated finish; and the makespan of its batch. plan: batch, server_id, finish_s."""
    per = plan.groupBy("batch", "server_id").agg(F.count("*").alias("items"), F.max("finish_s").alias("finish_s"))
    return per.join(per.groupBy("batch").agg(F.max("finish_s").alias("makespan_s")), "batch")


def queue_left(plan: DataFrame) -> DataFrame:
    """Per server: seconds of work left and the item that ends last. plan: server_id, item, est_s, finish_s."""
    return plan.groupBy("server_id").agg(F.sum("est_s").alias("left_s"), F.max("finish_s").alias("last_finish_s"), F.max_by("item", F.struct("finish_s", "item")).alias("last_item"))


def imbalance(plan: DataFrame, servers: DataFrame) -> DataFrame:
    """One verdict: servers without work beside a backlog of 30 s or more, or the fullest queue above 1.5 times the emptiest."""
    q = plan.groupBy("server_id").agg(F.sum("est_s").alias("left_s"))
    g = servers.where("enabled and status = 'ONLINE' and max_concurrency > 0").select("server_id").join(q, "server_id", "left").select(F.coalesce("left_s", F.lit(0)).alias("left_s"))
    a = g.agg(F.count_if(F.col("left_s") == 0).alias("idle"), F.coalesce(F.max("left_s"), F.lit(0)).alias("most"), F.coalesce(F.min(F.when(F.col("left_s") > 0, F.col("left_s"))), F.lit(0)).alias("least"))
    return a.withColumn("verdict", F.when((F.col("idle") > 0) & (F.col("most") >= 30), "exhausted").when((F.col("least") > 0) & (F.col("most") > 1.5 * F.col("least")), "imbalanced").otherwise("balanced"))


def task_summary(tasks: DataFrame, result: Column) -> DataFrame:
    return tasks.groupBy("status").agg(F.count("*").alias("n"), F.count_if(F.trim(F.coalesce(result, F.lit(""))) != "").alias("with_result"))


def folder_summary(files: DataFrame, folder: Column, newest: int) -> DataFrame:
    """Per folder: files, bytes and the ids of its newest files. files: file_id, size_bytes, mtime."""
    from pyspark.sql import Window as W

    f = files.withColumn("folder", folder)
    rn = F.row_number().over(W.partitionBy("folder").orderBy(F.desc("mtime"), "file_id"))
    f = f.withColumn("rn", rn)
    return f.groupBy("folder").agg(F.count("*").alias("n"), F.sum("size_bytes").alias("bytes"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("rn") <= newest, F.struct("rn", "file_id")))), lambda x: x["file_id"].cast("string")), ",").alias("newest"))


def reconcile(tables: dict[str, DataFrame], expected: DataFrame) -> DataFrame:
    """Tables whose row count isn't the expected one. expected: table, expected."""
    counts = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("actual")).select(F.lit(name).alias("table"), "actual")
        counts = one if counts is None else counts.unionByName(one)
    return expected.join(counts, "table", "full_outer").where(~F.col("expected").eqNullSafe(F.col("actual")))


def reclaimable(files: DataFrame, area: Column) -> DataFrame:
    """Bytes by storage area, in all and without uploads."""
    g = files.groupBy(area.alias("area")).agg(F.sum("size_bytes").alias("bytes"))
    return g.withColumn("bytes_without_uploads", F.when(F.col("area") == "uploads", 0).otherwise(F.col("bytes")))


def manifest_totals(files: DataFrame, key: str, chunk: int) -> DataFrame:
    return files.groupBy(key).agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"), F.coalesce(F.sum("duration_sec"), F.lit(0)).alias("seconds"), F.ceil(F.count("*") / chunk).cast("long").alias("chunks"))


def submit_summary(rows: DataFrame, key: str, outcome: Column) -> DataFrame:
    return rows.groupBy(key).agg(*(F.sum(F.when(outcome == o, 1).otherwise(0)).alias(o) for o in ("submitted", "deduplicated", "failed")))


def histogram(rows: DataFrame, keys: list[str], value: Column, bounds: list[float]) -> DataFrame:
    """Cumulative counts by upper bound (le), the last one without bound (null). One aggregation, a column a bound, unpivoted afterwards."""
    g = rows.groupBy(*keys).agg(*(F.count_if(value <= b).alias(f"b{i}") for i, b in enumerate(bounds)), F.count(value).alias("b_all"))
    pairs = F.array(*(F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)), F.struct(F.lit(None).cast("double").alias("le"), F.col("b_all").alias("n")))
    return g.select(*keys, F.inline(pairs))


def histogram_quantile(hist: DataFrame, keys: list[str], q: float) -> DataFrame:
    """Quantile by linear interpolation in its bucket; the highest bound if it lies beyond. hist: keys, le, n (cumulative)."""
    from pyspark.sql import Window as W

    order = W.partitionBy(*keys).orderBy(F.asc_nulls_last("le"))
    h = hist.withColumns({"total": F.max("n").over(W.partitionBy(*keys)), "before": F.coalesce(F.lag("n").over(order), F.lit(0)), "low": F.coalesce(F.lag("le").over(order), F.lit(0.0))})
    want = F.lit(q) * F.col("total")
    hit = h.where((F.col("n") >= want) & (F.col("before") < want))
    return hit.select(*keys, F.round(F.when(F.col("le").isNull(), F.col("low")).otherwise(F.col("low") + (F.col("le") - F.col("low")) * (want - F.col("before")) / (F.col("n") - F.col("before"))), 4).alias("quantile"))


def failure_windows(events: DataFrame, seconds: int = 300) -> DataFrame:
    """Share of failures among ended work by window. events: ts_us, to_status."""
    start = (F.expr("ts_us div 1000000") - F.expr("ts_us div 1000000") % seconds).alias("window_s")
    g = events.groupBy(start).agg(F.count_if(F.col("to_status") == "FAILED").alias("failed"), F.count_if(F.col("to_status").isin("FAILED", "SUCCEEDED")).alias("ended"))
    return g.withColumn("ratio", F.when(F.col("ended") > 0, F.round(F.col("failed") / F.col("ended"), 6)).otherwise(0.0))


def fleet_verdict(servers: DataFrame, key: str) -> DataFrame:
    g = servers.groupBy(key).agg(F.count("*").alias("n"), F.count_if(F.col("status") == "ONLINE").alias("online"))
    return g.withColumn("verdict", F.when(F.col("n") == 0, "warning").when(F.col("online") == 0, "error").when(F.col("online") < F.col("n"), "warning").otherwise("ok"))


def quality_report(tasks: DataFrame) -> DataFrame:
    """Per batch: normal, warning and error tasks; consistent when ended ones are all."""
    g = tasks.where("task_group_id is not null").groupBy("task_group_id").agg(F.count_if(is_("SUCCEEDED") & (F.col("retry_count") == 0)).alias("normal"), F.count_if(is_("SUCCEEDED") & (F.col("retry_count") > 0)).alias("warning"), F.count_if(is_("FAILED")).alias("error"), F.count("*").alias("total"))
    return g.withColumn("consistent", F.col("normal") + F.col("warning") + F.col("error") == F.col("total"))


def monitor(tasks: DataFrame, as_of: int) -> DataFrame:
    """Per batch: counts, elapsed seconds, and seconds left at the pace so far."""
    g = tasks.where("task_group_id is not null").groupBy("task_group_id").agg(F.count("*").alias("total"), F.count_if(is_("SUCCEEDED")).alias("succeeded"), F.count_if(is_(*C.TERMINAL)).alias("ended"), (F.lit(as_of) - F.min("created_s")).alias("elapsed_s"))
    left = F.col("total") - F.col("ended")
    return g.select("task_group_id", "total", "succeeded", left.alias("left"), "elapsed_s", F.when(F.col("succeeded") > 0, F.floor(F.col("elapsed_s") * left / F.col("succeeded"))).cast("long").alias("remaining_s"))


def deliveries(outbox: DataFrame, key: str) -> DataFrame:
    return outbox.groupBy(key).agg(F.count("*").alias("notices"), F.count_if(F.col("status") == "SENT").alias("delivered"))


def evaluation_summary(pairs: DataFrame) -> DataFrame:
    """pairs: key, similarity, diff_ratio, violations."""
    g = pairs.groupBy("key").agg(F.count("*").alias("pairs"), F.round(F.avg("similarity"), 4).alias("similarity"), F.round(F.avg("diff_ratio"), 4).alias("diff_ratio"), F.sum("violations").alias("violations"))
    return g.withColumn("verdict", F.when((F.col("similarity") >= 0.95) & (F.col("violations") == 0), "good").when(F.col("similarity") >= 0.85, "fair").otherwise("poor"))


def batch_estimate(files: DataFrame, servers: DataFrame, key: str) -> DataFrame:
    """Seconds for each batch of files: audio times ratio, by servers and their mean slots; a ratio of 0.1 where none is known."""
    s = servers.where("enabled and status = 'ONLINE' and max_concurrency > 0").agg(F.count("*"), F.avg("max_concurrency"), F.avg("rtf_baseline")).head()
    n, slots, rtf = s[0] or 0, float(s[1] or 0), float(s[2] if s[2] is not None else 0.1)
    total = F.coalesce(F.sum("duration_sec"), F.lit(0))
    return files.groupBy(key).agg(total.alias("audio_s"), (F.round(total * rtf / n / slots, 2) if n and slots else F.lit(None).cast("double")).alias("estimate_s"))


def blocking(rows: DataFrame, key: str, level: Column) -> DataFrame:
    return rows.groupBy(key).agg(F.bool_or(level == "error").alias("has_blocking_errors"))
