"""Window operators. Every window is partitioned by a key and ends in a unique sort column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from voxmill import constants as C
from voxmill.operators.ranks import numbered


def _by_work() -> W:
    return W.partitionBy("server_id", "work_kind").orderBy("ts_us", "event_id")


def rolling_p90(done: DataFrame, value: Column, size: int = 50, least: int = 3) -> DataFrame:
    """Nearest-rank 90th percentile of the last ``size`` values per server and kind; null until there are ``least``. Only key, order and value are gathered."""
    rows = done.select("event_id", "server_id", "work_kind", "ts_us", value.alias("v"))
    seen = F.array_sort(F.collect_list("v").over(_by_work().rowsBetween(1 - size, 0)))
    n = F.size(seen)
    return rows.select("event_id", "server_id", "work_kind", F.when(n >= least, F.element_at(seen, F.ceil(n * 9 / 10).cast("int"))).alias("p90"))


def rolling_mean(done: DataFrame, value: Column, size: int = 50) -> DataFrame:
    frame = _by_work().rowsBetween(1 - size, 0)
    return done.select("event_id", "server_id", "work_kind", F.round(F.sum(value).over(frame) / F.count(value).over(frame), 4).alias("mean"), F.count(value).over(frame).alias("n"))


def eta_factor(done: DataFrame) -> DataFrame:
    """Correction of estimates: the mean of the last two actual / predicted ratios, in steps of 0.1 within 0.5 and 3, whenever it is off by more than 0.05; else as before (1 at first)."""
    w = _by_work()
    ratio = F.col("actual_cs") / F.col("predicted_cs")
    rows = done.where("predicted_cs > 0 and actual_cs > 0").withColumn("ratio", ratio)
    rows = rows.withColumn("mean2", F.when(F.count("ratio").over(w.rowsBetween(-1, 0)) == 2, F.avg("ratio").over(w.rowsBetween(-1, 0))))
    step = F.least(F.lit(3.0), F.greatest(F.lit(0.5), F.round(F.col("mean2") * 10) / 10))
    rows = rows.withColumn("candidate", F.when(F.abs(F.col("mean2") - 1.0) > 0.05, step))
    return rows.select("event_id", "server_id", "work_kind", F.round(F.coalesce(F.last("candidate", True).over(w.rowsBetween(W.unboundedPreceding, 0)), F.lit(1.0)), 1).alias("factor"))


def dwell(events: DataFrame) -> DataFrame:
    """Microseconds that a task stayed in each state, summed; the last state has no end yet."""
    nxt = F.lead("ts_us").over(W.partitionBy("task_id").orderBy("ts_us", "event_id"))
    return events.withColumn("stay", nxt - F.col("ts_us")).groupBy("task_id", F.col("to_status").alias("status")).agg(F.sum("stay").alias("dwell_us"), F.count("stay").alias("stays"))


def broken_chain(events: DataFrame) -> DataFrame:
    """Events that don't start from the state before; those without a state before (moves between servers) are left out."""
    prev = F.lag("to_status").over(W.partitionBy("task_id").orderBy("ts_us", "event_id"))
    return events.withColumn("expected", prev).where("from_status is not null and expected is not null").where(~F.col("from_status").eqNullSafe(F.col("expected"))).select("event_id", "task_id", "from_status", "expected")


def order_violations(sentences: DataFrame, first: int = 10) -> DataFrame:
    """Sentences that begin before the latest end so far, the first few per task; sentences at 0-0 have no time."""
    w = W.partitionBy("task_id").orderBy("segment_index", "pos")
    timed = sentences.where("start_ms > 0 or end_ms > 0").withColumn("latest", F.max("end_ms").over(w.rowsBetween(W.unboundedPreceding, -1)))
    bad = timed.where("start_ms < latest")
    return bad.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= first).select("task_id", "segment_index", "pos", "start_ms", "latest", "rn")


def best_level(levels: DataFrame, least_gain: float = 0.1, most_slower: float = 2.0) -> DataFrame:
    """Per server the last benchmark level before the first failure: throughput must gain 10 % on the level before and a file may take twice as long as alone. levels: server_id, level, throughput_ppm, per_file_ppm."""
    w = W.partitionBy("server_id").orderBy("level")
    rows = levels.withColumns({"prev": F.lag("throughput_ppm").over(w), "single": F.first("per_file_ppm").over(w)})
    slow = F.coalesce((F.col("prev") > 0) & (1.0 - F.col("throughput_ppm") / F.col("prev") < least_gain), F.lit(False))
    late = F.col("prev").isNotNull() & (F.col("single") > 0) & (F.col("per_file_ppm") > most_slower * F.col("single"))
    rows = rows.withColumn("failed", F.max((slow | late).cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return rows.where("failed = 0").groupBy("server_id").agg(F.max_by("level", "level").alias("level"), F.max_by("throughput_ppm", "level").alias("throughput_ppm"))


def numbered_names(files: DataFrame, key: str, base: Column, order: str) -> DataFrame:
    """Output names without clashes: the first keeps its name, later ones get _2, _3, ..."""
    rows = files.withColumn("base", base)
    rn = F.row_number().over(W.partitionBy(key, "base").orderBy(order))
    return rows.select(key, order, F.when(rn == 1, F.col("base")).otherwise(F.concat("base", F.lit("_"), rn.cast("string"))).alias("name"))


def queue_position(items: DataFrame) -> DataFrame:
    """Longest estimate first. items: batch, item, est_s."""
    return items.select("batch", "item", F.row_number().over(W.partitionBy("batch").orderBy(F.desc("est_s"), "item")).alias("position"))


def chunk_bounds(items: DataFrame, key: str, order: str, size: int) -> DataFrame:
    """Items in chunks of ``size``, with each chunk's first and last index."""
    i = F.row_number().over(W.partitionBy(key).orderBy(order)) - 1
    rows = items.withColumn("i", i).withColumn("chunk", F.floor(F.col("i") / size).cast("long"))
    return rows.groupBy(key, "chunk").agg(F.min("i").cast("long").alias("first"), F.max("i").cast("long").alias("last"), F.count("*").alias("n"))


def trailing_bytes(uploads: DataFrame, limit: int, window_us: int = 60_000_000) -> DataFrame:
    """Bytes of the user's uploads in the last 60 s, this one included, and whether they are above the limit. The window's far end is exclusive. uploads: event_id, user_id, ts_us, bytes."""
    total = F.sum("bytes").over(W.partitionBy("user_id").orderBy("ts_us").rangeBetween(1 - window_us, 0))
    return uploads.select("event_id", "user_id", total.alias("trailing"), (total > limit).alias("over"))


def running_daily(tasks: DataFrame, limit: int) -> DataFrame:
    """Tasks of the user so far on the UTC day. tasks: task_id, user_id, created_s."""
    day = F.expr("created_s div 86400")
    n = F.row_number().over(W.partitionBy("user_id", day).orderBy("created_s", "task_id"))
    return tasks.select("task_id", "user_id", n.alias("n"), (n > limit).alias("over"))


def _prefixes(steps: DataFrame, key: str, order: list[str], span_s: int) -> tuple[DataFrame, DataFrame]:
    """A running sum of ``step`` per key in two levels: inside spans of time, and over the spans.

    Gives the rows with ``span``, ``s`` (sum so far in the span) and ``low`` (its lowest
    value so far); and for each key and span ``before`` (sum of earlier spans) and
    ``lowest`` (lowest sum in them, null for the first), ``high`` (highest sum within).
    No window sees more than a key's rows of one span, or one row a span.
    """
    w = W.partitionBy(key, "span").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    rows = steps.withColumn("span", F.expr(f"floor(at_s / {span_s})")).withColumn("s", F.sum("step").over(w)).withColumn("low", F.min("s").over(w))
    totals = rows.groupBy(key, "span").agg(F.sum("step").alias("sum"), F.min("s").alias("low"), F.max("s").alias("top"))
    earlier = W.partitionBy(key).orderBy("span").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.withColumn("before", F.coalesce(F.sum("sum").over(earlier), F.lit(0)))
    return rows, totals.select(key, "span", "before", F.min(F.col("before") + F.col("low")).over(earlier).alias("lowest"), (F.col("before") + F.col("top")).alias("high"))


def running_concurrency(tasks: DataFrame, span_s: int = 86_400) -> DataFrame:
    """Tasks of the user at work after each start (+1) and end (-1), never below 0: the running sum less its lowest value so far. A user's rows are worked on by spans of ``span_s``."""
    up = tasks.select("user_id", "task_id", F.col("created_s").alias("at_s"), F.lit(1).alias("step"))
    down = tasks.where("completed_s is not null").select("user_id", "task_id", F.col("completed_s").alias("at_s"), F.lit(-1).alias("step"))
    rows, spans = _prefixes(up.unionByName(down), "user_id", ["at_s", "task_id", "step"], span_s)
    spans = spans.select(F.col("user_id").alias("its"), F.col("span").alias("at"), "before", "lowest")
    met = rows.join(spans, F.col("user_id").eqNullSafe(F.col("its")) & (F.col("span") == F.col("at")))
    floor = F.least(F.lit(0), F.col("lowest"), F.col("before") + F.col("low"))  # a null lowest is left out
    return met.select("user_id", "task_id", "step", (F.col("before") + F.col("s") - floor).alias("running"))


def occupancy(work: DataFrame, span_s: int = 86_400) -> DataFrame:
    """Per server the most work at the same time; work that ends makes room for what starts in that second. A server's work is worked on by spans of ``span_s``. work: server_id, work_id, started_s, completed_s."""
    up = work.select("server_id", "work_id", F.col("started_s").alias("at_s"), F.lit(1).alias("step"))
    down = work.select("server_id", "work_id", F.col("completed_s").alias("at_s"), F.lit(-1).alias("step"))
    _, spans = _prefixes(up.unionByName(down), "server_id", ["at_s", "step", "work_id"], span_s)
    return spans.groupBy("server_id").agg(F.max("high").alias("peak"))


def slot_queues(plan: DataFrame) -> DataFrame:
    """Place of each planned item in its slot's queue, and whether it starts at once."""
    rn = F.row_number().over(W.partitionBy("server_id", "slot").orderBy("start_s", "item"))
    return plan.select("server_id", "slot", "item", rn.alias("place"), (F.col("start_s") <= 1e-9).alias("now"))


def next_items(plan: DataFrame, k: int, later: bool = True) -> DataFrame:
    """Per server the next k planned items: those that can start now first, then, if allowed, the earliest others."""
    now = F.col("start_s") <= 1e-9
    rows = plan if later else plan.where(now)
    rn = F.row_number().over(W.partitionBy("server_id").orderBy(F.desc(now), "start_s", "item"))
    return rows.withColumn("rn", rn).where(F.col("rn") <= k).select("server_id", "item", "rn")


def undominated(items: DataFrame, parts: int = 64) -> DataFrame:
    """Items of which none ends later, or as late, with less audio, or as little; of equal ones the largest id. items: item, audio_s, finish_s.

    Each of ``parts`` shares by hash is reduced first, and then what is left of them.
    """
    rows = items
    for share in (F.pmod(F.xxhash64("item"), F.lit(parts)), F.lit(0)):
        before = W.partitionBy(share).orderBy(F.desc("finish_s"), "audio_s", F.desc("item")).rowsBetween(W.unboundedPreceding, -1)
        rows = rows.withColumn("__least", F.min("audio_s").over(before)).where("__least is null or audio_s < __least").drop("__least")
    return rows


def rebalance(plan: DataFrame, servers: DataFrame, tail: int = 3, least_s: float = 3.0, share: float = 0.05, block: int = 256) -> DataFrame:
    """What an idle server would gain most by: of the last items of each queue, the one whose planned finish is latest against its estimate there. plan: server_id, item, audio_s, finish_s.

    The gain and its threshold both rise with the finish and fall with the audio, so only
    undominated items can win. These are few; they stand in blocks of ``block``, in one
    row each, and every idle server's speed is tried against each block.
    """
    w = W.partitionBy("server_id").orderBy(F.desc("finish_s"), F.desc("item"))
    ends = plan.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= tail)
    busy = plan.select("server_id").distinct()
    idle = servers.where("enabled and status = 'ONLINE' and max_concurrency > 0").join(busy, "server_id", "left_anti").select(F.col("server_id").alias("idle_id"), F.coalesce("rtf_baseline", F.lit(0.3)).alias("rtf"))
    line = numbered(undominated(ends.select("item", "audio_s", "finish_s").where("audio_s is not null and finish_s is not null")), "place", F.desc("finish_s"), F.desc("item"))
    blocks = line.groupBy(F.expr(f"(place - 1) div {block}").alias("block")).agg(F.collect_list(F.struct("finish_s", "audio_s", "item")).alias("items"))
    many = blocks.agg(F.max("block")).head()[0]
    if many is None:
        return idle.limit(0).select("idle_id", F.lit(None).cast(plan.schema["item"].dataType).alias("item"), F.lit(None).cast("double").alias("gain"))
    speeds = idle.select("rtf").distinct().select("rtf", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(many))).alias("block"))
    gains = F.transform("items", lambda x: F.struct((x["finish_s"] - (x["audio_s"] * F.col("rtf") + 5)).alias("gain"), x["item"].alias("item"), x["finish_s"].alias("finish_s")))
    enough = F.filter(gains, lambda g: g["gain"] >= F.greatest(F.lit(least_s), share * g["finish_s"]))
    best = speeds.join(blocks, "block").select("rtf", F.array_max(enough).alias("g")).where("g is not null").groupBy("rtf").agg(F.max(F.struct("g.gain", "g.item")).alias("g"))
    return idle.join(best, "rtf").select("idle_id", "g.item", F.round("g.gain", 3).alias("gain"))


def history(samples: DataFrame, key: str, n: int = 60) -> DataFrame:
    """The newest n samples per key."""
    rn = F.row_number().over(W.partitionBy(key).orderBy(F.desc("ts_us"), F.desc("event_id")))
    return samples.withColumn("rn", rn).where(F.col("rn") <= n)


def sustained(samples: DataFrame, as_of_s: int, for_s: int) -> DataFrame:
    """Keys whose condition has held without a break, up to the newest sample, for ``for_s``. samples: key, at_s, bad."""
    g = samples.where(F.col("at_s") <= as_of_s).groupBy("key").agg(F.max(F.when(~F.col("bad"), F.col("at_s"))).alias("good_s"))
    late = samples.where(F.col("at_s") <= as_of_s).join(g, "key").where("bad and (good_s is null or at_s > good_s)")
    since = late.groupBy("key").agg(F.min("at_s").alias("since_s"))
    return since.where(F.lit(as_of_s) - F.col("since_s") >= for_s)


def repeated_phrases(texts: DataFrame, pattern: str) -> DataFrame:
    """Runs of the pattern that equal the run before them. texts: key, text."""
    rows = texts.select("key", F.posexplode(F.regexp_extract_all("text", F.lit(pattern), 0)).alias("i", "run"))
    prev = F.lag("run").over(W.partitionBy("key").orderBy("i"))
    return rows.withColumn("prev", prev).where("run = prev").groupBy("key").agg(F.count("*").alias("repeats"))


def latest(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    return rows.withColumn("rn", F.row_number().over(W.partitionBy(key).orderBy(*order))).where("rn = 1").drop("rn")


def sample_files(files: DataFrame, ext: Column, small: int = 10 << 20, fill: int = 5) -> DataFrame:
    """Test set: the smallest lossless, compressed and video file up to ``small`` bytes, filled with the next smallest media files. files: file_id, size_bytes."""
    kind = F.when(ext.isin(".wav", ".flac", ".pcm"), "lossless").when(ext.isin(*C.AUDIO_EXTENSIONS), "compressed").when(ext.isin(*C.VIDEO_EXTENSIONS), "video")
    media = files.withColumn("kind", kind).where("kind is not null and size_bytes > 0").where(F.col("size_bytes") <= small)
    firsts = media.groupBy("kind").agg(F.min(F.struct("size_bytes", "file_id")).alias("f")).select("f.file_id", "kind")
    rest = media.join(firsts, "file_id", "left_anti").orderBy("size_bytes", "file_id").limit(fill)
    return firsts.unionByName(rest.select("file_id", "kind"))
