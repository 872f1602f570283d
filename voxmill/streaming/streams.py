"""Streaming operators: a stream in, a stream out; ``drain`` runs one to the end of its input.

Each has a batch twin on the same rows, named in its docstring; tests compare them.
State is typed, kept per key in the RocksDB store, and bounded: a list of 50 values, one
breaker, one row a segment; event-time timers free it or tell that something is due.
Rows of a key are put in order within a micro-batch; order across batches is that of
the files.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from voxmill import constants as C
from voxmill.operators import jobs, replay
from voxmill.sources.files import shared_folder
from voxmill.sources.tables import SCHEMAS

STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def event_stream(spark: SparkSession, path: str, files_at_once: int = 1) -> DataFrame:
    """The events table as a stream of files. The path is given as a glob, as the table may be one file."""
    return spark.readStream.schema(SCHEMAS["events"]).option("maxFilesPerTrigger", files_at_once).parquet(f"{path[:-1]}[{path[-1]}]")


def folder(spark: SparkSession, name: str) -> str:
    return shared_folder(spark, f"stream-{name}")


def start(stream: DataFrame, to: str, mode: str = "append", sink: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Starts a query over all input there is, with its state in the RocksDB store; ``sink`` gets the micro-batches, else they are written as Parquet. The session's settings are as before when it runs."""
    conf, before = stream.sparkSession.conf, stream.sparkSession.conf.get(*STORE)
    out = stream.writeStream.option("checkpointLocation", f"{to}/state").outputMode(mode).trigger(availableNow=True)
    out = out.foreachBatch(sink) if sink else out.format("parquet").option("path", f"{to}/out")
    conf.set(*STORE)
    try:
        return out.start()
    finally:
        conf.set(STORE[0], before)


def drain(stream: DataFrame, name: str, to: str | None = None) -> DataFrame:
    """Runs an append stream over all input there is and gives what it wrote so far. ``to``: its folder, where it goes on from an earlier run."""
    spark, to = stream.sparkSession, to or folder(stream.sparkSession, name)
    start(stream, to).awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{to}/out")


def drain_latest(stream: DataFrame, name: str, keys: list[str], version: str) -> DataFrame:
    """Runs an update stream; each batch's changes are kept, and the newest of a key is its value (T11, T12)."""
    spark, to = stream.sparkSession, folder(stream.sparkSession, name)

    def save(batch: DataFrame, number: int) -> None:
        batch.withColumn("__batch", F.lit(number)).write.mode("overwrite").parquet(f"{to}/out/n={number}")

    start(stream, to, "update", save).awaitTermination()
    rows = spark.read.parquet(f"{to}/out").drop("n")
    others = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(*(F.max_by(c, F.struct("__batch", version)).alias(c) for c in others))


def with_end(rows: DataFrame, ends: DataFrame) -> DataFrame:
    """The stream and a stream of end markers: moments (ts) by which all of a bounded input has come. A marker is a row of nulls but for its time; where it is grouped, its group is never closed."""
    return rows.unionByName(ends, allowMissingColumns=True)


def drain_to_end(rows: DataFrame, operator: Callable[[DataFrame], DataFrame], name: str, after_s: int) -> DataFrame:
    """Runs an append stream to the end of a bounded input, windows that are still open there included.

    The query runs over the input first. Then a marker ``after_s`` after its newest
    row is put where the query's second source reads, and the query goes on from its
    checkpoint: the watermark moves past all that is open. No row is late by that, as
    the marker comes last.
    """
    spark, to = rows.sparkSession, folder(rows.sparkSession, name)
    none = spark.createDataFrame([], "ts timestamp")
    none.write.parquet(f"{to}/ends")
    ends = spark.readStream.schema("ts timestamp").parquet(f"{to}/ends")
    stream = operator(with_end(rows, ends))
    query = start(stream, to)
    query.awaitTermination()
    newest = [p["eventTime"]["max"] for p in query.recentProgress if "max" in (p["eventTime"] or {})]
    if newest:
        one = spark.range(1).select((F.lit(max(newest)).cast("timestamp") + F.make_interval(secs=F.lit(after_s))).alias("ts"))
        one.coalesce(1).write.mode("append").parquet(f"{to}/ends")
        start(stream, to).awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{to}/out")


def _sorted(rows: Iterator[Row], order: list[str]) -> list[Row]:
    """A key's rows of one micro-batch in order, nulls first."""
    return sorted(rows, key=lambda r: [(r[c] is not None, r[c]) for c in order])


class Keyed(StatefulProcessor):
    """A walk over each key's rows with one typed value as its state, and one event-time timer.

    ``step(state, row)`` gives the next state (None before a key's first row) and the
    values of an output row, or None. ``expires(state)``: event time in seconds (None:
    never) of the timer. When it is over, ``due(state)`` gives the values of an output
    row, or None, and whether the state is kept; without it the state goes.
    """

    def __init__(self, names: list[str], order: list[str], state: str, step, expires=None, due=None):
        self.names, self.order, self.kept, self.step, self.expires, self.due = names, order, state, step, expires, due

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("walk", f"{self.kept}, timer bigint")

    def load(self) -> tuple[tuple | None, int | None]:
        if not self.state.exists():
            return None, None
        *s, timer = self.state.get()
        return tuple(s), timer

    def row(self, key: tuple, values: tuple) -> Row:
        return Row(*self.names)(*key, *values)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        s, timer = self.load()
        for r in _sorted(rows, self.order):
            s, made = self.step(s, r)
            if made is not None:
                yield self.row(key, made)
        if self.expires:
            until = self.expires(s)
            due = None if until is None else max(int(until * 1000), timerValues.getCurrentWatermarkInMs() + 1)
            if timer != due:
                if timer is not None:
                    self.handle.deleteTimer(timer)
                if due is not None:
                    self.handle.registerTimer(due)
            timer = due
        self.state.update((*s, timer))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        s, _ = self.load()
        made, keep = self.due(s) if self.due else (None, False)
        if keep:
            self.state.update((*s, None))
        else:
            self.state.clear()
        if made is not None:
            yield self.row(key, made)

    def close(self) -> None:
        pass


def _stateful(rows: DataFrame, keys: list[str], schema: str, processor: Callable[[list[str]], StatefulProcessor], timed: bool) -> DataFrame:
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keys).schema.fields)
    names = [*keys, *(c.strip().split(" ")[0] for c in schema.split(","))]
    return rows.groupBy(*keys).transformWithState(processor(names), f"{types}, {schema}", "append", "eventTime" if timed else "none")


def keyed_walk(rows: DataFrame, keys: list[str], order: list[str], schema: str, state: str, step, expires=None, due=None) -> DataFrame:
    """The walk of a batch twin over a stream; see ``Keyed``."""
    return _stateful(rows, keys, schema, lambda names: Keyed(names, order, state, step, expires, due), expires is not None)


def progress_changes(samples: DataFrame, least: float = 0.01, lifetime_s: int = 3600, late: str = "10 minutes") -> DataFrame:
    """T01; twin: replay.emitted_changes with the same lifetime. A listener hears a task for ``lifetime_s``; then its state is freed, and a later sample opens a new one. samples: ts and those of the twin."""

    def step(s, r):
        return replay.sent(s, r["at_s"], r["event_id"], r["status"], r["progress"], least, lifetime_s)

    schema, state = "event_id bigint, status string, progress double", "opened bigint, status string, progress double, ended boolean"
    return keyed_walk(samples.withWatermark("ts", late), ["task_id"], ["at_s", "event_id"], schema, state, step, lambda s: s[0] + lifetime_s)


def window_counts(events: DataFrame, length: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """T02: ended work by tumbling window; twin: a window aggregation. events: ts, status."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", length))
    return w.agg(F.count_if(F.col("status") == "FAILED").alias("failed"), F.count_if(F.col("status").isin("FAILED", "SUCCEEDED")).alias("ended")).select(F.unix_seconds(F.col("window.start")).alias("window_s"), "failed", "ended")


def sliding_bytes(uploads: DataFrame, length: str = "60 seconds", slide: str = "10 seconds", late: str = "60 seconds") -> DataFrame:
    """T03: bytes a user sends in sliding windows; twin: the same aggregation, and windows.trailing_bytes at each upload. uploads: ts, user_id, bytes."""
    return uploads.withWatermark("ts", late).groupBy("user_id", F.window("ts", length, slide)).agg(F.sum("bytes").alias("bytes")).select("user_id", F.unix_seconds(F.col("window.start")).alias("window_s"), "bytes")


def first_submissions(batches: DataFrame, within_s: int = 1800, late: str = "10 minutes") -> DataFrame:
    """T04: batches that aren't a copy of one let through less than ``within_s`` before, by user and fingerprint; twin: replay.grouped_alerts with that interval. State is freed after the interval. batches: ts, at_s, event_id, user_id, fingerprint."""

    def step(s, r):
        last, through = replay.spaced(s[0] if s else None, r["at_s"], within_s)
        return (last,), ((r["event_id"], r["at_s"]) if through else None)

    return keyed_walk(batches.withWatermark("ts", late), ["user_id", "fingerprint"], ["at_s", "event_id"], "event_id bigint, at_s bigint", "last bigint", step, lambda s: s[0] + within_s)


class Recent(StatefulProcessor):
    """A list of the last ``size`` values of a key, and with ``tuned`` the calibration's value beside it."""

    def __init__(self, names: list[str], size: int, put):
        self.names, self.size, self.put = names, size, put

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.values = handle.getListState("values", "value double")
        self.tuned = handle.getValueState("tuned", "before double, factor double, penalty double, fast int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        seen = [v for (v,) in self.values.get()] if self.values.exists() else []
        state = tuple(self.tuned.get()) if self.tuned.exists() else None
        for r in _sorted(rows, ["ts_us", "event_id"]):
            value, state, made = self.put(seen, state, r)
            seen = [*seen, value][-self.size :]
            yield Row(*self.names)(*key, *made(seen))
        self.values.put([(v,) for v in seen])
        if state is not None:
            self.tuned.update(state)

    def close(self) -> None:
        pass


def _ninetieth(seen: list[float | None], least: int, default=None):
    """Nearest-rank 90th percentile of the values that there are; ``default`` below ``least`` of them."""
    known = sorted(v for v in seen if v is not None)
    return known[(len(known) * 9 + 9) // 10 - 1] if len(known) >= least else default


def rolling_p90(done: DataFrame, size: int = 50, least: int = 3) -> DataFrame:
    """T05; twin: windows.rolling_p90. State: ``size`` values of each server and kind; a null value takes a place and doesn't count. done: server_id, work_kind, ts_us, event_id, value."""

    def put(seen, state, r):
        def made(now):
            p90 = _ninetieth(now, least)
            return r["event_id"], None if p90 is None else int(p90)

        return None if r["value"] is None else float(r["value"]), None, made

    return _stateful(done, ["server_id", "work_kind"], "event_id bigint, p90 bigint", lambda names: Recent(names, size, put), False)


def calibration(done: DataFrame, size: int = 50, least: int = 3, default: float = 0.3) -> DataFrame:
    """T05; twin: replay.calibrate. State: the last ``size`` ratios of work to audio time, and ratio before, factor, penalty and fast ones so far. done: server_id, work_kind, ts_us, event_id, audio_sec, actual_cs, predicted_cs."""

    def put(seen, state, r):
        a, p = (None if r[c] is None else r[c] / 100 for c in ("actual_cs", "predicted_cs"))
        ratio = default if r["audio_sec"] is None or r["audio_sec"] <= 0 else None if a is None else a / r["audio_sec"]
        state = replay.tuned(state, a, p)
        deviation = a / p if a is not None and p is not None and p > 0 else None
        return ratio, state, lambda now: (r["event_id"], _ninetieth(now, least, default), deviation, state[2], state[1])

    return _stateful(done, ["server_id", "work_kind"], "event_id bigint, p90 double, deviation double, penalty double, factor double", lambda names: Recent(names, size, put), False)


def breaker(calls: DataFrame, failures: int = 5, timeout_s: float = 60, probes: int = 3, late: str = "0 seconds") -> DataFrame:
    """T06; twin: replay.breaker. A breaker that is still open when its recovery time is over, by the stream's event time, is reported half open by a timer, in a row without an event; the state stays. calls: ts, server_id, at_s, event_id, ok."""
    moves = replay.breaker_moves(failures, probes)

    def step(s, r):
        s, through = replay.moved(s, r["at_s"], bool(r["ok"]), moves, timeout_s)
        return s, (r["event_id"], through, moves[s[0]][0])

    def expires(s):
        return s[1] + timeout_s if moves[s[0]][0] == "OPEN" else None

    return keyed_walk(calls.withWatermark("ts", late), ["server_id"], ["at_s", "event_id"], "event_id bigint, let_through boolean, state string", "place int, failed_s bigint", step, expires, lambda s: ((None, None, "HALF_OPEN"), True))


def heartbeat_timeouts(beats: DataFrame, timeout_s: int = C.HEARTBEAT_TIMEOUT_S, late: str = "0 seconds") -> DataFrame:
    """T07: a server whose last answer lies ``timeout_s`` before the watermark goes OFFLINE, by an event-time timer. beats: server_id, ts."""

    def step(s, r):
        return (max(s[0], r["at_s"]) if s else r["at_s"],), None

    rows = beats.withWatermark("ts", late).select("server_id", "ts", F.unix_seconds("ts").alias("at_s"))
    return keyed_walk(rows, ["server_id"], ["at_s"], "last_s bigint, state string", "last_s bigint", step, lambda s: s[0] + timeout_s, lambda s: ((s[0], "OFFLINE"), False))


def activity_sessions(events: DataFrame, gap: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """T08: spans of a server's activity without a pause of ``gap``; twin: gaps and islands. A span comes out when the watermark has passed it; ``drain_to_end`` closes the last ones of a bounded input. events: ts, server_id."""
    return events.withWatermark("ts", late).groupBy("server_id", F.session_window("ts", gap)).agg(F.count("*").alias("n")).select("server_id", F.unix_seconds(F.col("session_window.start")).alias("start_s"), "n")


class Completion(StatefulProcessor):
    """Per task the last row's time, whether it was told, and a map of the segments that have ended."""

    def __init__(self, names: list[str], keep_s: int):
        self.names, self.keep_s = names, keep_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.task = handle.getValueState("task", "last_s bigint, told boolean, timer bigint")
        self.ended = handle.getMapState("ended", "segment_index bigint", "status string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        last, told, timer = self.task.get() if self.task.exists() else (None, False, None)
        for r in _sorted(rows, ["at_s", "event_id"]):
            if last is not None and r["at_s"] - last > self.keep_s:
                self.ended.clear()
                told = False
            last = r["at_s"]
            if not told and r["status"] in ("SUCCEEDED", "FAILED"):
                self.ended.updateValue((r["segment_index"],), (r["status"],))
                states = [v for (v,) in self.ended.values()]
                if len(states) >= r["n_segments"]:
                    told = True
                    self.ended.clear()
                    yield Row(*self.names)(*key, r["event_id"], set(states) == {"SUCCEEDED"})
        due = max((last + self.keep_s) * 1000, timerValues.getCurrentWatermarkInMs() + 1)
        if timer != due:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
        self.task.update((last, told, due))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.task.clear()
        self.ended.clear()
        return iter([])

    def close(self) -> None:
        pass


def completed_tasks(segments: DataFrame, keep_s: int = 604_800, late: str = "10 minutes") -> DataFrame:
    """T09: a task once, when all its segments have ended. A task without a row for ``keep_s`` is forgotten, its state freed; rows after that are a new run. segments: ts, at_s, task_id, segment_index, n_segments, status, event_id."""
    return _stateful(segments.withWatermark("ts", late), ["task_id"], "event_id bigint, succeeded boolean", lambda names: Completion(names, keep_s), True)


def merged_once(done: DataFrame, segments: DataFrame, to: str) -> StreamingQuery:
    """T09: transcripts of tasks that completed well, each merged once (jobs.merge_segments) and written under ``to``/out; returns the running query.

    A micro-batch has a folder of its own, ``batch=<number>``, that is written anew as a
    whole: when a query died after the write and before its commit, the batch is
    replayed onto itself. A task that an earlier batch has merged, as it ran twice, is
    left out. done: task_id, succeeded; segments: see jobs.merge_segments. The query is
    told apart by its folder, which also has its checkpoint.
    """
    spark = done.sparkSession
    files = spark._jvm.org.apache.hadoop.fs

    def merge(batch: DataFrame, number: int) -> None:
        due = batch.where("succeeded").select("task_id").distinct()
        out = files.Path(f"{to}/out")
        if out.getFileSystem(spark._jsc.hadoopConfiguration()).exists(out):
            earlier = spark.read.schema("task_id bigint, batch bigint").parquet(f"{to}/out").where(F.col("batch") < number)
            due = due.join(earlier, "task_id", "left_anti")
        jobs.merge_segments(segments.join(due, "task_id", "left_semi")).write.mode("overwrite").parquet(f"{to}/out/batch={number}")

    return start(done, to, sink=merge)


def fresh_results(results: DataFrame, tasks: DataFrame) -> DataFrame:
    """T10: results with the generation of their task's table row, those of an older one marked stale; twin: filters.stale_results. A stream joined to a table."""
    now = tasks.select("task_id", F.col("run_generation").alias("current"))
    return results.join(now, "task_id", "left").withColumn("stale", ~F.col("generation").eqNullSafe(F.col("current")))


def latest_state(events: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """T11, T12: newest value of each key, in update mode; twin: windows.latest."""
    return events.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value), F.max(F.struct(*order)).alias("version"))


def progress_sink(changes: DataFrame, to: str, state: str):
    """S16: progress events as JSON lines for later readers; returns the running query. changes: task_id, event_id, status, progress."""
    events = changes.select("task_id", F.lit("progress").alias("event_type"), "status", "progress", "event_id")
    return events.writeStream.format("json").option("path", to).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
