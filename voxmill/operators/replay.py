"""Replays of ordered logs.

What a window or a column expression can say is said that way: percentiles,
deviations, and segment plans (a file's silences folded by ``aggregate``). The rest
is a walk: rows are dealt out by key and sorted there, and a task goes over them with
one small state per key, so a long log needs no more memory than a short one. A null
key is a key like any other, and values keep their exact types.

A walk over a key is one task. Where a key may hold a large share of all rows, the walk
is segmented (``segmented``): the log is cut into chunks, each is run from every state
that it may be entered in, and the chunks' maps are composed.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from voxmill import constants as C
from voxmill.sources.files import shared_folder

CHUNK_BITS = 16  # rows of a chunk, as a power of 2: what a map is made from at once

_STATE = pa.struct([("place", pa.int64()), ("failed_s", pa.int64())])
_ARROW = {
    "bigint": pa.int64(),
    "double": pa.float64(),
    "string": pa.string(),
    "boolean": pa.bool_(),
    "array<double>": pa.list_(pa.float64()),
    "array<struct<place:bigint;failed_s:bigint>>": pa.list_(_STATE),
    "array<struct<until_s:bigint;place:bigint;failed_s:bigint>>": pa.list_(pa.struct([("until_s", pa.int64()), *_STATE])),
}


def _types(schema: str) -> list[tuple[str, str]]:
    """Names and types of a list of columns; fields of structs are parted by a semicolon."""
    return [tuple(c.strip().split(" ")) for c in schema.split(",")]


def _ddl(schema: str) -> str:
    return schema.replace(";", ",")


def walk(rows: DataFrame, keys: list[str], order: list[str], values: list[str], schema: str, step: Callable) -> DataFrame:
    """``step(state, *values)`` gives the next state (None before the first row of a key) and a row of ``schema``, or None for no row."""
    made = _types(schema)
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keys).schema.fields)
    n = len(keys)

    def run(batches):
        before, state = None, None
        for b in batches:
            columns = [c.to_pylist() for c in b.columns]
            at, out = [], []
            for i, key in enumerate(zip(*columns[:n])):
                state, row = step(state if key == before else None, *(c[i] for c in columns[n:]))
                before = key
                if row is not None:
                    at.append(i)
                    out.append(row)
            picked = [c.take(pa.array(at, pa.int64())) for c in b.columns[:n]]
            yield pa.RecordBatch.from_arrays([*picked, *(pa.array([r[j] for r in out], _ARROW[t]) for j, (_, t) in enumerate(made))], [*keys, *(c for c, _ in made)])

    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, *order)
    return dealt.select(*keys, *values).mapInArrow(run, f"{types}, {_ddl(schema)}")


def segmented(rows: DataFrame, keys: list[str], order: list[str], values: list[str], schema: str, step: Callable, summary: str, summarise: Callable, state: str, enter: Callable) -> DataFrame:
    """The rows of ``walk``, with no key in one task.

    1. Rows are sorted into ranges of key and order and written; of a range, each
       ``2 ** CHUNK_BITS`` rows are a chunk. A key with a third of all rows is a third of
       the ranges, and of the chunks.
    2. Only the last key of a chunk can go on in the next one. ``summarise(columns)`` gives
       the map of its rows there, a row of ``summary``: what they do to every state that
       they may be entered in. There are no more maps than chunks, however many keys.
    3. A walk over the maps of a key, of which there are few, composes them:
       ``enter(state, *map)`` gives the next state, a row of ``state``, in which the next
       chunk is entered.
    4. Each key is walked in each chunk, from there or, where it begins, from no state:
       ``step`` as in ``walk``, but that its first state may be a row of ``state``.
    """
    spark, to = rows.sparkSession, shared_folder(rows.sparkSession, "chunks")
    cut = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("__chunk", F.shiftright(F.monotonically_increasing_id(), CHUNK_BITS))
    cut.write.parquet(to)
    cut = spark.read.schema(cut.schema).parquet(to)
    met = F.col("__chunk") == F.col("__of")
    for k in keys:
        met = met & F.col(k).eqNullSafe(F.col(f"__{k}"))
    by = W.orderBy("__chunk")
    key = F.struct(*keys)
    ends = cut.groupBy("__chunk").agg(F.min(key).alias("first"), F.max(key).alias("last"))
    ends = ends.withColumns({"__next": F.lead("__chunk").over(by), "after": F.lead("first").over(by)}).where(F.col("last").eqNullSafe(F.col("after")))
    going = ends.select(F.col("__chunk").alias("__of"), "__next", *(F.col("last")[k].alias(f"__{k}") for k in keys))
    heads_of = [*keys, "__chunk", "__next"]
    open_ = cut.join(F.broadcast(going), met)
    made, n = _types(summary), len(heads_of)
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in open_.select(*heads_of).schema.fields)

    def maps(batches):
        now, held = None, []

        def told():
            columns = [pa.chunked_array([h[j] for h in held]) for j in range(len(values))]
            row = summarise(columns)
            return pa.RecordBatch.from_arrays([*(k.slice(0, 1) for k in now[1]), *(pa.array([v], _ARROW[t]) for v, (_, t) in zip(row, made))], [*heads_of, *(c for c, _ in made)])

        for b in batches:
            heads = list(zip(*(c.to_pylist() for c in b.columns[:n])))
            begin = 0
            for i in range(1, len(heads) + 1):
                if i == len(heads) or heads[i] != heads[begin]:
                    if now is not None and now[0] != heads[begin]:
                        yield told()
                        held = []
                    now = (heads[begin], [c.slice(begin, 1) for c in b.columns[:n]])
                    held.append([c.slice(begin, i - begin) for c in b.columns[n:]])
                    begin = i
        if held:
            yield told()

    by_chunk = open_.repartition(*keys, "__chunk").sortWithinPartitions(*keys, "__chunk", *order)
    known = by_chunk.select(*heads_of, *values).mapInArrow(maps, f"{types}, {_ddl(summary)}")
    told = ["__next", *(c for c, _ in made)]

    def entered(s, chunk, *map_):
        s = enter(s, *map_)
        return s, (chunk, *s)

    entries = walk(known, keys, ["__chunk"], told, f"__chunk bigint, {state}", entered)
    names = [c for c, _ in _types(state)]
    its = entries.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("__chunk").alias("__of"), *(F.col(c).alias(f"__entry_{c}") for c in names))

    def first(s, *v):
        if s is None and v[len(values)] is not None:
            s = tuple(v[len(values) + 1 :])
        return step(s, *v[: len(values)])

    return walk(cut.join(F.broadcast(its), met, "left"), [*keys, "__chunk"], order, [*values, "__of", *(f"__entry_{c}" for c in names)], schema, first).drop("__chunk")


# --------------------------------------------------------- changes of samples


def sent(state, at_s, event_id, status, progress, least: float, lifetime_s: int | None):
    """State: (opened, status, progress, ended) of what a listener has got. After ``lifetime_s`` a new one listens. A null progress is no change of progress."""
    if state is None or lifetime_s is not None and at_s - state[0] > lifetime_s:
        opened = at_s
    elif state[3]:
        return state, None
    elif status != state[1] or None not in (progress, state[2]) and abs(progress - state[2]) > least:
        opened = state[0]
    else:
        return state, None
    return (opened, status, progress, status in C.TERMINAL), (event_id, status, progress)


def emitted_changes(samples: DataFrame, least: float = 0.01, lifetime_s: int | None = None) -> DataFrame:
    """Samples that a listener gets: the state changed, or progress moved by more than ``least`` since the last one sent; nothing after an end state. samples: task_id, at_s, event_id, status, progress."""
    step = lambda s, *v: sent(s, *v, least, lifetime_s)
    return walk(samples, ["task_id"], ["at_s", "event_id"], ["at_s", "event_id", "status", "progress"], "event_id bigint, status string, progress double", step)


def spaced(state, at_s, every_s):
    """State: the moment of the last one let through; another one only ``every_s`` later."""
    return (at_s, True) if state is None or at_s - state >= every_s else (state, False)


def grouped_alerts(alerts: DataFrame, repeat_s: dict[str, int] | None = None) -> DataFrame:
    """Alerts that are sent on: the first of a name and severity, then one after each repeat interval (1 h critical, 4 h else). alerts: alertname, severity, at_s, event_id.

    Of the alerts of one second only the first can be sent, so they are one row
    before the shuffle: what a name holds grows with its time span, not its rows.
    """
    every = F.lit(14400)
    for severity, seconds in (repeat_s or {"critical": 3600}).items():
        every = F.when(F.col("severity") == severity, seconds).otherwise(every)
    seconds = alerts.groupBy("alertname", "severity", "at_s").agg(F.min("event_id").alias("event_id")).withColumn("every_s", every)

    def step(state, at_s, event_id, every_s):
        state, through = spaced(state, at_s, every_s)
        return state, ((event_id, at_s) if through else None)

    return walk(seconds, ["alertname", "severity"], ["at_s"], ["at_s", "event_id", "every_s"], "event_id bigint, at_s bigint", step)


# ---------------------------------------------------------------- calibration

START = (None, 1.0, 0.1, 0)


def tuned(state, actual, predicted, late: float = 1.3, early: float = 0.7):
    """State: (ratio before, estimate factor, penalty, fast ones so far) after a completion.

    The ratio is actual to the prediction without the factor in force. The mean of two
    ratios moves the factor, in tenths from 0.5 to 3, when it is off by more than 0.05.
    A completion without a time or a prediction changes nothing.
    """
    before, factor, penalty, fast = state or START
    if actual is None or not predicted or predicted < 0:
        return before, factor, penalty, fast
    share = actual / predicted
    if actual > 0:
        ratio = actual / (predicted / factor)
        mean = 1.0 if before is None else (before + ratio) / 2
        if abs(mean - 1.0) > 0.05:
            factor = min(3.0, max(0.5, round(mean / 0.1) / 10))
        before = ratio
    if share > late:
        penalty *= 1.2
    elif share < early:
        fast = (fast + 1) % 10
        penalty = penalty if fast else max(0.01, penalty * 0.9)
    return before, factor, penalty, fast


GRID = np.arange(5, 31) / 10  # all values of the factor


def _tuned_all(before: np.ndarray, factor: np.ndarray, actual: float, predicted: float) -> tuple[np.ndarray, np.ndarray]:
    """Ratio and factor after a completion, for many states at once; see ``tuned``."""
    ratio = actual / (predicted / factor)
    mean = (before + ratio) / 2
    return ratio, np.where(np.abs(mean - 1.0) > 0.05, np.minimum(3.0, np.maximum(0.5, np.rint(mean / 0.1) / 10)), factor)


def _calibration_map(size: int, late: float = 1.3, early: float = 0.7):
    """A chunk's map. The ratio before a completion follows from the factor before it, so that after the first completion the state is one of all pairs of factors; the penalty is scaled and has a floor, by how many fast ones came before."""

    def summarise(columns):
        a, p, recent = (c.to_numpy(zero_copy_only=False).astype(float) for c in columns[1:4])
        valid = np.flatnonzero(~np.isnan(a) & (p > 0))
        moves = valid[a[valid] > 0]
        pairs = len(GRID) ** 2
        before, factor, where = np.full(pairs, np.nan), np.repeat(GRID, len(GRID)), np.arange(pairs)
        then = np.tile(GRID, len(GRID))
        if len(moves):
            # the pair: the factor in force at the first completion, and the one after it
            before, factor = a[moves[0]] / (p[moves[0]] / factor), then
        for k, i in enumerate(moves[1:]):
            before, factor = _tuned_all(before, factor, a[i], p[i])
            if k % 16 == 0 and len(factor) > 1:
                _, first, again = np.unique(np.stack([before, factor]), axis=1, return_index=True, return_inverse=True)
                before, factor, where = before[first], factor[first], again.ravel()[where]
        share = a[valid] / p[valid]
        scale, floor, fast = np.ones(10), np.zeros(10), np.arange(10)
        for x in share:
            if x > late:
                scale, floor = scale * 1.2, floor * 1.2
            elif x < early:
                fast = (fast + 1) % 10
                tenth = fast == 0
                scale, floor = np.where(tenth, scale * 0.9, scale), np.where(tenth, np.maximum(0.01, floor * 0.9), floor)
        head = (float(a[moves[0]]), float(p[moves[0]])) if len(moves) else (None, None)
        tail = [None if np.isnan(x) else float(x) for x in recent[-size:]]
        return (*head, before[where].tolist() if len(moves) else [], factor[where].tolist() if len(moves) else [], scale.tolist(), floor.tolist(), int(np.sum(share < early)), tail)

    return summarise


def calibrate(done: DataFrame, size: int = 50, least: int = 3, default: float = 0.3, split: bool = True) -> DataFrame:
    """After each completion: 90th percentile of the last ``size`` ratios of work to audio time, deviation from the prediction, penalty and estimate factor. done: server_id, work_kind, ts_us, event_id, audio_sec, actual_cs, predicted_cs.

    ``split``: a busy server's log is many chunks (``segmented``); penalties are then
    those of one walk up to rounding. Else each server and kind is one walk.
    """
    actual, predicted = F.col("actual_cs") / 100, F.col("predicted_cs") / 100
    ratio = F.when(F.col("audio_sec") > 0, actual / F.col("audio_sec")).otherwise(F.lit(default))
    rows = done.select("server_id", "work_kind", "ts_us", "event_id", actual.alias("a"), predicted.alias("p"), ratio.alias("r"))

    def step(state, event_id, a, p, r):
        *tune, seen = state or (*START, [])
        seen = [*(seen or []), r][-size:]
        tune = tuned(tune, a, p)
        known = sorted(x for x in seen if x is not None)
        p90 = known[(len(known) * 9 + 9) // 10 - 1] if len(known) >= least else default
        return (*tune, seen), (event_id, p90, a / p if a is not None and p is not None and p > 0 else None, tune[2], tune[1])

    keys, order, values, schema = ["server_id", "work_kind"], ["ts_us", "event_id"], ["event_id", "a", "p", "r"], "event_id bigint, p90 double, deviation double, penalty double, factor double"
    if not split:
        return walk(rows, keys, order, values, schema, step)

    def enter(state, a, p, before, factor, scale, floor, n_fast, tail):
        ratio, now, penalty, fast, seen = state or (*START, [])
        if a is not None:
            first = tuned((ratio, now, penalty, fast), a, p)
            at = (round(now * 10) - 5) * len(GRID) + round(first[1] * 10) - 5
            ratio, now = before[at], factor[at]
        return ratio, now, max(scale[fast] * penalty, floor[fast]), (fast + n_fast) % 10, [*seen, *tail][-size:]

    summary = "a double, p double, before array<double>, factor array<double>, scale array<double>, floor array<double>, n_fast bigint, tail array<double>"
    return segmented(rows, keys, order, values, schema, step, summary, _calibration_map(size), "before double, factor double, penalty double, fast bigint, seen array<double>", enter)


# -------------------------------------------------------------------- breaker


def breaker_moves(failures: int, probes: int) -> list[tuple[str, int, int]]:
    """The breaker as a table: state, next row after a success, next row after a failure. Rows: closed with 0, 1, ... failures in a row; open; half open with 1, 2, ... good probes."""
    open_, half = failures, failures + 1
    closed = [("CLOSED", 0, i + 1) for i in range(failures)]
    good = [("HALF_OPEN", half + i, open_) for i in range(1, probes)]
    moves = [*closed, ("OPEN", half, open_), *good]
    return [(name, ok if ok < len(moves) else 0, failed) for name, ok, failed in moves]


def moved(state, at_s, ok, moves, timeout_s):
    """State: (row, moment of the last failure); and whether the call is let through. An open breaker refuses for ``timeout_s`` after that failure. A call without an outcome has failed."""
    row, failed_s = state or (0, None)
    if moves[row][0] == "OPEN" and at_s - failed_s < timeout_s:
        return (row, failed_s), False
    return ((moves[row][1], failed_s) if ok else (moves[row][2], at_s)), True


def _breaker_map(moves, timeout_s: float):
    """A chunk's map: the state after it for every place that it may be entered in; and for an open breaker, by the moment from which it lets calls through.

    Worked out backwards: from a call the rest of the chunk goes on as from the call
    after it, or, if the breaker opens there, from the first call after the timeout.
    """
    opened = next(i for i, m in enumerate(moves) if m[0] == "OPEN")

    def summarise(columns):
        at, ok = columns[0].to_pylist(), columns[2].to_pylist()
        after: list = [(place, None) for place in range(len(moves))]  # from the next call on
        probe: list = [None] * len(at)  # an open breaker that lets this call through
        for i in range(len(at) - 1, -1, -1):
            q = bisect_left(at, at[i] + timeout_s, i + 1)
            failing = probe[q] if q < len(at) else (opened, at[i])
            now = []
            for place, (_, good, bad) in enumerate(moves):
                to = good if ok[i] else bad
                now.append(failing if to == opened else after[to])
            probe[i] = now[opened]
            after = now
        waits: list = []
        for t, state in zip(at, probe):
            if waits and waits[-1]["place"] == state[0] and waits[-1]["failed_s"] == state[1]:
                waits[-1]["until_s"] = t
            else:
                waits.append({"until_s": t, "place": state[0], "failed_s": state[1]})
        return [{"place": a, "failed_s": b} for a, b in after], waits

    return summarise


def breaker(calls: DataFrame, failures: int = 5, timeout_s: float = 60, probes: int = 3, split: bool = True) -> DataFrame:
    """Time line of each server's breaker: whether a call is let through, and the state after it. calls: server_id, at_s, event_id, ok. ``split``: a busy server's log is many chunks (``segmented``); else each server is one walk. A call without a moment can't be placed by ``split``."""
    moves = breaker_moves(failures, probes)

    def step(state, at_s, event_id, ok):
        state, through = moved(state, at_s, ok, moves, timeout_s)
        return state, (event_id, through, moves[state[0]][0])

    keys, order, values, schema = ["server_id"], ["at_s", "event_id"], ["at_s", "event_id", "ok"], "event_id bigint, let_through boolean, state string"
    if not split:
        return walk(calls, keys, order, values, schema, step)

    def enter(state, places, waits):
        its = state or (0, None)
        if moves[its[0]][0] != "OPEN":
            to = places[its[0]]
        else:
            q = bisect_left(waits, its[1] + timeout_s, key=lambda w: w["until_s"])
            to = waits[q] if q < len(waits) else {"place": its[0], "failed_s": its[1]}
        return to["place"], to["failed_s"]

    summary = "places array<struct<place:bigint;failed_s:bigint>>, waits array<struct<until_s:bigint;place:bigint;failed_s:bigint>>"
    return segmented(calls, keys, order, values, schema, step, summary, _breaker_map(moves, timeout_s), "place bigint, failed_s bigint", enter)


# ------------------------------------------------------------- segment plans


def best_cut(pos: Column, silences: Column, target: int, step: int, rounds: int, primary: int, fallback: int, longest: int, shortest: int) -> Column:
    """Where to cut after ``pos``: the middle of the silence that comes first by search round, then length, then start.

    Rounds go outwards from the target in rings of ``step``, each ring first after
    and then before it, so a middle's round is twice its ring, and one more before
    the target. A silence of ``primary`` or more counts in its round; any of
    ``fallback`` or more counts in a last round, from the earliest ring to the hard
    limit. Without one the cut is at the hard limit.
    """
    aim, hard = pos + target, pos + longest

    def placed(s: Column) -> Column:
        middle, length = F.floor((s["start_ms"] + s["end_ms"]) / 2), s["end_ms"] - s["start_ms"]
        off = middle - aim
        turn = F.greatest(F.ceil(F.abs(off) / step) - 1, F.lit(0)) * 2 + F.when(off < 0, 1).otherwise(0)
        inside = middle.between(pos + shortest, hard)
        turn = F.when(inside & (length >= primary) & (turn < rounds), turn).when(inside & (length >= fallback) & (off >= -step * (rounds // 2)), F.lit(rounds))
        return F.struct(turn.cast("long").alias("turn"), (-length).alias("length"), s["start_ms"].alias("start_ms"), middle.alias("middle"))

    first = F.array_min(F.filter(F.transform(silences, placed), lambda x: x["turn"].isNotNull()))
    return F.coalesce(first["middle"], hard)


def plan_segments(files: DataFrame, silences: DataFrame, target: int = 600_000, shortest: int = 120_000, longest: int = 720_000, overlap: int = 400, step: int = 60_000, rounds: int = 3, fallback: int = 300, primary: int = 800) -> DataFrame:
    """Segment plan of every file; a tail shorter than ``shortest`` stays with the segment before. files: file_id, total_ms; silences: file_id, start_ms, end_ms (open ones end at -1, and are no place to cut).

    A file's silences are bounded by its length and are gathered in one row.
    """
    quiet = silences.where(F.col("end_ms") - F.col("start_ms") >= fallback).groupBy("file_id").agg(F.collect_list(F.struct("start_ms", "end_ms")).alias("quiet"))
    rows = files.join(quiet, "file_id", "left").select("file_id", F.col("total_ms").cast("long").alias("total"), F.coalesce("quiet", F.array().cast("array<struct<start_ms:bigint,end_ms:bigint>>")).alias("quiet"))
    least = max(shortest, target - step * (rounds // 2), 1)  # every cut is at least so far from the one before
    begin = F.struct(F.lit(0).cast("long").alias("pos"), F.array(F.lit(0).cast("long")).alias("cuts"))

    def further(done: Column, _: Column) -> Column:
        at = F.transform(F.array(best_cut(done["pos"], F.col("quiet"), target, step, rounds, primary, fallback, longest, shortest)), lambda c: F.when(F.col("total") - c < shortest, F.struct(F.col("total").alias("pos"), done["cuts"].alias("cuts"))).otherwise(F.struct(c.alias("pos"), F.concat(done["cuts"], F.array(c)).alias("cuts"))))[0]
        return F.when(F.col("total") - done["pos"] > longest, at).otherwise(done)

    cuts = F.aggregate(F.sequence(F.lit(0).cast("long"), F.greatest(F.floor(F.col("total") / least), F.lit(0).cast("long"))), begin, further, lambda done: done["cuts"])
    rows = rows.select("file_id", "total", cuts.alias("cuts")).select("file_id", "total", "cuts", F.posexplode("cuts")).select("file_id", "total", F.col("pos").cast("long").alias("segment_index"), F.col("col").alias("keep_start_ms"), F.get("cuts", F.col("pos") + 1).alias("next"))
    return rows.select(
        "file_id",
        "segment_index",
        F.greatest(F.col("keep_start_ms") - F.when(F.col("segment_index") > 0, overlap).otherwise(0), F.lit(0)).cast("long").alias("source_start_ms"),
        F.least(F.coalesce(F.col("next") + overlap, "total"), "total").cast("long").alias("source_end_ms"),
        "keep_start_ms",
        F.coalesce("next", "total").alias("keep_end_ms"),
    )
