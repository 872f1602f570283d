"""Streams against their batch twins: typed state, restarts, the end of the input, and a sink that merges once."""

import json

import pytest
from pyspark.sql import functions as F

from voxmill.operators import jobs, replay
from voxmill.streaming import streams

BIG = 2**60 + 1  # no double holds it


class Input:
    """A folder of files that come one after the other."""

    def __init__(self, spark, name: str, schema: str):
        self.spark, self.schema, self.to = spark, schema, streams.folder(spark, f"test-{name}")
        self.rows = []
        spark.createDataFrame([], schema).write.parquet(self.to)

    def put(self, rows: list[tuple]) -> None:
        self.rows += rows
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(self.to)

    def stream(self):
        # not from 1970 on, where the first watermark stands
        return self.spark.readStream.schema(self.schema).parquet(self.to).withColumn("ts", F.timestamp_seconds(F.col("at_s") + 10))

    def table(self):
        return self.spark.createDataFrame(self.rows, self.schema)


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def test_progress_is_exact_and_goes_on_after_a_restart(spark):
    samples = Input(spark, "samples", "task_id long, at_s long, event_id long, status string, progress double")
    to = streams.folder(spark, "t01")
    run = lambda: streams.drain(streams.progress_changes(samples.stream()), "t01", to)
    samples.put([(BIG, 10, BIG + 1, "QUEUED", None), (BIG, 11, BIG + 3, "QUEUED", 0.5), (None, 12, BIG, "QUEUED", 0.1), (BIG, 20, BIG + 5, None, 0.5)])
    run()
    samples.put([(BIG, 30, BIG + 7, "SUCCEEDED", 1.0), (BIG, 31, BIG + 9, "QUEUED", 0.0), (None, 32, None, "QUEUED", 0.105)])
    columns = ["task_id", "event_id", "status", "progress"]
    assert rows(run(), *columns) == rows(replay.emitted_changes(samples.table(), lifetime_s=3600), *columns)
    assert {r.event_id for r in run().collect()} >= {BIG + 1, BIG + 7}


def test_breaker_keeps_its_state_over_a_restart(spark):
    calls = Input(spark, "calls", "server_id long, at_s long, event_id long, ok boolean")
    to = streams.folder(spark, "t06")
    run = lambda: streams.drain(streams.breaker(calls.stream(), failures=2), "t06", to)
    calls.put([(1, 0, BIG, False), (1, 1, BIG + 1, None), (2, 5, 1, True), (1, 10, BIG + 2, True)])
    run()
    calls.put([(1, 70, BIG + 3, True), (1, 71, BIG + 4, True), (1, 72, BIG + 5, True), (2, 73, 2, False), (3, 500, 9, True)])
    columns = ["server_id", "event_id", "let_through", "state"]
    got = run()
    assert rows(got.where("event_id is not null"), *columns) == rows(replay.breaker(calls.table(), failures=2), *columns)
    # the open breaker was told half open when its time was over
    assert rows(got.where("event_id is null"), "server_id", "state") in ([], [(1, "HALF_OPEN")])


def test_calibration_equals_its_twin(spark):
    done = Input(spark, "done", "server_id long, work_kind string, at_s long, ts_us long, event_id long, audio_sec long, actual_cs long, predicted_cs long")
    to = streams.folder(spark, "t05")
    made = [(i % 2, "task", i, i, BIG + i, (i * 7) % 40 - 2, 100 + (i * 37) % 900, 50 + (i * 53) % 700) for i in range(150)]
    odd = [(0, None, 1, 1, 1, None, None, None), (0, None, 2, 2, 2, 10, 500, None), (0, None, 3, 3, 3, 10, None, 500), (0, None, 4, 4, 4, 10, 500, 0), (None, "task", 5, 5, 5, 10, 100, 100)]
    run = lambda: streams.drain(streams.calibration(done.stream()), "t05", to)
    done.put(made[:70] + odd)
    run()
    done.put(made[70:])
    columns = ["server_id", "work_kind", "event_id", "p90", "deviation", "penalty", "factor"]
    assert rows(run(), *columns) == rows(replay.calibrate(done.table()), *columns)


def test_rolling_p90_with_a_null_value(spark):
    done = Input(spark, "p90", "server_id long, work_kind string, at_s long, ts_us long, event_id long, value long")
    done.put([(1, "a", i, i, i, None if i == 2 else i * 10) for i in range(6)])
    assert rows(streams.drain(streams.rolling_p90(done.stream()), "p90"), "event_id", "p90") == [(0, None), (1, None), (2, None), (3, 30), (4, 40), (5, 50)]


def test_sessions_at_the_end_of_the_input_come_out(spark):
    events = Input(spark, "sessions", "server_id long, at_s long")
    events.put([(1, 0), (1, 100), (1, 900), (2, 950)])
    events.put([(1, 1000), (None, 1001)])
    got = streams.drain_to_end(events.stream().select("server_id", "ts"), streams.activity_sessions, "t08", 3600)
    assert rows(got, "server_id", "start_s", "n") == sorted([(1, 10, 2), (1, 910, 2), (2, 960, 1), (None, 1011, 1)], key=repr)
    none = Input(spark, "nothing", "server_id long, at_s long")
    assert streams.drain_to_end(none.stream().select("server_id", "ts"), streams.activity_sessions, "t08n", 3600).count() == 0


@pytest.fixture(scope="module")
def parts(spark):
    doc = lambda t: json.dumps({"text": t})
    made = [(task, i, i * 1000, i * 1000, (i + 1) * 1000, doc(f"{task}-{i} ")) for task in (1, 2, 3, BIG) for i in range(2)]
    return spark.createDataFrame(made, "task_id long, segment_index long, source_start_ms long, keep_start_ms long, keep_end_ms long, raw_result_json string")


def test_merged_once(spark, parts, monkeypatch):
    ends = Input(spark, "ends", "task_id long, at_s long, segment_index long, n_segments long, status string, event_id long")
    to = streams.folder(spark, "t09m")

    def run(dies: bool = False):
        if dies:
            real = streams.start

            def failing(stream, to, mode="append", sink=None):
                def then_die(batch, number):
                    sink(batch, number)
                    raise RuntimeError("lost after the write")

                return real(stream, to, mode, then_die)

            monkeypatch.setattr(streams, "start", failing)
        query = streams.merged_once(streams.completed_tasks(ends.stream()), parts, to)
        monkeypatch.undo()
        if dies:
            with pytest.raises(Exception, match="lost after the write"):
                query.awaitTermination()
        else:
            query.awaitTermination()
        return spark.read.parquet(f"{to}/out")

    ok, bad = "SUCCEEDED", "FAILED"
    ends.put([(1, 1, 0, 2, ok, 1), (1, 2, 1, 2, ok, 2), (2, 1, 0, 2, ok, 3), (2, 2, 1, 2, bad, 4), (BIG, 3, 0, 2, ok, 5)])
    assert run(dies=True).count() == 1  # written, not committed
    assert run().count() == 1  # replayed onto itself
    week = 604_800
    ends.put([(BIG, 9, 1, 2, ok, 6), (1, 3 * week, 0, 2, ok, 7), (1, 3 * week + 1, 1, 2, ok, 8)])  # task 1 runs again
    got = run()
    want = jobs.merge_segments(parts.where(F.col("task_id").isin(1, BIG)))
    columns = ["task_id", "text", "sentences", "mode", "status"]
    assert rows(got, *columns) == rows(want, *columns) and got.count() == 2
    assert run().count() == 2  # nothing new
