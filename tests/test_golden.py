"""Golden cases: inputs and results typed in as values."""

import hmac
import json
import random

import pytest
from pyspark.sql import Window as W, functions as F

from voxmill.functions import network, scalars as fn, signatures as sig, transcripts as tr, vectorised as vec
from voxmill.operators import aggregates, jobs, joins, replay, windows
from voxmill.plans.domain import Domain
from voxmill.sources import files as src, tables
from voxmill.streaming import streams


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'long' if isinstance(v, int) else 'string'}" for k, v in values.items())).select(column).head()[0]


def rows_of(spark, raw):
    return [tuple(u) for u in one(spark, tr.utterances(F.col("raw")), raw=json.dumps(raw))]


def test_utterance_shapes(spark):
    assert rows_of(spark, {"stamp_sents": [{"text_seg": "你 好", "punc": "，", "ts": [0, 500]}, {"text_seg": "hello world", "punc": ".", "start": 600, "end": 900}, {"text_seg": "x", "ts_list": [[1, 2], [3, 4]]}, {"text_seg": "lost", "start": 5}, 7]}) == [(0, 500, "你好，"), (600, 900, "hello world."), (1, 4, "x")]
    assert rows_of(spark, {"timestamp": [[0, 1], [1, 2], [2, 3]], "text": "ab"}) == [(0, 1, "a"), (1, 2, "b"), (2, 3, "")]
    assert rows_of(spark, {"text": "plain"}) == [(0, 0, "plain")] and rows_of(spark, {"text": ""}) == []


def segment(index, source, low, high, raw):
    return (1, index, source, low, high, json.dumps(raw))


def sentence(text, a, b):
    return {"text_seg": text, "punc": "", "ts": [a, b]}


def test_merge(spark):
    schema = "task_id long, segment_index long, source_start_ms long, keep_start_ms long, keep_end_ms long, raw_result_json string"
    merged = lambda *s: jobs.merge_segments(spark.createDataFrame(list(s), schema)).head()
    r = merged(segment(1, 619600, 620000, 1241000, {"stamp_sents": [sentence("drop", 0, 300), sentence("第二段。", 400, 900)], "mode": "x"}), segment(0, 0, 0, 620000, {"stamp_sents": [sentence("第一段。", 100, 500), sentence("late", 620000, 620100)]}))
    assert r.text == "第一段。第二段。" and [tuple(s) for s in r.sentences] == [(100, 500, "第一段。"), (620000, 620500, "第二段。")] and r.mode == "x" and r.status == "OK"
    r = merged(segment(0, 0, 0, 1000, {"text": "only text"}), segment(1, 0, 1000, 2000, {"stamp_sents": [sentence("gone", 1, 2)]}))
    assert r.text == "only text" and r.status == "TEXT_ONLY_FALLBACK" and r.sentences == []


def test_times_and_names(spark):
    assert [one(spark, fn.srt_time(F.col("ms")), ms=x) for x in (0, 3_723_004, 360_000_000)] == ["00:00:00,000", "01:02:03,004", "100:00:00,000"]
    assert [one(spark, fn.safe_name(F.col("n")), n=x) for x in ("../../etc/passwd", "a/.hidden", "/", "会议.mp4")] == ["passwd", "hidden", "unnamed", "会议.mp4"]
    assert [one(spark, fn.human_size(F.col("n")), n=x) for x in (5, 1536, 5 * 1024**3)] == ["5 B", "1.50 KB", "5.00 GB"]
    assert [one(spark, fn.human_size(F.col("n"), 1, ("B", "KB", "MB", "GB")), n=x) for x in (1023, 1024 * 1024)] == ["1023 B", "1.0 MB"]
    assert one(spark, fn.canonical_json(F.col("j")), j='{"b": 1, "a": "x"}') == '{"a":"x","b":"1"}'


def test_addresses(spark):
    bad = ["127.0.0.1", "10.1.2.3", "172.31.255.255", "192.168.0.9", "169.254.1.1", "localhost", "a.LOCALHOST", "db.corp.", "::1", "fd00::1", "fe80::2", "0.0.0.0"]
    good = ["8.8.8.8", "100.64.0.1", "172.32.0.1", "example.com", "999.1.1.1", "2001:db8::1"]
    got = spark.createDataFrame([(h,) for h in bad + good], "h string").select("h", network.is_private(F.col("h")).alias("p")).collect()
    assert {r.h for r in got if r.p} == set(bad)
    urls = {"http://127.0.0.1/x": "private", "ftp://a.com": "scheme", "https://u:p@10.0.0.1:80/": "private", "https://ok.com/": None, "http://": "host"}
    got = spark.createDataFrame([(u,) for u in urls], "u string").select("u", network.callback_problem(F.col("u")).alias("p")).collect()
    assert {r.u: r.p for r in got} == urls


def test_ipv6_in_all_spellings(spark):
    import ipaddress

    hosts = {
        "0:0:0:0:0:0:0:1": True, "::1": True, "[::1]": True, "0000:0000::0001": True, "::": True, "0::0": True, "::ffff:7f00:1": True, "::ffff:127.0.0.1": True, "::FFFF:127.255.3.9": True, "0:0:0:0:0:ffff:7f12:3": True,
        "fc00::": True, "fdff:ffff::1": True, "[fd12:3456::1]": True, "fe80::1": True, "febf::1": True, "fe80::1%eth0": True,
        "::2": False, "::ffff:8.8.8.8": False, "::ffff:10.0.0.1": False, "fec0::1": False, "fe00::1": False, "2001:db8::1": False, "1:2:3:4:5:6:7:8": False, "1:2:3:4:5:6:127.0.0.1": False, "::1:2:3:4:5:6:7": False,
    }
    wrong = ["1:2:3", "1::2::3", "12345::1", "::g", ":1", "1:2:3:4:5:6:7:8:9", "1:2:3:4:5:6:7::8:9", "::127.0.0.1:1", "::1.2.3", "::256.1.1.1", "", ":", ":::", "a:b"]
    rows = spark.createDataFrame([(h,) for h in [*hosts, *wrong]] + [(None,)], "h string").select("h", network.is_private(F.col("h")).alias("p"), network.ipv6_halves(F.col("h")).alias("x")).collect()
    for r in rows:
        if r.h in hosts:
            at = int(ipaddress.ip_address(r.h.strip("[]").split("%")[0]))
            assert (r.x.high % 2**64, r.x.low % 2**64) == (at >> 64, at & 2**64 - 1), r
        else:
            assert r.x is None, r
        assert r.p == hosts.get(r.h, False), r
    urls = {"http://[::ffff:7f00:1]:80/x": "private", "https://[2001:db8::1]/": None, "http://u@[0:0:0:0:0:0:0:1]/": "private"}
    got = spark.createDataFrame([(u,) for u in urls], "u string").select("u", network.callback_problem(F.col("u")).alias("p")).collect()
    assert {r.u: r.p for r in got} == urls


@pytest.mark.parametrize(
    "silences, cut",
    [
        ([(619_000, 621_000)], 620_000),
        ([(699_000, 701_000)], 700_000),
        ([(559_000, 561_000)], 560_000),
        ([(610_000, 610_500), (630_000, 633_000), (650_000, 651_000)], 631_500),
        ([(620_000, 620_500)], 620_250),
        ([(700_000, 700_400)], 700_200),
        ([(650_000, -1)], 720_000),
        ([], 720_000),
    ],
)
def test_cut_search(spark, silences, cut):
    assert first_cut(spark, silences) == cut


def first_cut(spark, silences, **how):
    quiet = spark.createDataFrame([(1, *s) for s in silences], "file_id long, start_ms long, end_ms long")
    plan = replay.plan_segments(spark.createDataFrame([(1, 2_000_000)], "file_id long, total_ms long"), quiet, **{"shortest": 1000} | how)
    return plan.where("segment_index = 0").head().keep_end_ms


def test_cut_floor(spark):
    assert first_cut(spark, [(530_000, 532_000)], shortest=550_000) == 720_000


def plain_cut(pos, silences, target=600_000, step=60_000, rounds=3, primary=800, fallback=300, longest=720_000, shortest=120_000):
    """Rounds told as they are: rings by turns after and before the target, longest silence first."""
    ways = [(pos + target + (i // 2) * step, pos + target + (i // 2 + 1) * step, primary) if i % 2 == 0 else (pos + target - (i // 2 + 1) * step, pos + target - (i // 2) * step, primary) for i in range(rounds)]
    for low, high, least in [*ways, (pos + target - (rounds // 2) * step, pos + longest, fallback)]:
        fit = [(a - b, a, (a + b) // 2) for a, b in silences if max(low, pos + shortest) <= (a + b) // 2 <= min(high, pos + longest) and b - a >= least]
        if fit:
            return min(fit)[2]
    return pos + longest


def test_plans_against_a_plain_loop(spark):
    rng = random.Random(3)
    files = [(i, rng.randrange(0, 7_000_000)) for i in range(80)] + [(80, 0), (81, 720_000), (82, 720_001)]
    silences = [(i, a, a + rng.choice((100, 350, 700, 900, 900, 2000))) for i, total in files for a in (rng.randrange(0, total + 1) for _ in range(rng.choice((0, 5, 40, 150))))]
    want = set()
    for i, total in files:
        quiet, pos, cuts = sorted((a, b) for f, a, b in silences if f == i), 0, [0]
        while total - pos > 720_000 and total - (pos := plain_cut(pos, quiet)) >= 120_000:
            cuts.append(pos)
        want |= {(i, k, a, b) for k, (a, b) in enumerate(zip(cuts, [*cuts[1:], total]))}
    plan = replay.plan_segments(spark.createDataFrame(files, "file_id long, total_ms long"), spark.createDataFrame(silences, "file_id long, start_ms long, end_ms long"))
    assert {(r.file_id, r.segment_index, r.keep_start_ms, r.keep_end_ms) for r in plan.collect()} == want


def test_plans_tile(spark):
    rng = random.Random(1)
    files = [(i, rng.randrange(1, 6_000_000)) for i in range(60)]
    silences = [(i, a, a + rng.randrange(100, 3000)) for i, total in files for a in sorted(rng.randrange(0, total + 1) for _ in range(rng.randrange(0, 60)))]
    plan = replay.plan_segments(spark.createDataFrame(files, "file_id long, total_ms long"), spark.createDataFrame(silences, "file_id long, start_ms long, end_ms long"))
    total = spark.createDataFrame(files, "file_id long, t long")
    assert jobs.plan_violations(plan.join(total, "file_id"), F.col("t")).count() == 0
    assert {r.file_id for r in plan.collect()} == {i for i, _ in files}
    sizes = plan.select((F.col("keep_end_ms") - F.col("keep_start_ms")).alias("n"), F.lead("segment_index").over(W.partitionBy("file_id").orderBy("segment_index")).alias("nxt")).collect()
    assert all(120_000 <= r.n <= 720_000 for r in sizes if r.nxt is not None)


def test_quotas(spark):
    shares = lambda n, speeds: {r.server_id: r.quota for r in jobs.quotas(spark.createDataFrame([(1, n)], "batch long, n long"), spark.createDataFrame(list(speeds.items()), "server_id string, speed double")).collect()}
    assert shares(10, {"a": 4.0, "b": 1.0}) == {"a": 8, "b": 2}
    assert shares(10, {"a": 1.0, "b": 1.0, "c": 1.0}) == {"a": 4, "b": 3, "c": 3}
    assert shares(3, {"a": 1.0, "b": 1.0}) == {"a": 1, "b": 2}
    for n in (1, 2, 7, 29):
        assert sum(shares(n, {"a": 3.0, "b": 2.9, "c": 0.1, "d": 2.9}).values()) == n


def calibrated(spark, rows, server=1):
    done = spark.createDataFrame([(server, "task", i, i, 100, a * 100, p and p * 100) for i, (a, p) in enumerate(rows)], "server_id long, work_kind string, ts_us long, event_id long, audio_sec long, actual_cs long, predicted_cs long")
    return replay.calibrate(done).orderBy("event_id").collect()


def test_calibration(spark):
    out = calibrated(spark, [(30, None), (10, None), (20, None)])
    assert [r.p90 for r in out] == [0.3, 0.3, 0.3] and out[2].deviation is None and out[2].penalty == 0.1
    out = calibrated(spark, [(20, 10), (20, 10)])
    assert [r.factor for r in out] == [1.0, 2.0] and out[1].penalty == pytest.approx(0.1 * 1.2 * 1.2)
    assert calibrated(spark, [(5, 20)] * 10)[-1].penalty == pytest.approx(0.09)


def timeline(spark, calls, **how):
    rows = spark.createDataFrame([(server, at, i, ok) for i, (server, at, ok) in enumerate(calls)], "server_id long, at_s long, event_id long, ok boolean")
    return [(r.let_through, r.state) for r in replay.breaker(rows, **how).orderBy("event_id").collect()]


def test_breaker(spark):
    failed = [(1, i, False) for i in range(5)]
    got = timeline(spark, [*failed, (1, 30, True), *((1, 64 + i, True) for i in range(3))])
    assert [s for _, s in got] == ["CLOSED"] * 4 + ["OPEN"] * 2 + ["HALF_OPEN", "HALF_OPEN", "CLOSED"] and [t for t, _ in got] == [True] * 5 + [False] + [True] * 3
    assert timeline(spark, [*failed, (1, 64, True), (1, 65, False), (1, 66, True)])[-3:] == [(True, "HALF_OPEN"), (True, "OPEN"), (False, "OPEN")]
    assert timeline(spark, [(1, 0, False), (1, 60, True)], failures=1, probes=1) == [(True, "OPEN"), (True, "CLOSED")]


def test_null_and_large_keys(spark):
    big = 9007199254740993
    rows = spark.createDataFrame([(k, i, i, False) for i in range(4) for k in (None, big)], "server_id long, at_s long, event_id long, ok boolean")
    got = replay.breaker(rows, failures=2).collect()
    assert {r.server_id for r in got} == {None, big}
    for key in (None, big):
        assert [r.state for r in sorted(got, key=lambda r: r.event_id) if r.server_id == key] == ["CLOSED", "OPEN", "OPEN", "OPEN"]


def test_alert_grouping(spark):
    rng = random.Random(5)
    alerts = [(rng.choice(("a", "b", None)), rng.choice(("critical", "warning", None)), rng.randrange(100_000), i) for i in range(400)]
    last, want = {}, set()
    for name, severity, at, i in sorted(alerts, key=lambda x: (x[2], x[3])):
        if (name, severity) not in last or at - last[name, severity] >= (3600 if severity == "critical" else 14400):
            last[name, severity] = at
            want.add(i)
    got = replay.grouped_alerts(spark.createDataFrame(alerts, "alertname string, severity string, at_s long, event_id long"))
    assert {r.event_id for r in got.collect()} == want


def test_batch_statistics(spark):
    tasks = spark.createDataFrame([(1, 7, "SUCCEEDED", 0, 100, 1), (2, 7, "FAILED", None, None, None)], "task_id long, task_group_id long, status string, started_s long, completed_s long, assigned_server_id long")
    servers = spark.createDataFrame([(1, 1, "ONLINE", True), (2, 1, "ONLINE", True)], "server_id long, max_concurrency long, status string, enabled boolean")
    none = spark.createDataFrame([], "segment_id long, task_id long, started_s long, completed_s long, assigned_server_id long")
    assert aggregates.idle_slots(tasks, none, servers).head().idle_slot_seconds == 100
    assert aggregates.idle_slots(tasks, none, servers.limit(0)).head().idle_slot_seconds is None
    steal = [(1, json.dumps({"event_type": "work_steal", "estimated_gain_sec": 12.5, "est_stolen_sec": 9})), (1, json.dumps({"event_type": "work_steal", "estimated_gain_sec": 7.5, "est_stolen_sec": 5})), (1, '{"event_type": "work_steal"'), (1, json.dumps({"event_type": "other", "note": "work_steal"}))]
    r = aggregates.steals(spark.createDataFrame(steal, "task_id long, payload_json string")).head()
    assert (r.steals, r.gain, r.stolen) == (2, 20.0, 14.0)
    left = joins.inhibited(spark.createDataFrame([("a", "critical"), ("a", "warning"), ("b", "warning")], "alertname string, severity string")).collect()
    assert {(r.alertname, r.severity) for r in left} == {("a", "critical"), ("b", "warning")}


def test_similarity_and_signatures(spark):
    pairs = spark.createDataFrame([("a b c", "abd"), ("", ""), ("x" * 30, "x" * 15 + "y" * 15)], "a string, b string")
    got = [round(r.similarity, 4) for r in vec.similarity(pairs, "a", "b", 20).collect()]
    assert sorted(got) == [0.5, 0.6667, 1.0]
    signed = sig.signed(pairs.limit(1), F.lit("{}"), F.lit("key")).head()
    assert signed.signature == "sha256=" + hmac.new(b"key", b"{}", "sha256").hexdigest()
    keys = spark.createDataFrame([(k,) for k in ("", "schlüssel", "x" * 64, "y" * 65, "z" * 200, None)], "k string")
    for r in keys.select("k", sig.hmac_sha256(F.col("k"), F.lit("täxt")).alias("h")).collect():
        assert r.h == (None if r.k is None else hmac.new(r.k.encode(), "täxt".encode(), "sha256").hexdigest())


def test_sources(spark, tmp_path):
    media = tmp_path / "media" / "sub"
    media.mkdir(parents=True)
    for name in ("a.WAV", "b.mp3", "c.txt", "d.mp4"):
        (media / name).write_bytes(b"123")
    inv = src.media_inventory(spark, [str(tmp_path / "media")], 2).collect()
    assert sorted((r.path.rsplit("/", 1)[1], r.size_bytes, r.chunk) for r in inv) == [("a.WAV", 3, 0), ("b.mp3", 3, 0), ("d.mp4", 3, 1)]
    res = spark.createDataFrame([("abcd1", "json", "{}"), ("abcd1", "txt", "hi"), ("wxyz2", "txt", "yo")], "task_id string, fmt string, content string")
    src.write_results(res, str(tmp_path / "results"))
    assert {r.content for r in src.read_results(spark, str(tmp_path / "results"), "txt").collect()} == {"hi", "yo"}
    one_file = tmp_path / "raw" / "abcd" / "abcd1"
    one_file.mkdir(parents=True)
    (one_file / "result.srt").write_text("1\nx")
    r = src.read_result_files(spark, str(tmp_path / "raw")).head()
    assert (r.task_id, r.fmt, r.content) == ("abcd1", "srt", "1\nx")
    state = {n: spark.createDataFrame([], s) for n, s in tables.STATE_TABLES.items()}
    for n, df in state.items():
        df.write.parquet(str(tmp_path / "state" / n))
    assert set(tables.load(spark, str(tmp_path / "state"))) == set(state)
    drift = src.schema_drift(spark, {**state, "files": state["files"].drop("mime").withColumn("old", F.lit(1))}, {"files": ["old"]}).collect()
    assert {(r.table, r.problem) for r in drift if r.level == "error"} == {("files", "column missing: mime"), ("files", "legacy column: old")}
    lost = src.schema_drift(spark, {k: v for k, v in state.items() if k != "tasks"}).where("level = 'error'").collect()
    assert [(r.table, r.problem) for r in lost] == [("tasks", "table missing")]


def test_manifests_and_logs(spark, tmp_path):
    good = {"batch_id": "local-20240101-120000", "source": "x", "created_at": "t", "agent_platform": "unknown", "status": "COMPLETED", "config": {"chunk_size": 5}, "progress": {"total": 1}, "timing": {}, "items": [{"file_path": "a", "size_bytes": 1, "status": "SUCCEEDED", "fingerprint": "f"}]}
    bad = {**good, "batch_id": "nope", "status": "DONE", "config": {"chunk_size": 0}, "items": [{"size_bytes": -1}]}
    del bad["source"]
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "1.json").write_text(json.dumps(good))
    (tmp_path / "m" / "2.json").write_text(json.dumps(bad))
    m = src.read_manifests(spark, str(tmp_path / "m"))
    v = src.manifest_violations(m).collect()
    assert {(r.batch_id, r.problem) for r in v} == {("nope", p) for p in ("missing: source", "batch_id", "status", "chunk_size", "item without path", "item size")}
    assert src.latest_manifest_items(m.where("source is not null"), "source").head().fingerprint == "f"
    log = [{"type": "gradient_complete", "server_id": "s", "concurrency": 2, "per_file_rtf": 0.2, "throughput_rtf": 0.1}, {"type": "gradient_error", "server_id": "s", "concurrency": 8, "error": "boom"}, {"type": "benchmark_complete", "server_id": "s", "recommended_concurrency": 2, "gradient_complete": False}]
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "1.ndjson").write_text("\n".join(map(json.dumps, log)))
    e = src.benchmark_events(spark, str(tmp_path / "b"))
    assert e["levels"].head().concurrency == 2 and e["errors"].head().error == "boom" and e["results"].head().gradient_complete is False
    newest = src.newest_benchmark(spark, str(tmp_path / "b"), 4102444800)
    assert newest.count() == 3 and newest.head().age_minutes > 0
    lines = ["silence_end: 1", "silence_start: 2.5", "x", "silence_end: 3.25 | d", "silence_start: 5", "silence_start: 6", "silence_end: 7", "silence_start: 9"]
    got = src.silence_intervals(spark.createDataFrame([(1, i, s) for i, s in enumerate(lines)], "file_id long, line_no long, line string")).orderBy("start_ms").collect()
    assert [(r.start_ms, r.end_ms) for r in got] == [(2500, 3250), (6000, 7000), (9000, -1)]


def test_probes_and_webhooks(spark):
    probe = {"format": {"duration": "12.5", "format_name": "mov,mp4"}, "streams": [{"codec_type": "video", "codec_name": "mjpeg"}, {"codec_type": "audio", "codec_name": "aac", "sample_rate": "44100", "channels": 2}]}
    p = one(spark, src.probe_metadata(F.col("j")), j=json.dumps(probe))
    assert (p.duration_sec, p.media_type, p.codec, p.sample_rate, p.channels, p.mime) == (12.5, "audio", "aac", 44100, 2, "video/mp4")
    a = one(spark, src.webhook_alerts(F.col("j")), j=json.dumps({"status": "firing", "alerts": [{"labels": {"alertname": "n"}}, {"status": "resolved"}]}))
    assert [(x.status, x.alertname, x.severity) for x in a] == [("firing", "n", "unknown"), ("resolved", "unknown", "unknown")]


# --------------------------------------------------------------------- streams


def test_progress_sink(spark):
    import os

    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("no test data")
    d = Domain(spark, data)
    stream = streams.event_stream(spark, f"{data}/events.parquet")
    assert stream.isStreaming
    to = streams.folder(spark, "sink")
    streams.progress_sink(stream.select(F.col("user_id").alias("task_id"), "event_id", F.col("event_type").alias("status"), F.col("value").alias("progress")), f"{to}/out", f"{to}/state").awaitTermination()
    assert spark.read.json(f"{to}/out").where("event_type = 'progress'").count() == d.events.count()


def test_plan_shapes(spark):
    """Filters and columns reach the scan."""
    import os

    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("no test data")
    from voxmill.plans import registry

    plan = registry.QUERIES["q_s01_typed_scan"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(value,100.0)" in plan and "props" not in plan.split("ReadSchema")[1]


def test_entry_imports_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    code = "import __spark_entry__ as e; assert len(e.queries()) > 180 and len(e.oracle_sql()) > 170"
    assert subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[1]).returncode == 0


def test_one_busy_user_is_split_by_spans(spark):
    """Running sums in two levels equal those of one walk, for a single user with nulls beside it."""
    import random

    rng = random.Random(5)
    tasks = []
    for i in range(400):
        at = rng.randrange(0, 500)
        tasks.append((i, 1 if i % 10 else None, at, None if i % 7 == 0 else at + rng.randrange(-40, 300)))
    df = spark.createDataFrame(tasks, "task_id long, user_id long, created_s long, completed_s long")
    want = []
    for user in (1, None):
        steps = sorted([(c, t, 1) for t, u, c, _ in tasks if u == user] + [(d, t, -1) for t, u, _, d in tasks if u == user and d is not None])
        n = 0
        for _, t, step in steps:
            n = max(0, n + step)
            want.append((user, t, step, n))
    for span_s in (1, 37, 10_000):
        assert sorted(map(tuple, windows.running_concurrency(df, span_s).collect()), key=repr) == sorted(want, key=repr)
    work = df.where("completed_s > created_s").select(F.col("user_id").alias("server_id"), F.col("task_id").alias("work_id"), F.col("created_s").alias("started_s"), "completed_s")
    peaks = {}
    for user in (1, None):
        own = [(c, d) for _, u, c, d in tasks if u == user and d is not None and d > c]
        peaks[user] = max(sum(c <= t < d for c, d in own) for t in range(900))
    for span_s in (1, 50, 10_000):
        assert {r.server_id: r.peak for r in windows.occupancy(work, span_s).collect()} == peaks


def test_newest_benchmark_reads_one_file(spark, tmp_path):
    import os

    from voxmill.sources import files

    for i, at in enumerate((1000, 3000, 2000)):
        (tmp_path / f"{i}.jsonl").write_text('{"type": "benchmark_complete", "server_id": "s%d"}\n' % i)
        os.utime(tmp_path / f"{i}.jsonl", (at, at))
    got = files.newest_benchmark(spark, str(tmp_path), 3120)
    assert [(r.server_id, r.file, r.age_minutes) for r in got.collect()] == [("s1", "1.jsonl", 2)]
    assert len(got.inputFiles()) == 1
    (tmp_path / "none").mkdir()
    assert files.newest_benchmark(spark, str(tmp_path / "none"), 0).count() == 0


def test_a_failed_import_of_the_corpus_leaves_the_others(tmp_path):
    import subprocess
    import sys
    from pathlib import Path

    code = "import sys; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert len(q) > 180 and 'q_a05_batch_overview' in q"
    assert subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[1]).returncode == 0
