"""Sources and sinks beside the state tables: folders, results, manifests, benchmark logs, probes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from voxmill import constants as C
from voxmill.operators.filters import extension
from voxmill.sources.tables import STATE_TABLES

MANIFEST = """batch_id string, source string, created_at string, agent_platform string, status string,
config struct<language:string,format:string,segment_level:string,chunk_size:int,poll_interval_sec:int,max_retries:int>,
progress struct<total:int,submitted:int,succeeded:int,failed:int,in_progress:int,skipped:int>,
timing struct<scan_started_at:string,submit_started_at:string,submit_completed_at:string,monitor_completed_at:string,total_elapsed_sec:double>,
items array<struct<file_path:string,file_id:string,task_id:string,status:string,size_bytes:bigint,duration_sec:double,fingerprint:string>>, _corrupt string"""
# What a manifest may say.
MANIFEST_REQUIRED = ("batch_id", "source", "created_at", "agent_platform", "status", "config", "progress", "timing", "items")
MANIFEST_STATES = ("SCANNED", "SUBMITTING", "MONITORING", "COMPLETED", "INTERRUPTED", "FAILED")
BATCH_ID = r"^(local-\d{8}-\d{6}|retry-of-.+)$"
BENCHMARK_EVENT = "type string, server_id string, concurrency int, level_index int, total_levels int, repeats int, single_rtf double, per_file_rtf double, throughput_rtf double, wall_clock_sec double, elapsed_sec double, audio_sec double, recommended_concurrency int, gradient_complete boolean, error string, description string"
ALERTS = "status string, alerts array<struct<status:string,labels:map<string,string>,annotations:map<string,string>,startsAt:string,endsAt:string>>"
PROBE = "format struct<duration:string,format_name:string>, streams array<struct<codec_type:string,codec_name:string,sample_rate:string,channels:int>>"
# Part of a container's name -> mime type, the first that fits.
MIME = (("wav", "audio/wav"), ("mp3", "audio/mpeg"), ("flac", "audio/flac"), ("ogg", "audio/ogg"), ("mp4", "video/mp4"), ("matroska", "video/x-matroska"), ("webm", "video/webm"))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder where executors and driver both write, under the session's spark.checkpoint.dir; only a local master may go without that setting. It goes when the driver ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return path.toString()


def media_inventory(spark: SparkSession, folders: list[str], chunk: int, extensions=C.MEDIA_EXTENSIONS) -> DataFrame:
    """Media files under the folders with size, time and chunk number; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folders).select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("mtime"))
    files = files.where(extension(F.col("path")).isin(*extensions)).withColumn("folder", F.regexp_extract("path", r"^(.*)/[^/]*$", 1))
    return files.withColumn("chunk", F.floor((F.row_number().over(W.partitionBy("folder").orderBy("path")) - 1) / chunk).cast("long"))


def write_results(results: DataFrame, folder: str, files: int = 16) -> None:
    """results: task_id, fmt (json, txt, srt), content. One folder a format and id prefix, with up to ``files`` files: ids of one time may all have one prefix."""
    prefix = F.substring(F.col("task_id").cast("string"), 1, 4)
    rows = results.select("task_id", "fmt", prefix.alias("prefix"), "content")
    rows.repartition("fmt", "prefix", F.pmod(F.xxhash64("task_id"), F.lit(files))).write.partitionBy("fmt", "prefix").parquet(folder)


def read_results(spark: SparkSession, folder: str, fmt: str | None = None) -> DataFrame:
    """Partitions of other formats are not opened."""
    rows = spark.read.schema("task_id string, content string, fmt string, prefix string").parquet(folder)
    return rows if fmt is None else rows.where(F.col("fmt") == fmt)


def read_result_files(spark: SparkSession, folder: str) -> DataFrame:
    """Results stored as ``prefix/id/result.fmt`` files: (task_id, fmt, content)."""
    path = F.col("_metadata.file_path")
    rows = spark.read.text(folder, wholetext=True, recursiveFileLookup=True).select(path.alias("p"), F.col("value").alias("content"))
    return rows.select(F.regexp_extract("p", r"/([^/]+)/result\.(json|txt|srt)$", 1).alias("task_id"), F.regexp_extract("p", r"\.(json|txt|srt)$", 1).alias("fmt"), "content").where("task_id <> ''")


def schema_drift(spark: SparkSession, tables: dict[str, DataFrame], legacy: dict[str, list[str]] | None = None, expected: dict[str, str] = STATE_TABLES) -> DataFrame:
    """(table, level, problem): missing tables and columns are errors, legacy columns still there too; a table in order has one ok row."""
    rows = []
    for name, schema in expected.items():
        if name not in tables:
            rows.append((name, "error", "table missing"))
            continue
        have = set(tables[name].columns)
        lost = sorted(c.split()[0] for c in schema.split(", ") if c.split()[0] not in have)
        old = sorted(have & set((legacy or {}).get(name, [])))
        rows += [(name, "error", f"column missing: {c}") for c in lost] + [(name, "error", f"legacy column: {c}") for c in old]
        if not lost and not old:
            rows.append((name, "ok", ""))
    return spark.createDataFrame(rows, "table string, level string, problem string")


def read_manifests(spark: SparkSession, path: str, one_a_line: bool = False) -> DataFrame:
    """Manifests, one (or an array of them) a file, or ``one_a_line``."""
    return spark.read.schema(MANIFEST).option("multiLine", not one_a_line).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def manifest_violations(manifests: DataFrame) -> DataFrame:
    """(batch_id, problem) of manifests that aren't as agreed."""
    checks = [F.when(F.col("_corrupt").isNotNull(), "unreadable")]
    checks += [F.when(F.col(c).isNull(), f"missing: {c}") for c in MANIFEST_REQUIRED]
    checks += [
        F.when(~F.col("batch_id").rlike(BATCH_ID), "batch_id"),
        F.when(~F.col("status").isin(*MANIFEST_STATES), "status"),
        F.when(F.col("config.chunk_size") < 1, "chunk_size"),
        F.when(F.col("progress.total") < 0, "total"),
        F.when(F.exists("items", lambda i: i["file_path"].isNull()), "item without path"),
        F.when(F.exists("items", lambda i: i["size_bytes"] < 0), "item size"),
    ]
    return manifests.select("batch_id", F.explode(F.array_compact(F.array(*checks))).alias("problem"))


def latest_manifest_items(manifests: DataFrame, key: str) -> DataFrame:
    """Items of the newest manifest for each key."""
    g = manifests.groupBy(key).agg(F.max_by("items", F.struct("created_at", "batch_id")).alias("items"))
    return g.select(key, F.inline("items"))


def benchmark_events(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A benchmark log by kind of event: levels done, levels failed, and what was recommended."""
    e = spark.read.schema(BENCHMARK_EVENT).json(path)
    return {
        "levels": e.where("type = 'gradient_complete'").select("server_id", "concurrency", "level_index", "per_file_rtf", "throughput_rtf", "wall_clock_sec"),
        "errors": e.where("type = 'gradient_error'").select("server_id", "concurrency", "level_index", "error"),
        "results": e.where("type = 'benchmark_complete'").select("server_id", "single_rtf", "throughput_rtf", "recommended_concurrency", "gradient_complete"),
    }


def newest_benchmark(spark: SparkSession, path: str, as_of_s: int) -> DataFrame:
    """Rows of the newest file of an archive and its age in whole minutes. The files are listed only, and then one is read. An empty archive gives no rows."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "modificationTime")
    top = listed.agg(F.max(F.struct("modificationTime", "path")).alias("x")).head()[0]
    e = spark.read.schema(BENCHMARK_EVENT)
    rows = e.json(top["path"]) if top else spark.createDataFrame([], BENCHMARK_EVENT)
    age = F.floor((F.lit(as_of_s) - F.unix_seconds(F.lit(top["modificationTime"] if top else None).cast("timestamp"))) / 60)
    return rows.select("*", F.lit(top["path"].rsplit("/", 1)[-1] if top else None).alias("file"), age.alias("age_minutes"))


def probe_metadata(probe: Column) -> Column:
    """Struct of duration, media type, codec, rate, channels and mime from a media probe's JSON; the first stream of a kind counts and cover pictures aren't video."""
    p = F.from_json(probe, PROBE)
    first = lambda kind: F.get(F.filter(p["streams"], lambda s: s["codec_type"] == kind), F.lit(0))
    audio, video = first("audio"), first("video")
    is_video = video.isNotNull() & ~F.coalesce(video["codec_name"].isin("mjpeg", "png"), F.lit(False))
    mime, name = F, F.coalesce(p["format"]["format_name"], F.lit(""))
    for key, value in MIME:
        mime = mime.when(F.contains(name, F.lit(key)), value)
    return F.struct(
        F.nullif(p["format"]["duration"].try_cast("double"), F.lit(0.0)).alias("duration_sec"),
        F.when(is_video, "video").when(audio.isNotNull(), "audio").otherwise("unknown").alias("media_type"),
        F.coalesce(F.when(is_video, video["codec_name"]), audio["codec_name"]).alias("codec"),
        audio["sample_rate"].try_cast("int").alias("sample_rate"),
        audio["channels"].alias("channels"),
        mime.alias("mime"),
    )


def silence_intervals(log: DataFrame) -> DataFrame:
    """Silences from the lines of a detection log. log: file_id, line_no, line. A start without an end runs to -1 at the end of the file; a later start replaces it; an end without a start is ignored."""
    number = lambda what: F.nullif(F.regexp_extract("line", rf"silence_{what}:\s*([\d.]+)", 1), F.lit("")).try_cast("double")
    rows = log.select("file_id", "line_no", number("start").alias("s"), number("end").alias("e")).where("s is not null or e is not null")
    nxt = W.partitionBy("file_id").orderBy("line_no")
    rows = rows.withColumns({"next_end": F.lead("e").over(nxt), "next_line": F.lead("line_no").over(nxt)})
    ms = lambda c: (F.col(c) * 1000).cast("long")
    return rows.where("s is not null and (next_end is not null or next_line is null)").select("file_id", ms("s").alias("start_ms"), F.coalesce(ms("next_end"), F.lit(-1)).alias("end_ms"))


def webhook_alerts(payload: Column) -> Column:
    """Array of alerts of a webhook payload; an alert without a state has the payload's."""
    p = F.from_json(payload, ALERTS)
    return F.transform(p["alerts"], lambda a: F.struct(F.coalesce(a["status"], p["status"], F.lit("unknown")).alias("status"), F.coalesce(a["labels"]["alertname"], F.lit("unknown")).alias("alertname"), F.coalesce(a["labels"]["severity"], F.lit("unknown")).alias("severity"), F.coalesce(a["annotations"]["summary"], F.lit("")).alias("summary")))


def batch_summaries(tasks: DataFrame, files: DataFrame) -> DataFrame:
    """One nested document a batch: its items with state and output path."""
    rows = tasks.where("task_group_id is not null").join(files.select("file_id", "original_name"), "file_id", "left")
    item = F.struct("task_id", "original_name", "status", F.when(F.col("status") == "SUCCEEDED", F.concat(F.lit("results/"), F.col("task_id").cast("string"), F.lit(".json"))).alias("output"))
    return rows.groupBy("task_group_id").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "SUCCEEDED").alias("succeeded"), F.array_sort(F.collect_list(item)).alias("items"))


def json_export(results: DataFrame) -> DataFrame:
    """One JSON array a batch; content that isn't JSON stands under ``_raw``. results: batch, task_id, name, content."""
    parsed = F.try_parse_json("content")
    one = F.when(parsed.isNotNull(), F.to_json(parsed)).otherwise(F.to_json(F.struct(F.col("content").alias("_raw"))))
    item = F.concat(F.lit('{"name":'), F.to_json(F.struct(F.col("name").alias("n"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.col("name").alias("n")))) - 6), F.lit(',"result":'), one, F.lit("}"))
    g = results.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("task_id", item.alias("i")))).alias("l"))
    return g.select("batch", F.concat(F.lit("["), F.array_join(F.transform("l", lambda x: x["i"]), ","), F.lit("]")).alias("document"))
