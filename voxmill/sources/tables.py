"""Typed scans: tables are read with explicit schemas, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Columns of the given tables.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "conversations": "conv_id long, turn long, role string, text string",
}

# The six state tables of a transcription service.
STATE_TABLES = {
    "files": "file_id string, user_id string, original_name string, media_type string, mime string, duration_sec double, codec string, sample_rate int, channels short, size_bytes long, storage_path string, checksum_sha256 string, status string, created_at timestamp, updated_at timestamp",
    "tasks": "task_id string, user_id string, file_id string, task_group_id string, status string, progress double, eta_seconds int, assigned_server_id string, external_vendor string, external_task_id string, language string, options_json string, result_path string, error_code string, error_message string, retry_count short, run_generation short, callback_url string, callback_secret string, created_at timestamp, started_at timestamp, completed_at timestamp",
    "task_events": "event_id string, task_id string, from_status string, to_status string, payload_json string, created_at timestamp",
    "task_segments": "segment_id string, task_id string, segment_index short, source_start_ms int, source_end_ms int, keep_start_ms int, keep_end_ms int, storage_path string, status string, assigned_server_id string, retry_count short, run_generation short, raw_result_json string, error_message string, created_at timestamp, started_at timestamp, completed_at timestamp",
    "server_instances": "server_id string, name string, host string, port int, protocol_version string, server_type string, supported_modes string, max_concurrency int, rtf_baseline double, throughput_rtf double, benchmark_concurrency short, penalty_factor double, status string, enabled boolean, last_heartbeat timestamp, labels_json string",
    "callback_outbox": "outbox_id string, task_id string, event_id string, callback_url string, payload_json string, status string, retry_count short, last_error string, created_at timestamp, sent_at timestamp",
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One given table; columns that the query doesn't use are pruned from the scan."""
    reader = spark.read
    if name in SCHEMAS:
        reader = reader.schema(SCHEMAS[name])
    return reader.parquet(f"{sf_dir}/{name}.parquet")


def table_bytes(spark: SparkSession, sf_dir: str, name: str) -> int:
    """Size of one given table as it is stored."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()


def load(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The six state tables under ``folder``, each a Parquet table of its own name."""
    return {name: spark.read.schema(schema).parquet(f"{folder}/{name}") for name, schema in STATE_TABLES.items()}
