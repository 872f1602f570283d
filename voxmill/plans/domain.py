"""Derived views over the given tables: one SQL text serves Spark and the oracle.

Four tokens differ between the engines: integer division, epoch seconds, epoch
microseconds and the string type. Progress is in basis points and times are whole
seconds or microseconds, so that sums are exact.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from voxmill.sources.tables import read_table, table_bytes

AS_OF_US = 1706659200000000  # 2024-01-31 00:00 UTC

VIEWS = {
    "d_files": """
SELECT p_partkey AS file_id, p_partkey % 20 AS user_id,
  concat(replace(p_name, ' ', '_'), '_', cast(p_partkey AS STRING),
    CASE p_partkey % 15 WHEN 0 THEN '.wav' WHEN 1 THEN '.mp3' WHEN 2 THEN '.mp4' WHEN 3 THEN '.flac'
      WHEN 4 THEN '.ogg' WHEN 5 THEN '.webm' WHEN 6 THEN '.m4a' WHEN 7 THEN '.aac' WHEN 8 THEN '.wma'
      WHEN 9 THEN '.mkv' WHEN 10 THEN '.avi' WHEN 11 THEN '.mov' WHEN 12 THEN '.pcm' WHEN 13 THEN '.txt'
      ELSE '.JPG' END) AS original_name,
  CASE WHEN p_partkey % 50 = 0 THEN cast(0 AS BIGINT)
       ELSE cast(p_size AS BIGINT) * 1000003 + p_partkey * 1009 END AS size_bytes,
  CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE (p_partkey * 37) % 5400 + p_size END AS duration_sec
FROM part
""",
    "d_tasks": """
SELECT o.o_orderkey AS task_id, o.o_custkey % 20 AS user_id, l.file_id AS file_id,
  CASE WHEN o.o_orderkey % 40 = 0 THEN NULL ELSE {IDIV(o.o_orderkey,25)} END AS task_group_id,
  o.status AS status,
  CAST(CASE o.status WHEN 'SUCCEEDED' THEN 10000 WHEN 'TRANSCRIBING' THEN 2000 + (o.o_custkey % 76) * 100
    WHEN 'QUEUED' THEN 1500 WHEN 'PREPROCESSING' THEN 500 WHEN 'DISPATCHED' THEN 2000 ELSE 5000 END AS BIGINT) AS progress_bp,
  CASE WHEN o.status IN ('QUEUED','PREPROCESSING') THEN NULL ELSE l.server_id END AS assigned_server_id,
  CASE WHEN o.status = 'FAILED' THEN CASE o.o_custkey % 4 WHEN 0 THEN 'MERGE_FAILED' WHEN 1 THEN 'SEGMENT_RETRY_EXHAUSTED'
    WHEN 2 THEN 'EMPTY_RESULT' ELSE 'TRANSCRIBE_ERROR' END END AS error_code,
  o.o_orderkey % 5 AS retry_count, o.created_s AS created_s,
  CASE WHEN o.status IN ('QUEUED','PREPROCESSING','DISPATCHED') THEN NULL ELSE o.created_s + o.o_custkey % 600 END AS started_s,
  CASE WHEN o.status IN ('SUCCEEDED','FAILED') THEN o.created_s + o.o_custkey % 600 + 1 + (o.o_orderkey * 131) % 1800 END AS completed_s
FROM (SELECT *, {EPOCH_S(o_orderdate)} + (o_orderkey * 7919) % 86400 AS created_s,
        CASE (o_orderkey * 7 + o_custkey) % 10 WHEN 4 THEN 'FAILED' WHEN 5 THEN 'CANCELED' WHEN 6 THEN 'QUEUED'
          WHEN 7 THEN 'TRANSCRIBING' WHEN 8 THEN 'PREPROCESSING' WHEN 9 THEN 'DISPATCHED' ELSE 'SUCCEEDED' END AS status
      FROM orders) o
LEFT JOIN (SELECT l_orderkey, min(l_partkey) AS file_id, min(l_suppkey) AS server_id FROM lineitem GROUP BY l_orderkey) l
  ON l.l_orderkey = o.o_orderkey
""",
    # a task of one part is not segmented; the hint deals the lines out once, by task
    "d_segments": """
SELECT segment_id, task_id, segment_index, keep_start_ms, keep_end_ms, source_start_ms, source_end_ms, status, assigned_server_id, retry_count, started_s, completed_s
FROM (SELECT count(*) OVER (PARTITION BY l_orderkey) AS parts, l_orderkey * 10 + l_linenumber AS segment_id, l_orderkey AS task_id, cast(l_linenumber AS BIGINT) - 1 AS segment_index,
  (cast(l_linenumber AS BIGINT) - 1) * 600000 AS keep_start_ms, cast(l_linenumber AS BIGINT) * 600000 AS keep_end_ms,
  greatest((cast(l_linenumber AS BIGINT) - 1) * 600000 - 400, 0) AS source_start_ms,
  cast(l_linenumber AS BIGINT) * 600000 + 400 AS source_end_ms,
  CASE (l_orderkey + 3 * l_linenumber) % 8 WHEN 5 THEN 'FAILED' WHEN 6 THEN 'PENDING' WHEN 7 THEN 'TRANSCRIBING'
    WHEN 4 THEN 'DISPATCHED' ELSE 'SUCCEEDED' END AS status,
  CASE WHEN (l_orderkey + 3 * l_linenumber) % 8 = 6 THEN NULL ELSE min(l_suppkey) END AS assigned_server_id,
  l_orderkey % 4 AS retry_count,
  CASE WHEN (l_orderkey + 3 * l_linenumber) % 8 IN (4, 6) THEN NULL ELSE {EPOCH_S(min(l_shipdate))} END AS started_s,
  CASE WHEN (l_orderkey + 3 * l_linenumber) % 8 IN (4, 6, 7) THEN NULL
       ELSE {EPOCH_S(min(l_shipdate))} + cast(max(l_quantity) AS BIGINT) END AS completed_s
FROM (SELECT /*+ REPARTITION(l_orderkey) */ l_orderkey, l_linenumber, l_suppkey, l_shipdate, l_quantity FROM lineitem) l GROUP BY l_orderkey, l_linenumber) s WHERE parts > 1
""",
    "d_servers": """
SELECT s_suppkey AS server_id, concat('10.0.0.', cast(s_suppkey % 250 AS STRING)) AS host, 10095 + s_suppkey % 3 AS port,
  s_suppkey % 9 AS max_concurrency,
  CAST(CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE (5 + (s_suppkey * 13) % 60) / 100.0 END AS DOUBLE) AS rtf_baseline,
  CASE s_suppkey % 5 WHEN 3 THEN 'OFFLINE' WHEN 4 THEN 'DEGRADED' ELSE 'ONLINE' END AS status,
  s_suppkey % 11 <> 0 AS enabled
FROM supplier
""",
    "d_events": """
SELECT event_id, user_id AS task_id, {EPOCH_US(ts)} AS ts_us,
  lag(to_status) OVER (PARTITION BY user_id ORDER BY {EPOCH_US(ts)}, event_id) AS from_status, to_status, payload_json
FROM (SELECT *, CASE event_type WHEN 'signup' THEN 'PREPROCESSING' WHEN 'view' THEN 'QUEUED' WHEN 'click' THEN 'DISPATCHED'
        WHEN 'purchase' THEN 'SUCCEEDED' ELSE 'FAILED' END AS to_status, props AS payload_json FROM events) e
""",
    "d_completions": """
SELECT event_id, user_id AS server_id, CASE WHEN event_id % 3 = 0 THEN 'segment' ELSE 'task' END AS work_kind,
  {EPOCH_US(ts)} AS ts_us, cast(300 AS BIGINT) AS audio_sec, cast(round(value * 100) AS BIGINT) AS actual_cs,
  cast(4000 + (event_id * 37) % 6000 AS BIGINT) AS predicted_cs
FROM events WHERE value > 0
""",
    "d_utterances": """
SELECT conv_id AS task_id, turn AS segment_index, turn * 600000 AS keep_start_ms, (turn + 1) * 600000 AS keep_end_ms,
  greatest(turn * 600000 - 400, 0) AS source_start_ms, pos, pos * 300 AS start_ms, pos * 300 + 250 AS end_ms,
  substring(text, cast(pos * 20 + 1 AS INT), 20) AS text
FROM (SELECT conv_id, turn, text, {POSITIONS} AS pos FROM conversations WHERE length(text) > 0) c
""",
    "d_transcript_pairs": """
SELECT a.conv_id * 1000 + a.turn AS pair_id, a.text AS baseline_text, b.text AS experiment_text,
  CASE WHEN a.conv_id % 4 = 0 THEN 45 ELSE 10 + a.conv_id % 200 END AS duration_sec
FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1
""",
}


def _text(sql: str, spark: bool) -> str:
    sql = re.sub(r"\{IDIV\(([^{}]*),(\d+)\)\}", r"(\1 div \2)" if spark else r"(\1 // \2)", sql)
    sql = re.sub(r"\{EPOCH_S\(((?:[^{}()]|\([^()]*\))*)\)\}", r"unix_seconds(cast(\1 as timestamp))" if spark else r"cast(epoch(\1) as bigint)", sql)
    sql = re.sub(r"\{EPOCH_US\(((?:[^{}()]|\([^()]*\))*)\)\}", r"unix_micros(cast(\1 as timestamp))" if spark else r"epoch_us(\1)", sql)
    sql = sql.replace("{POSITIONS}", "explode(sequence(0L, (length(text) - 1) div 20))" if spark else "unnest(range(0, (length(text) - 1) // 20 + 1))")
    return sql if spark else sql.replace("AS STRING", "AS VARCHAR")


#: What a view deals out by a hint comes in pieces of so much of its stored table, so that a task's memory stays as it is while the table grows.
PIECE_BYTES = 8 << 20

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations", "embeddings")


class Domain:
    """The tables and views under ``sf_dir`` as attributes, each a DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._made = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            view = VIEWS.get(f"d_{name}") if name != "events" else None
            self._made[name] = read_table(self.spark, self.sf_dir, name) if view is None else self.view(f"d_{name}")
        return self._made[name]

    def view(self, name: str) -> DataFrame:
        sql = _text(VIEWS[name], True)
        sql = re.sub(r"/\*\+ REPARTITION\((\w+)\) \*/(.*?FROM (\w+))", lambda m: f"/*+ REPARTITION({self._dealt(m[3])}{m[1]}) */{m[2]}", sql)
        used = [t for t in BASE if re.search(rf"(FROM|JOIN|,) {t}\b", sql)]
        for t in used:
            sql = re.sub(rf"((?:FROM|JOIN|,) ){t}\b", rf"\1{{{t}}}", sql)
        return self.spark.sql(sql, **{t: read_table(self.spark, self.sf_dir, t) for t in used})

    def _dealt(self, table: str) -> str:
        """The hint's number of partitions for a large table, no fewer than other shuffles have, so that joins keep it; a small one's is Spark's choice."""
        pieces = table_bytes(self.spark, self.sf_dir, table) // PIECE_BYTES
        if pieces <= self.spark.sparkContext.defaultParallelism:
            return ""
        return f"{max(pieces, int(self.spark.conf.get('spark.sql.shuffle.partitions')))}, "

    @property
    def task_events(self) -> DataFrame:
        if "_ev" not in self._made:
            self._made["_ev"] = self.view("d_events")
        return self._made["_ev"]

    @property
    def as_of_s(self) -> int:
        """The reports' moment: half a day after the newest task."""
        if "_at" not in self._made:
            self._made["_at"] = self.tasks.agg({"created_s": "max"}).head()[0] + 43200
        return self._made["_at"]


def oracle(sql: str) -> str:
    """``sql`` with the derived views that it names put before it."""
    used = [n for n in VIEWS if re.search(rf"\b{n}\b", sql)]
    views = ",\n".join(f"{n} AS ({_text(VIEWS[n], False)})" for n in used)
    own = re.match(r"\s*WITH (RECURSIVE )?", sql)
    if not used:
        return sql
    return f"WITH {own and own[1] or ''}{views}" + (",\n" + sql[own.end() :] if own else "\n" + sql)
