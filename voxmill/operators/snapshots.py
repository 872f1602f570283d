"""Changes as table -> next table: nothing is updated in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from voxmill import constants as C
from voxmill.operators.filters import transitions


def apply_transitions(tasks: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(next tasks, rejected moves). moves: task_id, to_status, at_s, one a task. A legal move sets the state, lifts progress to the state's floor and sets or clears the completion time."""
    legal = F.broadcast(transitions(tasks.sparkSession).withColumn("legal", F.lit(True)))
    asked = tasks.select("task_id", F.col("status").alias("from_status")).join(moves, "task_id").join(legal, ["from_status", "to_status"], "left")
    low = F
    for state, (floor, _) in C.PROGRESS_BANDS.items():
        low = low.when(F.col("to_status") == state, int(floor * 10000))
    ok = asked.where("legal").select("task_id", "to_status", "at_s", low.cast("long").alias("floor_bp"))
    moved = F.col("to_status").isNotNull()
    nxt = tasks.join(ok, "task_id", "left").withColumns(
        {
            "status": F.coalesce("to_status", "status"),
            "progress_bp": F.when(moved, F.greatest("progress_bp", "floor_bp")).otherwise(F.col("progress_bp")),
            "completed_s": F.when(moved, F.when(F.col("to_status").isin(*C.TERMINAL), F.col("at_s"))).otherwise(F.col("completed_s")),
        }
    )
    return nxt.drop("to_status", "at_s", "floor_bp"), asked.where("legal is null").select("task_id", "from_status", "to_status")


def cancel(tasks: DataFrame, segments: DataFrame, wanted: Column) -> tuple[DataFrame, DataFrame]:
    """(next tasks, next segments): the wanted open tasks are canceled, their open segments fail and get a new generation, so that late results are stale."""
    hit = wanted & ~F.col("status").isin(*C.TERMINAL)
    ids = tasks.where(hit).select("task_id", F.lit(True).alias("hit"))
    nxt = tasks.withColumn("status", F.when(hit, "CANCELED").otherwise(F.col("status")))
    open_ = F.col("hit") & F.col("status").isin("PENDING", *C.ACTIVE_SLOT)
    seg = segments.join(ids, "task_id", "left").withColumn("generation", F.when(open_, F.col("generation") + 1).otherwise(F.col("generation"))).withColumn("status", F.when(open_, "FAILED").otherwise(F.col("status"))).drop("hit")
    return nxt, seg


def bulk_delete(tasks: DataFrame, events: DataFrame, segments: DataFrame, wanted: Column) -> DataFrame:
    """Counts of a protected delete: open tasks are skipped, ended ones go with their events and segments."""
    asked = tasks.where(wanted).withColumn("gone", F.col("status").isin(*C.TERMINAL))
    gone = asked.where("gone").select("task_id")
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")
    return count(gone, "deleted").unionByName(count(asked.where("not gone"), "skipped")).unionByName(count(events.join(gone, "task_id", "left_semi"), "events")).unionByName(count(segments.join(gone, "task_id", "left_semi"), "segments"))


def reset_segments(segments: DataFrame, message: Column) -> DataFrame:
    """Failed segments start again: the error joins the history under its retry's number, of which the last 2000 characters stay, and the assignment is cleared."""
    failed = F.col("status") == "FAILED"
    history = F.right(F.concat(F.lit("[retry#"), (F.col("retry_count") + 1).cast("string"), F.lit("] "), message), F.lit(2000))
    return segments.withColumns({"error_message": F.when(failed, history), "assigned_server_id": F.when(~failed, F.col("assigned_server_id")), "retry_count": F.when(failed, F.col("retry_count") + 1).otherwise(F.col("retry_count"))}).withColumn("status", F.when(failed, "PENDING").otherwise(F.col("status")))


def fail_orphans(segments: DataFrame, tasks: DataFrame) -> DataFrame:
    """Open segments of failed tasks fail."""
    failed = tasks.where("status = 'FAILED'").select("task_id", F.lit(True).alias("p"))
    hit = F.col("p") & F.col("status").isin("PENDING", *C.ACTIVE_SLOT)
    return segments.join(failed, "task_id", "left").withColumn("status", F.when(hit, "FAILED").otherwise(F.col("status"))).drop("p")


def unbind(tasks: DataFrame, servers: Column) -> DataFrame:
    """Per server to delete: work at it and whether the delete is refused, and the ended tasks that lose their binding."""
    mine = tasks.where(servers)
    return mine.groupBy(F.col("assigned_server_id").alias("server_id")).agg(F.count_if(F.col("status").isin(*C.ACTIVE_SLOT)).alias("active"), F.count("*").alias("bound")).select("server_id", "active", (F.col("active") > 0).alias("refused"), F.when(F.col("active") > 0, 0).otherwise(F.col("bound")).alias("unbound"))


def apply_benchmark(servers: DataFrame, best: DataFrame) -> DataFrame:
    """Registry with measured ratios; a gradient that ended early never lowers a capacity. best: server_id, level, rtf, complete."""
    old, new = F.col("max_concurrency"), F.col("level")
    keep = new.isNull() | (~F.col("complete") & (new < old))
    return servers.join(best, "server_id", "left").withColumns({"max_concurrency": F.when(keep, old).otherwise(new), "rtf_baseline": F.coalesce("rtf", "rtf_baseline")}).drop("level", "rtf", "complete")


def backfill(rows: DataFrame, key: str, sources: list[str]) -> DataFrame:
    """Missing ids from a hash of the row's keys, so that a second run gives the same; missing updated times from the created ones."""
    made = F.left(F.sha2(F.concat_ws(":", *(F.col(c).cast("string") for c in sources)), 256), F.lit(26))
    return rows.withColumns({key: F.coalesce(F.col(key), made), "updated_s": F.coalesce("updated_s", "created_s")})


def expired(files: DataFrame, active: DataFrame, as_of: int, days: dict[str, float]) -> DataFrame:
    """Files to delete: older than their area keeps them, and not needed by active work. files: file_id, area, mtime_s."""
    age = F
    for area, keep in days.items():
        age = age.when(F.col("area") == area, F.lit(int(keep * 86400)))
    return files.where(F.lit(as_of) - F.col("mtime_s") > age).join(active.select("file_id"), "file_id", "left_anti")


def reconcile_late(tasks: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(next tasks, recovery events): an open task whose result is there has succeeded."""
    hit = tasks.where(~F.col("status").isin(*C.TERMINAL)).join(results.select("task_id").distinct(), "task_id", "left_semi").select("task_id", F.lit(True).alias("r"))
    both = tasks.join(hit, "task_id", "left")
    events = both.where("r").select("task_id", F.col("status").alias("from_status"), F.lit("SUCCEEDED").alias("to_status"), F.lit("late_result_recovered").alias("event"))
    nxt = both.withColumns({"progress_bp": F.when(F.col("r"), 10000).otherwise(F.col("progress_bp")), "status": F.when(F.col("r"), "SUCCEEDED").otherwise(F.col("status"))}).drop("r")
    return nxt, events
