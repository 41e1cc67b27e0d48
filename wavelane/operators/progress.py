"""Progress counters of tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavelane.operators.lifecycle import pending_count


def success_delta(n: Column) -> dict[str, Column]:
    """A page of ``n`` successes."""
    zero = F.lit(0).cast("bigint")
    return {"success_delta": n, "failed_delta": zero, "total_delta": n}


def failed_delta(failed: Column, total: Column) -> dict[str, Column]:
    return {"success_delta": F.lit(0).cast("bigint"), "failed_delta": failed, "total_delta": total}


def progress_sums() -> list[Column]:
    return [
        F.sum("total_delta").alias("total_count"),
        F.sum("success_delta").alias("success_count"),
        F.sum("failed_delta").alias("failed_count"),
        F.max("ts").alias("updated_at"),
        F.count(F.lit(1)).alias("version"),
    ]


def progress_snapshot(deltas: DataFrame) -> DataFrame:
    """Totals per task; the version counts the updates behind them."""
    return deltas.groupBy("task_id").agg(*progress_sums())


def task_status(tasks: DataFrame, progress: DataFrame) -> DataFrame:
    """State and cursor of each task with its progress, which shows once a total is known."""
    shown = progress.filter(F.col("total_count") > 0).select(
        "task_id", "total_count", "success_count", "failed_count"
    )
    return tasks.select("task_id", "state", "cursor").join(shown, "task_id", "left").select(
        "*",
        pending_count(
            F.col("total_count"), F.col("success_count"), F.col("failed_count")
        ).alias("_p"),
    ).select(
        "task_id",
        "state",
        "cursor",
        "total_count",
        "success_count",
        "failed_count",
        F.when(F.col("total_count").isNotNull(), F.col("_p")).alias("pending_count"),
    )


def unknown_tasks(requested: DataFrame, tasks: DataFrame) -> DataFrame:
    """Requested ids that no stored task has."""
    return requested.select("task_id").distinct().join(tasks, "task_id", "left_anti")
