"""New tasks, checked and shaped; rejected rows keep their reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavelane.functions.scalars import is_blank, or_empty_json
from wavelane.schemas import RESOURCES


def _reasons(*checks: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(bad, F.lit(text)) for bad, text in checks]))


def check_commands(commands: DataFrame) -> DataFrame:
    """Add ``errors``, the list of rules an ingest command breaks."""
    return commands.withColumn(
        "errors",
        _reasons(
            # The texts that callers know.
            (is_blank(F.col("resource_class")), "resourceClass must not be blank"),
            (is_blank(F.col("resource_id")), "resourceId must not be blank"),
        ),
    )


def check_deltas(deltas: DataFrame) -> DataFrame:
    """Progress increments must not be negative."""
    return deltas.withColumn(
        "errors",
        _reasons(
            *[
                (F.col(c) < 0, f"{c} must not be negative")
                for c in ("success_delta", "failed_delta", "total_delta")
            ]
        ),
    )


def check_simulations(requests: DataFrame) -> DataFrame:
    """A dry run needs at least one task."""
    return requests.withColumn(
        "errors", _reasons((F.coalesce(F.size("tasks"), F.lit(0)) <= 0, "tasks must not be empty"))
    )


def split_checked(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected); works on streams as well, since it only filters."""
    ok = F.size("errors") == 0
    return checked.filter(ok).drop("errors"), checked.filter(~ok)


def new_tasks(commands: DataFrame, task_id: Column, created_at: Column) -> DataFrame:
    """PENDING rows for accepted commands.

    ``task_id`` should be derived from the command, so that a retried job writes the same
    ids; ``uuid()`` would not.
    """
    return commands.select(
        task_id.alias("task_id"),
        created_at.alias("created_at"),
        or_empty_json(F.col("payload")).alias("payload"),
        or_empty_json(F.col("search_dsl")).alias("search_dsl"),
        F.array().cast(RESOURCES).alias("resources"),
        F.lit(None).cast("string").alias("cursor"),
        F.lit("PENDING").alias("state"),
        F.col("timeout_at"),
        F.col("resource_class").alias("top_resource_class"),
        F.col("resource_id").alias("top_resource_id"),
        F.lit(0).cast("bigint").alias("version"),
    )
