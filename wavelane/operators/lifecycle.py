"""Task states: selection, transitions, and what the result of a task makes of it."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavelane.functions.scalars import at_least_zero, failure_text, ms_iso_duration
from wavelane.schemas import ELIGIBLE_STATES, EXPIRABLE_STATES, IN_FLIGHT_STATES, TASK_STATES

DEFAULT_TASK_TIMEOUT_MS = 300_000


def eligible(tasks: DataFrame) -> DataFrame:
    return tasks.filter(F.col("state").isin(*ELIGIBLE_STATES))


def eligible_batch(tasks: DataFrame, limit: int) -> DataFrame:
    """The oldest ``limit`` tasks that wait for planning; none for a limit of 0 or less."""
    return eligible(tasks).orderBy("created_at", "task_id").limit(max(0, limit))


def by_states(tasks: DataFrame, states: Sequence[str]) -> DataFrame:
    return tasks.filter(F.col("state").isin(*states)) if states else tasks.filter(F.lit(False))


def by_id(rows: DataFrame, key: str, value) -> DataFrame:
    return rows.filter(F.col(key) == F.lit(value))


def _is_expired(now: datetime | Column, states: Sequence[str]) -> Column:
    return F.col("state").isin(*states) & F.coalesce(
        F.col("timeout_at") <= F.lit(now), F.lit(False)
    )


def expired(
    tasks: DataFrame, now: datetime | Column, states: Sequence[str] = EXPIRABLE_STATES
) -> DataFrame:
    """Tasks in one of ``states`` whose deadline is at or before ``now``."""
    return tasks.filter(_is_expired(now, states))


def reap_timeouts(tasks: DataFrame, now: datetime | Column) -> DataFrame:
    """Expired tasks become TIMEOUT; ``slot_released`` marks those that were in flight."""
    hit = _is_expired(now, EXPIRABLE_STATES)
    return tasks.select(
        "*",
        hit.alias("_hit"),
    ).select(
        *[
            F.when(F.col("_hit"), F.lit("TIMEOUT")).otherwise(F.col("state")).alias("state")
            if c == "state"
            else F.col(c)
            for c in tasks.columns
        ],
        (F.col("_hit") & F.col("state").isin(*IN_FLIGHT_STATES)).alias("slot_released"),
    )


def recover_orphans(tasks: DataFrame) -> DataFrame:
    """After a restart, work left in flight resumes at its cursor or starts over."""
    resumed = F.when(F.col("cursor").isNull(), F.lit("PENDING")).otherwise(F.lit("PAUSED"))
    return tasks.withColumn(
        "state",
        F.when(F.col("state").isin(*IN_FLIGHT_STATES), resumed).otherwise(F.col("state")),
    )


def tasks_by_state(tasks: DataFrame) -> DataFrame:
    """Number of tasks in each state, 0 for states nobody is in."""
    counts = tasks.groupBy("state").agg(F.count(F.lit(1)).alias("n"))
    states = tasks.sparkSession.createDataFrame([(s,) for s in TASK_STATES], "state string")
    return states.join(counts, "state", "left").select(
        "state", F.coalesce("n", F.lit(0).cast("bigint")).alias("n")
    )


def inflight_work_by_class(tasks: DataFrame, progress: DataFrame) -> DataFrame:
    """Remaining items of unfinished work per class."""
    running = tasks.filter(F.col("state").isin(*IN_FLIGHT_STATES, "PAUSED"))
    left = F.col("total_count") - F.col("success_count") - F.col("failed_count")
    return (
        running.select("task_id", F.col("top_resource_class").alias("resource_class"))
        .join(progress, "task_id")
        .groupBy("resource_class")
        .agg(F.sum(left).alias("inflight_work"))
    )


def latest_by_version(versions: DataFrame, key: str = "task_id") -> DataFrame:
    """The newest version of each row. Only maxima are shuffled, not the history of a key."""
    rest = [c for c in versions.columns if c not in (key, "version")]
    newest = F.max(F.struct("version", *rest)).alias("_row")
    return versions.groupBy(key).agg(newest).select(key, "_row.version", *[f"_row.{c}" for c in rest])


def force_complete(tasks: DataFrame, commands: DataFrame) -> DataFrame:
    """Named tasks become COMPLETED from any state; unknown ids have no effect."""
    named = commands.select("task_id").distinct().withColumn("_named", F.lit(True))
    return (
        tasks.join(named, "task_id", "left")
        .withColumn(
            "state", F.when(F.col("_named"), F.lit("COMPLETED")).otherwise(F.col("state"))
        )
        .select(*tasks.columns)
    )


def apply_outcomes(
    outcomes: DataFrame, tasks: DataFrame, task_timeout_ms: int = DEFAULT_TASK_TIMEOUT_MS
) -> DataFrame:
    """Next state, cursor and wire result of every executed task.

    The rules are tried in order: unknown task; already complete; past its own deadline
    before it started; error thrown; ran longer than ``task_timeout_ms`` (pausing is
    exempt); then the reported outcome.
    """
    known = tasks.select(
        "task_id",
        F.col("state").alias("_was"),
        F.col("cursor").alias("_had"),
        "timeout_at",
        F.lit(True).alias("_known"),
    )
    run = outcomes.join(known, "task_id", "left")
    missing = F.col("_known").isNull()
    complete = F.col("_was") == "COMPLETED"
    stale = F.coalesce(F.col("timeout_at") <= F.col("started_at"), F.lit(False))
    thrown = F.col("error_type").isNotNull()
    allowed = F.expr(f"interval {task_timeout_ms * 1000} microseconds")
    overran = (F.col("finished_at") > F.col("started_at") + allowed) & (
        F.col("outcome") != "PAUSED"
    )
    overrun_text = F.concat(
        F.lit("Task exceeded deadline ("),
        ms_iso_duration(F.lit(task_timeout_ms).cast("bigint")),
        F.lit(")"),
    )

    def rules(on_missing, on_complete, on_stale, on_thrown, on_overrun, on_ok, on_paused, on_failed):
        return (
            F.when(missing, on_missing)
            .when(complete, on_complete)
            .when(stale, on_stale)
            .when(thrown, on_thrown)
            .when(overran, on_overrun)
            .when(F.col("outcome") == "COMPLETED", on_ok)
            .when(F.col("outcome") == "PAUSED", on_paused)
            .otherwise(on_failed)
        )

    # The wire texts "Task not found", "Task timed out before dispatch" and
    # "Task exceeded deadline (...)" are part of the result format.
    t, f, none = F.lit(True), F.lit(False), F.lit(None).cast("string")
    timeout, failed, done = F.lit("TIMEOUT"), F.lit("FAILED"), F.lit("COMPLETED")
    had = F.col("_had")
    return run.select(
        "task_id",
        rules(none, F.col("_was"), timeout, failed, timeout, done, F.lit("PAUSED"), failed).alias(
            "state"
        ),
        rules(none, had, had, had, had, had, F.coalesce("cursor", "_had"), had).alias("cursor"),
        rules(f, t, f, f, f, t, t, f).alias("success"),
        rules(
            F.lit("Task not found"),
            none,
            F.lit("Task timed out before dispatch"),
            failure_text(F.col("error_type"), F.col("error_message"), F.col("failure_reason")),
            overrun_text,
            none,
            none,
            F.coalesce("failure_reason", F.lit("failed")),
        ).alias("failure_reason"),
        "started_at",
        "finished_at",
    )


def pending_count(total: Column, success: Column, failed: Column) -> Column:
    return at_least_zero(total - success - failed)
