"""Operational metrics over plan, lookup and run records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavelane.functions.scalars import lookup_outcome, ratio


def five_minutes(ts: Column) -> Column:
    """Start of the five-minute window an instant falls in."""
    return F.window(ts, "5 minutes")["start"]


def resolution_outcomes(calls: DataFrame) -> DataFrame:
    """Resource lookups by outcome: success, timeout or failure."""
    return calls.groupBy(lookup_outcome(F.col("error_type")).alias("outcome")).agg(
        F.count(F.lit(1)).alias("n")
    )


def resolution_rate_5m(calls: DataFrame) -> DataFrame:
    """Lookups per second and outcome in each five-minute window."""
    return (
        calls.groupBy(
            five_minutes(F.col("ts")).alias("window_start"),
            lookup_outcome(F.col("error_type")).alias("outcome"),
        )
        .agg(F.count(F.lit(1)).alias("n"))
        .select("window_start", "outcome", (F.col("n") / 300).alias("per_second"))
    )


def ingest_counter(tasks: DataFrame) -> DataFrame:
    """Ingested tasks per top resource class."""
    return tasks.groupBy(F.col("top_resource_class").alias("resource_class")).agg(
        F.count(F.lit(1)).alias("n")
    )


def build_duration_5m(timings: DataFrame) -> DataFrame:
    """Mean of ``elapsed_ms`` in each five-minute window."""
    return timings.groupBy(five_minutes(F.col("ts")).alias("window_start")).agg(
        (F.sum("elapsed_ms") / F.count(F.lit(1))).alias("mean_ms")
    )


def compile_vs_dispatch_5m(timings: DataFrame) -> DataFrame:
    """Mean compile and mean dispatch time side by side; NULL where a window has none."""

    def mean(phase: str) -> Column:
        is_phase = F.col("phase") == phase
        n = F.count(F.when(is_phase, 1))
        return F.try_divide(F.sum(F.when(is_phase, F.col("elapsed_ms"))), n)

    return timings.groupBy(five_minutes(F.col("ts")).alias("window_start")).agg(
        mean("compile").alias("compile_ms"), mean("dispatch").alias("dispatch_ms")
    )


def states_over_time(transitions: DataFrame) -> DataFrame:
    """How many tasks entered each state in each five-minute window."""
    return transitions.groupBy(five_minutes(F.col("ts")).alias("window_start"), "state").agg(
        F.count(F.lit(1)).alias("n")
    )


def group_results(results: DataFrame, keys: Sequence[str] = ("batch_id", "component")) -> DataFrame:
    """A group succeeds if all its tasks do; its time runs from first start to last finish."""
    ok = F.bool_and("success")
    micros = F.unix_micros(F.max("finished_at").cast("timestamp")) - F.unix_micros(
        F.min("started_at").cast("timestamp")
    )
    return results.groupBy(*keys).agg(
        ok.alias("success"),
        F.when(ok, "success").otherwise("failure").alias("outcome"),
        F.floor(micros / 1000).cast("bigint").alias("elapsed_ms"),
    )


def task_duration_stats(durations: DataFrame) -> DataFrame:
    """Timer figures per class."""
    return durations.groupBy("resource_class").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("elapsed_ms").alias("sum_ms"),
        F.max("elapsed_ms").alias("max_ms"),
        (F.sum("elapsed_ms") / F.count(F.lit(1))).alias("mean_ms"),
    )


def plan_duration_error(estimated: DataFrame, results: DataFrame) -> DataFrame:
    """Estimated against actual run time of each plan."""
    actual = group_results(results, ["batch_id"]).select(
        "batch_id", F.col("elapsed_ms").alias("actual_ms")
    )
    gap = F.abs(F.col("actual_ms") - F.col("estimated_duration_ms"))
    return estimated.join(actual, "batch_id").select(
        "batch_id",
        "estimated_duration_ms",
        "actual_ms",
        gap.alias("abs_error_ms"),
        ratio(gap, F.col("actual_ms")).alias("relative_error"),
    )


def plan_trend(history: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Chosen plan metrics in plan order."""
    return history.select("batch_id", *columns)
