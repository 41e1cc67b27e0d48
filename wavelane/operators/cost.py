"""Run-time estimates and the critical path they imply."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavelane.functions.joins import lookup_join
from wavelane.functions.scalars import integer_mean, ratio
from wavelane.functions.scans import running_sums

DEFAULT_TASK_MS = 100


def class_duration_mean(durations: DataFrame) -> DataFrame:
    """Observed mean run time per class in whole milliseconds; negative readings are dropped."""
    return (
        durations.filter(F.col("elapsed_ms") >= 0)
        .groupBy("resource_class")
        .agg(integer_mean(F.sum("elapsed_ms"), F.count(F.lit(1))).alias("mean_ms"))
    )


def running_duration_estimate(durations: DataFrame, default_ms: int = DEFAULT_TASK_MS) -> DataFrame:
    """The estimate in force just before each reading: mean of the class's earlier readings."""
    scanned = running_sums(
        durations.filter(F.col("elapsed_ms") >= 0).select("event_id", "resource_class", "ts", "elapsed_ms"),
        ["resource_class"],
        ["ts", "event_id"],
        {"_total": F.col("elapsed_ms"), "_n": F.lit(1)},
        inclusive=False,
    )
    mean = F.when(F.col("_n") > 0, F.floor(F.try_divide(F.col("_total"), F.col("_n"))))
    return scanned.select(
        "event_id",
        "resource_class",
        F.coalesce(mean.cast("bigint"), F.lit(default_ms).cast("bigint")).alias("estimate_ms"),
    )


def with_estimates(
    tasks: DataFrame,
    observed: DataFrame | None = None,
    configured: dict[str, int] | None = None,
    default_ms: int = DEFAULT_TASK_MS,
    enabled: bool = True,
) -> DataFrame:
    """Add ``estimate_ms``: configured for the class, else observed, else the default.

    The tasks are not shuffled; with estimates switched off every task counts 0.
    """
    if not enabled:
        return tasks.withColumn("estimate_ms", F.lit(0).cast("bigint"))
    sources, cls = [], F.col("top_resource_class")
    if configured:
        table = F.create_map(*[F.lit(x) for pair in configured.items() for x in pair])
        sources.append(F.try_element_at(table, cls))
    joined = tasks
    if observed is not None:
        means = observed.select(F.col("resource_class").alias("top_resource_class"), "mean_ms")
        joined = lookup_join(tasks, means, "top_resource_class")
        sources.append(F.col("mean_ms"))
    return joined.select(
        *tasks.columns, F.coalesce(*sources, F.lit(default_ms)).cast("bigint").alias("estimate_ms")
    )


def task_estimates(tasks: DataFrame, *args, **options) -> DataFrame:
    """(batch_id, task_id, estimate_ms) under the rules of ``with_estimates``."""
    return with_estimates(tasks, *args, **options).select("batch_id", "task_id", "estimate_ms")


def wave_costs(schedule: DataFrame) -> DataFrame:
    """One row per wave: its size and its longest estimate."""
    return schedule.groupBy("batch_id", "component", "colour").agg(
        F.count(F.lit(1)).alias("wave_size"), F.max("estimate_ms").alias("wave_ms")
    )


def component_costs(waves: DataFrame) -> DataFrame:
    """One row per component: tasks, waves, largest wave, and waves run one after another."""
    return waves.groupBy("batch_id", "component").agg(
        F.sum("wave_size").alias("component_size"),
        F.count(F.lit(1)).alias("wave_count"),
        F.max("wave_size").alias("max_wave_size"),
        (F.max("colour") + 1).cast("bigint").alias("colours"),
        F.sum("wave_ms").alias("critical_path_ms"),
    )


def critical_path(components: DataFrame) -> DataFrame:
    """Components run side by side, so a plan takes as long as its slowest component."""
    return components.groupBy("batch_id").agg(
        F.max("critical_path_ms").alias("estimated_duration_ms")
    )


def schedule_speedup(schedule: DataFrame) -> DataFrame:
    """Serial run time of each component against its coloured one."""
    serial = schedule.groupBy("batch_id", "component").agg(F.sum("estimate_ms").alias("serial_ms"))
    coloured = component_costs(wave_costs(schedule)).select(
        "batch_id", "component", "critical_path_ms"
    )
    return serial.join(coloured, ["batch_id", "component"]).select(
        "batch_id",
        "component",
        "serial_ms",
        "critical_path_ms",
        ratio(F.col("serial_ms"), F.col("critical_path_ms")).alias("speedup"),
    )
