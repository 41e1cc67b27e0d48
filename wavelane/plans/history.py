"""Questions to the plan history: newest, by id, as of an instant, and what changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest_plan(plans: DataFrame) -> DataFrame:
    """The newest plan; equal times are decided by the larger id."""
    return plans.orderBy(F.col("generated_at").desc(), F.col("plan_id").desc()).limit(1)


def plan_for(plans: DataFrame, at: Column) -> DataFrame:
    """The plan in force at one instant; empty before the first plan."""
    return latest_plan(plans.filter(F.col("generated_at") <= at))


def plan_as_of(probes: DataFrame, plans: DataFrame, ts: str = "ts") -> DataFrame:
    """Each probe row with the plan in force at its time, NULL before the first plan.

    Plans are turned into validity intervals, cut at day ends: a day starts with the last
    plan of the days before it. A probe then meets the intervals of its own day, an equi join
    on the day in which a crowded day can be split. Only plans are ever sorted.
    """
    day = F.to_date(F.col(ts))
    headers = plans.select("plan_id", "generated_at", F.to_date("generated_at").alias("_day"))
    newest = F.max(F.struct("generated_at", "plan_id"))
    per_day = headers.groupBy("_day").agg(newest.alias("_last"))
    asked = probes.select(day.alias("_day")).distinct()
    earlier = Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    # One row per calendar day, so this unpartitioned window stays as short as the calendar.
    openings = (
        asked.join(per_day, "_day", "full")
        .select("_day", F.last("_last", ignorenulls=True).over(earlier).alias("_open"))
        .filter(F.col("_open").isNotNull())
        .select("_day", F.col("_open.generated_at").alias("generated_at"), F.col("_open.plan_id").alias("plan_id"))
    )
    in_day = Window.partitionBy("_day").orderBy("generated_at", "plan_id")
    intervals = openings.unionByName(headers).select(
        "_day", "plan_id", "generated_at", F.lead("generated_at").over(in_day).alias("_until")
    )
    valid = (F.col(ts) >= F.col("generated_at")) & (
        F.col("_until").isNull() | (F.col(ts) < F.col("_until"))
    )
    keyed = probes.withColumn("_day", day)
    match = (keyed["_day"] == intervals["_day"]) & valid
    return keyed.join(intervals, match, "left").select(
        *[keyed[c] for c in probes.columns], intervals["plan_id"], intervals["generated_at"]
    )


def plan_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Tasks whose component or wave differs between two schedules, or that only one has."""
    keys = ["batch_id", "task_id"]
    old = before.select(*keys, F.col("component").alias("old_component"), F.col("colour").alias("old_colour"))
    new = after.select(*keys, F.col("component").alias("new_component"), F.col("colour").alias("new_colour"))
    same = F.col("old_component").eqNullSafe(F.col("new_component")) & F.col(
        "old_colour"
    ).eqNullSafe(F.col("new_colour"))
    return old.join(new, keys, "full").filter(~same)


def plan_digest(schedule: DataFrame) -> DataFrame:
    """(batch_id, n, total, parity): equal for schedules with the same rows, in whatever order they come.

    Two independent 64-bit hashes of every row, one added up and one xor-ed; each batch is reduced in one aggregation.
    """
    row = [F.col(c) for c in sorted(schedule.columns)]
    return schedule.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64(*row).cast("decimal(38,0)")).alias("total"),
        F.bit_xor(F.xxhash64(F.lit("again"), *row)).alias("parity"),
    )


def same_batches(before: DataFrame, after: DataFrame) -> DataFrame:
    """(batch_id, same): whether two compiles gave a batch the same schedule; only digests are joined."""
    old, new = plan_digest(before), plan_digest(after)
    digest = ("n", "total", "parity")
    renamed = new.select("batch_id", *[F.col(c).alias(f"_{c}") for c in digest])
    equal = F.lit(True)
    for c in digest:
        equal = equal & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return old.join(renamed, "batch_id", "full").select("batch_id", equal.alias("same"))


def same_plan(before: DataFrame, after: DataFrame) -> bool:
    """Whether two compiles gave identical schedules."""
    return same_batches(before, after).filter(~F.col("same")).isEmpty()
