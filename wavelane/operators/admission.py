"""Per-class limits: in-flight balance, hourly rate, pressure, and what they let through."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wavelane.functions.joins import lookup_join
from wavelane.functions.scalars import epoch_minute
from wavelane.functions.scans import clamped_balance, running_max, running_sums
from wavelane.schemas import IN_FLIGHT_STATES

DEFAULT_MAX_INFLIGHT = 1_000_000
DEFAULT_MAX_RATE = 500_000
RATE_MINUTES = 60


def class_limits(
    classes: DataFrame,
    overrides: DataFrame,
    max_inflight: int = DEFAULT_MAX_INFLIGHT,
    max_rate_per_hour: int = DEFAULT_MAX_RATE,
) -> DataFrame:
    """Limits of every class, the defaults where it has no override."""
    return classes.join(overrides, "resource_class", "left").select(
        *classes.columns,
        F.coalesce("max_inflight", F.lit(max_inflight)).cast("bigint").alias("max_inflight"),
        F.coalesce("max_rate_per_hour", F.lit(max_rate_per_hour))
        .cast("bigint")
        .alias("max_rate_per_hour"),
    )


def inflight_by_class(tasks: DataFrame) -> DataFrame:
    """Started or processing tasks per class; also the seed of the running balance."""
    return (
        tasks.filter(F.col("state").isin(*IN_FLIGHT_STATES))
        .groupBy(F.col("top_resource_class").alias("resource_class"))
        .agg(F.count(F.lit(1)).alias("inflight"))
    )


def inflight_balance(events: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """In-flight count after each event: +1 on emit, -1 on complete, never below 0."""
    moves = events.select(
        "event_id",
        "resource_class",
        "ts",
        F.when(F.col("kind") == "emit", 1).otherwise(-1).cast("bigint").alias("_delta"),
    )
    seed = None
    if seeds is not None:
        moves = lookup_join(moves, seeds.select("resource_class", F.col("inflight").alias("_seeded")), "resource_class")
        seed = F.coalesce("_seeded", F.lit(0))
    balanced = clamped_balance(
        moves, ["resource_class"], ["ts", "event_id"], "_delta", "inflight", seed
    )
    return balanced.select("event_id", "resource_class", "ts", "inflight")


def emissions(events: DataFrame) -> DataFrame:
    """The events that a rate counts: work sent out, not work that came back."""
    return events.filter(F.col("kind") == "emit")


def minute_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("resource_class", epoch_minute(F.col("ts")).alias("minute")).agg(
        F.count(F.lit(1)).alias("in_minute")
    )


def hourly_rate(events: DataFrame, minutes: int = RATE_MINUTES) -> DataFrame:
    """Emissions of the class in each emission's minute and the 59 before it.

    ``n`` covers the whole minute; ``n_at_event`` leaves out the emissions of that minute that
    come later. The sliding sum runs over minute totals, not over events.
    """
    events = emissions(events)
    trailing = (
        Window.partitionBy("resource_class").orderBy("minute").rangeBetween(-(minutes - 1), 0)
    )
    totals = minute_counts(events).withColumn("n", F.sum("in_minute").over(trailing))
    placed = events.select("event_id", "resource_class", "ts", epoch_minute(F.col("ts")).alias("minute"))
    counted = running_sums(placed, ["resource_class", "minute"], ["ts", "event_id"], {"_nth": F.lit(1)})
    return counted.join(totals, ["resource_class", "minute"]).select(
        "event_id",
        "resource_class",
        "minute",
        "n",
        (F.col("n") - F.col("in_minute") + F.col("_nth")).alias("n_at_event"),
    )


def hourly_rate_arrival(
    events: DataFrame, minutes: int = RATE_MINUTES, earlier: DataFrame | None = None
) -> DataFrame:
    """Rate as a ring counter books it: in arrival order, late events count as current.

    The clock of a class is the latest minute seen so far. An event is booked in the clock's
    minute and sees the bookings of the trailing window up to and including itself.
    ``earlier(resource_class, booked_minute, booked)`` are bookings made before these events.
    Only emissions are booked.
    """
    keyed = emissions(events).select("event_id", "resource_class", epoch_minute(F.col("ts")).alias("minute"))
    placed = running_max(keyed, ["resource_class"], ["event_id"], "minute", "_clock")
    clock = F.col("_clock")
    if earlier is not None:
        started = earlier.groupBy("resource_class").agg(F.max("booked_minute").alias("_from"))
        placed = lookup_join(placed, started, "resource_class")
        clock = F.greatest("_clock", "_from")
    booked = placed.select("event_id", "resource_class", clock.alias("booked_minute"))
    counts = booked.groupBy("resource_class", "booked_minute").agg(
        F.count(F.lit(1)).alias("_in"), F.lit(0).cast("bigint").alias("_old")
    )
    if earlier is not None:
        old = earlier.select(
            "resource_class",
            "booked_minute",
            F.lit(0).cast("bigint").alias("_in"),
            F.col("booked").alias("_old"),
        )
        counts = (
            counts.unionByName(old)
            .groupBy("resource_class", "booked_minute")
            .agg(F.sum("_in").alias("_in"), F.sum("_old").alias("_old"))
        )
    trailing = (
        Window.partitionBy("resource_class").orderBy("booked_minute").rangeBetween(-(minutes - 1), 0)
    )
    totals = counts.withColumn("_n", F.sum(F.col("_in") + F.col("_old")).over(trailing))
    # A backlog of late events all lands in one minute, which is no more than another order for the scan.
    counted = running_sums(booked, ["resource_class", "booked_minute"], ["event_id"], {"_nth": F.lit(1)})
    return (
        counted.join(totals, ["resource_class", "booked_minute"])
        .select(
            "event_id",
            "resource_class",
            "booked_minute",
            (F.col("_n") - F.col("_in") + F.col("_nth")).alias("n"),
        )
    )


def class_state(events: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """In-flight balance and trailing hourly rate of emissions of each class after the last event of all."""
    last = F.struct("ts", "event_id", "inflight")
    balance = (
        inflight_balance(events, seeds)
        .groupBy("resource_class")
        .agg(F.max(last)["inflight"].alias("inflight"))
    )
    now = events.agg(F.max(epoch_minute(F.col("ts")))).first()[0]
    recent = (
        minute_counts(emissions(events))
        .filter(F.col("minute") > F.lit(now) - RATE_MINUTES)
        .groupBy("resource_class")
        .agg(F.sum("in_minute").alias("rate"))
    )
    return balance.join(recent, "resource_class", "left").select(
        "resource_class", "inflight", F.coalesce("rate", F.lit(0).cast("bigint")).alias("rate")
    )


def class_admission(
    classes: DataFrame,
    state: DataFrame,
    overrides: DataFrame,
    enabled: bool = True,
    max_inflight: int = DEFAULT_MAX_INFLIGHT,
    max_rate_per_hour: int = DEFAULT_MAX_RATE,
) -> DataFrame:
    """One row per class: counts, limits, whether new tasks are admitted, and pressure."""
    zero = F.lit(0).cast("bigint")
    known = classes.select("resource_class").union(state.select("resource_class")).distinct()
    counted = known.join(state, "resource_class", "left").select(
        "resource_class",
        F.coalesce("inflight", zero).alias("inflight"),
        F.coalesce("rate", zero).alias("rate"),
    )
    limited = class_limits(counted, overrides, max_inflight, max_rate_per_hour)
    open_ = (F.col("inflight") < F.col("max_inflight")) & (F.col("rate") < F.col("max_rate_per_hour"))
    one = F.lit(1).cast("bigint")
    pressure = F.greatest(
        F.col("inflight") / F.greatest(one, F.col("max_inflight")),
        F.col("rate") / F.greatest(one, F.col("max_rate_per_hour")),
    )
    return limited.select(
        "*",
        (open_ if enabled else F.lit(True)).alias("admitted"),
        (pressure if enabled else F.lit(0.0)).alias("pressure"),
    )


def _denied_classes(admission: DataFrame) -> DataFrame:
    return admission.filter(~F.col("admitted")).select(
        F.col("resource_class").alias("top_resource_class")
    )


def admit_partial(members: DataFrame, admission: DataFrame) -> DataFrame:
    """Drop the tasks of denied classes only; components left empty vanish with them."""
    return lookup_join(members, _denied_classes(admission), "top_resource_class", "left_anti")


def denied_components(members: DataFrame, admission: DataFrame) -> DataFrame:
    """Components with a member of a denied class, and the first such member by id."""
    hit = lookup_join(members, _denied_classes(admission), "top_resource_class", "left_semi")
    return hit.groupBy("batch_id", "component").agg(F.min("task_id").alias("first_denied"))


def admit_all_or_nothing(members: DataFrame, admission: DataFrame) -> DataFrame:
    """Drop every component that has a member of a denied class."""
    return members.join(
        denied_components(members, admission), ["batch_id", "component"], "left_anti"
    )


def denied_by_class(members: DataFrame, admission: DataFrame, partial: bool = True) -> DataFrame:
    """Denials recorded per class.

    Partial mode records one per dropped task. Whole-component mode stops at the first
    denied member in id order and records each class met up to there once.
    """
    cls = F.col("top_resource_class").alias("resource_class")
    if partial:
        hit = lookup_join(members, _denied_classes(admission), "top_resource_class", "left_semi")
        return hit.groupBy(cls).agg(F.count(F.lit(1)).alias("denied"))
    met = members.join(denied_components(members, admission), ["batch_id", "component"]).filter(
        F.col("task_id") <= F.col("first_denied")
    )
    return (
        met.select("batch_id", "component", "top_resource_class")
        .distinct()
        .groupBy(cls)
        .agg(F.count(F.lit(1)).alias("denied"))
    )
