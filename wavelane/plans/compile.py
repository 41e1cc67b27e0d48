"""From tasks and their resources to conflict-free schedules, all batches in one job."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavelane.functions.joins import lookup_join
from wavelane.functions.scalars import ratio
from wavelane.operators import admission, colouring, components, cost, footprint, graph, ordering
from wavelane.session import cut_lineage


@dataclass(frozen=True)
class PlanConfig:
    """Planning options; the defaults have every optimisation on."""

    batch_size: int = 100
    order_policy: ordering.Policy = "FIFO"
    max_bucket_size: int = 10_000
    colouring: bool = True
    locality: bool = True
    cost: bool = True
    backpressure_reorder: bool = True
    default_task_ms: int = 100
    task_ms: dict[str, int] = field(default_factory=dict)
    admission_enabled: bool = True
    planner_version: str = "v4"

    def __post_init__(self) -> None:
        if self.max_bucket_size < 1:
            raise ValueError("max_bucket_size must be at least 1")
        if self.default_task_ms < 0:
            raise ValueError("default_task_ms must not be negative")

    @classmethod
    def serial(cls, **options) -> PlanConfig:
        """Components only: no waves, no clustering, no estimates, whole-component admission."""
        off = dict(colouring=False, locality=False, cost=False, backpressure_reorder=False)
        return cls(**{**off, **options})


@dataclass(frozen=True)
class PlanFrames:
    """The frames a compile works on; passes fill in ``components`` and ``colours``.

    ``tasks`` carries the planning columns and ``estimate_ms``. ``all_coloured`` is set by passes that leave no
    task with conflicts uncoloured; without it that is looked into.
    """

    tasks: DataFrame
    footprint: DataFrame
    shared: DataFrame
    degree: DataFrame
    components: DataFrame | None = None
    colours: DataFrame | None = None
    all_coloured: bool = False

    def weighted(self) -> DataFrame:
        keys = graph.VERTEX
        estimates = self.tasks.select(*keys, "estimate_ms")
        return estimates.join(self.degree, keys, "left").withColumn(
            "degree", F.coalesce("degree", F.lit(0).cast("bigint"))
        )


Pass = Callable[[PlanFrames], PlanFrames]


def components_pass(frames: PlanFrames) -> PlanFrames:
    stars = components.component_stars(frames.shared)
    found = cut_lineage(components.connected_components(frames.tasks, stars))
    return replace(frames, components=found)


def colouring_pass(frames: PlanFrames) -> PlanFrames:
    members = cut_lineage(
        colouring.member_rows(frames.shared, frames.weighted(), frames.components)
    )
    return replace(frames, colours=cut_lineage(colouring.colour_waves(members)), all_coloured=True)


def added_edges(before: PlanFrames, after: PlanFrames) -> DataFrame:
    """Bucket memberships a pass introduced; passes must not add conflicts, so this is empty."""
    keys = ["batch_id", "task_id", *footprint.RESOURCE]
    return after.shared.select(*keys).join(before.shared.select(*keys), keys, "left_anti")


@dataclass(frozen=True)
class CompiledPlan:
    """A compiled plan as flat frames; ``schedule`` has one row per admitted task."""

    config: PlanConfig
    frames: PlanFrames
    members: DataFrame
    schedule: DataFrame
    class_admission: DataFrame | None

    def metrics(self) -> DataFrame:
        return plan_metrics(self.frames, self.schedule)

    def component_ids(self) -> DataFrame:
        return components.component_ids(self.schedule)

    def hot_buckets(self) -> DataFrame:
        """Resources touched by more tasks than ``max_bucket_size``; they are reported, never dropped."""
        return graph.hot_buckets(self.frames.footprint, self.config.max_bucket_size)


# What planning reads of a task; search text and payload stay in the task table.
PLAN_COLUMNS = (
    "batch_id",
    "task_id",
    "created_at",
    "timeout_at",
    "priority",
    "top_resource_class",
    "top_resource_id",
)


def plan_columns(tasks: DataFrame) -> DataFrame:
    return tasks.select(*[c for c in PLAN_COLUMNS if c in tasks.columns])


# A looked-up footprint, or a function that looks it up for the tasks it is given.
Resolver = DataFrame | Callable[[DataFrame], DataFrame]


def prepare(
    tasks: DataFrame,
    resources: Resolver,
    config: PlanConfig = PlanConfig(),
    observed: DataFrame | None = None,
    failed: DataFrame | None = None,
) -> PlanFrames:
    """Resolve footprints and take the measures the passes need.

    Each frame is materialised once, narrow, because several later steps read it.
    """
    if failed is not None:
        tasks = footprint.resolved_tasks(tasks, failed)
    if callable(resources):
        resources = resources(tasks)
    tasks = cut_lineage(
        cost.with_estimates(
            plan_columns(tasks), observed, config.task_ms, config.default_task_ms, config.cost
        )
    )
    fp = cut_lineage(footprint.footprint(tasks, resources))
    shared = cut_lineage(graph.shared_rows(fp))
    degree = cut_lineage(graph.degrees(shared))
    return PlanFrames(tasks, fp, shared, degree)


def compile_plan(
    tasks: DataFrame,
    resources: Resolver,
    config: PlanConfig = PlanConfig(),
    class_admission: DataFrame | None = None,
    observed: DataFrame | None = None,
    failed: DataFrame | None = None,
    passes: Sequence[Pass] | None = None,
    pressure: Column | None = None,
) -> CompiledPlan:
    """Compile every batch in ``tasks``; reading only, writing the plan is a separate step.

    ``resources(task_id, resource_class, resource_id)`` is the looked-up footprint,
    ``class_admission`` the per-class decisions (none: everything is admitted), ``observed``
    the mean run times per class, ``failed`` the tasks whose lookup failed and ``pressure``
    an expression over the planning columns to use instead of the pressure of the class.
    """
    if passes is None:
        passes = [components_pass, colouring_pass] if config.colouring else [components_pass]
    if not passes:
        raise ValueError("at least one pass is required")
    frames = prepare(tasks, resources, config, observed, failed)
    for step in passes:
        after = step(frames)
        if after.shared is not frames.shared and not added_edges(frames, after).isEmpty():
            raise ValueError(f"{getattr(step, '__name__', step)} adds conflicts")
        frames = after
    return assemble(frames, config, class_admission, pressure)


def assemble(
    frames: PlanFrames,
    config: PlanConfig,
    class_admission: DataFrame | None = None,
    pressure: Column | None = None,
) -> CompiledPlan:
    """Admission and ordering on top of finished passes; also re-plans under other options."""
    keys = graph.VERTEX
    members = frames.tasks.join(frames.components, keys)
    admitted = members
    if class_admission is not None and config.admission_enabled:
        class_admission = cut_lineage(class_admission)
        if config.backpressure_reorder:
            admitted = admission.admit_partial(members, class_admission)
        else:
            admitted = admission.admit_all_or_nothing(members, class_admission)

    use_pressure = config.backpressure_reorder and (
        pressure is not None or class_admission is not None
    )
    if use_pressure and pressure is not None:
        admitted = admitted.withColumn("pressure", pressure)
    elif use_pressure:
        of_class = class_admission.select(
            F.col("resource_class").alias("top_resource_class"), "pressure"
        )
        admitted = lookup_join(admitted, of_class, "top_resource_class").withColumn(
            "pressure", F.coalesce("pressure", F.lit(0.0))
        )
    order = ordering.wave_keys(
        config.order_policy, admitted.columns, config.locality, use_pressure
    )
    columns = ["batch_id", "component", "colour", "pos", "ordinal", "task_id", "estimate_ms"]
    if frames.colours is None:
        schedule = ordering.serial_schedule(admitted, order, frames.components)
    else:
        schedule = _coloured_schedule(admitted, frames, order, columns)
    return CompiledPlan(
        config, frames, members, cut_lineage(schedule.select(*columns)), class_admission
    )


def _coloured_schedule(
    admitted: DataFrame, frames: PlanFrames, order: list[Column], columns: list[str]
) -> DataFrame:
    """Waves by colour; a component in which a pass coloured nothing runs one task at a time.

    Members without a colour in a coloured component have no conflicts left to avoid and join wave 0,
    unless they share a resource, in which case nothing is known about them and the component is serial too.
    """
    keys, whole = graph.VERTEX, ["batch_id", "component"]
    coloured = admitted.join(frames.colours, keys, "left")
    if frames.all_coloured:
        return ordering.wave_schedule(
            coloured.withColumn("colour", F.coalesce("colour", F.lit(0))), order, frames.components
        )
    bare = coloured.filter(F.col("colour").isNull()).select(*keys, "component")
    conflicting = frames.shared.select(*keys).distinct()
    serial = bare.join(conflicting, keys, "left_semi").select(*whole).distinct()
    if serial.isEmpty():
        return ordering.wave_schedule(
            coloured.withColumn("colour", F.coalesce("colour", F.lit(0))), order, frames.components
        )
    serial = cut_lineage(serial)
    waves = coloured.join(serial, whole, "left_anti").withColumn("colour", F.coalesce("colour", F.lit(0)))
    alone = coloured.join(serial, whole, "left_semi").drop("colour")
    parts = (
        ordering.wave_schedule(waves, order, frames.components),
        ordering.serial_schedule(alone, order, frames.components),
    )
    return parts[0].select(*columns).unionByName(parts[1].select(*columns))


def plan_metrics(frames: PlanFrames, schedule: DataFrame) -> DataFrame:
    """One row per batch. Tasks and conflicts count all resolved tasks, the rest admitted ones."""
    zero = F.lit(0).cast("bigint")
    groups = cost.component_costs(cost.wave_costs(schedule))
    admitted = groups.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("connected_components"),
        F.max("component_size").alias("largest_component"),
        F.max("max_wave_size").alias("max_wave_size"),
        F.max("colours").alias("chromatic_number"),
        F.sum("wave_count").alias("wave_count"),
        F.max("critical_path_ms").alias("estimated_duration_ms"),
    )
    totals = frames.tasks.groupBy("batch_id").agg(F.count(F.lit(1)).alias("total_tasks"))
    joined = totals.join(graph.edge_counts(frames.degree), "batch_id", "left").join(
        admitted, "batch_id", "left"
    )
    filled = joined.select(
        "batch_id",
        "total_tasks",
        *[
            F.coalesce(F.col(c), zero).alias(c)
            for c in (
                "connected_components",
                "largest_component",
                "conflicts_detected",
                "chromatic_number",
                "wave_count",
                "max_wave_size",
                "estimated_duration_ms",
            )
        ],
    )
    one = F.lit(1).cast("bigint")
    return filled.select(
        "batch_id",
        "total_tasks",
        "connected_components",
        "largest_component",
        ratio(
            F.col("connected_components"), F.greatest(one, F.col("largest_component"))
        ).alias("parallelism_factor"),
        ratio(F.col("largest_component"), F.col("total_tasks")).alias("serialization_ratio"),
        "conflicts_detected",
        "chromatic_number",
        "wave_count",
        ratio(F.col("max_wave_size"), F.greatest(one, F.col("largest_component"))).alias(
            "intra_component_parallelism"
        ),
        "estimated_duration_ms",
    )


def plan_explain(metrics: DataFrame) -> DataFrame:
    """Metrics plus how dense the conflict graph is."""
    v, e = F.col("total_tasks"), F.col("conflicts_detected")
    return metrics.select(
        "*",
        ratio(e * 2, v * (v - 1)).alias("conflict_density"),
        ratio(e * 2, v).alias("average_degree"),
    )


def task_to_component(schedule: DataFrame, ids: DataFrame) -> DataFrame:
    return schedule.select("batch_id", "component", "task_id").join(
        ids, ["batch_id", "component"]
    ).select("batch_id", "task_id", "component_id")


def colouring_violations(shared: DataFrame, colours: DataFrame) -> DataFrame:
    """Resources held twice in one wave; a right colouring has none."""
    return (
        shared.join(colours, graph.VERTEX)
        .groupBy(*graph.BUCKET, "colour")
        .agg(F.count(F.lit(1)).alias("holders"))
        .filter(F.col("holders") > 1)
    )


def isolation_violations(shared: DataFrame, found: DataFrame) -> DataFrame:
    """Resources reached from two components; a right partition has none."""
    return (
        shared.join(found, graph.VERTEX)
        .groupBy(*graph.BUCKET)
        .agg(F.min("component").alias("one"), F.max("component").alias("two"))
        .filter(F.col("one") != F.col("two"))
    )
