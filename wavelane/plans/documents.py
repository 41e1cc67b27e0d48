"""Plans as nested rows and JSON text.

The flat schedule is the primary form. A nested row holds at most ``part_tasks`` tasks: a
larger component is split into numbered parts, in order, so no row grows with the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavelane.functions.scalars import is_blank, ms_iso_duration, name_uuid, serial_waves
from wavelane.schemas import GROUP, PLAN_JSON, WAVE

PART_TASKS = 10_000

# Metric names with the columns they come from; ones that older plans lack read as 0.
_METRICS = (
    ("totalTasks", "total_tasks", "int"),
    ("connectedComponents", "connected_components", "int"),
    ("largestComponent", "largest_component", "int"),
    ("parallelismFactor", "parallelism_factor", "double"),
    ("serializationRatio", "serialization_ratio", "double"),
    ("conflictsDetected", "conflicts_detected", "int"),
    ("chromaticNumber", "chromatic_number", "int"),
    ("waveCount", "wave_count", "int"),
    ("intraComponentParallelism", "intra_component_parallelism", "double"),
    ("estimatedDurationMillis", "estimated_duration_ms", "bigint"),
)


def nested_groups(schedule: DataFrame, ids: DataFrame, part_tasks: int = PART_TASKS) -> DataFrame:
    """One row per component and part: ordered task ids and the waves they form.

    A wave cut by a part's end continues in the next part; its piece there names the position it begins at.
    """
    sizes = schedule.groupBy("batch_id", "component").agg(
        (F.floor((F.max("ordinal") - 1) / part_tasks) + 1).alias("parts")
    )
    parts = schedule.select(
        "batch_id",
        "component",
        F.floor((F.col("ordinal") - 1) / part_tasks).alias("part"),
        "colour",
        "pos",
        F.col("task_id").cast("string").alias("task_id"),
    )
    pieces = parts.groupBy("batch_id", "component", "part", "colour").agg(
        F.sort_array(F.collect_list(F.struct("pos", "task_id"))).alias("_rows")
    )
    first = F.col("_rows")[0]["pos"]
    waves = pieces.select(
        "batch_id",
        "component",
        "part",
        F.struct(
            "colour", F.col("_rows")["task_id"].alias("taskIds"), F.when(first > 1, first).alias("firstPos")
        ).alias("_wave"),
    )
    groups = waves.groupBy("batch_id", "component", "part").agg(
        F.sort_array(F.collect_list("_wave")).cast(f"array<{WAVE}>").alias("waves")
    )
    return groups.join(sizes, ["batch_id", "component"]).join(ids, ["batch_id", "component"]).select(
        "batch_id",
        "component_id",
        "part",
        "parts",
        F.flatten("waves.taskIds").alias("ordered_tasks"),
        "waves",
    )


def with_waves(waves: Column, ordered: Column) -> Column:
    """The given waves, or one single-task wave per task where they are missing or empty."""
    whole = F.lit(None).cast("bigint").alias("firstPos")
    serial = F.transform(serial_waves(ordered), lambda w: F.struct(w["colour"], w["taskIds"], whole))
    return F.when(F.size(waves) > 0, waves).otherwise(serial.cast(f"array<{WAVE}>"))


def group_fields() -> list[Column]:
    """Fields of a group on the wire; part numbers only where there are several parts."""
    several = F.col("parts") > 1
    return [
        F.col("component_id").alias("componentId"),
        F.col("ordered_tasks").alias("orderedTasks"),
        F.col("waves"),
        F.when(several, F.col("part")).alias("part"),
        F.when(several, F.col("parts")).alias("parts"),
    ]


def plan_headers(
    metrics: DataFrame, generated_at: Column, planner_version: str, order_policy: str, duration_ms: Column
) -> DataFrame:
    """Identity and labels of each batch's plan next to its metrics."""
    text = F.concat(F.date_format(generated_at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    return metrics.select(
        "*",
        generated_at.alias("generated_at"),
        text.alias("generated_text"),
        F.lit(planner_version).alias("planner_version"),
        duration_ms.cast("bigint").alias("planning_ms"),
        F.lit(order_policy).alias("order_policy"),
    ).withColumn(
        "plan_id", name_uuid(F.concat_ws("|", "generated_text", F.col("batch_id").cast("string")))
    )


def plan_documents(headers: DataFrame, groups: DataFrame, page_tasks: int = PART_TASKS) -> DataFrame:
    """(plan_id, page, plan) rows of JSON text.

    A plan of up to ``page_tasks`` tasks is one document. A larger one becomes several with
    the same header, each with some of the groups; together they hold every group once.
    """
    number = F.split_part(F.col("component_id"), F.lit("-"), F.lit(-1)).cast("bigint")
    pages = F.greatest(F.lit(1), F.ceil(F.col("total_tasks") / page_tasks))
    placed = groups.join(
        headers.select("batch_id", pages.alias("_pages")), "batch_id"
    ).withColumn("page", F.concat_ws(".", F.pmod(number, F.col("_pages")), F.col("part")))
    group = F.struct(*group_fields())
    numbered = F.struct(number.alias("n"), group.alias("g"))
    owner = F.transform(
        F.col("ordered_tasks"), lambda t: F.struct(t.alias("key"), F.col("component_id").alias("value"))
    )
    pages_of = placed.groupBy("batch_id", "page").agg(
        F.sort_array(F.collect_list(numbered))["g"].alias("groups"),
        F.map_from_entries(F.flatten(F.collect_list(owner))).alias("taskToComponent"),
    )
    metric_fields = [F.col(column).cast(kind).alias(name) for name, column, kind in _METRICS]
    document = F.struct(
        F.col("plan_id").alias("id"),
        F.col("generated_text").alias("generatedAt"),
        F.col("planner_version").alias("plannerVersion"),
        ms_iso_duration(F.col("planning_ms")).alias("planningDuration"),
        F.col("order_policy").alias("orderPolicy"),
        F.coalesce("groups", F.array().cast(f"array<{GROUP}>")).alias("groups"),
        F.struct(*metric_fields).alias("metrics"),
        F.coalesce("taskToComponent", F.create_map().cast("map<string,string>")).alias(
            "taskToComponent"
        ),
    )
    return headers.join(pages_of, "batch_id", "left").select(
        "batch_id",
        "plan_id",
        "generated_at",
        F.coalesce("page", F.lit("0.0")).alias("page"),
        F.to_json(document).alias("plan"),
    )


def read_plan_json(rows: DataFrame, column: str = "plan") -> DataFrame:
    """Typed plans from JSON text of any age.

    Missing metrics are 0, groups without waves run one task at a time, and a plan without
    an id gets the one its generation time implies.
    """
    parsed = rows.withColumn("_p", F.from_json(F.col(column), PLAN_JSON))
    plan = lambda name: F.col(f"_p.{name}")
    groups = F.transform(
        plan("groups"),
        lambda g: F.struct(
            g["componentId"].alias("componentId"),
            g["orderedTasks"].alias("orderedTasks"),
            with_waves(g["waves"], g["orderedTasks"]).alias("waves"),
            F.coalesce(g["part"], F.lit(0).cast("bigint")).alias("part"),
            F.coalesce(g["parts"], F.lit(1).cast("bigint")).alias("parts"),
        ),
    )
    metrics = F.struct(
        *[
            F.coalesce(F.col(f"_p.metrics.{n}"), F.lit(0).cast(t)).alias(n)
            for n, _, t in _METRICS
        ]
    )
    return parsed.select(
        *[c for c in rows.columns if c != column],
        F.when(is_blank(plan("id")), name_uuid(plan("generatedAt")))
        .otherwise(F.lower(plan("id")))
        .alias("id"),
        plan("generatedAt").alias("generatedAt"),
        plan("plannerVersion").alias("plannerVersion"),
        plan("planningDuration").alias("planningDuration"),
        plan("orderPolicy").alias("orderPolicy"),
        groups.alias("groups"),
        metrics.alias("metrics"),
        plan("taskToComponent").alias("taskToComponent"),
    )


def flat_waves(plans: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """(plan, component, colour, pos, task) rows of typed plans, with the ``keep`` columns."""
    head = ["plan_id", *keep]
    groups = plans.select(F.col("id").alias("plan_id"), *keep, F.explode("groups").alias("g"))
    waves = groups.select(
        *head, F.col("g.componentId").alias("component_id"), F.explode("g.waves").alias("w")
    )
    return waves.select(*head, "component_id", *_wave_rows())


def _wave_rows() -> list[Column]:
    """colour, pos, task_id of the wave column ``w``, a row per task."""
    first = F.coalesce(F.col("w.firstPos"), F.lit(1).cast("bigint"))
    tasks = F.transform(
        "w.taskIds",
        lambda t, k: F.struct(
            F.col("w.colour").alias("colour"), (first + k).cast("bigint").alias("pos"), t.alias("task_id")
        ),
    )
    return [F.inline(tasks)]


def group_waves(groups: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """(keep, component, colour, pos, task) rows of nested groups, whatever parts they come in."""
    waves = groups.select(*keep, "component_id", F.explode("waves").alias("w"))
    return waves.select(*keep, "component_id", *_wave_rows())
