"""Conflict-free waves: greedy colouring in a fixed priority order.

Priority is longest estimate first, then most conflicts, then task id. Every task takes the
smallest colour no earlier conflicting task holds. Tasks of one resource all conflict, so
the colours taken so far are kept per resource and no adjacency list is needed.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import repeat

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from wavelane.functions.ranking import in_order, rank_rows, sliced_rank
from wavelane.operators.footprint import RESOURCE
from wavelane.operators.graph import VERTEX
from wavelane.session import cut_lineage

# Rows of a component that one task colours in a single pass.
COMPONENT_ROWS = 200_000


def priority() -> list[Column]:
    return [F.col("estimate_ms").desc(), F.col("degree").desc(), F.col("task_id").asc()]


def colour_priority(weighted: DataFrame) -> DataFrame:
    """Rank of each task in its batch in colouring order."""
    return rank_rows(
        weighted.select("batch_id", "task_id", "estimate_ms", "degree"),
        ["batch_id"],
        priority(),
        "priority_rank",
    )


def member_rows(shared: DataFrame, weighted: DataFrame, components: DataFrame) -> DataFrame:
    """Shared footprint rows with their component and the colouring priority of their task."""
    facts = weighted.select("batch_id", "task_id", "estimate_ms", "degree").join(
        components, VERTEX
    )
    return shared.select(
        *VERTEX, F.concat_ws("\x01", *RESOURCE).alias("resource")
    ).join(facts, VERTEX)


def _take_least(held: list[list[int]]) -> int:
    """Least colour free in every list, which is then marked taken in each of them.

    A list holds the taken colours as rising bounds ``[from, to, from, to, ...]``.
    """
    colour, settled = 0, False
    while not settled:
        settled = True
        for bounds in held:
            at = bisect_right(bounds, colour)
            if at % 2:
                colour, settled = bounds[at], False
    for bounds in held:
        at = bisect_right(bounds, colour)
        joins_left = at > 0 and bounds[at - 1] == colour
        joins_right = at < len(bounds) and bounds[at] == colour + 1
        if joins_left and joins_right:
            del bounds[at - 1 : at + 1]
        elif joins_left:
            bounds[at - 1] = colour + 1
        elif joins_right:
            bounds[at] = colour
        else:
            bounds[at:at] = [colour, colour + 1]
    return colour


def _greedy(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Colour rows sorted by (batch, component, priority); state is one component's resources.

    An optional ``bounds`` column holds the colours already taken in the row's resource.
    """
    columns = ["batch_id", "component", "task_id", "resource"]
    group, taken, task, touched = None, {}, None, {}
    for frame in frames:
        done = []
        bounds = frame["bounds"] if "bounds" in frame else repeat(())
        for *key, row_task, resource, held in zip(*(frame[c] for c in columns), bounds):
            if task is not None and (key != group or row_task != task):
                done.append((group[0], task, _take_least(list(touched.values()))))
                touched = {}
            if key != group:
                group, taken = key, {}
            task = row_task
            if resource not in taken:
                taken[resource] = [int(x) for x in held]
            touched[resource] = taken[resource]
        yield pd.DataFrame(done, columns=["batch_id", "task_id", "colour"])
    if task is not None:
        last = [(group[0], task, _take_least(list(touched.values())))]
        yield pd.DataFrame(last, columns=["batch_id", "task_id", "colour"])


def colour_schema(rows: DataFrame) -> T.StructType:
    types = {f.name: f.dataType for f in rows.schema.fields}
    return T.StructType(
        [
            T.StructField("batch_id", types["batch_id"]),
            T.StructField("task_id", types["task_id"]),
            T.StructField("colour", T.IntegerType()),
        ]
    )


def colour_small(members: DataFrame) -> DataFrame:
    """Greedy colours of components small enough for one task; many share each task.

    Sorted rows stream through in Arrow batches, so no component is ever held whole.
    """
    ordered = in_order(members, ["batch_id", "component"], [*priority(), F.col("resource")])
    rows = ordered.select("batch_id", "component", "task_id", "resource", "_turn")
    return rows.mapInPandas(_greedy, colour_schema(members))


# Buckets above this size are filled in runs instead of one task per round.
HEAVY_BUCKET = 1_000
# Tasks of one component coloured in sequence by one task when rounds stop paying off.
BLOCK_TASKS = 100_000

SPANS = "array<struct<lo:int,hi:int>>"


def _least_free(spans: Column) -> Column:
    """Least colour outside all spans."""
    return F.aggregate(
        F.array_sort(spans),
        F.lit(0),
        lambda c, s: F.when(s["lo"] <= c, F.greatest(c, s["hi"])).otherwise(c),
    )


def _nth_free(spans: Column, n: Column) -> Column:
    """The n-th colour (from 0) outside disjoint spans."""
    return F.aggregate(
        F.array_sort(spans),
        n.cast("int"),
        lambda c, s: F.when(s["lo"] <= c, c + s["hi"] - s["lo"]).otherwise(c),
    )


def _merged(spans: Column) -> Column:
    """Sorted disjoint spans covering the same colours."""

    def add(acc: Column, s: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        wider = F.struct(last["lo"].alias("lo"), F.greatest(last["hi"], s["hi"]).alias("hi"))
        joined = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(wider))
        return F.when(last["hi"] >= s["lo"], joined).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(F.array_sort(spans), F.array().cast(SPANS), add)


def _giant_rows(members: DataFrame, heavy_bucket: int) -> DataFrame:
    """Rows with the task's rank ``rk``, its heavy bucket ``h`` (if it has exactly one) or
    ``multi``, and, on heavy rows, the task's place ``pos`` in the bucket."""
    facts = members.select(*VERTEX, "component", "estimate_ms", "degree").distinct()
    ranked = sliced_rank(facts, ["batch_id", "component"], priority(), "rk").select(*VERTEX, "rk")
    bucket = ["batch_id", "resource"]
    sizes = members.groupBy(*bucket).agg((F.count(F.lit(1)) > heavy_bucket).alias("heavy"))
    rows = cut_lineage(
        members.select(*VERTEX, "component", "resource").join(ranked, VERTEX).join(sizes, bucket)
    )
    per_task = rows.groupBy(*VERTEX).agg(
        F.count_if("heavy").alias("_k"), F.max(F.when(F.col("heavy"), F.col("resource"))).alias("_h")
    )
    rows = rows.join(per_task, VERTEX).select(
        *rows.columns, F.when(F.col("_k") == 1, F.col("_h")).alias("h"), (F.col("_k") > 1).alias("multi")
    )
    light = rows.filter(~F.col("heavy")).withColumn("pos", F.lit(None).cast("bigint"))
    placed = sliced_rank(rows.filter("heavy"), bucket, [F.col("rk")], "pos")
    return cut_lineage(light.unionByName(placed))


def _round(open_rows: DataFrame, used: DataFrame) -> DataFrame:
    """One parallel step: colour every task whose earlier neighbours are all coloured.

    A task outside heavy buckets is ready when it comes first in all its buckets. In a heavy
    bucket a whole run is ready at once: its tasks up to the first that waits for a task
    elsewhere. They take the bucket's free colours in order, which is what one-by-one
    greedy gives them, up to the first task that may not have the colour of its turn.
    """
    bucket = ["batch_id", "resource"]
    light = ~F.col("heavy")
    firsts = (
        open_rows.filter(light)
        .groupBy(*bucket, "h")
        .agg(F.min("rk").alias("rk"))
        .groupBy(*bucket)
        .agg(F.slice(F.sort_array(F.collect_list(F.struct("rk", "h"))), 1, 2).alias("firsts"))
    )
    one, two = F.try_element_at("firsts", F.lit(1)), F.try_element_at("firsts", F.lit(2))
    # Waiting for a task of the same heavy bucket is settled by the order inside that bucket.
    rival = F.when(F.col("h").isNotNull() & one["h"].eqNullSafe(F.col("h")), two["rk"]).otherwise(one["rk"])
    place = F.col("pos") - F.coalesce("n", F.lit(0))
    marked = (
        open_rows.join(firsts, bucket, "left")
        .join(used, bucket, "left")
        .select(
            *VERTEX, "component", "rk", "h", "heavy",
            F.coalesce(light & (rival < F.col("rk")), F.lit(False)).alias("waits"),
            place.alias("place"),
            F.explode_outer("spans").alias("span"),
        )
    )
    tasks = marked.groupBy(*VERTEX, "component", "rk", "h").agg(
        F.bool_or("waits").alias("waits"),
        F.max("place").alias("place"),
        F.bool_and(light | (F.col("place") == 1)).alias("leads"),
        F.collect_set(F.when(light, F.col("span"))).alias("near"),
        F.collect_set(F.when(F.col("heavy"), F.col("span"))).alias("far"),
    )
    tasks = cut_lineage(tasks)
    least = _least_free(F.concat("near", "far"))

    alone = tasks.filter(F.col("h").isNull() & ~F.col("waits") & F.col("leads")).select(
        *VERTEX, least.alias("colour"), F.lit(False).alias("in_turn")
    )

    in_heavy = tasks.filter(F.col("h").isNotNull())
    stops = (
        in_heavy.filter("waits")
        .select("batch_id", "h", "rk")
        .union(open_rows.filter("heavy and multi").select("batch_id", "resource", "rk"))
        .groupBy("batch_id", "h")
        .agg(F.min("rk").alias("stop"))
    )
    turn = _nth_free(F.col("far"), F.col("place") - 1)
    held = F.exists("near", lambda s: (s["lo"] <= F.col("turn")) & (F.col("turn") < s["hi"]))
    runs = (
        in_heavy.join(stops, ["batch_id", "h"], "left")
        .filter(~F.col("waits") & (F.col("stop").isNull() | (F.col("rk") < F.col("stop"))))
        .select(*VERTEX, "h", "rk", "place", "near", turn.alias("turn"), least.alias("least"))
        .select(
            *VERTEX, "h", "rk", "place", "turn", "least",
            F.when(F.col("place") == 1, F.col("turn") != F.col("least")).otherwise(held).alias("off"),
        )
    )
    ends = runs.filter("off").groupBy("batch_id", "h").agg(F.min("rk").alias("end"))
    lead = F.col("place") == 1
    in_runs = (
        runs.join(ends, ["batch_id", "h"], "left")
        .filter(F.col("end").isNull() | (F.col("rk") < F.col("end")) | lead)
        .select(
            *VERTEX,
            F.when(lead, F.col("least")).otherwise(F.col("turn")).alias("colour"),
            (~(lead & F.col("off"))).alias("in_turn"),
        )
    )
    return alone.unionByName(in_runs)


def _block(open_rows: DataFrame, used: DataFrame, block_tasks: int) -> DataFrame:
    """Colour the next tasks of each component one by one, a bounded number of them."""
    slot = F.floor(F.col("rk") / block_tasks).alias("slot")
    filled = (
        open_rows.select("batch_id", "component", "rk", slot)
        .distinct()
        .groupBy("batch_id", "component", "slot")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    upto = Window.partitionBy("batch_id", "component").orderBy("slot")
    chosen = (
        filled.withColumn("total", F.sum("n").over(upto))
        .withColumn("nth", F.row_number().over(upto))
        .filter((F.col("total") <= block_tasks) | (F.col("nth") == 1))
        .groupBy("batch_id", "component")
        .agg(F.max("slot").alias("last"))
    )
    bounds = F.flatten(F.transform("spans", lambda s: F.array(s["lo"], s["hi"])))
    rows = (
        open_rows.join(chosen, ["batch_id", "component"])
        .filter(F.floor(F.col("rk") / block_tasks) <= F.col("last"))
        .join(used, ["batch_id", "resource"], "left")
        .select(
            "batch_id", "component", "task_id", "resource", "rk",
            F.coalesce(bounds, F.array().cast("array<int>")).alias("bounds"),
        )
    )
    ordered = in_order(rows, ["batch_id", "component"], [F.col("rk"), F.col("resource")])
    return ordered.mapInPandas(_greedy, colour_schema(rows)).withColumn("in_turn", F.lit(False))


def _use(used: DataFrame, open_rows: DataFrame, coloured: DataFrame) -> DataFrame:
    """Colours taken per bucket as merged spans, and the number of coloured tasks."""
    bucket = ["batch_id", "resource"]
    new = open_rows.select(*VERTEX, "resource", "heavy").join(coloured, VERTEX)
    run = F.col("heavy") & F.col("in_turn")
    span = lambda lo, hi: F.array(F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi")))
    # A run takes every free colour up to its largest one.
    runs = new.filter(run).groupBy(*bucket).agg(
        F.count(F.lit(1)).alias("n"), span(F.lit(0), F.max("colour") + 1).alias("spans")
    )
    island = F.col("colour") - F.row_number().over(Window.partitionBy(*bucket).orderBy("colour"))
    single = (
        new.filter(~run)
        .withColumn("_i", island)
        .groupBy(*bucket, "_i")
        .agg(F.count(F.lit(1)).alias("n"), span(F.min("colour"), F.max("colour") + 1).alias("spans"))
        .drop("_i")
    )
    return (
        used.unionByName(runs)
        .unionByName(single)
        .groupBy(*bucket)
        .agg(F.sum("n").alias("n"), _merged(F.flatten(F.collect_list("spans"))).alias("spans"))
    )


def colour_giants(
    members: DataFrame, heavy_bucket: int = HEAVY_BUCKET, block_tasks: int = BLOCK_TASKS
) -> DataFrame:
    """Greedy colours of components too large for one task, equal to the one-by-one result.

    Parallel rounds run as long as they colour plenty of tasks. Where long chains leave
    only a few ready at a time, bounded blocks of the chain are coloured in sequence, twice
    as many after each poor round.
    """
    open_rows = _giant_rows(members, heavy_bucket)
    types = dict(open_rows.dtypes)
    used = open_rows.sparkSession.createDataFrame(
        [], f"batch_id {types['batch_id']}, resource string, n bigint, spans {SPANS}"
    )
    done: DataFrame | None = None
    blocks, poor = 0, 0
    while not open_rows.isEmpty():
        if blocks:
            coloured = cut_lineage(_block(open_rows, used, block_tasks))
            blocks -= 1
        else:
            coloured = cut_lineage(_round(open_rows, used))
            poor = poor + 1 if coloured.count() < block_tasks else 0
            blocks = min(2**poor, 1_024) if poor else 0
        used = cut_lineage(_use(used, open_rows, coloured))
        open_rows = cut_lineage(open_rows.join(coloured, VERTEX, "left_anti"))
        found = coloured.select("batch_id", "task_id", "colour")
        done = found if done is None else done.unionByName(found)
    return done


def colour_waves(members: DataFrame, component_rows: int = COMPONENT_ROWS) -> DataFrame:
    """(batch_id, task_id, colour) for every task that has conflicts."""
    sizes = members.groupBy("batch_id", "component").agg(F.count(F.lit(1)).alias("_rows"))
    giant = sizes.filter(F.col("_rows") > component_rows).select("batch_id", "component")
    if giant.isEmpty():
        return colour_small(members)
    giant = cut_lineage(giant)
    keys = ["batch_id", "component"]
    small = colour_small(members.join(giant, keys, "left_anti"))
    return small.unionByName(colour_giants(members.join(giant, keys, "left_semi")))
