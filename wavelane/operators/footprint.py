"""Which resources each task touches."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavelane.session import cut_lineage

RESOURCE = ["resource_class", "resource_id"]

# Classes of the resources that a search lookup adds.
LOOKED_UP = ("project", "connection", "talk", "transcription", "tag-set", "tag")

# The fields of a task's search JSON that a lookup may use.
SEARCH = """projectId string, `from` string, `to` string, tagSetId string, talkId string,
    engine string"""


def footprint(tasks: DataFrame, resources: DataFrame) -> DataFrame:
    """Distinct (batch_id, task_id, resource) rows; a task without any gets its top resource.

    The match is an inner join, so that a task with a huge footprint can be split by AQE
    from either side; the fallback only needs the distinct keys.
    """
    wanted = tasks.select("batch_id", "task_id")
    matched = wanted.join(resources.select("task_id", *RESOURCE), "task_id").select(
        "batch_id", "task_id", *RESOURCE
    )
    bare = tasks.join(resources.select("task_id").distinct(), "task_id", "left_anti").select(
        "batch_id",
        "task_id",
        F.col("top_resource_class").alias("resource_class"),
        F.col("top_resource_id").alias("resource_id"),
    )
    return matched.distinct().unionByName(bare)


def resolved_tasks(tasks: DataFrame, failed: DataFrame) -> DataFrame:
    """Tasks whose resource lookup did not fail; the others stay out of the plan."""
    return tasks.join(failed.select("task_id").distinct(), "task_id", "left_anti")


def skipped_tasks(tasks: DataFrame, planned: DataFrame) -> DataFrame:
    """Batch rows that did not make it into the plan, unresolved or denied."""
    return tasks.join(planned.select("task_id").distinct(), "task_id", "left_anti")


def dependency_closure(
    deps: DataFrame, child: str = "tag_id", parent: str = "depends_on", roots: DataFrame | None = None
) -> DataFrame:
    """Every (child, ancestor) pair of a dependency table, each once; cycles end by themselves.

    With ``roots`` only the pairs of those children. Steps of length 1, 2, 4 ... are kept for all rows, pairs for the asked ones:
    a round appends one long step to every pair found so far, so each length of path is made up in one way, and the number
    of rounds is the logarithm of the longest path.
    """
    steps = cut_lineage(deps.select(child, parent).filter(F.col(parent).isNotNull()).distinct())
    found = steps if roots is None else steps.join(roots.select(child).distinct(), child, "left_semi")
    found = cut_lineage(found)
    asked = None if roots is None else cut_lineage(roots.select(child).distinct())
    known = found.count()
    while True:
        via = F.col(child).alias("_via")
        doubled = steps.select(child, F.col(parent).alias("_via")).join(steps.select(via, parent), "_via")
        steps = cut_lineage(doubled.select(child, parent).distinct())
        own = steps if asked is None else steps.join(asked, child, "left_semi")
        longer = found.select(child, F.col(parent).alias("_via")).join(steps.select(via, parent), "_via")
        found = cut_lineage(found.union(own).union(longer.select(child, parent)).distinct())
        grown = found.count()
        if grown == known:
            return found
        known = grown


def range_footprint(
    tasks: DataFrame,
    connections: DataFrame,
    talks: DataFrame,
    tag_sets: DataFrame,
    tag_closure: DataFrame,
    slice_days: int = 7,
) -> DataFrame:
    """Footprint looked up from a task's search JSON.

    Adds the project, its connections, the talks of those connections dated inside
    ``[from, to]`` (only the named one where ``talkId`` is set) with their transcriptions,
    the tag set, its tags and their dependencies. The date range is cut into slices so that
    the range match is an equi join on (project, slice) with the exact test on top.

    The rows are a set. Those of a task that is listed once and whose top resource is of another class than what is looked
    up are distinct as they are made, and are not shuffled again; only the other tasks' rows are compared.

    ``connections(project_id, connection_id)``, ``talks(talk_id, connection_id, talked_on)``,
    ``tag_sets(tag_set_id, tag_id)``, ``tag_closure(tag_id, depends_on)``.
    """
    text = F.from_json("search_dsl", SEARCH)
    dsl = cut_lineage(
        tasks.select("task_id", "top_resource_class", "top_resource_id", text.alias("q")).select(
            "task_id",
            "top_resource_class",
            "top_resource_id",
            F.col("q.projectId").alias("project_id"),
            F.col("q.from").cast("date").alias("from_day"),
            F.col("q.to").cast("date").alias("to_day"),
            F.col("q.tagSetId").alias("tag_set_id"),
            F.col("q.talkId").alias("only_talk"),
        )
    )

    def slice_of(day: Column) -> Column:
        return F.floor(F.unix_date(day) / slice_days)

    def resource(cls: str | Column, value: str) -> Column:
        cls = F.lit(cls) if isinstance(cls, str) else cls
        return F.struct(cls.alias("resource_class"), F.col(value).alias("resource_id"))

    def rows(df: DataFrame, *resources: Column) -> DataFrame:
        named = df.select("task_id", F.inline(F.array(*resources)))
        return named.filter(F.col("resource_id").isNotNull())

    connections = connections.select("project_id", "connection_id").distinct()
    dated = talks.join(connections, "connection_id").select(
        "project_id", "talk_id", "talked_on", slice_of(F.col("talked_on")).alias("_slice")
    )
    set_tags = tag_sets.select("tag_set_id", "tag_id")
    all_tags = set_tags.unionByName(
        set_tags.join(tag_closure, "tag_id").select("tag_set_id", F.col("depends_on").alias("tag_id"))
    ).distinct()

    def looked_up(dsl: DataFrame) -> list[DataFrame]:
        linked = dsl.select("task_id", "project_id").join(connections, "project_id")
        asked = dsl.filter(F.col("project_id").isNotNull()).select(
            "task_id",
            "project_id",
            "from_day",
            "to_day",
            "only_talk",
            F.explode(F.sequence(slice_of(F.col("from_day")), slice_of(F.col("to_day")))).alias("_slice"),
        )
        spoken = asked.join(dated, ["project_id", "_slice"]).filter(
            F.col("talked_on").between(F.col("from_day"), F.col("to_day"))
            & (F.col("only_talk").isNull() | (F.col("only_talk") == F.col("talk_id")))
        )
        tagged = dsl.filter(F.col("tag_set_id").isNotNull()).select("task_id", "tag_set_id")
        return [
            rows(
                dsl,
                resource(F.col("top_resource_class"), "top_resource_id"),
                resource("project", "project_id"),
                resource("tag-set", "tag_set_id"),
            ),
            rows(linked, resource("connection", "connection_id")),
            rows(
                spoken.select("task_id", "talk_id").distinct(),
                resource("talk", "talk_id"),
                resource("transcription", "talk_id"),
            ),
            rows(tagged.join(all_tags, "tag_set_id"), resource("tag", "tag_id")),
        ]

    among = F.coalesce(F.col("top_resource_class").isin(*LOOKED_UP), F.lit(False))
    per_task = dsl.groupBy(F.col("task_id").alias("_task")).agg(
        F.count(F.lit(1)).alias("_n"), F.bool_or(among).alias("_among")
    )
    mixed = cut_lineage(per_task.filter((F.col("_n") > 1) | F.col("_among")).select("_task"))
    if mixed.isEmpty():
        return reduce(DataFrame.unionByName, looked_up(dsl))
    same = F.col("task_id").eqNullSafe(F.col("_task"))
    plain, rest = (cut_lineage(dsl.join(mixed, same, how)) for how in ("left_anti", "left_semi"))
    return reduce(DataFrame.unionByName, looked_up(plain)).unionByName(union_footprints(looked_up(rest)))


def union_footprints(sources: Sequence[DataFrame]) -> DataFrame:
    """Set union of several footprint sources."""
    whole = sources[0]
    for more in sources[1:]:
        whole = whole.unionByName(more)
    return whole.distinct()
