"""Task order inside components and waves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wavelane.functions.ranking import GROUP_ROWS, rank_rows, sliced_rank
from wavelane.session import cut_lineage

COMPONENT = ["batch_id", "component"]


Policy = str | Sequence[Column]


def policy_keys(policy: Policy, columns: list[str]) -> list[Column]:
    """Sort keys of an ordering policy; every policy ends on the task id.

    PRIORITY uses a ``priority`` column (smallest first) where the tasks carry one and is
    FIFO otherwise. Unknown names mean FIFO. A list of columns is a policy of its own.
    """
    if not isinstance(policy, str):
        return [*policy, F.col("task_id").asc()]
    fifo = [F.col("created_at").asc(), F.col("task_id").asc()]
    name = policy.strip().upper()
    if name == "DEADLINE":
        return [F.col("timeout_at").asc_nulls_last(), F.col("task_id").asc()]
    if name == "PRIORITY" and "priority" in columns:
        return [F.col("priority").asc_nulls_last(), *fifo]
    return fifo


def policy_ranks(
    members: DataFrame,
    policy: Policy,
    sized_by: DataFrame | None = None,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Rank of each task in its component under a policy."""
    order = policy_keys(policy, members.columns)
    return rank_rows(members, COMPONENT, order, "policy_rank", sized_by, group_rows)


def wave_keys(
    policy: Policy, columns: list[str], locality: bool = True, pressure: bool = True
) -> list[Column]:
    """Order inside a wave: same top resource together, then light classes, then policy."""
    keys = []
    if locality:
        keys += [F.col("top_resource_class").asc(), F.col("top_resource_id").asc()]
    if pressure:
        keys.append(F.col("pressure").asc())
    return keys + policy_keys(policy, columns)


def wave_schedule(
    coloured: DataFrame,
    order: list[Column],
    sized_by: DataFrame | None = None,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Add ``pos`` (rank in the wave) and ``ordinal`` (rank in the component), both 1-based.

    Both ranks come out of one shuffle and one sort: the wave order refines the component
    order. Oversized components take the sliced path; ``sized_by`` is a cheaper frame with at
    least the same rows per component to look for them in.
    """
    sizes = (sized_by if sized_by is not None else coloured).groupBy(*COMPONENT).count()
    hot = sizes.filter(F.col("count") > group_rows).select(*COMPONENT)
    by_component = Window.partitionBy(*COMPONENT).orderBy(F.col("colour"), *order)
    by_wave = Window.partitionBy(*COMPONENT, "colour").orderBy(*order)

    def plain(df: DataFrame) -> DataFrame:
        return df.withColumn(
            "ordinal", F.row_number().over(by_component).cast("bigint")
        ).withColumn("pos", F.row_number().over(by_wave).cast("bigint"))

    if hot.isEmpty():
        return plain(coloured)
    hot = cut_lineage(hot)
    ranked = cut_lineage(
        sliced_rank(
            coloured.join(hot, COMPONENT, "left_semi"), COMPONENT, [F.col("colour"), *order], "ordinal"
        )
    )
    starts = ranked.groupBy(*COMPONENT, "colour").agg(F.min("ordinal").alias("_first"))
    big = (
        ranked.join(starts, [*COMPONENT, "colour"])
        .withColumn("pos", F.col("ordinal") - F.col("_first") + 1)
        .drop("_first")
    )
    return plain(coloured.join(hot, COMPONENT, "left_anti")).unionByName(
        big.select(*coloured.columns, "ordinal", "pos")
    )


def serial_schedule(
    members: DataFrame,
    order: list[Column],
    sized_by: DataFrame | None = None,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Colouring switched off: every task is a wave of its own, in the given order."""
    ranked = rank_rows(members, COMPONENT, order, "ordinal", sized_by, group_rows)
    return ranked.withColumn("colour", (F.col("ordinal") - 1).cast("int")).withColumn(
        "pos", F.lit(1).cast("bigint")
    )


def batch_assign(backlog: DataFrame, batch_size: int) -> DataFrame:
    """Cut the backlog, oldest first, into consecutive batches of ``batch_size`` tasks."""
    if batch_size <= 0:
        return backlog.limit(0).withColumn("batch_no", F.lit(0).cast("bigint"))
    ranked = sliced_rank(backlog, [], [F.col("created_at").asc(), F.col("task_id").asc()], "_rank")
    return ranked.withColumn("batch_no", F.floor((F.col("_rank") - 1) / batch_size)).drop("_rank")
