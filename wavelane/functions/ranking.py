"""Ranks inside groups that may be too large for one task.

``row_number`` puts a whole group on one task. That is the right plan while groups are
small, and the wrong one for a group holding a third of the table. ``rank_rows`` looks at
the group sizes and sends only the oversized groups down a second path, where the rows are
range-partitioned by (group, order) and each slice adds the count of the slices before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wavelane.session import cut_lineage

# Rows of one group that a single task may sort.
GROUP_ROWS = 2_000_000


def slice_count(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def in_slices(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Rows range-partitioned by (keys, order), with the number of their slice as ``_slice``.

    Materialised, because boundaries come from sampling and every reader has to see the same ones.
    """
    by = [*[F.col(k) for k in keys], *[F.col(c) if isinstance(c, str) else c for c in order]]
    return cut_lineage(df.repartitionByRange(slice_count(df), *by).withColumn("_slice", F.spark_partition_id()))


def sliced_rank(df: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str) -> DataFrame:
    """1-based rank by ``order`` inside ``keys``; no task holds more than one range slice.

    ``order`` must be total. With no keys the rank is global.
    """
    keys = list(keys)
    placed = in_slices(df, keys, order)
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(*keys, "_slice")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order)
    return (
        placed.withColumn("_in", F.row_number().over(inside))
        .join(offsets, [*keys, "_slice"])
        .withColumn(out, F.col("_before") + F.col("_in"))
        .drop("_slice", "_in", "_before")
    )


def rank_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    out: str,
    sized_by: DataFrame | None = None,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """1-based ``bigint`` rank by ``order`` inside ``keys``, whatever the group sizes.

    ``sized_by`` is a cheaper frame with the same groups to take the sizes from.
    """
    keys = list(keys)
    sizes = (sized_by if sized_by is not None else df).groupBy(*keys).count()
    # At most rows / group_rows groups qualify, so this list is short by construction.
    hot = sizes.filter(F.col("count") > group_rows).select(*keys)
    plain = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint")
    if hot.isEmpty():
        return df.withColumn(out, plain)
    hot = cut_lineage(hot)
    cold_rows = df.join(hot, keys, "left_anti").withColumn(out, plain)
    return cold_rows.unionByName(sliced_rank(df.join(hot, keys, "left_semi"), keys, order, out))


def in_order(df: DataFrame, keys: Sequence[str], order: Sequence[Column], turn: str = "_turn") -> DataFrame:
    """Rows of a group together on one task and sorted, for a function that streams over them.

    The order number is what makes this hold: a window states that it needs its groups whole,
    while a bare ``repartition`` above a join on the same keys is dropped by Spark, which may
    then split a skewed group. Pass ``turn`` on to the function, or the window is pruned.
    """
    return df.withColumn(turn, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
