"""Running sums over long ordered groups, as parallel prefix scans.

A window that runs over a whole group needs the group on one task. Here rows are range-partitioned by (group, order), so a
group of any size, even one whose rows all carry one time, spreads over as many tasks as it needs. A window runs inside every slice,
slices are summed up, a second window runs over the (few) slice sums of a group, and the two are combined.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wavelane.functions.ranking import in_slices


def _windows(keys: list[str], order: Sequence[str], inclusive: bool = True):
    """Rows of a slice up to the current one, and slices of a group before the current one."""
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order)
    before = Window.partitionBy(*keys).orderBy("_slice")
    first = Window.unboundedPreceding
    return inside.rowsBetween(first, 0 if inclusive else -1), before.rowsBetween(first, -1)


def running_sums(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: dict[str, Column], inclusive: bool = True
) -> DataFrame:
    """Add one running sum per entry of ``sums``; ``order`` must be total inside ``keys``.

    With ``inclusive=False`` the current row is left out and the first row reads 0.
    """
    keys = list(keys)
    inside, before = _windows(keys, order, inclusive)
    zero = F.lit(0)
    placed = in_slices(df, keys, order)
    slices = placed.groupBy(*keys, "_slice").agg(*[F.sum(c).alias(f"_s_{n}") for n, c in sums.items()])
    carried = slices.select(
        *keys, "_slice", *[F.coalesce(F.sum(f"_s_{n}").over(before), zero).alias(f"_c_{n}") for n in sums]
    )
    local = placed.select(
        "*", *[F.coalesce(F.sum(c).over(inside), zero).alias(f"_l_{n}") for n, c in sums.items()]
    )
    joined = local.join(carried, [*keys, "_slice"])
    return joined.select(
        *[joined[c] for c in df.columns],
        *[(F.col(f"_c_{n}") + F.col(f"_l_{n}")).alias(n) for n in sums],
    )


def running_max(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str) -> DataFrame:
    """Add the largest ``value`` so far inside ``keys``."""
    keys = list(keys)
    inside, before = _windows(keys, order)
    placed = in_slices(df, keys, order)
    tops = placed.groupBy(*keys, "_slice").agg(F.max(value).alias("_top"))
    carried = tops.select(*keys, "_slice", F.max("_top").over(before).alias("_carried"))
    joined = placed.withColumn("_local", F.max(value).over(inside)).join(carried, [*keys, "_slice"])
    return joined.select(*[joined[c] for c in df.columns], F.greatest("_local", "_carried").alias(out))


def clamped_balance(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    delta: str,
    out: str,
    seed: Column | None = None,
) -> DataFrame:
    """Running balance that is reset to 0 whenever it would fall below it.

    With S the plain running sum (seed included) the clamped value is
    ``S - min(0, lowest S so far)``. Sum and lowest prefix both combine across slices, so
    the scan is exact.
    """
    keys = list(keys)
    inside, before = _windows(keys, order)
    placed = in_slices(df.withColumn("_seed", (F.lit(0) if seed is None else seed).cast("bigint")), keys, order)
    local = placed.withColumn("_s", F.sum(delta).over(inside)).withColumn("_low", F.min("_s").over(inside))
    slices = local.groupBy(*keys, "_slice").agg(
        F.sum(delta).alias("_t"), F.min("_s").alias("_m"), F.first("_seed").alias("_seed")
    )
    opened = slices.withColumn("_start", F.coalesce(F.sum("_t").over(before), F.lit(0)) + F.col("_seed"))
    carried = opened.select(
        *keys, "_slice", "_start", F.min(F.col("_start") + F.col("_m")).over(before).alias("_floor")
    )
    joined = local.drop("_seed").join(carried, [*keys, "_slice"])
    total = F.col("_start") + F.col("_s")
    lowest = F.least(F.lit(0), F.col("_floor"), F.col("_start") + F.col("_low"))
    return joined.select(*[joined[c] for c in df.columns], (total - lowest).alias(out))
