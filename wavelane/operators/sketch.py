"""Count-min frequency sketch as a table of (depth, cell, count) rows.

Each key is hashed once per depth row; a key's estimate is the least of its cells, which can
be too high but never too low. The sketch has at most depth x width rows whatever the input,
merging two is a union and a sum, and its size bound makes it safe to broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The sketch dimensions.
DEPTH = 5
WIDTH = 65_536

# Widest sketch row that is sent to every executor.
BROADCAST_CELLS = 1_000_000


def _cells(keys: Sequence[Column], depth: int, width: int) -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(d).alias("depth"),
                F.pmod(F.xxhash64(F.lit(d), *keys), F.lit(width)).cast("int").alias("cell"),
            )
            for d in range(depth)
        ]
    )


def build(rows: DataFrame, keys: Sequence[str], depth: int = DEPTH, width: int = WIDTH) -> DataFrame:
    """Sketch of how often each key occurs. Partial counts bound the shuffle by the sketch size."""
    cols = [F.col(k) for k in keys]
    return (
        rows.select(F.inline(_cells(cols, depth, width)))
        .groupBy("depth", "cell")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )


def merge(one: DataFrame, other: DataFrame) -> DataFrame:
    return one.unionByName(other).groupBy("depth", "cell").agg(F.sum("cnt").alias("cnt"))


def seed(
    sketch: DataFrame,
    counts: DataFrame,
    keys: Sequence[str],
    count_col: str,
    depth: int = DEPTH,
    width: int = WIDTH,
) -> DataFrame:
    """Raise the cells of given keys to at least their known counts; nothing is lowered."""
    cols = [F.col(k) for k in keys]
    raised = (
        counts.select(F.col(count_col).cast("bigint").alias("cnt"), F.inline(_cells(cols, depth, width)))
        .groupBy("depth", "cell")
        .agg(F.max("cnt").alias("cnt"))
    )
    return sketch.unionByName(raised).groupBy("depth", "cell").agg(F.max("cnt").alias("cnt"))


def reset(sketch: DataFrame) -> DataFrame:
    return sketch.limit(0)


def estimate(
    sketch: DataFrame,
    queried: DataFrame,
    keys: Sequence[str],
    depth: int = DEPTH,
    width: int = WIDTH,
) -> DataFrame:
    """Estimated count of each queried key, 0 for one never seen.

    Every depth row of the sketch is joined on its own, so keys are neither multiplied nor shuffled for the lookup;
    a row has at most ``width`` cells and is broadcast up to ``BROADCAST_CELLS``.
    """
    asked = queried.select(*keys).distinct()
    cells = _cells([F.col(k) for k in keys], depth, width)
    out = asked.withColumns({f"_c{d}": cells[d]["cell"] for d in range(depth)})
    zero = F.lit(0).cast("bigint")
    for d in range(depth):
        row = sketch.filter(F.col("depth") == d).select(F.col("cell").alias(f"_c{d}"), F.col("cnt").alias(f"_n{d}"))
        out = out.join(F.broadcast(row) if width <= BROADCAST_CELLS else row, f"_c{d}", "left")
    counts = [F.coalesce(f"_n{d}", zero) for d in range(depth)]
    return out.select(*keys, (F.least(*counts) if depth > 1 else counts[0]).alias("estimate"))
