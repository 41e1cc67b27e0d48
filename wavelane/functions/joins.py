"""Joins against tables that are expected, but not known, to be small."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavelane.session import cut_lineage

# Largest table handed to every executor; rows here are a key and a few numbers.
BROADCAST_ROWS = 200_000


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    keys: str | Sequence[str],
    how: str = "left",
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Join a big table with a per-class table without shuffling the big one.

    A handful of classes would leave a shuffled join with a handful of busy tasks, so the
    class side is broadcast after counting it. Past the bound it is an ordinary join, where
    AQE splits the skewed classes.
    """
    right = cut_lineage(right)
    if right.limit(broadcast_rows + 1).count() <= broadcast_rows:
        right = F.broadcast(right)
    return left.join(right, keys, how)
