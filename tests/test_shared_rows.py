"""Rows of shared resources against counting by hand, and how often they shuffle the footprint."""

import random

import pytest
from pyspark.sql import functions as F

from wavelane.operators import graph
from wavelane.session import cut_lineage

SCHEMA = "batch_id bigint, task_id bigint, resource_class string, resource_id string"


@pytest.mark.parametrize("broadcast", [1_000_000, 0])
def test_rows_sizes_and_centres(spark, monkeypatch, broadcast):
    monkeypatch.setattr(graph, "WIDE_BUCKETS", broadcast)
    rnd = random.Random(5)
    rows = {(b, t, rnd.choice("kl"), f"r{rnd.randrange(300)}") for b in (1, 2) for t in range(150) for _ in range(2)}
    rows |= {(1, t, "k", "hot") for t in range(100)}
    nulls = {(1, 7, None, "r"), (1, 8, None, "r"), (2, 7, "k", None), (2, 8, "k", None)}
    holders = {}
    for b, t, c, r in rows:
        holders.setdefault((b, c, r), set()).add(t)
    expected = {
        (b, c, r, t, len(ts), min(ts)) for (b, c, r), ts in holders.items() if len(ts) > 1 for t in ts
    }
    found = graph.shared_rows(spark.createDataFrame([*rows, *nulls], SCHEMA))
    assert found.columns == [*graph.BUCKET, "task_id", "bucket_size", "centre"]
    found = [tuple(r) for r in found.collect()]
    assert len(found) == len(expected) and set(found) == expected


def test_rows_are_not_shuffled_again_for_a_join(spark):
    fp = cut_lineage(
        spark.range(20_000).select(
            F.lit(1).cast("bigint").alias("batch_id"),
            F.col("id").alias("task_id"),
            F.lit("k").alias("resource_class"),
            F.when(F.col("id") < 300, F.lit("hot")).otherwise((F.col("id") % 12_000).cast("string")).alias("resource_id"),
        )
    )
    plan = graph.shared_rows(fp)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
