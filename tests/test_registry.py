"""The driver contract and a sample of queries against their SQL."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as contract  # noqa: E402
from wavelane import oracles, registry  # noqa: E402
from tools.check_queries import TABLES, rows  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
SAMPLE = ["conflict_edges", "supplier_degree", "plan_metrics", "class_admission", "plan_as_of", "apply_outcomes", "edge_shared_resources"]

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def test_every_query_has_sql():
    assert set(registry.queries()) == set(oracles.oracle_sql())
    assert set(registry.queries()) <= set(contract.queries())


def test_entry(spark):
    df = contract.entry(spark)
    assert "parallelism_factor" in df.columns and df.count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    df = contract.queries()[name](spark, FOLDER)
    want = db.sql(contract.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(want.columns, want.fetchall())
