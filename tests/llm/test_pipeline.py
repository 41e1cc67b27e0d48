"""The contract of the queries and the stages of the pipeline."""

import os

import pytest

import corpus_pipeline
from tests.llm.helpers import awkward, clashing, empty
from wavelane.llm import queries
from wavelane.llm.common import staged
from wavelane.session import configure

FOLDER = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def test_one_query_per_operator():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.queries() if n.startswith("op"))
    assert numbers == list(range(1, 14)) and "pipeline" in queries.queries()
    assert set(queries.oracle_sql()) <= set(queries.queries())


@needs_tables
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    import duckdb

    from tools.check_queries import TABLES, rows

    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    df = queries.queries()[name](spark, FOLDER)
    want = db.sql(queries.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(want.columns, want.fetchall())


@needs_tables
def test_stages(spark):
    configure(spark)
    for docs in (clashing(awkward(spark)), clashing(empty(spark))):
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = staged(stage(spark, docs, FOLDER), name)
            assert k == len(corpus_pipeline.STAGES) - 1 or out.schema.names == docs.schema.names
            assert out.count() <= docs.count()
            docs = out


@needs_tables
def test_whole_run(spark):
    out = corpus_pipeline.run(spark, FOLDER)
    rows = out.collect()
    ids = {r.doc_id for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id").collect()}
    assert 0 < len(rows) <= len(ids) and {r.doc_id for r in rows} <= ids
    assert all(r.n_tokens == len(r.ids) for r in rows)
