"""Looked-up footprints are sets, also where tasks are listed twice or their top resource is looked up as well."""

import json
from datetime import date

from wavelane.operators import footprint

TASKS = "task_id bigint, top_resource_class string, top_resource_id string, search_dsl string"


def frames(spark, tasks):
    rows = [(t, c, r, json.dumps(dsl) if dsl is not None else None) for t, c, r, dsl in tasks]
    day = date(2026, 1, 5)
    return (
        spark.createDataFrame(rows, TASKS),
        spark.createDataFrame([("1", "c1"), ("1", "c1"), ("1", "c2")], "project_id string, connection_id string"),
        spark.createDataFrame(
            [("t1", "c1", day), ("t1", "c2", date(2026, 1, 9)), ("t2", "c2", date(2026, 2, 1))],
            "talk_id string, connection_id string, talked_on date",
        ),
        spark.createDataFrame([("s1", "a"), ("s1", "b"), ("s2", "b")], "tag_set_id string, tag_id string"),
        spark.createDataFrame([("a", "b"), ("b", "z"), ("a", "z")], "tag_id string, depends_on string"),
    )


def dsl(tag_set):
    return {"projectId": "1", "from": "2026-01-01", "to": "2026-01-20", "tagSetId": tag_set}


EACH = {("project", "1"), ("connection", "c1"), ("connection", "c2"), ("talk", "t1"), ("transcription", "t1")}
S1 = {("tag-set", "s1"), ("tag", "a"), ("tag", "b"), ("tag", "z")}
S2 = {("tag-set", "s2"), ("tag", "b"), ("tag", "z")}


def found(df):
    return sorted(map(tuple, df.collect()), key=str)


def wanted(sets):
    return sorted(((t, *r) for t, rs in sets.items() for r in rs), key=str)


def test_rows_of_tasks_listed_once_are_distinct_without_another_shuffle(spark):
    tasks = [(1, "own", "x", dsl("s1")), (2, None, "y", dsl("s2")), (3, "own", None, None)]
    df = footprint.range_footprint(*frames(spark, tasks))
    assert found(df) == wanted({1: EACH | S1 | {("own", "x")}, 2: EACH | S2 | {(None, "y")}})
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert not plan.startswith("Aggregate")


def test_tasks_listed_twice_or_with_a_looked_up_top_resource(spark):
    tasks = [
        (1, "own", "x", dsl("s1")),
        (4, "own", "x", dsl("s1")), (4, "own", "x", dsl("s2")), (4, "own", "x", dsl("s2")),
        (5, "tag", "b", dsl("s1")),
        (None, "own", "x", dsl("s2")), (None, "own", "x", dsl("s2")),
    ]
    df = footprint.range_footprint(*frames(spark, tasks))
    own = {("own", "x")}
    assert found(df) == wanted({1: EACH | S1 | own, 4: EACH | S1 | S2 | own, 5: EACH | S1, None: EACH | S2 | own})
