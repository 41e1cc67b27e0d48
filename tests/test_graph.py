"""Graph operators against plain-Python references on random footprints."""

import random
from collections import Counter
from pathlib import Path
from urllib.parse import unquote, urlparse

import pytest
from pyspark.sql import functions as F

from tests.helpers import components as plain_components
from tests.helpers import greedy, neighbours
from wavelane.operators import colouring, components, graph, sketch
from wavelane.session import cut_lineage


def random_footprints(seed, n, kind):
    rnd, found = random.Random(seed), {}
    for t in range(n):
        rs = {f"r{rnd.randrange(n)}" for _ in range(2)}
        if kind == "hot" and rnd.random() < 0.6:
            rs.add("hot")
        if kind == "several hot":
            rs |= {rnd.choice(["h1", "h2", "h3"]) for _ in range(rnd.choice([1, 1, 1, 2]))}
        if kind == "clique":
            rs = {"hot", f"r{t}"}
        found[t] = rs
    return found


def shared(spark, footprints):
    rows = [(1, t, "k", r) for t, rs in footprints.items() for r in rs]
    fp = spark.createDataFrame(
        rows, "batch_id bigint, task_id bigint, resource_class string, resource_id string"
    )
    return cut_lineage(graph.shared_rows(fp))


KINDS = ["sparse", "hot", "several hot", "clique"]


@pytest.mark.parametrize("kind", ["sparse", "several hot"])
def test_edges_degrees_and_components(spark, kind):
    fp = random_footprints(3, 60, kind)
    near, rows = neighbours(fp), shared(spark, fp)
    edges = {(r.u, r.v) for r in graph.conflict_edges(rows, tile_rows=7).collect()}
    assert edges == {(t, v) for t in near for v in near[t] if t < v}
    for pairwise, sets in ((64, 1000), (3, 1000), (3, 7), (1, 1000)):
        degree = {r.task_id: r.degree for r in graph.degrees(rows, pairwise, sets).collect()}
        assert {t: degree.get(t, 0) for t in near} == {t: len(near[t]) for t in near}
    vertices = spark.createDataFrame([(1, t) for t in fp], "batch_id bigint, task_id bigint")
    found = components.connected_components(vertices, components.component_stars(rows))
    assert {r.task_id: r.component for r in found.collect()} == plain_components(fp)


def test_degrees_of_tasks_in_many_large_buckets(spark, monkeypatch):
    """200 tasks in 15 buckets each, of 5 000 tasks in any: no subsets, no pairs, in two batches."""
    rnd = random.Random(9)
    monkeypatch.setattr(graph, "UNION_ROWS", 50)
    fp = {t: {f"h{rnd.randrange(40)}" for _ in range(rnd.choice([1, 1, 2]))} for t in range(5000)}
    fp |= {t: set(rnd.sample([f"h{k}" for k in range(40)], 15)) for t in range(200)}
    rows = [(b, t * 8, "k", r) for b in (1, 2) for t, rs in fp.items() for r in rs if b == 1 or t % 3]
    frame = spark.createDataFrame(rows, "batch_id bigint, task_id bigint, resource_class string, resource_id string")
    found = graph.degrees(cut_lineage(graph.shared_rows(frame)), set_rows=300)
    plan = found._jdf.queryExecution().toString()
    assert "pow" not in plan.lower()
    got = {(r.batch_id, r.task_id): r.degree for r in found.collect()}
    for b in (1, 2):
        own = {t * 8: rs for t, rs in fp.items() if b == 1 or t % 3}
        holders = {}
        for t, rs in own.items():
            for r in rs:
                holders.setdefault(r, set()).add(t)
        want = {t: len(set().union(*[holders[r] for r in rs])) - 1 for t, rs in own.items()}
        assert {t: d for (k, t), d in got.items() if k == b} == want


@pytest.mark.parametrize("subset_buckets", [2, 4])
def test_degrees_of_tasks_on_both_sides_of_the_subset_limit(spark, subset_buckets):
    rnd = random.Random(5)
    fp = {t: {f"h{rnd.randrange(9)}" for _ in range(rnd.randrange(1, 7))} | {f"s{t // 3}"} for t in range(300)}
    near, rows = neighbours(fp), shared(spark, fp)
    found = graph.degrees(rows, 3, 50, subset_buckets, 40)
    assert {r.task_id: r.degree for r in found.collect()} == {t: len(n) for t, n in near.items()}


@pytest.mark.parametrize("group_rows", [10, 100_000])
def test_degrees_through_large_buckets_need_no_bitmaps(spark, monkeypatch, group_rows):
    """Overlaps are counted by subsets of a task's buckets; bitmaps meet every piece of the sets and grow with its square."""
    rnd = random.Random(4)
    fp = {t: {f"h{rnd.randrange(9)}" for _ in range(rnd.randrange(1, 7))} for t in range(400)}
    near, rows = neighbours(fp), shared(spark, fp)
    monkeypatch.setattr(graph, "_union_sizes", None)
    monkeypatch.setattr(graph, "BLOCK_ENTRIES", 50)
    found = graph.degrees(rows, 3, group_rows=group_rows)
    assert {r.task_id: r.degree for r in found.collect()} == {t: len(n) for t, n in near.items()}


def test_degrees_over_several_chunks(spark):
    rows = spark.range(70_000).selectExpr("1L as batch_id", "id as task_id", "'k' as resource_class", "explode(filter(array(concat('h', id % 2), if(id % 3 = 0, 't', null)), x -> x is not null)) as resource_id")
    found = graph.degrees(cut_lineage(graph.shared_rows(rows)))
    sizes = {(p, t): 35_000 + (sum(1 for k in range(70_000) if k % 3 == 0 and k % 2 != p) if t else 0) - 1 for p in (0, 1) for t in (0, 1)}
    got = found.selectExpr("task_id % 2 p", "int(task_id % 3 = 0) t", "degree").groupBy("p", "t").agg(F.min("degree"), F.max("degree"))
    assert {(r[0], r[1]): (r[2], r[3]) for r in got.collect()} == {k: (v, v) for k, v in sizes.items()}


@pytest.mark.parametrize("group_rows", [10, 100_000])
def test_degrees_in_several_passes(spark, group_rows):
    rnd = random.Random(6)
    fp = {t: {f"h{rnd.randrange(9)}" for _ in range(rnd.randrange(1, 7))} for t in range(400)}
    near, rows = neighbours(fp), shared(spark, fp)
    found = graph.degrees(rows, 3, group_rows=group_rows, pass_rows=150)
    assert {r.task_id: r.degree for r in found.collect()} == {t: len(n) for t, n in near.items()}


def test_degrees_leave_no_large_shuffles_and_only_tables_still_read(spark):
    """What remains on disk before the result is read: 100 000 rows of footprint in 200 buckets shuffled 1.3 MB."""
    fp = spark.range(50_000).selectExpr(
        "1L as batch_id", "id as task_id", "'k' as resource_class", "explode(array(concat('a', id % 90), concat('b', id % 110))) as resource_id"
    )
    rows = cut_lineage(graph.shared_rows(cut_lineage(fp)))
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    tables = Path(unquote(urlparse(spark.sparkContext.getCheckpointDir()).path), "tables")

    def on_disk():
        files = manager.getAllFiles()
        files = [Path(files.apply(k).getPath()) for k in range(files.size())]
        return {f: f.stat().st_size for f in files if f.name.startswith("shuffle_") and f.exists()}, set(tables.glob("*/*.parquet"))

    shuffles, written = on_disk()
    found = graph.degrees(rows)
    shuffles_after, written_after = on_disk()
    assert sum(size for f, size in shuffles_after.items() if f not in shuffles) < 100_000
    assert {f.parent.name.rsplit("-", 1)[0] for f in written_after - written} <= {"degree-sets", "degree-again"}
    assert len({f.parent for f in written_after - written}) == 2
    got = found.selectExpr("task_id % 990 as pair", "degree").groupBy("pair").agg(F.min("degree"), F.max("degree")).collect()
    sizes = [Counter(k % n for k in range(50_000)) for n in (90, 110)]
    both = Counter((k % 90, k % 110) for k in range(50_000))
    assert {r[0]: (r[1], r[2]) for r in got} == {
        p: (sizes[0][p % 90] + sizes[1][p % 110] - both[p % 90, p % 110] - 1,) * 2 for p in range(990)
    }


@pytest.mark.parametrize("kind", KINDS)
def test_colouring_paths_agree_with_one_by_one_greedy(spark, kind):
    fp = random_footprints(5, 30, kind)
    near, label = neighbours(fp), plain_components(fp)
    estimates = {t: 100 * (1 + t % 2) for t in fp}
    want = {t: c for t, c in greedy(fp, estimates).items() if near[t]}
    facts = spark.createDataFrame(
        [(1, t, label[t], estimates[t], len(near[t])) for t in fp],
        "batch_id bigint, task_id bigint, component bigint, estimate_ms bigint, degree bigint",
    )
    rows = cut_lineage(
        shared(spark, fp)
        .select("batch_id", "task_id", F.col("resource_id").alias("resource"))
        .join(facts, ["batch_id", "task_id"])
    )
    paths = {
        "one pass": colouring.colour_small(rows),
        "rounds and blocks": colouring.colour_giants(rows, heavy_bucket=5, block_tasks=6),
        "by size": colouring.colour_waves(rows, component_rows=40),
    }
    for name, frame in paths.items():
        assert {r.task_id: r.colour for r in frame.collect()} == want, name


def test_hot_bucket_is_coloured_in_one_round(spark, monkeypatch):
    rows = spark.range(200).select(
        F.lit(1).alias("batch_id"), F.col("id").alias("task_id"), F.lit(0).alias("component"),
        F.lit("hot").alias("resource"), F.lit(100).alias("estimate_ms"), F.lit(199).alias("degree"),
    )
    rounds, step = [], colouring._round
    monkeypatch.setattr(colouring, "_round", lambda *a: rounds.append(1) or step(*a))
    found = colouring.colour_giants(rows, heavy_bucket=10, block_tasks=1)
    assert {r.task_id: r.colour for r in found.collect()} == {t: t for t in range(200)}
    assert len(rounds) == 1


def test_chain_and_repeat(spark):
    fp = {t: {f"r{t}", f"r{t + 1}"} for t in range(40)}
    rows = shared(spark, fp)
    one = components.component_stars(rows)
    two = components.component_stars(rows)
    assert {r.lo for r in one.collect()} == {0} and one.count() == 39
    assert one.exceptAll(two).isEmpty()


def test_hot_bucket_report(spark):
    rows = shared(spark, random_footprints(1, 30, "clique"))
    report = graph.hot_buckets(rows, 10).collect()
    assert [(r.resource_id, r.bucket_size) for r in report] == [("hot", 30)]


def test_sketch(spark):
    rows = spark.createDataFrame([("a",)] * 3 + [("b",)], "k string")
    asked = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")

    def read(s, **dims):
        return {r.k: r.estimate for r in sketch.estimate(s, asked, ["k"], **dims).collect()}

    one = sketch.build(rows, ["k"])
    assert read(one) == {"a": 3, "b": 1, "c": 0}
    assert read(sketch.merge(one, one))["a"] == 6
    known = spark.createDataFrame([("a", 100), ("b", 0)], "k string, n bigint")
    assert read(sketch.seed(one, known, ["k"], "n")) == {"a": 100, "b": 1, "c": 0}
    assert read(sketch.reset(one)) == {"a": 0, "b": 0, "c": 0}
    narrow = sketch.build(rows, ["k"], depth=2, width=1)
    assert all(v >= 3 for v in read(narrow, depth=2, width=1).values())


def test_components_stay_whole_when_skewed_joins_are_split(spark):
    """AQE may cut a skewed join's partitions; rows of a component must still meet in order."""
    tight = {
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.0",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16KB",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    }
    before = {k: spark.conf.get(k, None) for k in tight}
    for k, v in tight.items():
        spark.conf.set(k, v)
    try:
        rows = spark.range(0, 40_000, 1, 8).select(
            F.lit(1).alias("batch_id"),
            F.col("id").alias("task_id"),
            F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 5_000).alias("component"),
            F.lit(100).alias("estimate_ms"),
            F.lit(3).alias("degree"),
        )
        rows = cut_lineage(rows.withColumn(
            "resource", F.when(F.col("component") == 0, "hot").otherwise(F.col("component").cast("string"))
        ))
        found = cut_lineage(colouring.colour_waves(rows, component_rows=10_000))
        clashes = rows.join(found, ["batch_id", "task_id"]).groupBy("resource", "colour").count()
        assert clashes.count() == 40_000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_tasks_of_a_large_shuffle_stay_small(spark):
    """A task sorts and hashes what it reads: more rows must make more tasks, not larger ones."""
    rows = spark.range(6_000_000).select(F.xxhash64("id").alias("a"), F.xxhash64("id", "id").alias("b"))
    held = rows.groupBy("a").agg(F.max("b")).rdd.getNumPartitions()
    assert held > 1.5 * spark.sparkContext.defaultParallelism
