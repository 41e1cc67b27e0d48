"""Golden planning examples."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tests.helpers import admission_frame, resource_frame, task_frame
from wavelane.operators import cost, graph
from wavelane.plans import compile as planning
from wavelane.plans import documents, history

# The worked example of the planning rules and, below, the figures expected for it.
RUNNING = [
    ("A", "project", "7"),
    ("B", "conference", "42"),
    ("C", "talk", "41"),
    ("D", "project", "7-remove"),
    ("E", "room", "3"),
]
RUNNING_FOOTPRINT = {
    "A": ["project:7", "talk:41", "tag:8"],
    "B": ["project:7"],
    "C": ["talk:41", "assistant:2"],
    "D": ["project:7"],
    "E": ["room:3", "project:9"],
}


def compile_(spark, specs, footprints, config=planning.PlanConfig(), limits=None, **more):
    return planning.compile_plan(
        task_frame(spark, specs), resource_frame(spark, footprints), config, limits, **more
    )


def waves(plan):
    found = {}
    for r in plan.schedule.orderBy("component", "colour", "pos").collect():
        found.setdefault((r.component, r.colour), []).append(r.task_id)
    return found


@pytest.fixture(scope="module")
def running(spark):
    return compile_(spark, RUNNING, RUNNING_FOOTPRINT)


def test_running_example_edges_and_components(running):
    edges = {(r.u, r.v) for r in graph.conflict_edges(running.frames.shared).collect()}
    assert edges == {("A", "B"), ("A", "C"), ("A", "D"), ("B", "D")}
    members = {r.task_id: r.component for r in running.frames.components.collect()}
    assert members == {"A": "A", "B": "A", "C": "A", "D": "A", "E": "E"}


def test_running_example_metrics(running):
    m = running.metrics().first()
    assert (m.total_tasks, m.connected_components, m.largest_component) == (5, 2, 4)
    assert (m.conflicts_detected, m.chromatic_number) == (4, 3)
    assert (m.parallelism_factor, m.serialization_ratio) == (0.5, 0.8)
    assert m.intra_component_parallelism == 0.5


def test_running_example_is_reproducible(spark, running):
    again = compile_(spark, RUNNING, RUNNING_FOOTPRINT)
    assert history.same_plan(running.schedule, again.schedule)


def test_path_of_three(spark):
    plan = compile_(
        spark, [(t, "x", t) for t in ("T1", "T2", "T3")], {"T1": ["k:A"], "T2": ["k:A", "k:B"], "T3": ["k:B"]}
    )
    assert sorted(map(sorted, waves(plan).values())) == [["T1", "T3"], ["T2"]]
    assert plan.metrics().first().chromatic_number == 2


def test_serial_preset_gives_single_task_waves_in_arrival_order(spark):
    plan = compile_(
        spark,
        [(t, "x", t) for t in ("T3", "T2", "T1")],
        {"T1": ["k:A"], "T2": ["k:A", "k:B"], "T3": ["k:B"]},
        planning.PlanConfig.serial(),
    )
    assert waves(plan) == {("T1", 0): ["T3"], ("T1", 1): ["T2"], ("T1", 2): ["T1"]}
    assert plan.metrics().first().estimated_duration_ms == 0


def test_longest_task_is_coloured_first(spark):
    specs = [("T1", "a", "1"), ("T2", "a", "2"), ("T3", "slow", "3")]
    plan = compile_(
        spark, specs, {t: ["k:A"] for t in ("T1", "T2", "T3")}, planning.PlanConfig(task_ms={"a": 1, "slow": 9000})
    )
    colours = {r.task_id: r.colour for r in plan.schedule.collect()}
    assert colours == {"T3": 0, "T1": 1, "T2": 2}
    assert plan.metrics().first().estimated_duration_ms == 9002


def test_independent_tasks_overlap(spark):
    plan = compile_(spark, [("1", "alpha", "1"), ("2", "beta", "2")], {"1": ["alpha:1"], "2": ["beta:2"]})
    m = plan.metrics().first()
    assert (m.connected_components, m.estimated_duration_ms) == (2, 100)


def test_locality_orders_a_wave_by_top_resource(spark):
    plan = compile_(
        spark,
        [("t1", "zoo", "1"), ("t2", "mid", "2"), ("t3", "alpha", "3")],
        {"t1": ["edge:A", "zoo:1"], "t2": ["edge:A", "edge:B", "mid:2"], "t3": ["edge:B", "alpha:3"]},
    )
    assert ["t3", "t1"] in waves(plan).values()


SHARED_TAG = ([("p", "project", "7"), ("t", "talk", "41")], {"p": ["tag:8"], "t": ["tag:8"]})


def test_partial_admission_keeps_the_rest_of_a_component(spark):
    limits = admission_frame(spark, ("project", False, 1.0), ("talk", True, 0.0))
    plan = compile_(spark, *SHARED_TAG, limits=limits)
    assert [r.task_id for r in plan.schedule.collect()] == ["t"]
    m = plan.metrics().first()
    assert (m.total_tasks, m.conflicts_detected, m.connected_components) == (2, 1, 1)


def test_whole_component_admission(spark):
    limits = admission_frame(spark, ("project", False, 1.0), ("talk", True, 0.0))
    plan = compile_(spark, *SHARED_TAG, planning.PlanConfig(backpressure_reorder=False), limits)
    assert plan.schedule.isEmpty()
    assert plan.metrics().first().largest_component == 0


def test_pressure_breaks_ties_inside_a_top_resource_only(spark):
    limits = admission_frame(spark, ("a", True, 0.9), ("b", True, 0.1))
    specs = [("1", "a", "x"), ("2", "b", "x")]
    near = {"1": ["k:A"], "2": ["k:B"], }
    plan = compile_(spark, specs, near, planning.PlanConfig(locality=False), limits)
    assert plan.schedule.count() == 2
    shared = {"1": ["k:A"], "3": ["k:A", "k:B"], "2": ["k:B"]}
    specs = [("1", "a", "x"), ("2", "b", "x"), ("3", "b", "y")]
    for locality, expected in ((False, ["2", "1"]), (True, ["1", "2"])):
        plan = compile_(spark, specs, shared, planning.PlanConfig(locality=locality), limits)
        assert expected in waves(plan).values()


def test_failed_lookups_stay_out_and_missing_ones_fall_back(spark):
    failed = spark.createDataFrame([("B",)], "task_id string")
    plan = compile_(spark, RUNNING[:3], {"A": ["talk:41"]}, failed=failed)
    rows = {(r.task_id, r.resource_class, r.resource_id) for r in plan.frames.footprint.collect()}
    assert rows == {("A", "talk", "41"), ("C", "talk", "41")}
    assert plan.metrics().first().conflicts_detected == 1


def test_empty_batch(spark):
    plan = planning.compile_plan(
        task_frame(spark, RUNNING).limit(0), resource_frame(spark, RUNNING_FOOTPRINT)
    )
    assert plan.schedule.isEmpty() and plan.metrics().isEmpty()


def test_uncoloured_components_run_serially(spark):
    specs = [("1", "a", "x"), ("2", "a", "y"), ("3", "a", "z")]

    def no_colours(frames):
        return replace(frames, colours=frames.components.select("batch_id", "task_id", F.lit(0).alias("colour")).limit(0))

    plan = compile_(
        spark, specs, {"1": ["k:A"], "2": ["k:A"]}, passes=[planning.components_pass, no_colours]
    )
    rows = {r.task_id: r for r in plan.schedule.collect()}
    assert sorted((rows["1"].colour, rows["2"].colour)) == [0, 1] and rows["3"].colour == 0


def test_added_conflicts_are_refused(spark):
    def more(frames):
        row = frames.shared.limit(1).withColumn("task_id", F.lit("2"))
        return replace(frames, shared=frames.shared.unionByName(row))

    with pytest.raises(ValueError, match="adds conflicts"):
        compile_(
            spark,
            [("1", "a", "x"), ("2", "a", "y"), ("3", "a", "z")],
            {"1": ["k:A"], "3": ["k:A"]},
            passes=[planning.components_pass, more],
        )


def test_planted_violations_are_found(running):
    frames = running.frames
    flat = frames.colours.withColumn("colour", F.lit(0))
    assert planning.colouring_violations(frames.shared, frames.colours).isEmpty()
    assert planning.colouring_violations(frames.shared, flat).count() == 2
    torn = frames.components.withColumn("component", F.col("task_id"))
    assert planning.isolation_violations(frames.shared, frames.components).isEmpty()
    assert planning.isolation_violations(frames.shared, torn).count() == 2


def test_hot_buckets_of_a_compile(spark):
    plan = compile_(spark, [("1", "a", "x"), ("2", "a", "y")], {"1": ["k:A"], "2": ["k:A"]}, planning.PlanConfig(max_bucket_size=1))
    assert [r.resource_id for r in plan.hot_buckets().collect()] == ["A"] and plan.schedule.count() == 2


def test_passes_are_required_and_must_not_add_conflicts(spark, running):
    with pytest.raises(ValueError):
        compile_(spark, RUNNING, RUNNING_FOOTPRINT, passes=[])
    coloured = planning.colouring_pass(running.frames)
    assert planning.added_edges(running.frames, coloured).isEmpty()


def test_explain_density(spark):
    plan = compile_(spark, *SHARED_TAG)
    row = planning.plan_explain(plan.metrics()).first()
    assert (row.conflict_density, row.average_degree) == (1.0, 1.0)


def test_shared_talk_example(spark):
    foot = {
        "42": ["project:42", "connection:conn-9", "talk:1001"],
        "99": ["project:99", "connection:conn-9", "talk:1001"],
        "7": ["project:7", "talk:1002"],
    }
    plan = compile_(spark, [(t, "project", t) for t in foot], foot)
    colours = {r.task_id: r.colour for r in plan.schedule.collect()}
    assert plan.metrics().first().connected_components == 2
    assert colours["42"] != colours["99"]


def test_speedup(running):
    rows = {r.component: r.speedup for r in cost.schedule_speedup(running.schedule).collect()}
    assert rows["A"] == pytest.approx(400 / 300) and rows["E"] == 1.0


def test_json_round_trip_and_paging(running):
    headers = documents.plan_headers(
        running.metrics(), F.lit("2026-01-01 10:00:00").cast("timestamp"), "v4", "FIFO", F.lit(120)
    )
    flat = {}
    for part_tasks in (10_000, 2):
        groups = documents.nested_groups(running.schedule, running.component_ids(), part_tasks)
        written = documents.plan_documents(headers, groups, part_tasks)
        plans = documents.read_plan_json(written.select("plan"))
        first = plans.first()
        assert first.planningDuration == "PT0.12S" and first.metrics.totalTasks == 5
        rows = documents.flat_waves(plans).collect()
        flat[part_tasks] = {(r.component_id, r.colour, r.pos, r.task_id) for r in rows}
    numbered = running.schedule.join(running.component_ids(), ["batch_id", "component"]).collect()
    want = {(r.component_id, r.colour, r.pos, r.task_id) for r in numbered}
    assert flat[10_000] == flat[2] == want and len(want) == 5


def test_old_plan_shape(spark):
    text = (
        # Field names are fixed values; the content is this test's own.
        '{"generatedAt":"2024-05-06T07:08:09Z","plannerVersion":"v0","planningDuration":"PT3S",'
        '"orderPolicy":"PRIORITY","groups":[{"componentId":"component-7","orderedTasks":["b","a"]}],'
        '"metrics":{"totalTasks":9,"connectedComponents":4,"largestComponent":3,"parallelismFactor":1.25,'
        '"serializationRatio":0.25,"conflictsDetected":6},"taskToComponent":{"b":"component-7"}}'
    )
    plan = documents.read_plan_json(spark.createDataFrame([(text,)], "plan string")).first()
    assert [(w.colour, list(w.taskIds)) for w in plan.groups[0].waves] == [(0, ["b"]), (1, ["a"])]
    assert (plan.metrics.chromaticNumber, plan.metrics.waveCount) == (0, 0)
    import hashlib
    import uuid

    digest = bytearray(hashlib.md5(b"2024-05-06T07:08:09Z").digest())
    assert plan.id == str(uuid.UUID(bytes=bytes(digest), version=3))


def test_own_policy_pressure_and_resolver(spark):
    specs = [("1", "a", "x"), ("2", "b", "x"), ("3", "b", "y")]
    foot = {"1": ["k:A"], "3": ["k:A", "k:B"], "2": ["k:B"]}
    newest_first = planning.PlanConfig(order_policy=[F.col("created_at").desc()], locality=False)
    plan = compile_(spark, specs, foot, newest_first)
    assert ["2", "1"] in waves(plan).values()
    tasks = task_frame(spark, specs)
    asked = []

    def resolve(found):
        asked.append(found.columns)
        return resource_frame(spark, foot)

    light_b = F.when(F.col("top_resource_class") == "b", 0.0).otherwise(1.0)
    plan = planning.compile_plan(tasks, resolve, planning.PlanConfig(locality=False), pressure=light_b)
    assert ["2", "1"] in waves(plan).values() and len(asked) == 1
