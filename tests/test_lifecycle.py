"""Task states, outcomes, progress, ingest and stored tables."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wavelane.operators import work as running
from wavelane.operators import admission, footprint, lifecycle, progress
from wavelane.schemas import TASKS
from wavelane.plans import documents
from wavelane.sources import ingest, messages, store, versions

NOW = datetime(2026, 8, 14, 12, 0, 0)
SEC = timedelta(seconds=1)


def task(tid, state, timeout=None, cursor=None, created=NOW, cls="project", rid="7", version=0):
    return (tid, created, "{}", "{}", [], cursor, state, timeout, cls, rid, version)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), TASKS)


def test_reaper_then_orphans(spark):
    tasks = frame(
        spark,
        task("late", "PENDING", NOW - SEC),
        task("soon", "PENDING", NOW + 60 * SEC),
        task("lost", "STARTED"),
        task("page", "STARTED", cursor="page:2"),
        task("over", "STARTED", NOW - SEC),
        task("edge", "PAUSED", NOW),
        task("done", "COMPLETED", NOW - SEC),
    )
    reaped = lifecycle.reap_timeouts(tasks, NOW)
    assert [r.task_id for r in reaped.filter("slot_released").collect()] == ["over"]
    assert {r.task_id for r in lifecycle.expired(tasks, NOW).collect()} == {"late", "over", "edge"}
    states = {r.task_id: r.state for r in lifecycle.recover_orphans(reaped).collect()}
    assert states == {
        "late": "TIMEOUT", "soon": "PENDING", "lost": "PENDING", "page": "PAUSED",
        "over": "TIMEOUT", "edge": "TIMEOUT", "done": "COMPLETED",
    }


def test_batch_load(spark):
    tasks = frame(
        spark,
        task("b", "PENDING"), task("a", "PAUSED"), task("c", "PENDING", created=NOW - SEC),
        task("d", "STARTED"), task("e", "FAILED"),
    )
    ids = lambda n: [r.task_id for r in lifecycle.eligible_batch(tasks, n).collect()]
    assert ids(10) == ["c", "a", "b"] and ids(2) == ["c", "a"] and ids(0) == [] and ids(-1) == []
    counts = {r.state: r.n for r in lifecycle.tasks_by_state(tasks).collect()}
    assert counts["PENDING"] == 2 and counts["RECEIVED"] == 0 and len(counts) == 8
    assert lifecycle.by_states(tasks, []).isEmpty()
    assert lifecycle.by_id(tasks, "task_id", "d").first().state == "STARTED"


def test_inflight_by_class(spark):
    tasks = frame(
        spark, task("1", "STARTED"), task("2", "PROCESSING"), task("3", "STARTED", cls="talk"), task("4", "PENDING")
    )
    assert {r.resource_class: r.inflight for r in admission.inflight_by_class(tasks).collect()} == {
        "project": 2, "talk": 1,
    }


def test_outcomes(spark):
    tasks = frame(
        spark,
        task("ok", "PENDING"), task("pause", "PENDING", cursor="p:1"), task("fail", "PENDING"),
        task("raise", "PENDING"), task("slow", "PENDING"), task("slowpause", "PENDING"),
        task("slowraise", "PENDING"), task("stale", "PENDING", NOW), task("done", "COMPLETED", NOW - SEC),
    )
    rows = [
        ("ok", "COMPLETED", None, None, None, None, 1),
        ("pause", "PAUSED", "p:2", None, None, None, 1),
        ("fail", "FAILED", None, None, None, None, 1),
        ("raise", None, None, None, "IOError", "disk", 1),
        ("slow", "FAILED", None, "why", None, None, 301),
        ("slowpause", "PAUSED", None, None, None, None, 301),
        ("slowraise", None, None, None, "IOError", "disk", 301),
        ("stale", "COMPLETED", None, None, None, None, 1),
        ("done", "FAILED", None, None, None, None, 1),
        ("ghost", "COMPLETED", None, None, None, None, 1),
    ]
    outcomes = spark.createDataFrame(
        [(*r[:6], NOW, NOW + r[6] * SEC) for r in rows],
        "task_id string, outcome string, cursor string, failure_reason string, error_type string, "
        "error_message string, started_at timestamp, finished_at timestamp",
    )
    got = {r.task_id: r for r in lifecycle.apply_outcomes(outcomes, tasks).collect()}
    expected = {
        "ok": ("COMPLETED", True, None), "pause": ("PAUSED", True, None), "fail": ("FAILED", False, "failed"),
        "raise": ("FAILED", False, "IOError: disk"),
        "slow": ("TIMEOUT", False, "Task exceeded deadline (PT5M)"), "slowpause": ("PAUSED", True, None),
        "slowraise": ("FAILED", False, "IOError: disk"),
        "stale": ("TIMEOUT", False, "Task timed out before dispatch"), "done": ("COMPLETED", True, None),
        "ghost": (None, False, "Task not found"),
    }
    assert {t: (r.state, r.success, r.failure_reason) for t, r in got.items()} == expected
    assert got["pause"].cursor == "p:2" and got["slowpause"].cursor is None


def test_progress(spark):
    rows = spark.range(1).select(F.lit("a").alias("task_id"), F.lit(NOW).alias("ts"))
    big = lambda n: F.lit(n).cast("bigint")
    deltas = rows.withColumns(progress.success_delta(big(3))).unionByName(
        rows.withColumns(progress.success_delta(big(4)))
    )
    snap = progress.progress_snapshot(deltas).first()
    assert (snap.total_count, snap.success_count, snap.failed_count, snap.version) == (7, 7, 0, 2)
    failed = progress.progress_snapshot(rows.withColumns(progress.failed_delta(big(2), big(10)))).first()
    assert (failed.total_count, failed.success_count, failed.failed_count) == (10, 0, 2)

    tasks = frame(spark, task("a", "STARTED"), task("b", "PENDING"))
    status = {r.task_id: r for r in progress.task_status(tasks, progress.progress_snapshot(deltas)).collect()}
    assert status["a"].pending_count == 0 and status["b"].total_count is None
    asked = spark.createDataFrame([("a",), ("x",)], "task_id string")
    assert [r.task_id for r in progress.unknown_tasks(asked, tasks).collect()] == ["x"]
    forced = {r.task_id: r.state for r in lifecycle.force_complete(tasks, asked).collect()}
    assert forced == {"a": "COMPLETED", "b": "PENDING"}


def test_failing_task_does_not_stop_the_next(spark):
    plan = spark.createDataFrame(
        [(1, "c", "t1", 1), (1, "c", "t2", 2), (1, "d", "t3", 1)],
        "batch_id bigint, component string, task_id string, ordinal bigint",
    )

    def work(row):
        if row["task_id"] == "t1":
            raise RuntimeError("boom")
        return {"outcome": "COMPLETED"}

    got = {r.task_id: (r.outcome, r.error_type, r.error_message) for r in running.apply_by_component(plan, work).collect()}
    ok = ("COMPLETED", None, None)
    assert got == {"t1": (None, "RuntimeError", "boom"), "t2": ok, "t3": ok}


def test_large_components_run_wave_by_wave(spark, tmp_path):
    """A wave sees what the waves before it left behind, and its tasks run on several partitions."""
    rows = [(1, "big", t % 3, t, t) for t in range(30)] + [(1, "small", 0, 1, 100)]
    plan = spark.createDataFrame(rows, "batch_id bigint, component string, colour int, ordinal bigint, task_id bigint")
    seen = str(tmp_path)

    def work(row):
        import os

        from pyspark import TaskContext

        before = [name.split("-")[0] for name in os.listdir(seen)]
        open(f"{seen}/{row['colour']}-{row['task_id']}", "w").close()
        whole = all(before.count(str(c)) >= 10 for c in range(row["colour"]))
        return {"outcome": "COMPLETED" if whole else "FAILED", "cursor": str(TaskContext.get().partitionId())}

    got = running.apply_by_component(plan, work, parallel_tasks=5, wide_wave=2).collect()
    big = [r for r in got if r.component == "big"]
    assert len(got) == 31 and {r.outcome for r in big} == {"COMPLETED"} and len({r.cursor for r in big}) > 1


RUN = "batch_id bigint, component string, colour int, ordinal bigint, task_id bigint"


def test_runs_of_waves(spark):
    sizes = [1, 2, 9, 8, 1, 3, 4, 2]
    rows, k = [], 0
    for colour, n in enumerate(sizes):
        for _ in range(n):
            k += 1
            rows.append((1, "big", colour, k, k))
    rows += [(1, "small", c, c, 100 + c) for c in range(3)]
    runs = running.plan_runs(spark.createDataFrame(rows, RUN), parallel_tasks=10, wide_wave=8, run_tasks=4)
    steps = {(r.component, r.colour): (r.step, r.wide) for r in runs.collect()}
    # Two narrow waves, two wide ones, and narrow ones again, cut where four tasks have gone before.
    want = [(0, False), (0, False), (1, True), (2, True), (3, False), (3, False), (4, False), (5, False)]
    assert [steps["big", c] for c in range(8)] == want
    assert {steps["small", c] for c in range(3)} == {(0, False)}


def test_one_hot_resource_takes_few_jobs(spark, tmp_path):
    """100 000 tasks that all conflict run one after the other, in order, in ten steps."""
    plan = spark.range(1, 100_001).selectExpr(
        "1L as batch_id", "'hot' as component", "cast(id - 1 as int) as colour", "id as ordinal", "id as task_id"
    )
    state = {"last": 0}

    def work(row):
        ok = row["task_id"] == state["last"] + 1 or (row["task_id"] - 1) % 10_000 == 0
        state["last"] = row["task_id"]
        return {"outcome": "COMPLETED" if ok else "FAILED"}

    got = running.apply_by_component(plan, work, str(tmp_path / "work"))
    assert got.groupBy("outcome").count().collect() == [("COMPLETED", 100_000)]
    assert len(list((tmp_path / "work" / "results").iterdir())) == 10


def test_killed_run_goes_on_where_it_stopped(spark, tmp_path):
    rows = [(1, "big", t, t, t) for t in range(12)] + [(2, "other", t, t, 100 + t) for t in range(3)]
    plan = spark.createDataFrame(rows, RUN)
    calls, folder = tmp_path / "calls", str(tmp_path / "work")
    calls.mkdir()

    def work_until(limit):
        def work(row):
            import os
            import uuid

            if row["task_id"] >= limit and row["batch_id"] == 1:
                os._exit(1)  # the worker is lost
            open(f"{calls}/{row['task_id']}-{uuid.uuid4().hex}", "w").close()
            return {"outcome": "COMPLETED"}

        return work

    options = dict(parallel_tasks=5, wide_wave=100, run_tasks=4)
    with pytest.raises(Exception):
        running.apply_by_component(plan, work_until(9), folder, **options)
    got = running.apply_by_component(plan, work_until(99), folder, **options)
    assert sorted(r.task_id for r in got.collect()) == sorted(r[4] for r in rows)
    times = [name.name.split("-")[0] for name in calls.iterdir()]
    # Two steps of four tasks were done; task 8 was in the one that broke.
    assert all(times.count(str(t)) == 1 for t in range(8)) and times.count("8") >= 2
    again = running.apply_by_component(plan, work_until(0), folder, **options)
    assert again.count() == 15 and len(list(calls.iterdir())) == len(times)
    assert running.apply_by_component(plan.limit(0), work_until(0)).count() == 0


def test_ingest_checks(spark):
    commands = spark.createDataFrame(
        [("1", "project", "7"), ("2", " ", "7"), ("3", "project", None), ("4", "", "")],
        "key string, resource_class string, resource_id string",
    )
    accepted, rejected = ingest.split_checked(ingest.check_commands(commands))
    assert [r.key for r in accepted.collect()] == ["1"]
    assert {r.key: len(r.errors) for r in rejected.collect()} == {"2": 1, "3": 1, "4": 2}
    shaped = accepted.selectExpr(
        "*", "cast(null as string) payload", "cast(null as string) search_dsl", "cast(null as timestamp) timeout_at"
    )
    row = ingest.new_tasks(shaped, F.col("key"), F.lit(NOW)).first()
    assert (row.state, row.payload, row.resources, row.cursor, row.version) == ("PENDING", "{}", [], None, 0)
    deltas = spark.createDataFrame([(1, 0, 0), (-1, 0, -2)], "success_delta int, failed_delta int, total_delta int")
    assert [len(r.errors) for r in ingest.check_deltas(deltas).collect()] == [0, 2]
    runs = spark.createDataFrame([(["a"],), ([],), (None,)], "tasks array<string>")
    assert [len(r.errors) for r in ingest.check_simulations(runs).collect()] == [0, 1, 1]


def test_task_table_keeps_newest_version(spark, tmp_path):
    path = str(tmp_path / "tasks")
    first = frame(spark, task("a", "PENDING"), task("b", "PENDING"))
    store.append_versions(first, path)
    change = frame(spark, task("a", "STARTED", cursor="p:1", created=NOW + 9 * SEC), task("n", "PENDING", version=5))
    merged = store.merge_versions(store.read_tasks(spark, path), change.withColumn(
        "resources", F.array(F.struct(F.lit("talk").alias("resource_class"), F.lit("1").alias("resource_id")))
    ))
    store.append_versions(merged, path)
    got = {r.task_id: r for r in store.read_tasks(spark, path).collect()}
    a = got["a"]
    assert (a.state, a.version, a.created_at, a.cursor) == ("STARTED", 1, NOW, "p:1")
    assert a.resources[0].resource_id == "1" and got["b"].resources == [] and got["n"].version == 0


def test_versions_survive_appends_during_compaction(spark, tmp_path, monkeypatch):
    table = versions.VersionTable(spark, str(tmp_path / "t"), "k", buckets=8)
    with pytest.raises(FileNotFoundError):
        table.read()
    schema = "k bigint, version bigint, v string"
    rows = lambda *r: spark.createDataFrame(list(r), schema)
    content = lambda keys=None: {r.k: (r.version, r.v) for r in table.read(keys).collect()}
    table.append(rows(*[(k, 0, "a") for k in range(100)]))
    table.compact()
    table.append(rows((1, 1, "b"), (200, 0, "n")))
    assert content([1, 2, 200]) == {1: (1, "b"), 2: (0, "a"), 200: (0, "n")} and len(content()) == 101
    # A delta that comes in when the snapshot has already chosen what it takes in.
    chosen = table.read_parts

    def and_then_append(taken):
        late = chosen(taken)
        table.append(rows((1, 2, "c"), (201, 0, "m"), (2, 0, "old")))
        return late

    monkeypatch.setattr(table, "read_parts", and_then_append)
    table.compact()
    monkeypatch.undo()
    want = {k: (0, "a") for k in range(100)} | {1: (2, "c"), 200: (0, "n"), 201: (0, "m")}
    got = content()
    assert got.pop(2)[0] == 0 and got == {k: v for k, v in want.items() if k != 2}
    assert len(table._parts()[3]) == 3
    table.vacuum()
    assert content([1, 200, 201]) == {1: (2, "c"), 200: (0, "n"), 201: (0, "m")}
    table.compact()
    table.vacuum()
    assert {k: v for k, v in content().items() if k != 2} == {k: v for k, v in want.items() if k != 2}
    plan = table.read([5])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan or "bucket#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    # Half a snapshot does not count.
    table.append(rows((5, 1, "x")))
    monkeypatch.setattr(table.spark, "createDataFrame", lambda *a, **k: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        table.compact()
    monkeypatch.undo()
    assert content([5]) == {5: (1, "x")}


def test_plan_lookups_read_one_day(spark, tmp_path):
    stored = store.PlanHistory(spark, str(tmp_path / "plans"))
    day = timedelta(days=1)
    for k in range(4):
        plans = [(k, f"p{k}", NOW + k * day, "{}"), (k, f"q{k}", NOW + k * day + SEC, "{}")]
        stored.append(spark.createDataFrame(plans, "batch_id int, plan_id string, generated_at timestamp, plan string"))
    ids = lambda found: [r.plan_id for r in found.collect()]
    assert ids(stored.newest()) == ["q3"] and ids(stored.by_id("p1")) == ["p1"]
    assert ids(stored.in_force(F.lit(NOW + 2 * day))) == ["p2"] and ids(stored.in_force(F.lit(NOW - day))) == []
    found = stored.in_force(F.lit(NOW + day))
    filters = found._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]
    assert "generated_date" in filters and len(found.inputFiles()) <= len(stored.newest().inputFiles())


def test_closure_from_requested_tags(spark):
    deps = [(k, k + 1) for k in range(10_000)] + [(20_000, 20_001), (20_001, 20_002), (20_002, 20_000), (7, None)]
    table = spark.createDataFrame(deps, "tag_id bigint, depends_on bigint")
    roots = spark.createDataFrame([(0,), (9_990,), (20_001,), (77_777,)], "tag_id bigint")
    found = footprint.dependency_closure(table, roots=roots)
    got = found.groupBy("tag_id").agg(F.count("*").alias("n"), F.count_distinct("depends_on").alias("d")).collect()
    assert {r.tag_id: (r.n, r.d) for r in got} == {0: (10_000,) * 2, 9_990: (10, 10), 20_001: (3, 3)}
    small = table.filter("tag_id > 9990")
    assert footprint.dependency_closure(small).count() == 9 * 10 // 2 + 9


def test_group_messages(spark):
    schedule = spark.createDataFrame(
        [(1, "A", 0, p, p, t) for p, t in enumerate("abcde", 1)] + [(1, "A", 1, 1, 6, "f"), (2, "A", 0, 1, 1, "g")],
        "batch_id bigint, component string, colour int, pos bigint, ordinal bigint, task_id string",
    )
    ids = schedule.select("batch_id", "component", F.lit("component-0").alias("component_id")).distinct()
    want = {(r.batch_id, "component-0", r.colour, r.pos, r.task_id) for r in schedule.collect()}
    for size, several in ((2, 4), (100, 2)):
        sent = messages.encode_groups(documents.nested_groups(schedule, ids, size))
        assert sent.count() == several and sent.first().key == "component-0"
        # Parts may arrive in any order.
        shuffled = sent.orderBy(F.col("part").desc(), F.col("batch_id").desc())
        got = documents.group_waves(messages.decode_groups(shuffled), ["batch_id"]).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert all('"part"' not in r.value and '"firstPos"' not in r.value for r in sent.collect())
    bare = spark.createDataFrame([("k", '{"componentId":"k","orderedTasks":["x","y"]}')], "key string, value string")
    assert [w.colour for w in messages.decode_groups(bare).first().waves] == [0, 1]


def test_plan_history_table(spark, tmp_path):
    from wavelane.plans import history

    times = [datetime(2026, 1, 1, h) for h in (1, 5, 5, 9)]
    plans = spark.createDataFrame(list(zip("abcd", times)), "plan_id string, generated_at timestamp")
    stored = store.PlanHistory(spark, str(tmp_path / "plans"))
    stored.append(plans)
    read = stored.headers()
    assert history.latest_plan(read).first().plan_id == "d"
    at = lambda ts: [r.plan_id for r in history.plan_for(read, F.lit(ts)).collect()]
    assert at(times[0]) == ["a"] and at(times[1]) == ["c"] and at(datetime(1970, 1, 1)) == []
    probes = spark.createDataFrame(
        [(1, times[0] - SEC), (2, times[0]), (3, times[1]), (4, times[3] - SEC), (5, datetime(2026, 2, 1))],
        "k int, ts timestamp",
    )
    got = {r.k: r.plan_id for r in history.plan_as_of(probes, read).collect()}
    assert got == {1: None, 2: "a", 3: "c", 4: "c", 5: "d"}


def test_plan_documents_are_made_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def make(frames):
        for frame in frames:
            made.add(len(frame))
            yield frame

    plans = spark.range(5).selectExpr("'p' || id as plan_id", "timestamp'2026-01-01 00:00:00' + make_interval(0, 0, 0, int(id)) as generated_at")
    stored = store.PlanHistory(spark, str(tmp_path / "plans"))
    for k in (1, 2):
        stored.append(plans.mapInPandas(make, plans.schema))
        assert made.value == 5 * k and stored.headers().count() == 5 * k
    assert stored.by_id("p3").count() == 2 and stored.newest().columns == ["plan_id", "generated_at", "generated_date"]
