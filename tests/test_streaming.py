"""Streaming jobs over several files and restarts, against their batch twins."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.helpers import BASE, admission_frame, resource_frame, task_frame
from wavelane.operators import admission, lifecycle
from wavelane.plans import compile as planning
from wavelane.sources import messages
from wavelane.streaming import jobs, timers

ONCE = {"availableNow": True}
MINUTE = timedelta(minutes=1)
EVENT = "event_id bigint, resource_class string, ts timestamp, kind string"


def add_file(spark, folder, rows, schema):
    """Append rows as one file named by its first value, so that files keep their order."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def events(start, n, late=0):
    return [
        (i, "ab"[i % 2], BASE + (i - (late if i % 5 == 0 else 0)) * MINUTE, "emit" if i % 3 else "complete")
        for i in range(start, start + n)
    ]


def feed(spark, tmp_path, run, parts, schema):
    """Run a job once per part, adding a file before each run and restarting in between."""
    folder = str(tmp_path / "in")
    for rows in parts:
        add_file(spark, folder, rows, schema)
        stream = spark.readStream.schema(schema).parquet(folder)
        run(stream).awaitTermination()


def paths(tmp_path):
    return [str(tmp_path / n) for n in ("out", "state", "ckpt")]


def test_inflight_is_carried_over_restarts(spark, tmp_path):
    out, state, ckpt = paths(tmp_path)
    parts = [events(0, 40), events(40, 40), events(80, 40)]
    seeds = spark.createDataFrame([("a", 2)], "resource_class string, inflight bigint")
    feed(spark, tmp_path, lambda s: jobs.stream_inflight(s, out, state, ckpt, ONCE, seeds), parts, EVENT)
    got = jobs.read_epochs(spark, out).select("event_id", "resource_class", "inflight")
    whole = spark.createDataFrame(sum(parts, []), EVENT)
    want = admission.inflight_balance(whole, seeds).drop("ts")
    assert got.count() == 120 and got.exceptAll(want).isEmpty()


def test_arrival_rate_books_late_events_as_current(spark, tmp_path):
    out, state, ckpt = paths(tmp_path)
    parts = [events(0, 70, late=9), events(70, 70, late=9)]
    feed(spark, tmp_path, lambda s: jobs.stream_rate_arrival(s, out, state, ckpt, ONCE), parts, EVENT)
    got = jobs.read_epochs(spark, out).drop("epoch")
    want = admission.hourly_rate_arrival(spark.createDataFrame(sum(parts, []), EVENT))
    assert got.count() == want.count() > 80 and got.exceptAll(want.select(got.columns)).isEmpty()
    last = spark.read.parquet(f"{state}/epoch=1")
    assert last.groupBy("resource_class").count().filter("count > 60").isEmpty()


def test_progress_and_state_keep_totals(spark, tmp_path):
    schema = "task_id string, success_delta bigint, failed_delta bigint, total_delta bigint, ts timestamp"
    out, _, ckpt = paths(tmp_path)
    parts = [[("a", 3, 0, 3, BASE), ("b", 0, 1, 2, BASE)], [("a", 4, 0, 4, BASE + MINUTE)]]
    feed(spark, tmp_path, lambda s: jobs.stream_progress(s, out, ckpt, ONCE), parts, schema)
    got = {r.task_id: (r.total_count, r.success_count, r.version) for r in jobs.latest_epoch_rows(spark, out, "task_id").collect()}
    assert got == {"a": (7, 7, 2), "b": (2, 0, 1)}


def test_newest_state_wins(spark, tmp_path):
    schema = "task_id string, version bigint, state string"
    out, _, ckpt = paths(tmp_path)
    parts = [[("a", 1, "PENDING"), ("a", 3, "PAUSED")], [("a", 2, "STARTED"), ("b", 1, "PENDING")]]
    feed(spark, tmp_path, lambda s: jobs.stream_task_state(s, out, ckpt, ONCE), parts, schema)
    got = {r.task_id: r.state for r in jobs.latest_epoch_rows(spark, out, "task_id").collect()}
    assert got == {"a": "PAUSED", "b": "PENDING"}


def test_timeouts_lose_no_change(spark, tmp_path):
    schema = "task_id string, ts timestamp, state string, timeout_at timestamp"
    due = BASE + 5 * MINUTE
    parts = [
        [("a", BASE, "PENDING", due), ("b", BASE, "PENDING", due), ("c", BASE, "STARTED", None)],
        [("b", BASE + MINUTE, "COMPLETED", due), ("d", BASE + 2 * MINUTE, "PENDING", BASE + 99 * MINUTE)],
        [("f", BASE + 4 * MINUTE, "PENDING", BASE + 6 * MINUTE)],
        [("e", BASE + 9 * MINUTE, "PENDING", None)],
        # Behind other tasks' changes: in time for a patient clock, too late for an impatient one.
        [("f", BASE + 5 * MINUTE, "COMPLETED", None), ("b", BASE, "PENDING", due)],
        [("e", BASE + 30 * MINUTE, "PENDING", None)],
    ]
    open_ = F.col("state").isin("PENDING", "STARTED")
    for lateness, fired, late in ((0, {"a", "f"}, {"f"}), (10, {"a"}, set())):
        folder = tmp_path / str(lateness)
        places = [str(folder / name) for name in ("rows", "late", "state", "ckpt")]
        feed(
            spark, folder, lambda s, p=places, n=lateness: timers.stream_timeouts(s, open_, *p, ONCE, n * 60_000), parts, schema
        )
        rows = jobs.read_epochs(spark, places[0]).collect()
        assert {r.task_id for r in rows} == fired and len(rows) == len(fired)
        assert all((r.from_state, r.state) == ("PENDING", "TIMEOUT") for r in rows)
        assert {r.task_id for r in jobs.read_epochs(spark, places[1]).collect()} == late


CHANGE = "task_id string, ts timestamp, state string, timeout_at timestamp"


def expected_timeouts(parts, lateness):
    """One change after the other in plain Python: fired (task, deadline) and late (task, ts) per part."""
    newest, fired, late, clock = {}, [], [], None
    for n, rows in enumerate(parts):
        given = {t: d for t, (_, _, _, d, f) in newest.items() if f}
        late += [(t, ts) for t, ts, _, _ in rows if t in given and ts <= given[t]]
        for t, ts, state, due in rows:
            clock = ts if clock is None else max(clock, ts)
            row = (ts, n, state not in ("PENDING", "STARTED"), due, False)
            # A null deadline sorts first.
            order = lambda r: (r[0], r[1], r[2], str(r[3]) if r[3] else "")
            if t not in newest or order(row) > order(newest[t]):
                newest[t] = row
        for t, (ts, k, closed, due, done) in list(newest.items()):
            if not closed and not done and due is not None and due <= clock - lateness:
                newest[t] = (ts, k, closed, due, True)
                fired.append((t, due))
    return sorted(fired), sorted(late)


def run_timeouts(spark, tmp_path, parts, lateness, **options):
    open_ = F.col("state").isin("PENDING", "STARTED")
    places = [str(tmp_path / name) for name in ("rows", "late", "state", "ckpt")]
    ms = int(lateness.total_seconds() * 1000)
    feed(spark, tmp_path, lambda s: timers.stream_timeouts(s, open_, *places, ONCE, ms, **options), parts, CHANGE)
    utc = lambda ms: datetime(1970, 1, 1) + timedelta(milliseconds=ms)
    fired = sorted((r.task_id, utc(r.timeout_ms)) for r in jobs.read_epochs(spark, places[0]).collect())
    late = sorted((r.task_id, utc(r.ts_ms)) for r in jobs.read_epochs(spark, places[1]).collect())
    return fired, late, places


def test_closed_tasks_stay_closed_whatever_arrives(spark, tmp_path):
    hour, due = 60 * MINUTE, BASE + 120 * MINUTE
    parts = [
        [("a", BASE + hour, "COMPLETED", due), ("b", BASE, "PENDING", due)],
        [("c", BASE + 72 * hour, "PENDING", None)],
        # Long after the clock has moved on: older than what is known of a, and too late for b.
        [("a", BASE + hour / 2, "PENDING", due), ("b", BASE + hour, "COMPLETED", due)],
        [("c", BASE + 100 * hour, "PENDING", None)],
        [("a", BASE + hour / 3, "STARTED", due), ("d", BASE, "PENDING", due)],
    ]
    fired, late, _ = run_timeouts(spark, tmp_path, parts, 0 * MINUTE, buckets=2, compact_every=2)
    assert fired == [("b", due), ("d", due)] and late == [("b", BASE + hour)]


@pytest.mark.parametrize("lateness, buckets, compact_every", [(0, 5, 3), (90, 3, 1)])
def test_timeouts_match_one_by_one(spark, tmp_path, lateness, buckets, compact_every):
    rng, parts = random.Random(lateness), []
    for n in range(8):
        part = []
        for t in rng.sample("abcdefghijkl", rng.randint(1, 5)):
            ts = BASE + (60 * n + rng.randint(-400, 60)) * MINUTE
            due = rng.choice([None, ts + rng.randint(1, 300) * MINUTE])
            part.append((t, ts, rng.choice(["PENDING", "PENDING", "STARTED", "COMPLETED"]), due))
        parts.append(part)
    fired, late, places = run_timeouts(
        spark, tmp_path, parts, lateness * MINUTE, buckets=buckets, compact_every=compact_every
    )
    assert (fired, late) == expected_timeouts(parts, lateness * MINUTE) and fired
    # Pieces of a bucket older than its last whole one are not read any more.
    log = timers.TaskLog(spark, f"{places[2]}/tasks", "task_id string, ts_ms bigint", buckets, compact_every)
    plan = log.read(len(parts), {0})._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert log.read(len(parts), {0}).count() < sum(map(len, parts))


def test_waiting_tasks_are_planned_later(spark, tmp_path):
    """Denied, unresolved and surplus tasks over several files, against the same loop without Spark."""
    out, backlog, ckpt = [str(tmp_path / n) for n in ("out", "backlog", "ckpt")]
    files = [[f"t{n}{k}" for k in range(4)] for n in range(4)] + [["t00"], []]
    resources = resource_frame(spark, {t: [f"r:{t[-1]}"] for f in files for t in f})
    schema = task_frame(spark, [("x", "c", "1")]).schema
    class_of = lambda t: "ab"[int(t[-1]) % 2]
    denied_at = lambda e: {"a"} if e in (0, 1) else {"b"} if e == 2 else set()
    unresolved_at = lambda e: {"t13", "t01"} if e in (1, 2) else set()
    seen = []

    def plan_batch(batch, epoch):
        seen.append(epoch)
        decisions = admission_frame(spark, *[(c, c not in denied_at(epoch), 0.0) for c in "ab"])
        failed = spark.createDataFrame([(t,) for t in unresolved_at(epoch)], "task_id string")
        return planning.compile_plan(batch, resources, class_admission=decisions, failed=failed).schedule

    def run():
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        jobs.stream_plan(stream, plan_batch, out, backlog, ckpt, ONCE, batch_size=6).awaitTermination()

    pool, want, asked = [], [], 0
    for epoch, tasks in enumerate(files):
        rows = [(1, t, BASE + (asked + k) * MINUTE, None, "PENDING", None, class_of(t), "1") for k, t in enumerate(tasks)]
        asked += len(rows)
        add_file(spark, str(tmp_path / "in"), rows, schema)
        run()
        pool = sorted([p for p in pool if p[1] not in tasks] + [(r[2], r[1]) for r in rows])
        chosen = [t for _, t in pool[:6]]
        planned = [t for t in chosen if class_of(t) not in denied_at(epoch) and t not in unresolved_at(epoch)]
        want += [(epoch, t) for t in planned]
        pool = [p for p in pool if p[1] not in planned]
        if epoch == 2:
            # The last micro-batch again, as after a crash before its commit: the same plan and the same backlog.
            before = sorted(r.task_id for r in jobs.waiting(spark, backlog, 2).collect())
            for name in ("commits/2", "commits/.2.crc"):
                (tmp_path / "ckpt" / name).unlink()
            run()
            assert seen[-2:] == [2, 2] and sorted(r.task_id for r in jobs.waiting(spark, backlog, 2).collect()) == before
    rows = jobs.read_epochs(spark, out).collect()
    assert sorted((r.epoch, r.task_id) for r in rows) == sorted(want)
    last = max(r.epoch for r in rows)
    assert sorted(r.task_id for r in jobs.waiting(spark, backlog, last).collect()) == [t for _, t in pool]
    # Once for each time it was asked for.
    assert sum(r.task_id == "t00" for r in rows) == 2


def test_plan_per_micro_batch_and_replay(spark, tmp_path):
    out, backlog, ckpt = paths(tmp_path)
    resources = resource_frame(spark, {"A": ["k:1"], "B": ["k:1"], "C": ["k:1"]})
    folder, compiled = str(tmp_path / "in"), []

    def compile_batch(batch, epoch):
        compiled.append(1)
        return planning.compile_plan(batch, resources).schedule

    def run():
        stream = spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder)
        jobs.stream_plan(stream, compile_batch, out, backlog, ckpt, ONCE).awaitTermination()

    task_frame(spark, [("A", "x", "1"), ("B", "x", "2")]).coalesce(1).write.parquet(folder)
    run()
    task_frame(spark, [("C", "x", "3")], batch=2).coalesce(1).write.mode("append").parquet(folder)
    run()
    run()
    rows = jobs.read_epochs(spark, out)
    assert {(r.batch_id, r.task_id, r.colour) for r in rows.collect()} == {(1, "A", 0), (1, "B", 1), (2, "C", 0)}
    # A replayed micro-batch overwrites its own rows.
    jobs.write_epoch(rows.filter("epoch = 1").drop("epoch"), str(tmp_path / "copy"), 1)
    jobs.write_epoch(rows.filter("epoch = 1").drop("epoch"), str(tmp_path / "copy"), 1)
    assert jobs.read_epochs(spark, str(tmp_path / "copy")).count() == 1


def test_orphan_completes_exactly_once_after_a_crash(spark, tmp_path):
    """A micro-batch that dies after writing is replayed; its completions count once."""
    out, _, ckpt = paths(tmp_path)
    folder, schema = str(tmp_path / "in"), "batch_id int, task_id string, state string, cursor string"
    add_file(spark, folder, [(1, "t1", "STARTED", None), (1, "t2", "PROCESSING", "page:3")], schema)
    attempts = []

    def step(batch, epoch):
        done = lifecycle.recover_orphans(batch).withColumn("state", F.lit("COMPLETED"))
        jobs.write_epoch(done, out, epoch)
        attempts.append(epoch)
        if len(attempts) == 1:
            raise RuntimeError("lost before the commit")

    def start():
        stream = spark.readStream.schema(schema).parquet(folder)
        return jobs.start(stream, step, ckpt, ONCE)

    with pytest.raises(Exception):
        start().awaitTermination()
    start().awaitTermination()
    assert attempts == [0, 0]
    rows = jobs.read_epochs(spark, out).collect()
    assert sorted((r.task_id, r.state) for r in rows) == [("t1", "COMPLETED"), ("t2", "COMPLETED")]


def test_sliding_rate_closes_windows_behind_the_watermark(spark, tmp_path):
    out, _, ckpt = paths(tmp_path)
    parts = [events(0, 70), events(70, 60)]
    feed(spark, tmp_path, lambda s: jobs.stream_hourly_rate(s, out, ckpt, ONCE), parts, EVENT)
    rows = jobs.read_epochs(spark, out)
    at = {(r.resource_class, r.window_end): r.n for r in rows.collect()}
    # A minute in three has a completion, which no window counts.
    assert at[("a", BASE + 60 * MINUTE)] == 20 and at[("b", BASE + 100 * MINUTE)] == 20
    assert max(e for _, e in at) <= BASE + 128 * MINUTE
    # A clock row at the end of a bounded run closes the windows that were still open, each once.
    frame = spark.createDataFrame(sum(parts, []), EVENT)
    jobs.closing_clock(frame, F.lit(BASE + 129 * MINUTE)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(EVENT).parquet(str(tmp_path / "in"))
    jobs.stream_hourly_rate(stream, out, ckpt, ONCE).awaitTermination()
    want = {}
    for _, c, ts, kind in sum(parts, []):
        for k in range(1, 61) if kind == "emit" else ():
            want[c, ts + k * MINUTE] = want.get((c, ts + k * MINUTE), 0) + 1
    rows = jobs.read_epochs(spark, out).collect()
    assert {(r.resource_class, r.window_end): r.n for r in rows} == want and len(rows) == len(want)


def test_group_messages_arrive(spark, tmp_path):
    out, _, ckpt = paths(tmp_path)
    topic = str(tmp_path / "topic")
    # Fixed value: the wire format of a group.
    text = '{"componentId":"component-0","orderedTasks":["a","b"]}'
    spark.createDataFrame([("component-0", text)], "key string, value string").write.json(topic)
    stream = spark.readStream.schema("key string, value string").json(topic)
    jobs.stream_group_messages(stream, out, ckpt, ONCE).awaitTermination()
    row = jobs.read_epochs(spark, out).first()
    assert row.ordered_tasks == ["a", "b"] and len(row.waves) == 2


def test_batches_come_back_from_headers(spark):
    """What the topic writer puts in the headers, as a topic delivers it; other senders may have none."""
    sent = spark.createDataFrame([("k1", "v1", 7), ("k2", "v2", None)], "key string, value string, batch_id bigint")
    delivered = sent.select(
        F.col("key").cast("binary"), F.col("value").cast("binary"), messages.batch_header(F.col("batch_id")).alias("headers")
    )
    other = F.array(F.struct(F.lit("trace").alias("key"), F.lit("x").cast("binary").alias("value")))
    bare = [F.lit(None).cast(delivered.schema["headers"].dataType), other, F.concat(other, messages.batch_header(F.lit("no"))), F.concat(other, messages.batch_header(F.lit(9)))]
    for k, headers in enumerate(bare):
        one = spark.range(1).select(F.lit(f"b{k}").cast("binary").alias("key"), F.lit("v").cast("binary").alias("value"), headers.alias("headers"))
        delivered = delivered.unionByName(one)
    got = {r.key: r.batch_id for r in jobs.message_rows(delivered).collect()}
    assert got == {"k1": 7, "k2": None, "b0": None, "b1": None, "b2": None, "b3": 9}
