"""Scalar expressions, ranks and running sums, and per-class counters."""

import random
from collections import deque
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tests.helpers import admission_frame
from wavelane.functions import joins, ranking, scalars, scans
from wavelane.operators import admission, cost, ordering

BASE = datetime(2026, 1, 1)
MINUTE = timedelta(minutes=1)


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_durations_and_instants(spark):
    texts = {"PT0.1S": 100, "PT5M": 300_000, "PT1H30M": 5_400_000, "PT0S": 0, "P1DT2H": 93_600_000, "PT2.345S": 2345}
    for text, ms in texts.items():
        row = one(spark, ms=scalars.iso_duration_ms(F.lit(text)), text=scalars.ms_iso_duration(F.lit(ms).cast("bigint")))
        assert row.ms == ms
        assert row.text == ("PT26H" if text.startswith("P1D") else text)
    row = one(
        spark,
        whole=scalars.format_instant(F.lit("2026-01-01 10:00:00").cast("timestamp")),
        part=scalars.format_instant(F.lit("2026-01-01 10:00:00.25").cast("timestamp")),
        back=scalars.parse_instant(F.lit("2026-01-01T10:00:00Z")),
    )
    assert (row.whole, row.part) == ("2026-01-01T10:00:00Z", "2026-01-01T10:00:00.250Z")
    assert row.back == datetime(2026, 1, 1, 10)


def test_small_scalars(spark):
    lit = F.lit
    row = one(
        spark,
        blank=scalars.is_blank(lit("  ")),
        pair=scalars.canonical_pair(lit("b"), lit("a")),
        slot=scalars.ring_slot(lit(61)),
        empty=scalars.resources_json(scalars.parse_resources(lit(None).cast("string"))),
        dsl=scalars.dsl_field(lit('{"projectId":"7"}'), "projectId"),
        uuid=scalars.uuid_text(lit("6FA459EA-EE8A-3CA4-894E-DB77E160355E")),
        no_uuid=scalars.uuid_text(lit("x")),
        ratio=scalars.ratio(lit(1), lit(0)),
        policy=scalars.policy_name(lit("deadline")),
        other=scalars.policy_name(lit("x")),
        state=scalars.state_name(lit("paused")),
        t1=scalars.lookup_outcome(lit("SocketTimeoutException")),
        t2=scalars.lookup_outcome(lit("RequestTimedOut")),
        t3=scalars.lookup_outcome(lit("IOException")),
        t4=scalars.lookup_outcome(lit(None).cast("string")),
    )
    assert row.blank and (row.pair.u, row.pair.v) == ("a", "b") and row.slot == 1 and row.empty is None
    assert row.dsl == "7" and row.uuid == "6fa459ea-ee8a-3ca4-894e-db77e160355e" and row.no_uuid is None
    assert row.ratio == 0.0 and (row.policy, row.other, row.state) == ("DEADLINE", "FIFO", "PAUSED")
    assert (row.t1, row.t2, row.t3, row.t4) == ("timeout", "timeout", "failure", "success")


def test_ranks_do_not_depend_on_the_path(spark):
    rnd = random.Random(1)
    rows = [("hot" if rnd.random() < 0.7 else f"g{rnd.randrange(5)}", rnd.randrange(20), i) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, o int, id int")
    order = [F.col("o").desc(), F.col("id").asc()]
    plain = ranking.rank_rows(df, ["g"], order, "r")
    for other in (
        ranking.rank_rows(df, ["g"], order, "r", group_rows=50),
        ranking.sliced_rank(df, ["g"], order, "r"),
    ):
        assert plain.exceptAll(other.select(plain.columns)).isEmpty()
    whole = {r.id: r.r for r in ranking.sliced_rank(df, [], order, "r").collect()}
    assert whole == {x[2]: k + 1 for k, x in enumerate(sorted(rows, key=lambda x: (-x[1], x[2])))}


def test_schedule_paths_agree(spark):
    rnd = random.Random(2)
    rows = [(1, "hot" if i % 3 else f"c{i}", i, rnd.randrange(4)) for i in range(90)]
    df = spark.createDataFrame(rows, "batch_id int, component string, task_id int, colour int")
    order = [F.col("task_id").desc()]
    plain = ordering.wave_schedule(df, order)
    sliced = ordering.wave_schedule(df, order, group_rows=10)
    assert plain.exceptAll(sliced.select(plain.columns)).isEmpty() and sliced.count() == 90
    serial = ordering.serial_schedule(df.drop("colour"), order, group_rows=10)
    assert serial.filter("pos <> 1 or colour <> ordinal - 1").isEmpty()


def test_batches(spark):
    df = spark.createDataFrame([(i, BASE) for i in range(25)], "task_id int, created_at timestamp")
    sizes = ordering.batch_assign(df, 10).groupBy("batch_no").count().collect()
    assert {r.batch_no: r["count"] for r in sizes} == {0: 10, 1: 10, 2: 5}
    assert ordering.batch_assign(df, 0).isEmpty()


def class_events(spark, marks):
    rows = [(i, c, BASE + m * MINUTE, k) for i, (c, m, k) in enumerate(marks)]
    return spark.createDataFrame(rows, "event_id bigint, resource_class string, ts timestamp, kind string")


def test_rates(spark):
    for minutes, last in (([0, 0], 2), ([0, 1], 2), ([0, 61], 1), ([0, 60], 1), ([0, 59], 2)):
        events = class_events(spark, [("a", m, "emit") for m in minutes])
        assert admission.hourly_rate(events).orderBy("event_id").collect()[-1].n == last
    late = class_events(spark, [("a", 100, "emit"), ("a", 99, "emit")])
    rows = admission.hourly_rate_arrival(late).orderBy("event_id").collect()
    assert [r.n for r in rows] == [1, 2] and rows[0].booked_minute == rows[1].booked_minute


def test_completions_leave_the_rate_alone(spark):
    events = class_events(spark, [("a", 0, "emit"), ("a", 1, "complete"), ("a", 2, "emit"), ("a", 3, "complete")])
    assert [r.n for r in admission.hourly_rate(events).orderBy("event_id").collect()] == [1, 2]
    assert admission.class_state(events).first().rate == 2
    one = "resource_class string, max_inflight bigint, max_rate_per_hour bigint"
    limit = spark.createDataFrame([("a", 9, 2)], one)
    state = admission.class_state(events)
    assert not admission.class_admission(state.select("resource_class"), state, limit).first().admitted


def test_counters_match_a_loop(spark):
    rnd = random.Random(4)
    marks, minute = [], 0
    for _ in range(300):
        minute += rnd.choice([0, 0, 1, 2, 30])
        marks.append((rnd.choice("ab"), minute - rnd.choice([0, 0, 0, 3]), rnd.choice(["emit", "complete"])))
    marks.sort(key=lambda m: m[1])
    events = class_events(spark, marks)
    seeds = spark.createDataFrame([("a", 3)], "resource_class string, inflight bigint")
    want, balance, recent = {}, {"a": 3, "b": 0}, {"a": deque(), "b": deque()}
    rates = {}
    for i, (c, m, kind) in enumerate(marks):
        balance[c] = max(0, balance[c] + (1 if kind == "emit" else -1))
        want[i] = balance[c]
        if kind == "emit":
            recent[c].append(m)
            while recent[c][0] < m - 59:
                recent[c].popleft()
            rates[i] = len(recent[c])
    got = {r.event_id: r.inflight for r in admission.inflight_balance(events, seeds).collect()}
    assert got == want
    assert {r.event_id: r.n_at_event for r in admission.hourly_rate(events).collect()} == rates
    sliced = admission.hourly_rate_arrival(events)
    assert {r.event_id: r.n for r in sliced.collect()} == rates


def test_running_sums_are_exclusive_on_request(spark):
    df = spark.createDataFrame([("g", i, 10 * i) for i in range(9)], "g string, o int, v bigint")
    out = scans.running_sums(df, ["g"], ["o"], {"t": F.col("v")}, inclusive=False)
    assert [r.t for r in out.orderBy("o").collect()] == [sum(10 * j for j in range(i)) for i in range(9)]


def test_scans_split_one_class_in_one_minute(spark):
    """All rows in one group with one time: slices by order, each on a task of its own."""
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    try:
        rows = spark.range(4000).selectExpr("'g' as g", "0L as ts", "id as o", "if(id % 7 < 3, 1L, -1L) as v", "id * 31 % 977 as m")
        slices = ranking.in_slices(rows, ["g"], ["ts", "o"]).groupBy("_slice").count().collect()
        assert len(slices) == 4 and max(r["count"] for r in slices) < 2000
        moves = [(1 if i % 7 < 3 else -1, i * 31 % 977) for i in range(4000)]
        balance, total, top, want = 2, 0, -1, []
        for v, m in moves:
            balance, total, top = max(0, balance + v), total + v, max(top, m)
            want.append((balance, total, top))
        found = scans.clamped_balance(rows, ["g"], ["ts", "o"], "v", "b", F.lit(2))
        found = scans.running_sums(found, ["g"], ["ts", "o"], {"t": F.col("v")})
        found = scans.running_max(found, ["g"], ["ts", "o"], "m", "x")
        assert [(r.b, r.t, r.x) for r in found.orderBy("o").collect()] == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")


def admitted(spark, inflight, rate, limits=(), enabled=True):
    schema = "resource_class string, max_inflight bigint, max_rate_per_hour bigint"
    state = spark.createDataFrame([("p", inflight, rate), ("q", 0, 0)], "resource_class string, inflight bigint, rate bigint")
    found = admission.class_admission(
        state.select("resource_class"), state, spark.createDataFrame(list(limits), schema), enabled
    )
    return {r.resource_class: r for r in found.collect()}


def test_admission_rules(spark):
    assert not admitted(spark, 1, 0, [("p", 1, 9)])["p"].admitted
    assert admitted(spark, 0, 0, [("p", 1, 9)])["p"].admitted
    assert not admitted(spark, 0, 2, [("p", 9, 2)])["p"].admitted
    assert admitted(spark, 5, 5, [("p", 1, 1)], enabled=False)["p"].admitted
    rows = admitted(spark, 1, 1, [("p", 1, 1)])
    assert not rows["p"].admitted and rows["q"].admitted and rows["p"].pressure == 1.0
    assert rows["q"].max_inflight == 1_000_000 and rows["q"].max_rate_per_hour == 500_000
    assert admitted(spark, 3, 0, [("p", 0, 9)])["p"].pressure == 3.0


def test_denials(spark):
    limits = admission_frame(spark, ("x", False, 1.0), ("y", True, 0.0), ("z", True, 0.0))
    members = spark.createDataFrame(
        [(1, "1", "1", "y"), (1, "1", "2", "x"), (1, "1", "3", "z"), (1, "4", "4", "y")],
        "batch_id int, component string, task_id string, top_resource_class string",
    )
    count = lambda p: {r.resource_class: r.denied for r in admission.denied_by_class(members, limits, p).collect()}
    assert count(True) == {"x": 1} and count(False) == {"y": 1, "x": 1}
    kept = admission.admit_all_or_nothing(members, limits)
    assert [r.task_id for r in kept.collect()] == ["4"]


def test_estimates(spark):
    tasks = spark.createDataFrame([(1, "1", "project"), (1, "2", "talk"), (1, "3", "tag")], "batch_id int, task_id string, top_resource_class string")
    seen = spark.createDataFrame([("talk", 40), ("talk", 60), ("talk", -5), ("project", 1)], "resource_class string, elapsed_ms bigint")
    got = cost.task_estimates(tasks, cost.class_duration_mean(seen), {"project": 2000})
    assert {r.task_id: r.estimate_ms for r in got.collect()} == {"1": 2000, "2": 50, "3": 100}
    off = cost.task_estimates(tasks, enabled=False)
    assert {r.estimate_ms for r in off.collect()} == {0}


def test_lookup_past_the_bound(spark, monkeypatch):
    left = spark.range(10).withColumnRenamed("id", "k")
    right = spark.range(5).select(F.col("id").alias("k"), F.lit(1).alias("x"))
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 3)
    assert joins.lookup_join(left, right, "k").filter("x is not null").count() == 5
