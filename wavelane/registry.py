"""Every operator as a query over the test tables."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import replace
from datetime import datetime
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavelane.functions.scalars import (
    canonical_pair,
    dsl_field,
    epoch_minute,
    format_instant,
    iso_duration_ms,
    ms_iso_duration,
    name_uuid,
    parse_instant,
    policy_name,
    resources_json,
    ring_slot,
    uuid_text,
)
from wavelane.operators import admission, colouring, components, cost, footprint, graph, lifecycle
from wavelane.operators import metrics, ordering, progress, sketch, work
from wavelane.plans import compile as planning
from wavelane.plans import documents, history
from wavelane.schemas import EXPIRABLE_STATES, IN_FLIGHT_STATES, RESOURCES
from wavelane.session import configure, cut_lineage, shared_path, staged
from wavelane.sources import ingest, messages, store, tables
from wavelane.streaming import jobs, timers

NOW = datetime(1996, 6, 1)
CONFIG = planning.PlanConfig(task_ms={"BUILDING": 2000})


class Inputs:
    """The model over one data folder; what several queries read is worked out once."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        configure(spark)

    def __getattr__(self, name: str) -> DataFrame:
        reader = getattr(tables, name, None)
        if reader is None:
            raise AttributeError(name)
        return reader(self.spark, self.folder)

    @cached_property
    def class_admission(self) -> DataFrame:
        seeds = admission.inflight_by_class(self.tasks)
        state = admission.class_state(self.class_events, seeds)
        return cut_lineage(admission.class_admission(self.classes, state, self.class_limits))

    @property
    def classes(self) -> DataFrame:
        return self.tasks.select(F.col("top_resource_class").alias("resource_class")).distinct()

    @cached_property
    def planned(self) -> DataFrame:
        """The planning columns of all tasks."""
        return cut_lineage(planning.plan_columns(self.tasks))

    @cached_property
    def footprint(self) -> DataFrame:
        return cut_lineage(footprint.footprint(self.planned, self.resource_rows))

    @cached_property
    def shared(self) -> DataFrame:
        return cut_lineage(graph.shared_rows(self.footprint))

    @cached_property
    def degree(self) -> DataFrame:
        return cut_lineage(graph.degrees(self.shared))

    @cached_property
    def frames(self) -> planning.PlanFrames:
        mean = cost.class_duration_mean(self.durations)
        costed = cost.with_estimates(self.planned, mean, CONFIG.task_ms)
        return planning.PlanFrames(costed, self.footprint, self.shared, self.degree)

    @cached_property
    def components(self) -> DataFrame:
        stars = components.component_stars(self.shared)
        return cut_lineage(components.connected_components(self.planned, stars))

    @cached_property
    def coloured(self) -> planning.PlanFrames:
        return planning.colouring_pass(replace(self.frames, components=self.components))

    @cached_property
    def plan(self) -> planning.CompiledPlan:
        return planning.assemble(self.coloured, CONFIG, self.class_admission)

    @property
    def members(self) -> DataFrame:
        """Tasks with component and estimate, before admission."""
        return self.planned.join(self.components, graph.VERTEX)

    @property
    def plan_headers(self) -> DataFrame:
        """One history entry per weekly batch, generated when its last task arrived."""
        times = self.tasks.groupBy("batch_id").agg(F.max("created_at").alias("at"))
        headers = documents.plan_headers(
            times, F.col("at"), "v4", "FIFO", F.lit(100)
        )
        return headers.select("plan_id", "batch_id", "generated_at")

    @cached_property
    def supplier_shared(self) -> DataFrame:
        orders = tables.table(self.spark, self.folder, "orders").select(
            F.lit(0).cast("bigint").alias("batch_id"), F.col("o_orderkey").alias("task_id")
        )
        rows = self.supplier_rows.join(orders, "task_id").select(*graph.BUCKET, "task_id").distinct()
        rows = staged(rows, "supplier-rows", graph.SPLIT)
        return staged(graph.shared_rows(rows), "supplier-shared", graph.SPLIT, [rows])


_inputs: dict[tuple[int, str], Inputs] = {}


def inputs(spark: SparkSession, folder: str) -> Inputs:
    key = (spark.sparkContext.applicationId, folder)
    if key not in _inputs:
        _inputs[key] = Inputs(spark, folder)
    return _inputs[key]


def forget_inputs() -> None:
    """Drop the shared intermediate results, so that the next query starts cold."""
    _inputs.clear()


# Selection and transitions.


def eligible_batch(i: Inputs) -> DataFrame:
    return lifecycle.eligible_batch(i.tasks, CONFIG.batch_size).select("task_id", "created_at", "state")


def expired_tasks(i: Inputs) -> DataFrame:
    return lifecycle.expired(i.tasks, NOW).select("task_id", "state", "cursor", "timeout_at")


def reap_timeouts(i: Inputs) -> DataFrame:
    return lifecycle.reap_timeouts(i.tasks, NOW).select("task_id", "state", "slot_released")


def orphan_recovery(i: Inputs) -> DataFrame:
    reaped = lifecycle.reap_timeouts(i.tasks, NOW)
    return lifecycle.recover_orphans(reaped).select("task_id", "cursor", "state")


def inflight_tasks(i: Inputs) -> DataFrame:
    found = lifecycle.by_states(i.tasks, IN_FLIGHT_STATES)
    return found.select("task_id", "state", "cursor", "timeout_at")


def tasks_by_state(i: Inputs) -> DataFrame:
    return lifecycle.tasks_by_state(i.tasks)


def inflight_by_class(i: Inputs) -> DataFrame:
    return admission.inflight_by_class(i.tasks)


def inflight_work_by_class(i: Inputs) -> DataFrame:
    return lifecycle.inflight_work_by_class(i.tasks, progress.progress_snapshot(i.progress_deltas))


def force_complete(i: Inputs) -> DataFrame:
    return lifecycle.force_complete(i.tasks, i.complete_commands).select("task_id", "cursor", "state")


def apply_outcomes(i: Inputs) -> DataFrame:
    return lifecycle.apply_outcomes(i.outcomes, i.tasks).drop("started_at", "finished_at")


def latest_task_state(i: Inputs) -> DataFrame:
    return lifecycle.latest_by_version(i.state_versions)


def batch_assign(i: Inputs) -> DataFrame:
    backlog = lifecycle.eligible(i.tasks).select("task_id", "created_at")
    return ordering.batch_assign(backlog, CONFIG.batch_size).select("task_id", "batch_no")


# Ingest.


def _checked_commands(i: Inputs) -> tuple[DataFrame, DataFrame]:
    return ingest.split_checked(ingest.check_commands(i.ingest_commands))


def ingest_tasks(i: Inputs) -> DataFrame:
    accepted, _ = _checked_commands(i)
    task_id = name_uuid(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")))
    rows = ingest.new_tasks(accepted, task_id, F.lit(NOW))
    return rows.drop("created_at", "timeout_at", "resources")


def ingest_rejected(i: Inputs) -> DataFrame:
    _, rejected = _checked_commands(i)
    return rejected.select("doc_id", F.array_join("errors", "; ").alias("errors"))


def ingest_checks(i: Inputs) -> DataFrame:
    """Commands, progress deltas and dry-run lists with what is wrong with each; documents, events and customers give them."""
    blank = F.when(F.col("doc_id") % 17 == 0, "  ").otherwise(F.col("lang"))
    commands = tables.table(i.spark, i.folder, "documents").select(
        F.col("doc_id").alias("key"), blank.alias("resource_class"), F.col("source").alias("resource_id")
    )
    at = F.col("event_id")
    deltas = tables.table(i.spark, i.folder, "events").select(
        at.alias("key"),
        (at % 7 - 1).alias("success_delta"),
        (at % 5 - 1).alias("failed_delta"),
        (at % 11 - 1).alias("total_delta"),
    )
    paused = F.collect_list(F.when(F.col("o_orderstatus") == "P", F.col("o_orderkey"))).alias("tasks")
    runs = tables.table(i.spark, i.folder, "orders").groupBy(F.col("o_custkey").alias("key")).agg(paused)
    checked = {
        "command": ingest.check_commands(commands),
        "delta": ingest.check_deltas(deltas),
        "dry run": ingest.check_simulations(runs),
    }

    def rejected(kind: str, rows: DataFrame) -> DataFrame:
        _, bad = ingest.split_checked(rows)
        return bad.select(F.lit(kind).alias("kind"), F.col("key").cast("bigint").alias("key"), F.array_join("errors", "; ").alias("errors"))

    return reduce(DataFrame.unionByName, [rejected(*entry) for entry in checked.items()])


def ingest_counter(i: Inputs) -> DataFrame:
    return metrics.ingest_counter(i.tasks)


# Footprint and graph.


def task_footprint(i: Inputs) -> DataFrame:
    return footprint.footprint(i.tasks, i.part_rows)


def unresolved_skipped(i: Inputs) -> DataFrame:
    resolved = footprint.resolved_tasks(i.tasks, i.failed_lookups)
    planned = admission.admit_partial(resolved, i.class_admission)
    return footprint.skipped_tasks(i.tasks, planned).select("task_id", "state")


def footprint_range_join(i: Inputs) -> DataFrame:
    closure = footprint.dependency_closure(i.tag_dependencies, roots=i.tag_sets)
    return footprint.range_footprint(i.tasks, i.connections, i.talks, i.tag_sets, closure)


def dependency_closure(i: Inputs) -> DataFrame:
    return footprint.dependency_closure(i.tag_dependencies)


def conflict_edges(i: Inputs) -> DataFrame:
    return graph.conflict_edges(i.shared)


def edge_shared_resources(i: Inputs) -> DataFrame:
    return graph.edge_shared_resources(i.shared)


def adjacency_lists(i: Inputs) -> DataFrame:
    return graph.adjacency(graph.conflict_edges(i.shared))


def task_degree(i: Inputs) -> DataFrame:
    return graph.task_degrees(i.planned, i.degree)


def hot_buckets(i: Inputs) -> DataFrame:
    return graph.hot_buckets(i.supplier_shared, 600)


def supplier_degree(i: Inputs) -> DataFrame:
    return graph.degrees(i.supplier_shared).select("task_id", "degree")


def supplier_components(i: Inputs) -> DataFrame:
    rows = i.supplier_shared.select(*graph.VERTEX).distinct()
    stars = components.component_stars(i.supplier_shared)
    return components.connected_components(rows, stars).select("task_id", "component")


def connected_components(i: Inputs) -> DataFrame:
    return i.components


def component_sizes(i: Inputs) -> DataFrame:
    return components.component_sizes(i.components)


def component_ids(i: Inputs) -> DataFrame:
    return i.plan.component_ids()


def task_to_component(i: Inputs) -> DataFrame:
    return planning.task_to_component(i.plan.schedule, i.plan.component_ids())


def isolation_violations(i: Inputs) -> DataFrame:
    return planning.isolation_violations(i.shared, i.components).agg(F.count(F.lit(1)).alias("violations"))


# Order.


def _ordered(policy: str) -> Callable[[Inputs], DataFrame]:
    def run(i: Inputs) -> DataFrame:
        ranked = ordering.policy_ranks(i.members, policy, i.components)
        return ranked.select("batch_id", "component", "task_id", "policy_rank")

    return run


def serial_waves(i: Inputs) -> DataFrame:
    order = ordering.policy_keys("FIFO", i.members.columns)
    serial = ordering.serial_schedule(i.members, order, i.components)
    return serial.select("batch_id", "component", "task_id", "colour")


# Cost.


def class_duration_mean(i: Inputs) -> DataFrame:
    return cost.class_duration_mean(i.durations)


def running_duration_estimate(i: Inputs) -> DataFrame:
    return cost.running_duration_estimate(i.durations)


def task_estimates(i: Inputs) -> DataFrame:
    return cost.task_estimates(i.tasks, cost.class_duration_mean(i.durations), CONFIG.task_ms)


def task_duration_stats(i: Inputs) -> DataFrame:
    return metrics.task_duration_stats(i.durations)


# Colouring and plan.


def colour_priority(i: Inputs) -> DataFrame:
    return colouring.colour_priority(i.frames.weighted()).select("batch_id", "task_id", "priority_rank")


def colour_waves(i: Inputs) -> DataFrame:
    """Every task with its wave; tasks without conflicts are in the first one."""
    coloured = i.planned.select(*graph.VERTEX).join(i.coloured.colours, graph.VERTEX, "left")
    return coloured.select(*graph.VERTEX, F.coalesce("colour", F.lit(0)).alias("colour"))


def colouring_violations(i: Inputs) -> DataFrame:
    found = planning.colouring_violations(i.shared, i.coloured.colours)
    return found.agg(F.count(F.lit(1)).alias("violations"))


def wave_schedule(i: Inputs) -> DataFrame:
    return i.plan.schedule


def critical_path(i: Inputs) -> DataFrame:
    costs = cost.component_costs(cost.wave_costs(i.plan.schedule))
    return costs.select("batch_id", "component", "critical_path_ms")


def schedule_speedup(i: Inputs) -> DataFrame:
    return cost.schedule_speedup(i.plan.schedule)


def plan_metrics(i: Inputs) -> DataFrame:
    return i.plan.metrics()


def plan_trend(i: Inputs) -> DataFrame:
    names = ["parallelism_factor", "chromatic_number", "wave_count", "intra_component_parallelism"]
    return metrics.plan_trend(i.plan.metrics(), names)


def plan_explain(i: Inputs) -> DataFrame:
    return planning.plan_explain(i.plan.metrics())


# Part sizes that queries are run with: one that cuts most groups and waves, and the default.
PART_SIZES = (2, documents.PART_TASKS)


def _groups(i: Inputs, part_tasks: int) -> DataFrame:
    return documents.nested_groups(i.plan.schedule, i.plan.component_ids(), part_tasks)


def _each_size(make: Callable[[int], DataFrame]) -> DataFrame:
    frames = [make(size).withColumn("part_tasks", F.lit(size)) for size in PART_SIZES]
    return reduce(DataFrame.unionByName, frames)


def plan_nested(i: Inputs) -> DataFrame:
    def wave(w):
        begin = F.coalesce(w["firstPos"], F.lit(1)).cast("string")
        return F.concat(w["colour"].cast("string"), F.lit("@"), begin, F.lit(":"), F.array_join(w["taskIds"], ","))

    return _each_size(lambda size: _groups(i, size)).select(
        "part_tasks",
        "batch_id",
        "component_id",
        "part",
        "parts",
        F.array_join("ordered_tasks", ",").alias("ordered_tasks"),
        F.array_join(F.transform("waves", wave), ";").alias("waves"),
    )


def plan_documents(i: Inputs) -> DataFrame:
    """Plans written as JSON and read back to rows, in few and in many parts."""
    times = i.tasks.groupBy("batch_id").agg(F.max("created_at").alias("at"))
    headers = documents.plan_headers(
        i.plan.metrics().join(times, "batch_id"), F.col("at"), "v4", "FIFO", F.lit(100)
    )

    def read_back(size: int) -> DataFrame:
        written = documents.plan_documents(headers, _groups(i, size), size)
        return documents.flat_waves(documents.read_plan_json(written.select("plan")))

    return _each_size(read_back)


def plan_history(i: Inputs) -> DataFrame:
    """Compiled plans appended to the history as documents; what three questions to it read back."""
    times = i.tasks.groupBy("batch_id").agg(F.max("created_at").alias("at"))
    headers = documents.plan_headers(
        i.plan.metrics().join(times, "batch_id"), F.col("at"), "v4", "FIFO", F.lit(100)
    )
    stored = store.PlanHistory(i.spark, shared_path(i.spark, "history"))
    stored.append(documents.plan_documents(headers, _groups(i, documents.PART_TASKS)))
    named = stored.headers().filter(F.col("batch_id") == 1400).first()
    asked = {
        "newest": stored.newest(),
        "by_id": stored.by_id(named.plan_id if named else ""),
        "as_of": stored.in_force(F.lit(NOW)),
    }

    def answer(question: str, pages: DataFrame) -> DataFrame:
        rows = documents.flat_waves(documents.read_plan_json(pages.select("plan")))
        return rows.withColumn("question", F.lit(question))

    return reduce(DataFrame.unionByName, [answer(*entry) for entry in asked.items()])


def group_messages(i: Inputs) -> DataFrame:
    """The waves that messages carry, row by row, in few and in many parts."""

    def received(size: int) -> DataFrame:
        sent = messages.encode_groups(_groups(i, size))
        return documents.group_waves(messages.decode_groups(sent), ["batch_id"])

    return _each_size(received)


def plan_diff(i: Inputs) -> DataFrame:
    """What changes when waves, clustering and partial admission are switched off."""
    frames = replace(i.coloured, colours=None)
    serial = planning.assemble(frames, planning.PlanConfig.serial(), i.class_admission)
    return history.plan_diff(i.plan.schedule, serial.schedule)


def plan_json_upgrade(i: Inputs) -> DataFrame:
    """Plans of an old shape: no id, no waves, few metrics; one per week and key range."""
    plan = ["batch_id", "page"]
    groups = (
        i.tasks.withColumn("page", F.floor(F.col("task_id") / documents.PART_TASKS))
        .groupBy(*plan, F.concat_ws("-", F.lit("component"), F.col("priority")).alias("componentId"))
        .agg(
            F.transform(F.sort_array(F.collect_list("task_id")), lambda t: t.cast("string")).alias(
                "orderedTasks"
            ),
            F.max("created_at").alias("at"),
            F.count(F.lit(1)).alias("n"),
        )
        .groupBy(*plan)
        .agg(
            F.collect_list(F.struct("componentId", "orderedTasks")).alias("groups"),
            F.max("at").alias("at"),
            F.sum("n").alias("n"),
        )
    )
    document = F.to_json(
        F.struct(
            F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("generatedAt"),
            F.lit("v1").alias("plannerVersion"),
            F.lit("PT0.1S").alias("planningDuration"),
            F.lit("FIFO").alias("orderPolicy"),
            "groups",
            F.struct(F.col("n").alias("totalTasks")).alias("metrics"),
            F.create_map().cast("map<string,string>").alias("taskToComponent"),
        )
    )
    upgraded = documents.read_plan_json(groups.select(*plan, document.alias("plan"))).withColumns(
        {
            "total_tasks": F.col("metrics.totalTasks"),
            "chromatic_number": F.col("metrics.chromaticNumber"),
        }
    )
    return documents.flat_waves(upgraded, [*plan, "total_tasks", "chromatic_number"]).drop("pos")


# Admission.


def class_limits(i: Inputs) -> DataFrame:
    return admission.class_limits(i.classes, i.class_limits)


def inflight_balance(i: Inputs) -> DataFrame:
    seeds = admission.inflight_by_class(i.tasks)
    return admission.inflight_balance(i.class_events, seeds).drop("ts")


def hourly_rate(i: Inputs) -> DataFrame:
    return admission.hourly_rate(i.class_events)


def hourly_rate_arrival(i: Inputs) -> DataFrame:
    return admission.hourly_rate_arrival(i.class_events)


def class_admission(i: Inputs) -> DataFrame:
    return i.class_admission


def class_pressure(i: Inputs) -> DataFrame:
    return i.class_admission.select("resource_class", "pressure")


def admit_partial(i: Inputs) -> DataFrame:
    kept = admission.admit_partial(i.members, i.class_admission)
    return kept.select("batch_id", "component", "task_id")


def admit_all_or_nothing(i: Inputs) -> DataFrame:
    kept = admission.admit_all_or_nothing(i.members, i.class_admission)
    return kept.select("batch_id", "component", "task_id")


def denied_by_class(i: Inputs) -> DataFrame:
    def mode(name: str, partial: bool) -> DataFrame:
        counts = admission.denied_by_class(i.members, i.class_admission, partial)
        return counts.select(F.lit(name).alias("mode"), "resource_class", "denied")

    return mode("partial", True).unionByName(mode("component", False))


def cms_estimate(i: Inputs) -> DataFrame:
    """Sketched against exact task counts per resource: never too low, and off by a few expected errors at most."""
    keys = footprint.RESOURCE
    fp = i.footprint
    exact = fp.groupBy(*keys).agg(F.count(F.lit(1)).alias("exact"))
    estimated = sketch.estimate(sketch.build(fp, keys), fp, keys)
    allowed = math.ceil(8 * math.e * fp.count() / sketch.WIDTH)
    return exact.join(estimated, keys).select(
        *keys,
        "exact",
        (F.col("estimate") >= F.col("exact")).alias("not_below"),
        (F.col("estimate") - F.col("exact") <= allowed).alias("close"),
    )


# Progress.


def progress_snapshot(i: Inputs) -> DataFrame:
    return progress.progress_snapshot(i.progress_deltas)


def task_status(i: Inputs) -> DataFrame:
    return progress.task_status(i.tasks, progress.progress_snapshot(i.progress_deltas))


# History.


def latest_plan(i: Inputs) -> DataFrame:
    return history.latest_plan(i.plan_headers)


def plan_by_id(i: Inputs) -> DataFrame:
    """The plan of one batch, looked up by the id its generation time and batch imply."""
    wanted = i.plan_headers.filter(F.col("batch_id") == 1400).select("plan_id")
    return i.plan_headers.join(wanted, "plan_id", "left_semi")


def plan_for_instant(i: Inputs) -> DataFrame:
    return history.plan_for(i.plan_headers, F.lit(NOW))


def plan_as_of(i: Inputs) -> DataFrame:
    probes = tables.table(i.spark, i.folder, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_shipdate").alias("ts")
    )
    return history.plan_as_of(probes, cut_lineage(i.plan_headers))


# Operations.


def resolution_outcomes(i: Inputs) -> DataFrame:
    return metrics.resolution_outcomes(i.lookup_calls)


def resolution_rate_5m(i: Inputs) -> DataFrame:
    return metrics.resolution_rate_5m(i.lookup_calls)


def build_duration_5m(i: Inputs) -> DataFrame:
    return metrics.build_duration_5m(i.timings)


def compile_vs_dispatch_5m(i: Inputs) -> DataFrame:
    return metrics.compile_vs_dispatch_5m(i.timings)


def states_over_time(i: Inputs) -> DataFrame:
    return metrics.states_over_time(i.transitions)


def task_store(i: Inputs) -> DataFrame:
    """Tasks written to the store, the waiting ones started as new versions, and what is read back."""
    path = shared_path(i.spark, "tasks")
    top = F.struct(F.col("top_resource_class").alias("resource_class"), F.col("top_resource_id").alias("resource_id"))
    resources = F.when(F.col("task_id") % 2 == 0, F.array(top)).otherwise(F.array().cast(RESOURCES))
    first = i.tasks.withColumn("resources", resources)
    store.append_versions(first, path)
    changes = first.filter(F.col("state") == "PENDING").withColumns(
        {"state": F.lit("STARTED"), "created_at": F.lit(NOW), "cursor": F.lit("page:0")}
    )
    store.task_table(i.spark, path).compact()
    store.append_versions(store.merge_versions(store.read_tasks(i.spark, path), changes), path)
    read = store.read_tasks(i.spark, path)
    pair = canonical_pair(F.col("top_resource_class"), F.col("top_resource_id"))
    return read.select(
        "task_id",
        "created_at",
        "state",
        "version",
        "cursor",
        resources_json(F.col("resources")).alias("resources"),
        pair["u"].alias("lesser_name"),
        format_instant(parse_instant(format_instant(F.col("timeout_at")))).alias("timeout_text"),
    )


def scalar_fields(i: Inputs) -> DataFrame:
    """Scalar readings of task columns: search fields, ring slots, durations, policy names, ids."""
    named = F.element_at(F.array(*map(F.lit, ("deadline", " Priority ", "fifo", "other"))), F.col("task_id").cast("int") % 4 + 1)
    return i.tasks.select(
        "task_id",
        dsl_field(F.col("search_dsl"), "projectId").alias("project"),
        ring_slot(epoch_minute(F.col("created_at"))).alias("slot"),
        iso_duration_ms(ms_iso_duration(F.col("task_id") * 100)).alias("duration_ms"),
        policy_name(named).alias("policy"),
        uuid_text(F.upper(name_uuid(F.col("task_id").cast("string")))).alias("name"),
    )


def _results(i: Inputs) -> DataFrame:
    done = lifecycle.apply_outcomes(i.outcomes, i.tasks)
    return i.plan.schedule.select("batch_id", "component", "task_id").join(done, "task_id")


def group_results(i: Inputs) -> DataFrame:
    return metrics.group_results(_results(i))


def plan_duration_error(i: Inputs) -> DataFrame:
    return metrics.plan_duration_error(i.plan.metrics(), _results(i))


def _example_work(task: dict) -> dict:
    """Stands for a user's work function: fails late waves, pauses long tasks."""
    if task["colour"] >= 2:
        raise ValueError(f"wave {task['colour']}")
    if task["estimate_ms"] > 1000:
        return {"outcome": "PAUSED", "cursor": f"page:{task['ordinal']}"}
    return {"outcome": "COMPLETED"}


def apply_by_component(i: Inputs) -> DataFrame:
    return work.apply_by_component(i.plan.schedule, _example_work).drop("failure_reason")


def identical_replan(i: Inputs) -> DataFrame:
    """Every batch compiled again from rows in another order, and that plan with one task of one batch moved."""
    limits, mean = i.class_admission, cost.class_duration_mean(i.durations)
    mixed = i.tasks.repartition(7, F.xxhash64("task_id"))
    again = planning.compile_plan(mixed, i.resource_rows, CONFIG, limits, mean).schedule
    first = again.agg(F.min(F.struct("batch_id", "task_id")).alias("f")).select("f.*")
    moved = again.join(F.broadcast(first.withColumn("_moved", F.lit(1))), ["batch_id", "task_id"], "left")
    moved = moved.withColumn("pos", F.col("pos") + F.coalesce("_moved", F.lit(0))).select(*again.columns)
    same = history.same_batches(i.plan.schedule, again)
    return same.join(history.same_batches(again, moved).withColumnRenamed("same", "same_when_moved"), "batch_id")


# Streaming.

ONCE = {"availableNow": True}


def _finish(query) -> None:
    query.awaitTermination()


def stream_plan(i: Inputs) -> DataFrame:
    spark, folder = i.spark, i.folder
    stream = tables.tasks_from(
        jobs.file_stream(spark, folder, "orders.parquet"), tables.table(spark, folder, "customer")
    )
    limits, mean = i.class_admission, cost.class_duration_mean(i.durations)

    def plan_batch(batch: DataFrame, epoch: int) -> DataFrame:
        return planning.compile_plan(batch, i.resource_rows, CONFIG, limits, mean).schedule

    out = shared_path(spark, "plan")
    _finish(jobs.stream_plan(stream, plan_batch, f"{out}/rows", f"{out}/backlog", f"{out}/ckpt", ONCE))
    return jobs.read_epochs(spark, f"{out}/rows").drop("epoch")


def stream_progress(i: Inputs) -> DataFrame:
    out = shared_path(i.spark, "progress")
    deltas = tables.progress_deltas_from(jobs.file_stream(i.spark, i.folder, "events.parquet"))
    _finish(jobs.stream_progress(deltas, f"{out}/rows", f"{out}/ckpt", ONCE))
    return jobs.latest_epoch_rows(i.spark, f"{out}/rows", "task_id")


def stream_task_state(i: Inputs) -> DataFrame:
    out = shared_path(i.spark, "states")
    changes = tables.state_versions_from(jobs.file_stream(i.spark, i.folder, "lineitem.parquet"))
    _finish(jobs.stream_task_state(changes, f"{out}/rows", f"{out}/ckpt", ONCE))
    return jobs.latest_epoch_rows(i.spark, f"{out}/rows", "task_id")


def _event_stream(i: Inputs) -> DataFrame:
    return tables.class_events_from(
        jobs.file_stream(i.spark, i.folder, "events.parquet"),
        tables.table(i.spark, i.folder, "customer"),
    )


def stream_hourly_rate(i: Inputs) -> DataFrame:
    """All events as one file and then, after a restart, the clock that closes the last windows."""
    out = shared_path(i.spark, "rate")
    events = i.class_events.select("event_id", "resource_class", "ts", "kind")
    events.write.parquet(f"{out}/events/part=0")

    def run() -> None:
        stream = i.spark.readStream.schema(events.schema).parquet(f"{out}/events/part=*")
        _finish(jobs.stream_hourly_rate(stream, f"{out}/rows", f"{out}/ckpt", ONCE))

    run()
    last = events.agg(F.max(F.col("ts").cast("timestamp"))).first()[0]
    jobs.closing_clock(events, F.lit(last)).write.parquet(f"{out}/events/part=1")
    run()
    rows = jobs.read_epochs(i.spark, f"{out}/rows")
    return rows.select(F.col("window_end").cast("timestamp_ntz").alias("window_end"), "resource_class", "n")


def stream_inflight(i: Inputs) -> DataFrame:
    out = shared_path(i.spark, "inflight")
    seeds = cut_lineage(admission.inflight_by_class(i.tasks))
    _finish(
        jobs.stream_inflight(_event_stream(i), f"{out}/rows", f"{out}/state", f"{out}/ckpt", ONCE, seeds)
    )
    return jobs.read_epochs(i.spark, f"{out}/rows").select("event_id", "resource_class", "inflight")


def stream_rate_arrival(i: Inputs) -> DataFrame:
    out = shared_path(i.spark, "arrival")
    _finish(
        jobs.stream_rate_arrival(_event_stream(i), f"{out}/rows", f"{out}/state", f"{out}/ckpt", ONCE)
    )
    return jobs.read_epochs(i.spark, f"{out}/rows").drop("epoch")


def stream_timeouts(i: Inputs) -> DataFrame:
    spark, out = i.spark, shared_path(i.spark, "timeouts")
    changes = tables.tasks_from(
        jobs.file_stream(spark, i.folder, "orders.parquet"), tables.table(spark, i.folder, "customer")
    ).withColumnRenamed("created_at", "ts")
    expirable = F.col("state").isin(*EXPIRABLE_STATES)
    places = (f"{out}/{name}" for name in ("rows", "late", "state", "ckpt"))
    _finish(timers.stream_timeouts(changes, expirable, *places, ONCE))
    return jobs.read_epochs(spark, f"{out}/rows").drop("epoch")


def stream_group_messages(i: Inputs) -> DataFrame:
    """Planned groups sent in parts through a folder of message files and received as a stream."""
    out = shared_path(i.spark, "messages")
    messages.write_files(messages.encode_groups(_groups(i, PART_SIZES[0])), f"{out}/topic")
    received = i.spark.readStream.schema("key string, value string, batch_id bigint").json(f"{out}/topic")
    _finish(jobs.stream_group_messages(received, f"{out}/rows", f"{out}/ckpt", ONCE))
    return documents.group_waves(jobs.read_epochs(i.spark, f"{out}/rows"), ["batch_id"])


QUERIES: dict[str, Callable[[Inputs], DataFrame]] = {
    "eligible_batch": eligible_batch,
    "expired_tasks": expired_tasks,
    "reap_timeouts": reap_timeouts,
    "orphan_recovery": orphan_recovery,
    "inflight_tasks": inflight_tasks,
    "tasks_by_state": tasks_by_state,
    "inflight_by_class": inflight_by_class,
    "inflight_work_by_class": inflight_work_by_class,
    "force_complete": force_complete,
    "apply_outcomes": apply_outcomes,
    "latest_task_state": latest_task_state,
    "batch_assign": batch_assign,
    "ingest_tasks": ingest_tasks,
    "ingest_rejected": ingest_rejected,
    "ingest_checks": ingest_checks,
    "ingest_counter": ingest_counter,
    "footprint": task_footprint,
    "unresolved_skipped": unresolved_skipped,
    "footprint_range_join": footprint_range_join,
    "dependency_closure": dependency_closure,
    "conflict_edges": conflict_edges,
    "edge_shared_resources": edge_shared_resources,
    "adjacency_lists": adjacency_lists,
    "task_degree": task_degree,
    "hot_buckets": hot_buckets,
    "supplier_degree": supplier_degree,
    "supplier_components": supplier_components,
    "connected_components": connected_components,
    "component_sizes": component_sizes,
    "component_ids": component_ids,
    "task_to_component": task_to_component,
    "isolation_violations": isolation_violations,
    "order_fifo": _ordered("FIFO"),
    "order_deadline": _ordered("DEADLINE"),
    "order_priority": _ordered("PRIORITY"),
    "serial_waves": serial_waves,
    "class_duration_mean": class_duration_mean,
    "running_duration_estimate": running_duration_estimate,
    "task_estimates": task_estimates,
    "task_duration_stats": task_duration_stats,
    "colour_priority": colour_priority,
    "colour_waves": colour_waves,
    "colouring_violations": colouring_violations,
    "wave_schedule": wave_schedule,
    "critical_path": critical_path,
    "schedule_speedup": schedule_speedup,
    "plan_metrics": plan_metrics,
    "plan_trend": plan_trend,
    "plan_explain": plan_explain,
    "plan_nested": plan_nested,
    "plan_documents": plan_documents,
    "plan_history": plan_history,
    "group_messages": group_messages,
    "plan_diff": plan_diff,
    "plan_json_upgrade": plan_json_upgrade,
    "class_limits": class_limits,
    "inflight_balance": inflight_balance,
    "hourly_rate": hourly_rate,
    "hourly_rate_arrival": hourly_rate_arrival,
    "class_admission": class_admission,
    "class_pressure": class_pressure,
    "admit_partial": admit_partial,
    "admit_all_or_nothing": admit_all_or_nothing,
    "denied_by_class": denied_by_class,
    "cms_estimate": cms_estimate,
    "progress_snapshot": progress_snapshot,
    "task_status": task_status,
    "latest_plan": latest_plan,
    "plan_by_id": plan_by_id,
    "plan_for_instant": plan_for_instant,
    "plan_as_of": plan_as_of,
    "resolution_outcomes": resolution_outcomes,
    "resolution_rate_5m": resolution_rate_5m,
    "build_duration_5m": build_duration_5m,
    "compile_vs_dispatch_5m": compile_vs_dispatch_5m,
    "states_over_time": states_over_time,
    "task_store": task_store,
    "scalar_fields": scalar_fields,
    "group_results": group_results,
    "plan_duration_error": plan_duration_error,
    "apply_by_component": apply_by_component,
    "identical_replan": identical_replan,
    "stream_plan": stream_plan,
    "stream_progress": stream_progress,
    "stream_task_state": stream_task_state,
    "stream_hourly_rate": stream_hourly_rate,
    "stream_inflight": stream_inflight,
    "stream_rate_arrival": stream_rate_arrival,
    "stream_timeouts": stream_timeouts,
    "stream_group_messages": stream_group_messages,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(query: Callable[[Inputs], DataFrame]):
        return lambda spark, folder: query(inputs(spark, folder))

    return {name: bind(query) for name, query in QUERIES.items()}
