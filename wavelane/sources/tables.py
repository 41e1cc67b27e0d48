"""The star-schema test tables read as tasks, footprints, events and their companions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def week_number(ts: Column) -> Column:
    """Weeks since the Monday before the epoch; one planning batch per calendar week."""
    return F.floor((F.unix_date(ts.cast("date")) + 3) / 7).cast("bigint")


def tasks(spark: SparkSession, folder: str) -> DataFrame:
    return tasks_from(table(spark, folder, "orders"), table(spark, folder, "customer"))


def tasks_from(orders: DataFrame, customer: DataFrame) -> DataFrame:
    """Orders as tasks: customer segment and key are the top resource, weeks are batches.

    ``orders`` may be a stream.
    """
    customer = customer.select("c_custkey", "c_mktsegment")
    key = F.col("o_orderkey")
    state = (
        F.when(F.col("o_orderstatus") == "O", "PENDING")
        .when(F.col("o_orderstatus") == "P", "PAUSED")
        .when(key % 4 == 0, "STARTED")
        .when(key % 4 == 1, "PROCESSING")
        .when(key % 4 == 2, "COMPLETED")
        .otherwise("FAILED")
    )
    page = F.concat(F.lit("page:"), (key % 5).cast("string"))
    even = F.floor(key / 4) % 2 == 0
    day = F.expr("interval 1 day")
    return (
        orders.join(customer, orders.o_custkey == customer.c_custkey)
        .select(
            week_number(F.col("o_orderdate")).alias("batch_id"),
            key.alias("task_id"),
            F.col("o_orderdate").alias("created_at"),
            F.to_json(
                F.struct(
                    F.floor(F.col("o_custkey") / 60).cast("string").alias("projectId"),
                    F.date_format("o_orderdate", "yyyy-MM-dd").alias("from"),
                    F.date_format(F.col("o_orderdate") + day * 6, "yyyy-MM-dd").alias("to"),
                    F.floor(F.col("o_custkey") / 3).cast("string").alias("tagSetId"),
                    F.when(key % 11 == 0, F.concat_ws("-", key, F.lit(1))).alias("talkId"),
                )
            ).alias("search_dsl"),
            F.lit("{}").alias("payload"),
            F.when(state.isin("PAUSED"), page)
            .when(state.isin("STARTED", "PROCESSING") & even, page)
            .alias("cursor"),
            state.alias("state"),
            F.when(key % 7 != 0, F.col("o_orderdate") + day * (key % 60).cast("int")).alias(
                "timeout_at"
            ),
            F.col("c_mktsegment").alias("top_resource_class"),
            F.col("o_custkey").cast("string").alias("top_resource_id"),
            F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"),
            F.lit(0).cast("bigint").alias("version"),
        )
    )


def resource_rows(spark: SparkSession, folder: str) -> DataFrame:
    """What each task touches: its customer and every part on its lines."""
    orders = table(spark, folder, "orders")
    customers = orders.select(
        F.col("o_orderkey").alias("task_id"),
        F.lit("customer").alias("resource_class"),
        F.col("o_custkey").cast("string").alias("resource_id"),
    )
    return customers.unionByName(part_rows(spark, folder))


def part_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The parts alone; tasks without lines have no row here and fall back to their top resource."""
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("task_id"),
        F.lit("part").alias("resource_class"),
        F.col("l_partkey").cast("string").alias("resource_id"),
    )


def supplier_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Few, very large buckets: the stress footprint."""
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("task_id"),
        F.lit("supplier").alias("resource_class"),
        F.col("l_suppkey").cast("string").alias("resource_id"),
    )


def _with_class(events: DataFrame, customer: DataFrame) -> DataFrame:
    """Events with the market segment of their user as resource class."""
    segment = customer.select(
        F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("resource_class")
    )
    return events.join(segment, "user_id")


def class_events(spark: SparkSession, folder: str) -> DataFrame:
    return class_events_from(table(spark, folder, "events"), table(spark, folder, "customer"))


def class_events_from(events: DataFrame, customer: DataFrame) -> DataFrame:
    """Emit and complete marks per resource class; ``events`` may be a stream."""
    return _with_class(events, customer).select(
        "event_id",
        "resource_class",
        "ts",
        F.when(F.col("event_type").isin("view", "click", "signup"), "emit")
        .otherwise("complete")
        .alias("kind"),
    )


def durations(spark: SparkSession, folder: str) -> DataFrame:
    """Observed run times in milliseconds by class; some are negative and must be ignored."""
    ms = F.floor(F.col("value") * 10).cast("bigint")
    events = _with_class(table(spark, folder, "events"), table(spark, folder, "customer"))
    return events.select(
        "event_id",
        "resource_class",
        F.when(F.col("event_id") % 7 == 0, -ms).otherwise(ms).alias("elapsed_ms"),
        "ts",
    )


def progress_deltas(spark: SparkSession, folder: str) -> DataFrame:
    return progress_deltas_from(table(spark, folder, "events"))


def progress_deltas_from(events: DataFrame) -> DataFrame:
    """Progress updates: a task per user, successes and failures by event type."""
    step = F.floor(F.col("value")).cast("bigint")
    zero = F.lit(0).cast("bigint")
    return events.select(
        F.col("user_id").alias("task_id"),
        F.when(F.col("event_type").isin("purchase", "view"), step).otherwise(zero).alias(
            "success_delta"
        ),
        F.when(F.col("event_type") == "error", step).otherwise(zero).alias("failed_delta"),
        F.when(F.col("event_type") != "signup", step).otherwise(zero).alias("total_delta"),
        "ts",
        "event_id",
    )


def outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """One dispatch result per shipped order line group, plus results for unknown tasks."""
    lines = table(spark, folder, "lineitem")
    key = F.col("task_id")
    base = lines.groupBy(F.col("l_orderkey").alias("task_id")).agg(
        F.min("l_shipdate").alias("started_at"), F.sum("l_linenumber").cast("bigint").alias("pages")
    )
    # Keys shifted past the largest order stand for tasks nobody stored.
    known = base.withColumn("task_id", F.when(key % 97 == 0, -key - 1).otherwise(key))
    seconds = (F.col("pages") * 60).cast("bigint")
    outcome = (
        F.when(F.col("pages") % 5 == 0, "FAILED")
        .when(F.col("pages") % 5 == 1, "PAUSED")
        .otherwise("COMPLETED")
    )
    thrown = F.col("pages") % 13 == 0
    return known.select(
        "task_id",
        F.when(~thrown, outcome).alias("outcome"),
        F.when(~thrown & (outcome == "PAUSED") & (F.col("pages") % 2 == 0), "page:9").alias("cursor"),
        F.when(~thrown & (outcome == "FAILED") & (F.col("pages") % 2 == 0), "bad input").alias(
            "failure_reason"
        ),
        F.when(thrown, "IllegalStateException").alias("error_type"),
        F.when(thrown, F.concat(F.lit("pages="), F.col("pages").cast("string"))).alias(
            "error_message"
        ),
        "started_at",
        (F.col("started_at") + F.expr("interval 1 second") * seconds).alias("finished_at"),
    )


def lookup_calls(spark: SparkSession, folder: str) -> DataFrame:
    """Resource lookup attempts: event errors carry an error class, other events succeed."""
    events = table(spark, folder, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return events.select(
        "event_id",
        "ts",
        F.when(
            F.col("event_type") == "error",
            F.when(k % 3 == 0, "SocketTimeoutException")
            .when(k % 3 == 1, "RequestTimedOut")
            .otherwise("IOException"),
        ).alias("error_type"),
    )


def class_limits(spark: SparkSession, folder: str) -> DataFrame:
    """Per-class limits derived from the number of customers; two segments keep the defaults."""
    n = F.count(F.lit(1))
    cls = F.col("c_mktsegment")
    return (
        table(spark, folder, "customer")
        .filter(cls.isin("BUILDING", "FURNITURE", "MACHINERY"))
        .groupBy(cls.alias("resource_class"))
        .agg(
            F.when(F.first(cls) == "MACHINERY", F.floor(n / 6))
            .otherwise(n * 50)
            .cast("bigint")
            .alias("max_inflight"),
            # Low enough for the rate alone to close a class.
            F.when(F.first(cls) == "BUILDING", F.floor(n / 80)).otherwise(n).cast("bigint").alias("max_rate_per_hour"),
        )
    )


def timings(spark: SparkSession, folder: str) -> DataFrame:
    """Compile and dispatch timings, taken from the events."""
    return table(spark, folder, "events").select(
        "event_id",
        "ts",
        F.when(F.col("event_type").isin("view", "click"), "compile").otherwise("dispatch").alias(
            "phase"
        ),
        F.floor(F.col("value") * 10).cast("bigint").alias("elapsed_ms"),
    )


def complete_commands(spark: SparkSession, folder: str) -> DataFrame:
    return (
        table(spark, folder, "events")
        .filter(F.col("event_type") == "purchase")
        .select(F.col("user_id").alias("task_id"))
    )


def failed_lookups(spark: SparkSession, folder: str) -> DataFrame:
    """Tasks whose resource lookup never worked."""
    k = F.get_json_object("props", "$.k").cast("int")
    return (
        table(spark, folder, "events")
        .filter((F.col("event_type") == "error") & (k >= 90))
        .select(F.col("user_id").alias("task_id"))
    )


def state_versions(spark: SparkSession, folder: str) -> DataFrame:
    return state_versions_from(table(spark, folder, "lineitem"))


def state_versions_from(lines: DataFrame) -> DataFrame:
    """A history of task versions: one per order line."""
    return lines.select(
        F.col("l_orderkey").alias("task_id"),
        F.col("l_linenumber").cast("bigint").alias("version"),
        F.when(F.col("l_returnflag") == "R", "PAUSED")
        .when(F.col("l_linestatus") == "O", "STARTED")
        .otherwise("COMPLETED")
        .alias("state"),
        F.col("l_partkey").cast("string").alias("cursor"),
    )


def ingest_commands(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as ingest commands; unlabelled ones lack a resource id and must be rejected."""
    labels = table(spark, folder, "labels")
    return table(spark, folder, "documents").join(labels, "doc_id", "left").select(
        "doc_id",
        F.col("lang").alias("resource_class"),
        F.col("quality").cast("string").alias("resource_id"),
        F.lit(None).cast("string").alias("payload"),
        F.when(F.col("toxic") == 1, F.to_json(F.struct("source"))).alias("search_dsl"),
        F.lit(None).cast("timestamp_ntz").alias("timeout_at"),
    )


def connections(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers as connections; four consecutive ones belong to a project."""
    return table(spark, folder, "supplier").select(
        F.floor(F.col("s_suppkey") / 4).cast("string").alias("project_id"),
        F.col("s_suppkey").cast("string").alias("connection_id"),
    )


def talks(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as dated talks on their supplier's connection."""
    return (
        table(spark, folder, "lineitem")
        .select(
            F.concat_ws("-", "l_orderkey", "l_linenumber").alias("talk_id"),
            F.col("l_suppkey").cast("string").alias("connection_id"),
            F.to_date("l_shipdate").alias("talked_on"),
        )
    )


def tag_sets(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as tags; four consecutive ones form a set."""
    return table(spark, folder, "part").select(
        F.floor(F.col("p_partkey") / 4).cast("string").alias("tag_set_id"),
        F.col("p_partkey").cast("string").alias("tag_id"),
    )


def tag_dependencies(spark: SparkSession, folder: str) -> DataFrame:
    """Each part depends on the part with half its key."""
    key = F.col("p_partkey")
    return table(spark, folder, "part").select(
        key.cast("string").alias("tag_id"),
        F.when(key > 0, F.floor(key / 2).cast("string")).alias("depends_on"),
    )


def transitions(spark: SparkSession, folder: str) -> DataFrame:
    """Dated state changes (task_id, state, ts): a task is received with its order and changes with every shipment."""
    received = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("task_id"), F.lit("RECEIVED").alias("state"), F.col("o_orderdate").alias("ts")
    )
    shipped = (
        F.when(F.col("l_returnflag") == "R", "PAUSED").when(F.col("l_linestatus") == "O", "STARTED").otherwise("COMPLETED")
    )
    changed = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("task_id"), shipped.alias("state"), F.col("l_shipdate").alias("ts")
    )
    return received.unionByName(changed)
