"""Structured Streaming twins of the stateful operators.

Two forms are used. Plain keyed totals run as streaming aggregations in the state store.
Operators with an order inside a key (clamped balance, ring counter, planning) run the batch
operator on each micro-batch, seeded with the small state the previous one left; a key may
then be arbitrarily hot, since the batch operators split it. Every micro-batch writes to a
folder named after its id and overwrites it when replayed, so results count once however
often a batch is retried.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from wavelane.operators import admission
from wavelane.operators.progress import progress_sums
from wavelane.session import cut_lineage
from wavelane.sources.messages import batch_of, decode_groups


# Kind of the rows that only say how late it is.
CLOCK = "clock"


def file_stream(
    spark: SparkSession, folder: str, glob: str, files_per_batch: int | None = None
) -> DataFrame:
    """Parquet files of a folder as an append stream, in the order they were written."""
    schema = spark.read.option("pathGlobFilter", glob).parquet(folder).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def topic_stream(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """(key, value, batch_id) messages of a Kafka topic; needs Spark's Kafka connector."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
    return message_rows(reader.option("subscribe", topic).option("includeHeaders", "true").load())


def message_rows(received: DataFrame) -> DataFrame:
    """Rows as a topic delivers them (key and value as bytes, headers) with the batch from the headers."""
    return received.select(
        F.col("key").cast("string").alias("key"),
        F.col("value").cast("string").alias("value"),
        batch_of(F.col("headers")).alias("batch_id"),
    )


def start(
    stream: DataFrame,
    step: Callable[[DataFrame, int], None],
    checkpoint: str,
    trigger: dict[str, Any],
    mode: str = "append",
) -> StreamingQuery:
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    return writer.foreachBatch(step).trigger(**trigger).start()


def write_epoch(df: DataFrame, out: str, epoch: int) -> None:
    df.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")


def read_epochs(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.option("basePath", out).parquet(f"{out}/epoch=*")


def stream_plan(
    tasks: DataFrame,
    plan_batch: Callable[[DataFrame, int], DataFrame],
    out: str,
    backlog: str,
    checkpoint: str,
    trigger: dict[str, Any],
    batch_size: int | None = None,
) -> StreamingQuery:
    """Plan each micro-batch of tasks together with what earlier ones left waiting, and append its schedule.

    ``plan_batch(tasks, epoch)`` gives a schedule; tasks of the batch that are not in it, denied by a limit or without
    resolved resources, wait for the next micro-batch, as do those beyond the oldest ``batch_size`` by (created_at, task_id).
    A waiting task keeps the epoch it first arrived in as ``arrived``; a row that repeats it takes its place. Once planned,
    a task leaves the backlog, so it is planned once for every time it was asked for.
    """

    def step(batch: DataFrame, epoch: int) -> None:
        new = batch.withColumn("arrived", F.lit(epoch).cast("bigint"))
        before = _backlog(batch.sparkSession, backlog, epoch, new)
        # One row a task: the last to arrive, under the first arrival.
        rest = [c for c in new.columns if c not in ("task_id", "arrived")]
        last = F.max(F.struct("arrived", *rest)).alias("_last")
        pool = before.unionByName(new).groupBy("task_id").agg(last, F.min("arrived").alias("arrived"))
        pool = cut_lineage(pool.select(*[F.col(f"_last.{c}").alias(c) if c in rest else F.col(c) for c in new.columns]))
        chosen = pool if batch_size is None else pool.orderBy("created_at", "task_id").limit(max(0, batch_size))
        write_epoch(plan_batch(cut_lineage(chosen), epoch), out, epoch)
        planned = batch.sparkSession.read.parquet(f"{out}/epoch={epoch}").select("task_id")
        write_epoch(pool.join(planned, "task_id", "left_anti").select(*new.columns), backlog, epoch)

    return start(tasks, step, checkpoint, trigger)


def _backlog(spark: SparkSession, backlog: str, epoch: int, like: DataFrame) -> DataFrame:
    """Tasks that the micro-batch before ``epoch`` left waiting."""
    if epoch == 0:
        return spark.createDataFrame([], like.schema)
    return spark.read.schema(like.schema).parquet(f"{backlog}/epoch={epoch - 1}")


def waiting(spark: SparkSession, backlog: str, epoch: int) -> DataFrame:
    """The backlog as micro-batch ``epoch`` left it."""
    return spark.read.parquet(f"{backlog}/epoch={epoch}")


def stream_progress(
    deltas: DataFrame, out: str, checkpoint: str, trigger: dict[str, Any]
) -> StreamingQuery:
    """Running totals per task; each micro-batch writes the tasks it changed."""
    totals = deltas.groupBy("task_id").agg(*progress_sums())
    return start(totals, lambda df, e: write_epoch(df, out, e), checkpoint, trigger, "update")


def stream_task_state(
    changes: DataFrame, out: str, checkpoint: str, trigger: dict[str, Any]
) -> StreamingQuery:
    """Newest state per task of a stream of (task_id, version, state) changes."""
    newest = changes.groupBy("task_id").agg(F.max(F.struct("version", "state")).alias("_n"))
    rows = newest.select("task_id", "_n.version", "_n.state")
    return start(rows, lambda df, e: write_epoch(df, out, e), checkpoint, trigger, "update")


def latest_epoch_rows(spark: SparkSession, out: str, key: str) -> DataFrame:
    """Last written row of each key of an update-mode output."""
    rows = read_epochs(spark, out)
    rest = [c for c in rows.columns if c not in (key, "epoch")]
    last = rows.groupBy(key).agg(F.max(F.struct("epoch", *rest)).alias("_r"))
    return last.select(key, *[f"_r.{c}" for c in rest])


def stream_hourly_rate(
    events: DataFrame, out: str, checkpoint: str, trigger: dict[str, Any], lateness: str = "1 minute"
) -> StreamingQuery:
    """Emissions per class in every 60-minute window sliding by a minute, in event time.

    Two stateful steps: counts per minute, then sums of at most 60 of them; an event meets one group, not sixty. Events
    later than ``lateness`` behind the newest one are left out of closed windows; ``stream_rate_arrival`` is the form
    that books them as current instead. A row of kind ``clock`` counts nowhere but moves the time on: at the
    end of a bounded run one that is an hour and twice the lateness ahead closes all windows (``closing_clock``).
    """
    marks = events.filter(F.col("kind").isin("emit", CLOCK)).select(
        F.col("ts").cast("timestamp").alias("ts"),
        "resource_class",
        F.when(F.col("kind") == "emit", 1).otherwise(0).cast("bigint").alias("one"),
    )
    minutes = marks.withWatermark("ts", lateness).groupBy(F.window("ts", "1 minute"), "resource_class").agg(
        F.sum("one").alias("in_minute")
    )
    rate = (
        minutes.select(F.window_time("window").alias("minute"), "resource_class", "in_minute")
        .groupBy(F.window("minute", "60 minutes", "1 minute"), "resource_class")
        .agg(F.sum("in_minute").alias("n"))
        .select(F.col("window.end").alias("window_end"), "resource_class", "n")
        .filter(F.col("n") > 0)
    )
    return start(rate, lambda df, e: write_epoch(df, out, e), checkpoint, trigger)


def closing_clock(events: DataFrame, last: Column, lateness: str = "1 minute") -> DataFrame:
    """One row like ``events`` that closes all windows up to the time ``last`` of a bounded run."""
    ahead = last + F.expr("interval 62 minutes") + F.expr(f"2 * interval {lateness}")
    given = {"kind": F.lit(CLOCK), "ts": ahead}
    kinds = events.schema
    one = events.sparkSession.range(1)
    return one.select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in kinds.fields])


def _previous(spark: SparkSession, state: str, epoch: int, schema: str) -> DataFrame:
    """State left by the micro-batch before ``epoch``; empty for the first one."""
    if epoch == 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{state}/epoch={epoch - 1}")


def stream_inflight(
    events: DataFrame,
    out: str,
    state: str,
    checkpoint: str,
    trigger: dict[str, Any],
    seeds: DataFrame | None = None,
) -> StreamingQuery:
    """Clamped in-flight balance after each event, carried from batch to batch.

    Inside a micro-batch events count in (ts, event_id) order; micro-batches follow arrival.
    """
    schema = "resource_class string, inflight bigint"

    def step(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        before = _previous(spark, state, epoch, schema)
        if epoch == 0 and seeds is not None:
            before = seeds.select("resource_class", "inflight")
        balance = cut_lineage(admission.inflight_balance(batch, before))
        ended = balance.groupBy("resource_class").agg(
            F.max(F.struct("ts", "event_id", "inflight"))["inflight"].alias("_end")
        )
        after = before.join(ended, "resource_class", "full").select(
            "resource_class", F.coalesce("_end", "inflight").alias("inflight")
        )
        write_epoch(balance, out, epoch)
        write_epoch(after, state, epoch)

    return start(events, step, checkpoint, trigger)


def stream_rate_arrival(
    events: DataFrame, out: str, state: str, checkpoint: str, trigger: dict[str, Any]
) -> StreamingQuery:
    """Ring-counter rate: late events are booked in the current minute, never dropped.

    State is the bookings of the last hour, at most 60 rows per class.
    """
    schema = "resource_class string, booked_minute bigint, booked bigint"

    def step(batch: DataFrame, epoch: int) -> None:
        before = _previous(batch.sparkSession, state, epoch, schema)
        rates = cut_lineage(admission.hourly_rate_arrival(batch, earlier=before))
        booked = rates.groupBy("resource_class", "booked_minute").agg(
            F.count(F.lit(1)).alias("booked")
        )
        ring = (
            before.unionByName(booked)
            .groupBy("resource_class", "booked_minute")
            .agg(F.sum("booked").alias("booked"))
        )
        clock = ring.groupBy("resource_class").agg(F.max("booked_minute").alias("_now"))
        kept = ring.join(clock, "resource_class").filter(
            F.col("booked_minute") > F.col("_now") - admission.RATE_MINUTES
        )
        write_epoch(rates, out, epoch)
        write_epoch(kept.drop("_now"), state, epoch)

    return start(events, step, checkpoint, trigger)


def stream_group_messages(
    messages: DataFrame, out: str, checkpoint: str, trigger: dict[str, Any]
) -> StreamingQuery:
    """Typed groups of a message stream, for consumers that run them."""
    groups = decode_groups(messages)
    return start(groups, lambda df, e: write_epoch(df, out, e), checkpoint, trigger)
