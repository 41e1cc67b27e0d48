"""Deadlines of a stream of task changes: a timing wheel and a task log, both kept as files.

The newest change of every task is kept for good, a small row, so a task that is closed stays closed whatever arrives later.
Rows are dealt out in buckets by task. A micro-batch appends what it changed, and once in ``compact_every`` batches each bucket
is written anew as a whole, a different share of the buckets each time; a bucket is therefore at most so many pieces. The
wheel holds open deadlines by the hour they are due in. A micro-batch reads the buckets of the tasks it meets and the hours
its clock has come to, and nothing else. Both only ever write under the number of the micro-batch, so a replayed one
overwrites its own rows.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from wavelane.session import cut_lineage, folders
from wavelane.streaming.jobs import start, write_epoch

HOUR_MS = 3_600_000
BUCKETS = 64
COMPACT_EVERY = 8


def _hour(ms: Column | int):
    return F.floor(ms / HOUR_MS).cast("bigint") if isinstance(ms, Column) else ms // HOUR_MS


class TaskLog:
    """Newest change per task, in buckets, with appended pieces and staggered compaction."""

    def __init__(self, spark: SparkSession, path: str, schema: str, buckets: int, compact_every: int) -> None:
        self.spark, self.path, self.schema = spark, path, schema
        self.buckets, self.compact_every = buckets, compact_every

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64("task_id"), F.lit(self.buckets)).cast("int").alias("bucket")

    def rewritten(self, epoch: int) -> set[int]:
        """Buckets that ``epoch`` writes as a whole."""
        return {b for b in range(self.buckets) if b % self.compact_every == epoch % self.compact_every}

    def read(self, epoch: int, buckets: set[int]) -> DataFrame:
        """Pieces of ``buckets`` as ``epoch`` finds them, with their bucket."""
        first = max(0, epoch - self.compact_every)
        paths = [f"{self.path}/epoch={e}" for e in range(first, epoch)]
        if not paths:
            return self.spark.createDataFrame([], f"{self.schema}, bucket int")
        rows = self.spark.read.schema(f"{self.schema}, bucket int, epoch bigint").option("basePath", self.path).parquet(*paths)
        # From the last time the bucket was written as a whole.
        whole = F.lit(epoch - 1) - F.pmod(F.lit(epoch - 1) - F.col("bucket"), F.lit(self.compact_every))
        asked = F.col("bucket").isin(sorted(buckets)) if len(buckets) < self.buckets else F.lit(True)
        return rows.filter(asked & (F.col("epoch") >= whole)).drop("epoch")

    def write(self, rows: DataFrame, epoch: int) -> None:
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/epoch={epoch}")


class Wheel:
    """(task_id, timeout_ms) of open deadlines by the hour they are due in."""

    def __init__(self, spark: SparkSession, path: str, schema: str) -> None:
        self.spark, self.path, self.schema = spark, path, schema

    def due(self, after_ms: int, until_ms: int, epoch: int) -> DataFrame:
        """Deadlines after ``after_ms`` up to ``until_ms`` that earlier micro-batches noted."""
        hours = folders(self.spark, self.path, "due_hour")
        paths = [p for h, p in hours.items() if h.lstrip("-").isdigit() and _hour(after_ms) <= int(h) <= _hour(until_ms)]
        schema = f"{self.schema}, due_hour bigint, epoch bigint"
        if not paths:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).option("basePath", self.path).parquet(*paths)
        at = F.col("timeout_ms")
        return rows.filter((F.col("epoch") < epoch) & (at > after_ms) & (at <= until_ms))

    def write(self, rows: DataFrame, epoch: int) -> None:
        placed = rows.withColumn("due_hour", _hour(F.col("timeout_ms"))).withColumn("epoch", F.lit(epoch).cast("bigint"))
        writer = placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("due_hour", "epoch").parquet(self.path)


def stream_timeouts(
    changes: DataFrame,
    expirable: Column,
    out: str,
    late: str,
    state: str,
    checkpoint: str,
    trigger: dict[str, Any],
    lateness_ms: int = 0,
    buckets: int = BUCKETS,
    compact_every: int = COMPACT_EVERY,
) -> StreamingQuery:
    """TIMEOUT transitions of tasks whose deadline passes while they wait or run.

    The newest time in the change stream is the clock. A deadline is decided ``lateness_ms`` after it has passed
    (0: at once), so changes that arrive up to that much behind the clock still count, whatever other
    tasks have sent. The newest change of a task by event time holds, in whichever order changes arrive and however
    late. One that would have stopped a timeout already given is written to ``late`` as well.
    """
    spark = changes.sparkSession
    task_type = dict(changes.dtypes)["task_id"]
    schema = f"task_id {task_type}, ts_ms bigint, seen bigint, closed boolean, state string, timeout_ms bigint, fired boolean"
    log = TaskLog(spark, f"{state}/tasks", schema, buckets, compact_every)
    wheel = Wheel(spark, f"{state}/wheel", f"task_id {task_type}, timeout_ms bigint")
    change = changes.select(
        "task_id",
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"),
        (~expirable).alias("closed"),
        "state",
        F.unix_millis(F.col("timeout_at").cast("timestamp")).alias("timeout_ms"),
        F.lit(False).alias("fired"),
    )

    def step(batch: DataFrame, epoch: int) -> None:
        arrived = batch.withColumn("seen", F.lit(epoch).cast("bigint")).select(*[c.split()[0] for c in schema.split(", ")])
        arrived = cut_lineage(arrived.withColumn("bucket", log.bucket()))
        was = spark.read.parquet(f"{state}/clock/epoch={epoch - 1}").first().clock_ms if epoch else None
        clock = max((t for t in (was, arrived.agg(F.max("ts_ms")).first()[0]) if t is not None), default=None)
        due = wheel.due(was - lateness_ms, clock - lateness_ms, epoch) if was is not None else arrived.limit(0)
        due = cut_lineage(due.select("task_id").distinct().withColumn("bucket", log.bucket()))
        met = arrived.select("task_id", "bucket").union(due.select("task_id", "bucket")).distinct()
        # At most as many numbers as there are buckets.
        touched = {r.bucket for r in met.select("bucket").distinct().collect()}
        whole = log.rewritten(epoch)
        held = log.read(epoch, touched | whole)
        # Equal times: what arrived last holds, a closing change before an opening one.
        newest = F.max(F.struct(*arrived.columns[1:-1])).alias("n")
        latest = held.unionByName(arrived).groupBy("task_id", "bucket").agg(newest).select("task_id", "bucket", "n.*")
        marked = latest.join(met.select("task_id").withColumn("_met", F.lit(True)), "task_id", "left")
        limit = F.lit(None if clock is None else clock - lateness_ms).cast("bigint")
        open_ = ~F.col("closed") & ~F.col("fired")
        marked = cut_lineage(marked.withColumn("_given", F.coalesce(open_ & (F.col("timeout_ms") <= limit), F.lit(False))))
        given = marked.filter("_given").select(
            "task_id", F.col("state").alias("from_state"), F.lit("TIMEOUT").alias("state"), "timeout_ms"
        )
        fired = held.groupBy("task_id").agg(newest).filter("n.fired").select("task_id", F.col("n.timeout_ms").alias("deadline_ms"))
        write_epoch(given, out, epoch)
        write_epoch(
            arrived.join(fired, "task_id").filter(F.col("ts_ms") <= F.col("deadline_ms")).drop("seen", "fired", "bucket"),
            late,
            epoch,
        )
        after = marked.withColumn("fired", F.col("fired") | F.col("_given"))
        noted = after.filter(open_ & (F.col("seen") == epoch) & (F.col("timeout_ms") > limit))
        wheel.write(noted.select("task_id", "timeout_ms"), epoch)
        changed = F.col("_met").isNotNull() | F.col("bucket").isin(sorted(whole))
        log.write(after.filter(changed).drop("_met", "_given"), epoch)
        write_epoch(spark.createDataFrame([(clock,)], "clock_ms bigint"), f"{state}/clock", epoch)

    return start(change, step, checkpoint, trigger)
