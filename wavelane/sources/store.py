"""Task, progress and plan tables on a file system or a database."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavelane.functions.scalars import or_empty_json, parse_resources, resources_json, state_name
from wavelane.plans import history
from wavelane.sources.versions import VersionTable


def read_jdbc(spark: SparkSession, table: str, partition_column: str | None = None, **options) -> DataFrame:
    """A database table; give a numeric ``partition_column`` with bounds to read in parallel."""
    reader = spark.read.format("jdbc").option("dbtable", table).options(**options)
    if partition_column:
        reader = reader.option("partitionColumn", partition_column)
    return reader.load()


def decode_tasks(rows: DataFrame) -> DataFrame:
    """Stored rows to typed tasks: JSON resources to an array, state names checked."""
    return rows.select(
        "task_id",
        "created_at",
        or_empty_json(F.col("payload")).alias("payload"),
        or_empty_json(F.col("search_dsl")).alias("search_dsl"),
        parse_resources(F.col("resources")).alias("resources"),
        "cursor",
        state_name(F.col("state")).alias("state"),
        "timeout_at",
        "top_resource_class",
        "top_resource_id",
        "version",
    )


def encode_tasks(tasks: DataFrame) -> DataFrame:
    return tasks.withColumn("resources", resources_json(F.col("resources")))


def task_table(spark: SparkSession, path: str) -> VersionTable:
    """The table of task versions under ``path``; compact it now and then."""
    return VersionTable(spark, path, "task_id")


def append_versions(tasks: DataFrame, path: str) -> None:
    """Write changed tasks as new versions; nothing is read."""
    task_table(tasks.sparkSession, path).append(encode_tasks(tasks))


def merge_versions(current: DataFrame, changes: DataFrame) -> DataFrame:
    """New versions of changed rows: id and creation time stay, the rest is overwritten."""
    kept = current.select(
        "task_id", F.col("created_at").alias("_created"), F.col("version").alias("_version")
    )
    merged = changes.join(kept, "task_id", "left")
    return merged.select(
        *[
            F.coalesce("_created", "created_at").alias("created_at")
            if c == "created_at"
            else F.coalesce(F.col("_version") + 1, F.lit(0).cast("bigint")).alias("version")
            if c == "version"
            else F.col(c)
            for c in changes.columns
        ]
    )


def read_tasks(spark: SparkSession, path: str, task_ids: list | None = None) -> DataFrame:
    """Current tasks, the newest version of each id; named ones are read from their buckets only."""
    return decode_tasks(task_table(spark, path).read(task_ids))


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


class PlanHistory:
    """Plan documents by day, and a header for each plan that says which day it is in.

    Headers are narrow and few. A question is answered from them first, so that documents are read from one day's partition.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def append(self, plans: DataFrame) -> None:
        """Add plan documents; nothing is rewritten. Headers come last: a plan counts once its documents are there."""
        dated = plans.withColumn("generated_date", F.to_date("generated_at"))
        added = f"{self.path}/documents/added={uuid.uuid4().hex}"
        dated.write.partitionBy("generated_date").parquet(added)
        # Taken from the documents just written: making them again would compile the plans' groups a second time.
        columns = [c for c in ("batch_id", "plan_id", "generated_at", "generated_date") if c in dated.columns]
        written = self.spark.read.schema(dated.schema).parquet(added)
        written.select(*columns).distinct().write.mode("append").parquet(f"{self.path}/headers")

    def headers(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/headers")

    def documents(self, headers: DataFrame) -> DataFrame:
        """Documents of the plans with these headers, of which there may be a handful."""
        found = headers.select("plan_id", "generated_date").distinct().collect()
        stored = self.spark.read.parquet(f"{self.path}/documents").drop("added")
        days = sorted({r.generated_date for r in found})
        return stored.filter(F.col("generated_date").isin(days) & F.col("plan_id").isin([r.plan_id for r in found]))

    def newest(self) -> DataFrame:
        return self.documents(history.latest_plan(self.headers()))

    def by_id(self, plan_id: str) -> DataFrame:
        return self.documents(self.headers().filter(F.col("plan_id") == plan_id))

    def in_force(self, at: Column) -> DataFrame:
        """The plan of the newest header at or before an instant; no rows before the first plan."""
        return self.documents(history.plan_for(self.headers(), at))
