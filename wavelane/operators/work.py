"""User work functions over a schedule: conflicting tasks never at the same time, in few jobs, resumable.

Waves are grouped into *runs*. A small component is one run. In a larger one a wide wave is a run of its own, spread over all
partitions, and consecutive narrow waves are one run that streams through a task in order, cut after ``run_tasks`` tasks. The runs
of a component follow each other and components do not wait for each other's tasks, so the k-th runs of all components are
one *step*: a Spark job whose results are written before the next one begins. A resource touched by very many
tasks thus costs its tasks and a few jobs, not a job a task.

Steps are planned and written in a folder. The same call with the same folder goes on where the last one stopped: steps that were
written are not run again, and a step that was cut short is run again as a whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from wavelane.functions.ranking import in_order
from wavelane.session import path_exists, shared_path

OUTCOME_COLUMNS = [
    ("outcome", T.StringType()),
    ("cursor", T.StringType()),
    ("failure_reason", T.StringType()),
    ("error_type", T.StringType()),
    ("error_message", T.StringType()),
]

# Tasks up to which a component is one run.
PARALLEL_TASKS = 10_000
# Tasks from which on a wave is spread over partitions, and tasks of one streamed run.
WIDE_WAVE = 256
RUN_TASKS = 10_000

COMPONENT = ["batch_id", "component"]


def plan_runs(
    schedule: DataFrame, parallel_tasks: int = PARALLEL_TASKS, wide_wave: int = WIDE_WAVE, run_tasks: int = RUN_TASKS
) -> DataFrame:
    """(batch_id, component, colour, step, wide) of every wave.

    The window over the waves of a component sees a row a wave, not its tasks.
    """
    waves = schedule.groupBy(*COMPONENT, "colour").agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*COMPONENT)
    ordered = whole.orderBy("colour")
    sized = waves.withColumn("_all", F.sum("_n").over(whole))
    large = F.col("_all") > parallel_tasks
    sized = sized.withColumn("wide", large & (F.col("_n") >= wide_wave))
    # A wide wave begins a stretch and so does what follows one.
    begins = F.col("wide") | F.coalesce(F.lag("wide").over(ordered), F.lit(True))
    stretches = sized.withColumn("_stretch", F.sum(begins.cast("int")).over(ordered))
    before = F.sum("_n").over(Window.partitionBy(*COMPONENT, "_stretch").orderBy("colour")) - F.col("_n")
    pieces = stretches.withColumn("_piece", F.when(large, F.floor(before / run_tasks)).otherwise(0))
    step = F.dense_rank().over(whole.orderBy("_stretch", "_piece")) - 1
    return pieces.select(*COMPONENT, "colour", step.alias("step"), "wide")


def apply_by_component(
    schedule: DataFrame,
    work: Callable[[dict], dict],
    folder: str | None = None,
    parallel_tasks: int = PARALLEL_TASKS,
    wide_wave: int = WIDE_WAVE,
    run_tasks: int = RUN_TASKS,
) -> DataFrame:
    """Run a user function on every scheduled task and give its results; all work is done when this returns.

    Rows reach ``work`` as dicts; it returns ``outcome`` and optionally ``cursor`` and ``failure_reason``. An
    exception fails its own task and no other. Rows stream through in Arrow batches. ``folder``, a fresh one unless
    given, is where to resume from.
    """
    spark = schedule.sparkSession
    fields = {f.name: f for f in schedule.schema.fields}
    keys = [*COMPONENT, "task_id"]
    schema = T.StructType(
        [T.StructField(k, fields[k].dataType) for k in keys]
        + [T.StructField(n, t) for n, t in OUTCOME_COLUMNS]
    )
    names = [n for n, _ in OUTCOME_COLUMNS]
    columns = schedule.columns
    if "colour" not in columns:
        # Without waves tasks go one by one.
        schedule = schedule.withColumn("colour", F.col("ordinal").cast("int"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            done = []
            for row in frame[columns].to_dict("records"):
                try:
                    result = work(row)
                    values = [result.get(n) for n in names]
                except Exception as error:  # the user's function may raise anything
                    values = [None, None, None, type(error).__name__, str(error)]
                done.append([row[k] for k in keys] + values)
            yield pd.DataFrame(done, columns=keys + names)

    folder = folder or shared_path(spark, "work")
    planned = f"{folder}/plan"
    if not path_exists(spark, f"{planned}/_SUCCESS"):
        runs = plan_runs(schedule, parallel_tasks, wide_wave, run_tasks)
        placed = schedule.join(runs, [*COMPONENT, "colour"]).select(*columns, "step", "wide")
        placed.write.mode("overwrite").partitionBy("step").parquet(planned)
    rows = spark.read.schema(T.StructType([*schedule.schema.fields, T.StructField("wide", T.BooleanType()), T.StructField("step", T.IntegerType())])).parquet(planned)
    last = rows.agg(F.max("step")).first()[0]
    slices = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for step in range(-1 if last is None else last + 1):
        out = f"{folder}/results/step={step}"
        if path_exists(spark, f"{out}/_SUCCESS"):
            continue
        due = rows.filter(F.col("step") == step)
        narrow = in_order(due.filter(~F.col("wide")), COMPONENT, [F.col("ordinal")])
        wide = due.filter("wide").repartition(slices, "task_id")
        results = narrow.mapInPandas(run, schema).unionByName(wide.mapInPandas(run, schema))
        results.write.mode("overwrite").parquet(out)
    if last is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{folder}/results/step={step}" for step in range(last + 1)])
