"""Session construction and lineage cutting."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

# Settings the operators rely on; all of them can be set on a running session.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Let AQE split a hot key even where that costs one more exchange above the join.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Rows of numbers shrink tenfold in a shuffle, and a task sorts and hashes what it reads several times over: with
    # partitions of this size, however many, its memory does not grow with the tables.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "400",
}

# Checkpoint files go away with the frame that owns them; read when the context starts.
START_CONF = {"spark.cleaner.referenceTracking.cleanCheckpoints": "true"}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else created."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", app: str = "wavelane", **conf: str) -> SparkSession:
    """A single-machine session for tests and benchmarks; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "16g")
    )
    for key, value in {**RUNTIME_CONF, **START_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Point the context at the shared checkpoint folder named by the cluster.

    Only a local master may fall back to a temporary folder: there, driver and executors
    share one disk. A cluster without ``spark.checkpoint.dir`` is a configuration error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        sc.setCheckpointDir(shared)
        return
    if not (sc.master or "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="wavelane-ckpt-", dir=os.environ.get("TMPDIR")))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in reliable shared storage so that losing executors loses nothing."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for ``name`` beside the checkpoints, reachable by all executors."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/tables/{name}-{uuid.uuid4().hex}"


# Spark then drops the shuffles of a query as soon as it has ended.
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_SPLIT = "spark.sql.files.maxPartitionBytes"


def staged(df: DataFrame, name: str, split: str | None = None, done: Sequence[DataFrame] = ()) -> DataFrame:
    """``df`` written to shared storage and read back: cuts lineage, prunes columns, survives lost executors.

    The shuffles behind it go once it is written, and so do the staged tables in ``done``, which nothing else may read.
    Files are read in pieces of ``split`` bytes meanwhile.
    """
    spark = df.sparkSession
    path, during = shared_path(spark, name), {_CLEAN_UP: "true"} | ({_SPLIT: split} if split else {})
    before = {key: spark.conf.get(key, None) for key in during}
    for key, value in during.items():
        spark.conf.set(key, value)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    for old in done:
        remove_folder(spark, old.staged_at)
    table = spark.read.schema(df.schema).parquet(path)
    table.staged_at = path
    return table


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in whichever store the path names."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def folders(spark: SparkSession, path: str, key: str) -> dict[str, str]:
    """Sub-folders named ``key=value`` of a folder, by value; only names are listed."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in files.listStatus(place) if s.isDirectory()] if files.exists(place) else []
    return {n.split("=", 1)[1]: f"{path}/{n}" for n in names if n.startswith(f"{key}=")}


def remove_folder(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
