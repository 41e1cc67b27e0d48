"""A log-structured table of row versions: bucketed snapshots and the deltas appended since.

An append writes one folder of changed rows and reads nothing. A snapshot holds the newest version of every row, in buckets by
key, and a list of the deltas it took in. A reader takes the newest finished snapshot and all deltas that are not on its
list, so a delta appended while a snapshot is being written is neither lost nor waited for, and one read twice does no
harm: the highest version of a key holds. Reading shuffles the keys that changed since the snapshot, not the table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavelane.operators.lifecycle import latest_by_version
from wavelane.session import folders, path_exists, remove_folder

BUCKETS = 64


class VersionTable:
    """Rows with a key and a ``version`` under ``path``."""

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def append(self, rows: DataFrame) -> str:
        """Write changed rows; the name of the delta."""
        name = uuid.uuid4().hex
        placed = rows.withColumn("bucket", self._bucket(F.col(self.key)))
        placed.write.partitionBy("bucket").parquet(f"{self.path}/deltas/delta={name}")
        return name

    def _newest_snapshot(self) -> tuple[int, str] | None:
        found = folders(self.spark, f"{self.path}/snapshots", "number")
        done = [(int(n), p) for n, p in found.items() if path_exists(self.spark, f"{p}/taken/_SUCCESS")]
        return max(done, default=None)

    def _deltas(self) -> dict[str, str]:
        found = folders(self.spark, f"{self.path}/deltas", "delta")
        return {n: p for n, p in found.items() if path_exists(self.spark, f"{p}/_SUCCESS")}

    def _parts(self) -> tuple[DataFrame | None, DataFrame | None, int, list[str]]:
        """Snapshot, newer deltas, the snapshot's number and the names of all deltas it and they hold."""
        last, deltas = self._newest_snapshot(), self._deltas()
        snapshot, taken, number = None, set(), 0
        if last is not None:
            number, folder = last
            snapshot = self.spark.read.parquet(f"{folder}/rows")
            taken = {r.delta for r in self.spark.read.parquet(f"{folder}/taken").collect()}
        newer = [p for n, p in deltas.items() if n not in taken]
        # Every delta is a folder of buckets of its own.
        rows = None
        for path in newer:
            part = self.spark.read.parquet(path)
            rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
        return snapshot, rows, number, sorted(set(deltas) | taken)

    def _pruned(self, rows: DataFrame, keys: list | None) -> DataFrame:
        """Rows of some keys, from their buckets only."""
        if keys is None:
            return rows
        kind = rows.schema[self.key].dataType
        asked = self.spark.createDataFrame([(k,) for k in keys], f"k {kind.simpleString()}")
        buckets = sorted({r.b for r in asked.select(self._bucket(F.col("k")).alias("b")).collect()})
        return rows.filter(F.col("bucket").isin(buckets) & F.col(self.key).isin(list(keys)))

    def read(self, keys: list | None = None) -> DataFrame:
        """The newest version of every row, or of those with the given keys."""
        snapshot, deltas, _, _ = self._parts()
        if snapshot is None and deltas is None:
            raise FileNotFoundError(f"nothing was written under {self.path}")
        if deltas is None:
            return self._pruned(snapshot, keys).drop("bucket")
        deltas = self._pruned(deltas, keys)
        if snapshot is None:
            return latest_by_version(deltas.drop("bucket"), self.key)
        snapshot = self._pruned(snapshot, keys)
        changed = deltas.select(self.key).distinct()
        met = snapshot.join(changed, self.key, "left_semi").unionByName(deltas, allowMissingColumns=True)
        newest = latest_by_version(met.drop("bucket"), self.key)
        return snapshot.join(changed, self.key, "left_anti").drop("bucket").unionByName(newest, allowMissingColumns=True)

    def compact(self) -> None:
        """Write a snapshot of what is there now. Appends may go on; two compactions at a time may not."""
        _, deltas, number, taken = self._parts()
        if deltas is None:
            return
        folder = f"{self.path}/snapshots/number={number + 1}"
        rows = self.read_parts(taken).withColumn("bucket", self._bucket(F.col(self.key)))
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/rows")
        # The list makes the snapshot count, so it comes last.
        self.spark.createDataFrame([(n,) for n in taken], "delta string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/taken")

    def read_parts(self, taken: list[str]) -> DataFrame:
        """What the snapshot and the deltas named give; later ones are left for the next snapshot."""
        last = self._newest_snapshot()
        known = set()
        rows = None
        if last is not None:
            rows = self.spark.read.parquet(f"{last[1]}/rows")
            known = {r.delta for r in self.spark.read.parquet(f"{last[1]}/taken").collect()}
        for name in taken:
            if name not in known:
                part = self.spark.read.parquet(f"{self.path}/deltas/delta={name}")
                rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
        return latest_by_version(rows.drop("bucket"), self.key)

    def vacuum(self) -> None:
        """Remove what no reader that starts now would read: older snapshots and the deltas taken in."""
        last = self._newest_snapshot()
        if last is None:
            return
        number, folder = last
        taken = {r.delta for r in self.spark.read.parquet(f"{folder}/taken").collect()}
        for name, path in self._deltas().items():
            if name in taken:
                remove_folder(self.spark, path)
        for n, path in folders(self.spark, f"{self.path}/snapshots", "number").items():
            if int(n) < number:
                remove_folder(self.spark, path)
