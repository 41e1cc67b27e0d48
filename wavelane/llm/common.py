"""What the operators share: reading tables, staging results, words and digests."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wavelane.session import staged  # noqa: F401

# Lower-cases A-Z and turns every ASCII byte that is no letter or digit into a blank; bytes of
# longer UTF-8 sequences stay, so splitting gives the words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+.
ALNUM = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
    for b in range(256)
)
# Lower-cases A-Z only; bytes.split() then cuts at \x20 and \x09-\x0D.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

UPPER_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# Text handled at a time inside a task.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back(spark: SparkSession) -> None:
    """Let the driver notice that the shuffles behind a written step are no longer needed."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession, times: int = 1) -> int:
    return times * int(spark.conf.get("spark.sql.shuffle.partitions"))


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER_LETTERS, UPPER_LETTERS.lower())


def joined_digest(values: Column) -> Column:
    return F.sha2(F.array_join(values, ","), 256)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a text column; a null text is an empty one."""
    return [b or b"" for b in pc.cast(column, pa.binary()).to_pylist()]


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch with about ``most`` bytes of text each, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
    start = held = 0
    for k, size in enumerate(sizes):
        if k > start and held + size > most:
            yield batch.slice(start, k - start)
            start, held = k, 0
        held += size
    if batch.num_rows > start:
        yield batch.slice(start)


def map_slices(
    df: DataFrame,
    function: Callable[[pa.RecordBatch], pa.RecordBatch],
    schema: str | StructType,
    text: str = "text",
    most: int = SLICE_BYTES,
) -> DataFrame:
    """Apply ``function`` to pieces of bounded text size, wherever the rows happen to be."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, text, most):
                yield function(piece)

    return df.mapInArrow(run, schema)
