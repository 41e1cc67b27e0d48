"""The corpus pipeline: quality rules, line dedup, near-duplicates, decontamination, encoding.

Every stage takes (spark, docs, sf_dir) and returns a frame, which is written and read again as the next one's
``docs``. All stages but the last return the columns of ``documents``. Rows with nulls, empty texts, repeated ids and extra
columns go through; what each stage makes of them is said at its operator and below.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavelane.llm import bpe, decontaminate, lines, quality, simhash
from wavelane.llm.common import staged, table
from wavelane.session import configure

# Differing bits up to which two fingerprints of five-word shingles are near-duplicates; what they share is then checked.
NEAR_BITS = 8
SHINGLE_WORDS = 5
SIMILARITY = 0.8


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or are outliers of their language and source go."""
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Chunks of lines met before are cut out of the texts; every document stays, if with an empty text."""
    return lines.deduplicated(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near-duplicates the document with the smallest id stays."""
    return simhash.deduplicated(docs, SHINGLE_WORDS, NEAR_BITS, SIMILARITY)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Occurrences of benchmark windows are cut out of the texts; every document stays."""
    return decontaminate.cleaned(docs, table(spark, sf_dir, "benchmark"))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): the ids of every text and what they decode to."""
    path = public_tokenizers.path("word_bpe_49k.json")
    decoded = bpe.decode(bpe.encode(docs, path), path)
    return decoded.select(
        F.col("id").alias("doc_id"), F.size("ids").cast("bigint").alias("n_tokens"), "ids", F.col("text").alias("decoded")
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("bpe_encoding", bpe_encoding),
]

# Covariance estimates and fingerprints have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table documents; the result of each but the last is written in between."""
    configure(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
