"""Likelihood of texts over all their subword segmentations.

The pieces of an existing vocabulary, weighted by its scores at first, are fitted to the training texts by expectation-maximisation: every
step adds up how often each piece is expected over all segmentations of the training words. A word's probability is
the sum over its segmentations, by forward recursion in logarithms; a text is its words and one end,
which is one more piece, so the probabilities of all texts add up to one.

Texts are read once, slice by slice. A slice keeps its documents as numbers into its own list of distinct words; these
words are what moves: counted over the corpus, scored once each, and sent back to the slices. So a frequent word
costs one row per slice, not per occurrence, and per-piece sums are as many as the vocabulary has pieces.

Defined results: a null or empty text is its end alone; without training texts counts are 0 and the vocabulary's own
weights hold; rows with a null id are training texts; rows that repeat an id are scored each; letters outside the vocabulary are spelt in bytes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavelane.llm import lattice
from wavelane.llm.common import LOWER, as_bytes, give_back, partitions, slices, staged

STEPS = 2
# What is added to every expected count of a piece.
SMOOTHING = 0.1
SLICE = 10 << 20


def held_out_fold(id_: Column, folds: int = 7, fold: int = 2) -> Column:
    """True for ids whose CRC-32, as text, leaves ``fold``; a null id is in no fold."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % folds == fold, F.lit(False))


def _encode(kind: str):
    """Slices of documents as numbers into the slice's words: one row per slice."""

    def one(slice_: int, piece: pa.RecordBatch) -> pa.RecordBatch:
        number: dict[bytes, int] = {}
        sizes, codes = [], []
        for text in as_bytes(piece.column("text")):
            words = text.translate(LOWER).split()
            sizes.append(len(words))
            codes.append(np.array([number.setdefault(w, len(number)) for w in words], np.int32))
        flat = np.concatenate(codes) if codes else np.zeros(0, np.int32)
        trained = np.repeat(~piece.column("held").to_numpy(zero_copy_only=False).astype(bool), sizes)
        counts = np.bincount(flat[trained], minlength=len(number))
        ids, held = piece.column("id"), piece.column("held")
        whole = pa.array([0, piece.num_rows], pa.int32())
        return pa.record_batch(
            [
                pa.array([slice_], pa.int64()),
                pa.ListArray.from_arrays(whole, ids),
                pa.ListArray.from_arrays(whole, held),
                pa.array([sizes], pa.list_(pa.int64())),
                pa.array([zstandard.compress(flat.tobytes())], pa.binary()),
                pa.array([[w.decode() for w in number]], pa.list_(pa.string())),
                pa.array([counts], pa.list_(pa.int64())),
            ],
            ["slice", "ids", "held", "sizes", "codes", "words", "counts"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slice_ = TaskContext.get().partitionId() << 32
        for batch in batches:
            for piece in slices(batch, "text", SLICE):
                yield one(slice_, piece)
                slice_ += 1

    schema = (
        f"slice bigint, ids array<{kind}>, held array<boolean>, sizes array<bigint>, codes binary, "
        "words array<string>, counts array<bigint>"
    )
    return run, schema


def _tries(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], np.ndarray]]:
    """Sorted words and their counts, as many as go into one trie."""
    for batch in batches:
        for k in range(0, batch.num_rows, lattice.TRIE_WORDS):
            piece = batch.slice(k, lattice.TRIE_WORDS)
            words, counts = piece.column("word").to_pylist(), piece.column("c").to_numpy()
            order = sorted(range(len(words)), key=lambda i: words[i].encode())
            yield [words[i] for i in order], counts[order]


def _marked(words: list[str]) -> list[bytes]:
    return [lattice.MARK + w.encode() for w in words]


def fit(words: DataFrame, ends: int, path: str, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """(log weights of the pieces, log weight of an end), fitted to (word, c) rows and ``ends`` texts."""
    spark = words.sparkSession
    pieces, start = lattice.load(path)
    fields = spark.sparkContext.broadcast(vars(pieces))
    kinds = pieces.count
    total = float(words.agg(F.sum("c")).first()[0] or 0)
    end = (ends + SMOOTHING) / (ends + total + 2 * SMOOTHING)
    weight = start + math.log1p(-end)
    for _ in range(steps if total else 0):
        now = spark.sparkContext.broadcast(weight)

        def run(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            own, sums = lattice.Pieces(**fields.value), np.zeros(kinds)
            for names, counts in _tries(batches):
                sums += lattice.expected_counts(lattice.build(_marked(names), own), now.value, counts, kinds)
            some = np.flatnonzero(sums)
            yield pa.record_batch([pa.array(some), pa.array(sums[some])], ["piece", "n"])

        found = words.filter("c > 0").select("word", "c").mapInArrow(run, "piece bigint, n double")
        # As many rows as the vocabulary has pieces, whatever the corpus.
        sums = np.full(kinds, SMOOTHING)
        for r in found.groupBy("piece").agg(F.sum("n").alias("n")).collect():
            sums[r["piece"]] += r["n"]
        whole = sums.sum() + ends + SMOOTHING
        weight, end = np.log(sums / whole), (ends + SMOOTHING) / whole
    return weight, math.log(end)


def score(
    docs: DataFrame,
    held_out: Column,
    path: str,
    steps: int = STEPS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document.

    Texts where ``held_out`` holds are scored but not learned from; scores are decimal logarithms.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col).alias("id"), held_out.alias("held"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    kind = rows.schema["id"].dataType.simpleString()
    encoded = staged(rows.mapInArrow(*_encode(kind)), "lm-slices")
    places = encoded.select("slice", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "w"))
    places = places.select("slice", "at", F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    counted = places.groupBy("word").agg(F.sum("n").alias("c"))
    # Neighbours share prefixes, so words are dealt out in order.
    words = staged(
        counted.repartitionByRange(partitions(spark), "word").sortWithinPartitions("word"), "lm-words"
    )
    give_back(spark)
    flags = encoded.select(F.explode("held").alias("held"))
    ends = flags.filter(~F.col("held")).count()
    known = words.agg(F.sum("c").alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v")).first()
    tokens, distinct = (known["n"] or 0) + ends, known["v"] + (1 if ends else 0)
    weight, end_weight = fit(words, ends, path, steps)
    pieces, _ = lattice.load(path)
    shared = spark.sparkContext.broadcast((vars(pieces), weight))

    def likelihood(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields, log_weight = shared.value
        own = lattice.Pieces(**fields)
        for names, counts in _tries(batches):
            trie = lattice.build(_marked(names), own)
            value = lattice.forward(trie, log_weight)[trie.terminal] / math.log(10)
            yield pa.record_batch([pa.array(names), pa.array(counts), pa.array(value)], ["word", "c", "value"])

    scored = words.mapInArrow(likelihood, "word string, c bigint, value double")
    replies = (
        places.select("slice", "at", "word")
        .join(scored, "word")
        .groupBy("slice")
        .agg(F.collect_list(F.struct("at", "c", "value")).alias("reply"))
    )
    whole = encoded.select("slice", "ids", "held", "sizes", "codes").join(replies, "slice", "left")
    divisor = math.log10(tokens + distinct + 1)
    end_base, end_value = math.log10(ends + 1) - divisor, end_weight / math.log(10)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                ids, held = row.column("ids").flatten(), row.column("held").flatten()
                sizes = row.column("sizes").flatten().to_numpy()
                codes = np.frombuffer(zstandard.decompress(row.column("codes")[0].as_py()), np.int32)
                reply = row.column("reply").flatten()
                count, value = np.zeros(len(reply), np.int64), np.zeros(len(reply))
                if len(reply):
                    at = reply.field("at").to_numpy()
                    count[at], value[at] = reply.field("c").to_numpy(), reply.field("value").to_numpy()
                doc = np.repeat(np.arange(len(sizes)), sizes)
                n = len(sizes)
                base = np.bincount(doc, (np.log10(count + 1) - divisor)[codes], n) + end_base
                total = np.bincount(doc, value[codes], n) + end_value
                seen = np.bincount(doc, count[codes] > 0, n).astype(np.int64) + (1 if ends else 0)
                yield pa.record_batch(
                    [ids, held, *map(pa.array, (sizes + 1, seen, np.full(n, tokens), base, total))],
                    ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return whole.mapInArrow(
        add_up,
        f"id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
        "base_score double, score double",
    )
