"""Token counts under a unigram vocabulary, by dynamic programming over a trie of words.

The distinct words of a slice of text go into tries; the best segmentation of every prefix is worked out once for all words that
share it, and the node a word ends at stores its number of tokens. A document's count adds up those of its words.
Nothing moves between tasks. The vocabulary has a fixed size and is sent to each executor once.

Defined results: a null or empty text, or one of white space only, has no words and no tokens; letters outside the
vocabulary count as their bytes; rows stay as they are, repeated or not; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavelane.llm import lattice
from wavelane.llm.common import as_bytes, map_slices


def word_tokens(words: list[bytes], pieces: lattice.Pieces, log_weight: np.ndarray) -> np.ndarray:
    """Tokens of each of some distinct, sorted words."""
    out = np.zeros(len(words), np.int64)
    for k in range(0, len(words), lattice.TRIE_WORDS):
        block = [lattice.MARK + w for w in words[k : k + lattice.TRIE_WORDS]]
        trie = lattice.build(block, pieces)
        out[k : k + len(block)] = lattice.best(trie, log_weight)[1][trie.terminal]
    return out


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_tokens) of every whole text."""
    pieces, weight = lattice.load(path)
    shared = docs.sparkSession.sparkContext.broadcast((vars(pieces), weight))

    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        fields, log_weight = shared.value
        split = [t.split() for t in as_bytes(piece.column(1))]
        words = sorted({w for s in split for w in s})
        tokens = dict(zip(words, word_tokens(words, lattice.Pieces(**fields), log_weight).tolist()))
        counts = [sum(map(tokens.__getitem__, s)) for s in split]
        columns = [piece.column(0), pa.array([len(s) for s in split], pa.int64()), pa.array(counts, pa.int64())]
        return pa.record_batch(columns, ["id", "n_words", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return map_slices(rows, run, f"id {kind}, n_words bigint, n_tokens bigint")
