"""Byte-pair encoding in batched numpy merge rounds, and decoding.

The symbols of all new words of a batch lie in one flat array. A round looks the adjacent pairs up
by binary search over sorted pair keys, takes the lowest rank of each word and merges it in every word
at once; only pairs beside a merge are looked up again. Words without a known pair leave the array.
Where a merge may bring forth a pair of a lower rank than its own, a round merges only the
leftmost occurrence in a word, as merging one by one would; elsewhere it merges all of them.

The vocabulary is a file in the format of the tokenizers library: NFC, lower case, a splitting pattern
whose matches are kept, byte symbols with a word-end suffix. It is read on the driver; its size is
bounded by its vocabulary, and the arrays made of it go to the tasks.

Defined results: a null or empty text, or one of white space only, has no ids and decodes to an empty
text; texts of any length are encoded whole; rows stay as they are, repeated or not; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections import defaultdict
from dataclasses import dataclass
from functools import cached_property
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavelane.llm.common import map_slices

# Letters whose handling depends on the version of the Unicode tables; texts with any of them are
# normalised and split by the library whose ids are to be met.
RARE = re.compile("[^\x00-\u036f\u2010-\u203f\u20ac]")
# Character classes that depend on the Unicode tables or differ between libraries.
_CLASS = re.compile(r"\\(?:[pP]\{[^}]*\}|[sSwWdDbB])")
NO_RANK = np.int64(1) << 40
# Distinct words a task remembers before it starts afresh.
CACHE_WORDS = 300_000


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where it is visible, else the next free one from 256."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b if b in visible else next(spare)) for b in range(256)]


@dataclass
class Vocabulary:
    keys: np.ndarray  # left << 32 | right, sorted
    ranks: np.ndarray
    merged: np.ndarray
    whole: np.ndarray  # by rank: may all occurrences be merged at once
    inner: np.ndarray  # symbol of a byte inside a word
    final: np.ndarray  # symbol of a byte that ends a word
    tokens: list[str]
    special: dict[str, int]
    pattern: str
    rules: str  # the file without its vocabulary

    @cached_property
    def words(self):
        return regex.compile(self.pattern)

    @cached_property
    def plain_words(self):
        """The pattern for texts without rare letters, its classes spelled out for the faster ``re``; else ``words``."""
        usual = [c for c in map(chr, range(0x20AD)) if not RARE.match(c)]

        def spelled(bracket: re.Match) -> str:
            return _CLASS.sub(lambda k: "".join(re.escape(c) for c in usual if regex.match(k[0], c)), bracket[0])

        pattern = re.sub(r"\[[^\]]*\]", spelled, self.pattern)
        return self.words if _CLASS.search(pattern) else re.compile(pattern)

    @cached_property
    def specials(self):
        return re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")

    @cached_property
    def library(self):
        split = tokenizers.pre_tokenizers.Split(tokenizers.Regex(self.pattern), "removed", invert=True)
        return tokenizers.Tokenizer.from_str(self.rules).normalizer, split


def load(path: str) -> Vocabulary:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    ids, suffix = model["vocab"], model["end_of_word_suffix"]
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    left = np.array([ids[a] for a, _ in pairs], np.int64)
    right = np.array([ids[b] for _, b in pairs], np.int64)
    new = np.array([ids[a + b] for a, b in pairs], np.int64)
    # The lowest rank of any pair that a symbol takes part in; a merge is plain if what it makes comes later.
    lowest = np.full(max(ids.values()) + 1, NO_RANK)
    rank = np.arange(len(pairs))
    np.minimum.at(lowest, left, rank)
    np.minimum.at(lowest, right, rank)
    order = np.argsort(left << 32 | right)
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    tokens = [""] * (max([*ids.values(), *special.values()]) + 1)
    for text, k in {**ids, **special}.items():
        tokens[k] = text
    letters = _byte_letters()
    return Vocabulary(
        (left << 32 | right)[order],
        rank[order],
        new[order],
        lowest[new] > rank,
        np.array([ids[c] for c in letters], np.int64),
        np.array([ids[c + suffix] for c in letters], np.int64),
        tokens,
        special,
        spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"],
        json.dumps(spec | {"model": {"type": "BPE", "vocab": {}, "merges": []}, "added_tokens": []}),
    )


def _look_up(v: Vocabulary, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rank, merged symbol) of pairs; unknown ones have NO_RANK."""
    key = left << 32 | right
    at = np.minimum(np.searchsorted(v.keys, key), len(v.keys) - 1)
    known = v.keys[at] == key
    return np.where(known, v.ranks[at], NO_RANK), v.merged[at]


def encode_words(v: Vocabulary, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words one after another, number of ids of each word); no word may be empty."""
    sizes = np.array([len(w) for w in words], np.int64)
    raw = np.frombuffer(b"".join(words), np.uint8)
    sym = v.inner[raw]
    last = np.cumsum(sizes) - 1
    sym[last] = v.final[raw[last]]
    word = np.repeat(np.arange(len(words)), sizes)
    rank = np.full(len(sym), NO_RANK)
    made = np.zeros(len(sym), np.int64)
    inside = np.flatnonzero(word[:-1] == word[1:])
    rank[inside], made[inside] = _look_up(v, sym[inside], sym[inside + 1])
    out: list[tuple[np.ndarray, np.ndarray]] = []
    while len(sym):
        starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        size = np.diff(np.append(starts, len(sym)))
        best = np.minimum.reduceat(rank, starts)
        over = np.repeat(best == NO_RANK, size)
        if over.any():
            out.append((word[over], sym[over]))
            rest = ~over
            sym, word, rank, made = sym[rest], word[rest], rank[rest], made[rest]
            live = best != NO_RANK
            best, size = best[live], size[live]
            if not len(sym):
                break
        lowest = np.repeat(best, size)
        hit = np.flatnonzero(rank == lowest)
        first = np.append(True, word[hit[1:]] != word[hit[:-1]])
        # In a row of overlapping hits every second one counts, from the left.
        run = np.append(True, hit[1:] != hit[:-1] + 1)
        place = np.arange(len(hit)) - np.flatnonzero(run)[np.cumsum(run) - 1]
        hit = hit[np.where(v.whole[rank[hit]], place % 2 == 0, first)]
        sym[hit] = made[hit]
        keep = np.ones(len(sym), bool)
        keep[hit + 1] = False
        at = (np.cumsum(keep) - 1)[hit]
        sym, word, rank, made = sym[keep], word[keep], rank[keep], made[keep]
        beside = np.zeros(len(sym), bool)
        beside[at] = True
        beside[at[at > 0] - 1] = True
        stale = np.flatnonzero(beside)
        rank[stale] = NO_RANK
        stale = stale[stale + 1 < len(sym)]
        stale = stale[word[stale] == word[stale + 1]]
        rank[stale], made[stale] = _look_up(v, sym[stale], sym[stale + 1])
    if not out:
        return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
    word = np.concatenate([w for w, _ in out])
    order = np.argsort(word, kind="stable")
    return np.concatenate([s for _, s in out])[order], np.bincount(word, minlength=len(words))


def split_words(v: Vocabulary, text: str) -> list[str]:
    """Pre-tokens of a text in order; a special token's string stays as it is."""
    if not any(s in text for s in v.special):
        return _section(v, text)
    found: list[str] = []
    for k, part in enumerate(v.specials.split(text)):
        found += [part] if k % 2 else _section(v, part)
    return found


def _section(v: Vocabulary, text: str) -> list[str]:
    # White space needs no normalising: the pattern drops it.
    if RARE.search(text):
        normalizer, split = v.library
        return [w for w, _ in split.pre_tokenize_str(normalizer.normalize_str(text))]
    text = unicodedata.normalize("NFC", text).lower()
    # Composing and lower case may bring forth rare letters.
    return (v.words if RARE.search(text) else v.plain_words).findall(text)


class Encoder:
    """Encodes texts, remembering a bounded number of distinct words."""

    def __init__(self, v: Vocabulary) -> None:
        self.v = v
        self.forget()

    def forget(self) -> None:
        known = {text: k for k, text in enumerate(self.v.special)}
        # A word that is new gets the next number when it is first asked for.
        self.place = defaultdict(count(len(known)).__next__, known)
        self.ids = np.array(list(self.v.special.values()), np.int32)
        self.size = np.ones(len(known), np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's ids begin, with the end)."""
        if len(self.place) > CACHE_WORDS:
            self.forget()
        split = [split_words(self.v, t) for t in texts]
        n_words = np.fromiter(map(len, split), np.int64, len(split))
        known = len(self.place)
        at = np.fromiter(map(self.place.__getitem__, chain.from_iterable(split)), np.int64, n_words.sum())
        fresh = list(islice(self.place, known, None))
        if fresh:
            ids, size = encode_words(self.v, [w.encode() for w in fresh])
            self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
            self.size = np.concatenate([self.size, size])
        start = np.cumsum(self.size) - self.size
        size = self.size[at]
        total = np.append(0, np.cumsum(size))
        offset = np.repeat(start[at] - total[:-1], size)
        bounds = np.append(0, np.cumsum(n_words))
        return self.ids[offset + np.arange(total[-1])], total[bounds]


def _shared(spark: SparkSession, path: str):
    """The vocabulary as plain values, once per executor: its class may not be installed there."""
    return spark.sparkContext.broadcast(vars(load(path)).copy())


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>): the ids of every whole text."""
    encoder: list[Encoder] = []
    shared = _shared(docs.sparkSession, path)

    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        if not encoder:
            encoder.append(Encoder(Vocabulary(**shared.value)))
        ids, bounds = encoder[0].encode([t or "" for t in piece.column(1).to_pylist()])
        lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids, pa.int32()))
        return pa.record_batch([piece.column(0), lists], ["id", "ids"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return map_slices(rows, run, f"id {kind}, ids array<int>", most=2 << 20)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(id, ids, text): token strings joined by blanks, as the vocabulary names no decoder; null ids: an empty text."""
    shared = _shared(encoded.sparkSession, path)

    def run(batches):
        named = pa.array(shared.value["tokens"], pa.string())
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                piece = batch.slice(k, 256)
                ids = piece.column(1)
                ends = np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False))
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), named.take(ids.flatten()))
                yield pa.record_batch([*piece.columns, pc.binary_join(lists, " ")], ["id", "ids", "text"])

    kind = encoded.schema["id"].dataType.simpleString()
    return encoded.select("id", "ids").mapInArrow(run, f"id {kind}, ids array<int>, text string")
