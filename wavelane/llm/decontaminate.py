"""Benchmark decontamination by an FM-index over every training shard.

A phrase is a run of ``size`` consecutive words of a benchmark item, or the whole item where it is shorter. A shard is a
slice of the documents inside a task. Words are symbols, and words of no item one symbol that ends a run: an occurrence cannot
reach across it, so runs shorter than the shortest phrase are left out. Over the symbols of a shard the task
builds a suffix order, the Burrows-Wheeler text, a wavelet tree with rank counts, and
suffix positions sampled every ``SAMPLE`` places. All phrases are searched backwards at once, narrowing their intervals
by two ranks a word; the suffixes in an interval are walked back to a sampled position, and the
found spans of a document are merged.

Documents never move: only their counts and spans leave a task. The phrases do, in blocks of up to ``BLOCK_WORDS``
words and one piece of an item. Spark cuts the items into pieces, deals them out and writes the blocks to the shared folder, a
file each, and hands the files to the executors; neither the driver nor a task holds more than one block, however large the
benchmark is. A shard is searched for one block after another.

Defined results: null or empty texts have no words and are clean; an item without words has no phrases; items
with equal texts are all found; documents that share an id are judged each for itself; a document longer than a shard is
a shard of its own; an item of more than ``PIECE_WORDS`` words is cut into pieces that overlap by one word less than a phrase has.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavelane.llm.common import ALNUM, as_bytes, map_slices, staged
from wavelane.session import shared_path

WINDOW = 10
SAMPLE = 16
# Words of benchmark items searched in one pass.
BLOCK_WORDS = 200_000
# Words of an item, beyond those of an overlap, that stay together.
PIECE_WORDS = 20_000
SHARD_BYTES = 4 << 20


class WaveletTree:
    """Rank over a symbol array: one bit row per level, most significant first, zeros kept in front."""

    def __init__(self, symbols: np.ndarray, bits: int) -> None:
        self.bits, self.ones, self.zeros = bits, [], []
        now = symbols
        for level in range(bits - 1, -1, -1):
            bit = now >> level & 1
            self.ones.append(np.append(0, np.cumsum(bit, dtype=np.int32)).astype(np.int32))
            self.zeros.append(len(now) - int(self.ones[-1][-1]))
            up = bit.astype(bool)
            now = np.concatenate([now[~up], now[up]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its position."""
        start, at = np.zeros_like(at), at.copy()
        for k in range(self.bits):
            up = symbol >> (self.bits - 1 - k) & 1 == 1
            before, upto = self.ones[k][start], self.ones[k][at]
            start = np.where(up, self.zeros[k] + before, start - before)
            at = np.where(up, self.zeros[k] + upto, at - upto)
        return at - start

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbol at each position, how often it stands before it)."""
        symbol, start, at = np.zeros_like(at), np.zeros_like(at), at.copy()
        for k in range(self.bits):
            before, upto = self.ones[k][start], self.ones[k][at]
            up = self.ones[k][at + 1] > upto
            symbol = symbol << 1 | up
            start = np.where(up, self.zeros[k] + before, start - before)
            at = np.where(up, self.zeros[k] + upto, at - upto)
        return symbol, at - start


def suffix_order(symbols: np.ndarray, bits: int) -> np.ndarray:
    """Suffix array of an integer text, by doubling over the suffixes that are still tied."""
    n = len(symbols)
    per = max(1, 62 // (bits + 1))
    padded = np.concatenate([symbols.astype(np.int64) + 1, np.zeros(per, np.int64)])
    key = np.zeros(n, np.int64)
    for k in range(per):
        key = key << (bits + 1) | padded[k : k + n]
    order = np.argsort(key, kind="stable")
    new = np.append(True, key[order][1:] != key[order][:-1])
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    reach = per
    while True:
        # Rows whose rank another row shares; ranks are first rows, so ties lie side by side.
        tied = np.flatnonzero(~new | np.append(~new[1:], False))
        if not len(tied):
            return order
        rows = order[tied]
        nxt = np.where(rows + reach < n, rank[np.minimum(rows + reach, n - 1)], -1)
        inner = np.lexsort((nxt, rank[rows]))
        rows, nxt = rows[inner], nxt[inner]
        order[tied] = rows
        first = np.append(True, (rank[rows[1:]] != rank[rows[:-1]]) | (nxt[1:] != nxt[:-1]))
        new[tied] = first
        rank[rows] = tied[np.flatnonzero(first)[np.cumsum(first) - 1]]
        reach *= 2


class FMIndex:
    """Backward search and location over one shard; its text must end in the only symbol 0."""

    def __init__(self, symbols: np.ndarray, bits: int) -> None:
        self.n = len(symbols)
        order = suffix_order(symbols, bits)
        self.tree = WaveletTree(symbols[order - 1], bits)  # the text is read as a circle
        self.first = np.append(0, np.cumsum(np.bincount(symbols, minlength=1 << bits)))
        self.sampled = order % SAMPLE == 0
        self.samples = order[self.sampled]
        self.sample_rank = np.cumsum(self.sampled) - 1

    def search(self, phrases: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix interval of every phrase (padded rows); empty ones have equal ends."""
        low, high = np.zeros(len(sizes), np.int64), np.full(len(sizes), self.n)
        for k in range(phrases.shape[1]):
            live = np.flatnonzero((k < sizes) & (low < high))
            symbol = phrases[live, sizes[live] - 1 - k]
            low[live] = self.first[symbol] + self.tree.rank(symbol, low[live])
            high[live] = self.first[symbol] + self.tree.rank(symbol, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows, walking back to the sampled ones."""
        found, steps, rows = np.zeros(len(rows), np.int64), 0, rows.copy()
        open_ = np.arange(len(rows))
        while len(open_):
            here = self.sampled[rows[open_]]
            done = open_[here]
            found[done] = self.samples[self.sample_rank[rows[done]]] + steps
            open_ = open_[~here]
            symbol, before = self.tree.access(rows[open_])
            rows[open_] = self.first[symbol] + before
            steps += 1
        return found


class Phrases:
    """The distinct phrases of some pieces of items as padded symbol rows, with the items that hold each."""

    def __init__(self, pieces: list[tuple[str, bytes]], size: int) -> None:
        self.symbol: dict[bytes, int] = {}
        holders: dict[tuple[int, ...], set[str]] = {}
        for item, text in pieces:
            words = [self.symbol.setdefault(w, len(self.symbol) + 2) for w in text.split()]
            for k in range(max(1, len(words) - size + 1)) if words else ():
                holders.setdefault(tuple(words[k : k + size]), set()).add(item)
        self.items = [sorted(h) for h in holders.values()]
        self.sizes = np.array([len(p) for p in holders], np.int64)
        self.rows = np.zeros((len(holders), size), np.int64)
        for k, p in enumerate(holders):
            self.rows[k, : len(p)] = p
        self.bits = (len(self.symbol) + 1).bit_length()

    def find(self, split: list[list[bytes]]) -> tuple[list[list[tuple[int, int]]], list[set[str]]]:
        """(merged hit spans in words, items found) of every text, given by its words."""
        symbol = self.symbol.get
        spans: list[list[tuple[int, int]]] = [[] for _ in split]
        items: list[set[str]] = [set() for _ in split]
        if not len(self.sizes):
            return spans, items
        # Symbol 1 is any other word and, after every text, none: it keeps runs inside a text.
        text = np.array([symbol(w, 1) for s in split for w in (*s, b"")], np.int64)
        begins = np.cumsum([0, *(len(s) + 1 for s in split)])
        ends = np.flatnonzero(text == 1)
        starts = np.append(0, ends[:-1] + 1)
        long = ends - starts >= self.sizes.min()
        starts, ends = starts[long], ends[long]
        if not len(starts):
            return spans, items
        size = ends - starts + 1  # with the blank that ends the run
        offset = np.cumsum(size) - size
        place = np.repeat(starts - offset, size) + np.arange(size.sum())
        index = FMIndex(np.append(text[place], 0), self.bits)
        low, high = index.search(self.rows, self.sizes)
        hit = np.repeat(np.arange(len(low)), high - low)
        if not len(hit):
            return spans, items
        shift = np.cumsum(high - low) - (high - low)
        at = place[index.locate(low[hit] + np.arange(len(hit)) - shift[hit])]
        doc = np.searchsorted(begins, at, side="right") - 1
        at = at - begins[doc]
        order = np.lexsort((at, doc))
        for d, p, a in zip(doc[order].tolist(), hit[order].tolist(), at[order].tolist()):
            end = a + int(self.sizes[p])
            items[d].update(self.items[p])
            if spans[d] and a <= spans[d][-1][1]:
                spans[d][-1] = (spans[d][-1][0], max(end, spans[d][-1][1]))
            else:
                spans[d].append((a, end))
        return spans, items


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _phrase_blocks(items: DataFrame, item_col: str, size: int, block_words: int) -> list[str]:
    """Names of the files that hold the phrases of all items, a block each, handed to every executor."""
    spark = items.sparkSession
    piece_words = min(PIECE_WORDS, block_words)

    def pieces(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, counts, texts = [], [], []
        for item, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
            words = text.translate(ALNUM).split()
            # A piece has the phrases that start in its first ``piece_words`` words.
            for k in range(0, max(1, len(words) - size + 1) if words else 0, piece_words):
                own = words[k : k + piece_words + size - 1]
                names.append(item)
                counts.append(len(own))
                texts.append(b" ".join(own))
        columns = [pa.array(names, pa.string()), pa.array(counts, pa.int64()), pa.array(texts, pa.binary())]
        return pa.record_batch(columns, ["item", "n_words", "words"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(held: list[tuple[str, bytes]]) -> pa.RecordBatch:
            return pa.record_batch([pa.array([pickle.dumps(vars(Phrases(held, size)))], pa.binary())], ["phrases"])

        held: list[tuple[str, bytes]] = []
        total = 0
        for batch in batches:
            for item, count, words in zip(*(c.to_pylist() for c in batch.columns)):
                if held and total + count > block_words:
                    yield block(held)
                    held, total = [], 0
                held.append((item, words))
                total += count
        if held:
            yield block(held)

    named = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), "text")
    cut = staged(map_slices(named, pieces, "item string, n_words bigint, words binary"), "benchmark-pieces")
    total = cut.agg(F.sum("n_words")).first()[0] or 0
    # Dealt in turn, not by key: pieces are of bounded size, and a block is closed when it is full.
    dealt = cut.repartition(-(-total // block_words) or 1)
    path = shared_path(spark, "benchmark-blocks")
    dealt.mapInArrow(blocks, "phrases binary").write.option("maxRecordsPerFile", 1).parquet(path)
    files = spark.read.schema("phrases binary").parquet(path).inputFiles() if total else []
    for file in files:
        spark.sparkContext.addFile(file)
    return sorted(file.rsplit("/", 1)[1] for file in files)


def merge_spans(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans without overlaps or touching ends."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


class _Blocks:
    """The phrase blocks as a task sees them: read from the executor's copy one at a time, the last one kept."""

    def __init__(self, files: list[str]) -> None:
        self.files, self.name, self.phrases = files, "", Phrases([], 1)

    def __iter__(self) -> Iterator[Phrases]:
        for name in self.files:
            if name != self.name:
                self.phrases = Phrases([], 1)
                rows = pq.ParquetFile(SparkFiles.get(name)).read().column("phrases").to_pylist()
                self.name = name
                for row in rows:
                    self.phrases.__dict__.update(pickle.loads(row))
            yield self.phrases


def _search(blocks: Iterable[Phrases], texts: list[bytes]) -> tuple[list[int], list[list[tuple[int, int]]], list[list[str]]]:
    """Of every text the words, merged spans and sorted items, over all blocks of phrases."""
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    items: list[set[str]] = [set() for _ in texts]
    split = [t.translate(ALNUM).split() for t in texts]
    for phrases in blocks:
        hits, found = phrases.find(split)
        for k, hit in enumerate(hits):
            if hit:
                spans[k] = merge_spans(spans[k] + hit)
                items[k] |= found[k]
    return [len(s) for s in split], spans, [sorted(i) for i in items]


def occurrences(
    docs: DataFrame,
    items: DataFrame,
    size: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """(id, n_words, spans, items) of every document: merged spans of hit words, and the items found."""
    blocks = _Blocks(_phrase_blocks(items, item_col, size, block_words))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        counts, spans, found = _search(blocks, as_bytes(piece.column(1)))
        structs = pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], _SPANS)
        columns = [piece.column(0), pa.array(counts, pa.int64()), structs, pa.array(found, pa.list_(pa.string()))]
        return pa.record_batch(columns, ["id", "n_words", "spans", "items"])

    schema = f"id {kind}, n_words bigint, spans array<struct<start: bigint, end: bigint>>, items array<string>"
    return map_slices(rows, run, schema, most=SHARD_BYTES)


def without_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """A text without the words of its spans and what stands between them."""
    words = [m.span() for m in re.finditer(rb"[^ ]+", text.translate(ALNUM))]
    kept, last = [], 0
    for start, end in spans:
        kept.append(text[last : words[start][0]])
        last = words[end - 1][1]
    return b"".join([*kept, text[last:]])


def cleaned(
    docs: DataFrame,
    items: DataFrame,
    size: int = WINDOW,
    text_col: str = "text",
    item_col: str = "item_id",
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """``docs`` with every occurrence cut out of the texts; all rows and columns stay."""
    blocks = _Blocks(_phrase_blocks(items, item_col, size, block_words))
    at = docs.columns.index(text_col)

    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        texts = as_bytes(piece.column(at))
        _, spans, _ = _search(blocks, texts)
        if not any(spans):
            return piece
        old = piece.column(at)
        new = [without_spans(t, s).decode() if s else old[k].as_py() for k, (t, s) in enumerate(zip(texts, spans))]
        return piece.set_column(at, piece.schema.field(at), pa.array(new, old.type))

    return map_slices(docs, run, docs.schema, text=text_col, most=SHARD_BYTES)
