"""Ranked lexical search with Block-Max MaxScore over an inverted index in shards.

The documents of a shard, a bounded amount of text, are numbered by id. Every term has a posting list there: blocks of
``BLOCK`` postings with the first document number and the largest score factor of each block in the open, document gaps and
term counts packed into one to four bytes each. The index holds all terms of all documents and is written once.

A query's terms pick their lists by a join, and each (shard, block of queries) is one task. A term's *bound* is its weight times
its largest factor. Lists ordered by bound split at the score that the k best documents so far have: the lower ones, which cannot
reach it between them, are not essential. Documents of essential lists are the candidates, a window of numbers at a time; in the
others they are only looked up, largest bound first, and a candidate goes as soon as its score, the block's largest factor and the
bounds of what is left fall short, before that block is unpacked. The k best of each shard are merged by rank.

Scores are whole numbers: with N documents that have terms, L terms in all, n in the document and df documents that hold a term,
its weight is ``floor(1000 ln((2N + 2) / (2 df + 1)))``, its factor ``1e9 tf div (1000 tf + 8 m)`` with
``m = 10 + (90 n N) div L``. Equal scores are ranked by id.

Defined results: documents and queries with a null id are left out wholly; null and empty texts have no terms; a document
without terms is not counted; rows that repeat a document id are documents of their own; rows that repeat a query id are one query;
a query without hits has no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wavelane.functions.joins import lookup_join
from wavelane.llm.common import ALNUM, as_bytes, lower_ascii, slices, staged

# Postings of a block.
BLOCK = 128
# Text of a shard; one document at least.
SHARD_BYTES = 16 << 20
# (query, term) pairs answered by one task of a shard.
QUERY_TERMS = 100_000
# Document numbers of the first and of the largest window.
WINDOWS = 256, 1 << 15

WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LIST_COLUMNS = "size bigint, top bigint, gap_bytes int, count_bytes int, firsts binary, tops binary, gaps binary, counts binary"
INDEX = f"shard bigint, term string, {LIST_COLUMNS}"


@dataclass(frozen=True)
class Corpus:
    """Documents with terms, and their terms."""

    docs: int
    terms: int

    def norm(self, n: np.ndarray) -> np.ndarray:
        return 10 + 90 * n * self.docs // max(self.terms, 1)


def _factor(tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 8 * norm)


def corpus_size(docs: DataFrame) -> Corpus:
    """Totals over (id, text): two numbers, whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                count = [len(t.translate(ALNUM).split()) for t in as_bytes(piece.column(1))]
                columns = [pa.array([sum(c > 0 for c in count)], pa.int64()), pa.array([sum(count)], pa.int64())]
                yield pa.record_batch(columns, ["docs", "terms"])

    total = docs.mapInArrow(run, "docs bigint, terms bigint").agg(F.sum("docs"), F.sum("terms")).first()
    return Corpus(total[0] or 0, total[1] or 0)


def _widths(most: np.ndarray) -> np.ndarray:
    return np.where(most < 1 << 8, 1, np.where(most < 1 << 16, 2, 4))


def _packed(values: np.ndarray, width: np.ndarray, size: np.ndarray) -> pa.Array:
    """Values of all lists in as many bytes each as their list takes, little end first."""
    ends = np.append(0, np.cumsum(size * width))
    each = np.repeat(width, size)
    at = np.repeat(ends[:-1], size) + (np.arange(len(values)) - np.repeat(np.cumsum(size) - size, size)) * each
    out = np.zeros(int(ends[-1]), np.uint8)
    for k in range(4):
        on = each > k
        out[at[on] + k] = values[on] >> (8 * k) & 255
    return _binary(out, ends)


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    buffers = [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))]
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, buffers)


class _Shard:
    """Texts gathered into one shard of the index."""

    def __init__(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.ids: list[int] = []
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, piece: pa.RecordBatch) -> None:
        texts = as_bytes(piece.column(1))
        split = [t.translate(ALNUM).split() for t in texts]
        coded = pa.array((w for s in split for w in s), pa.binary()).dictionary_encode()
        known = [self.numbers.setdefault(w, len(self.numbers)) for w in coded.dictionary.to_pylist()]
        terms = np.array(known, np.int64)[coded.indices.to_numpy()] if known else np.zeros(0, np.int64)
        docs = np.repeat(np.arange(len(split)) + len(self.ids), [len(s) for s in split])
        self.parts.append((terms, docs))
        self.ids += piece.column(0).to_pylist()
        self.held += sum(map(len, texts))

    def lists(self, shard: int, corpus: Corpus) -> pa.RecordBatch:
        ids = np.array(self.ids, np.int64)
        order = np.argsort(ids, kind="stable")
        number = np.empty(len(ids), np.int64)
        number[order] = np.arange(len(ids))
        term = np.concatenate([t for t, _ in self.parts])
        doc = number[np.concatenate([d for _, d in self.parts])]
        norm = corpus.norm(np.bincount(doc, minlength=len(ids)))
        names = list(self.numbers)
        key, tf = np.unique(term * len(ids) + doc, return_counts=True)
        term, doc = key // len(ids), key % len(ids)
        size = np.bincount(term, minlength=len(names))
        start = np.cumsum(size) - size
        place = np.arange(len(term)) - np.repeat(start, size)
        head = np.flatnonzero(place % BLOCK == 0)
        gap = np.diff(doc, prepend=0)
        gap[head] = 0
        factor = _factor(tf, norm[doc])
        blocks = np.append(0, np.cumsum((size + BLOCK - 1) // BLOCK)) * 4
        some = len(term) > 0
        most = [np.maximum.reduceat(v, start) if some else np.zeros(0, np.int64) for v in (gap, tf, factor)]
        tops = np.maximum.reduceat(factor, head) if some else factor
        gap_bytes, count_bytes = _widths(most[0]), _widths(most[1])
        lists = [
            pa.array(np.full(len(names), shard)),
            pa.array(names, pa.binary()).cast(pa.string()),
            pa.array(size),
            pa.array(most[2]),
            pa.array(gap_bytes.astype(np.int32)),
            pa.array(count_bytes.astype(np.int32)),
            _binary(doc[head].astype("<u4").view(np.uint8), blocks),
            _binary(tops.astype("<u4").view(np.uint8), blocks),
            _packed(gap, gap_bytes, size),
            _packed(tf, count_bytes, size),
        ]
        # The shard's documents themselves: a row without a term.
        own = [shard, None, len(ids), 0, 8, 8, b"", b"", ids[order].astype("<i8").tobytes(), norm.astype("<i8").tobytes()]
        columns = [pa.concat_arrays([a, pa.array([v], a.type)]) for a, v in zip(lists, own)]
        return pa.record_batch(columns, [c.split()[0] for c in INDEX.split(", ")])


def build_index(docs: DataFrame, corpus: Corpus, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Posting lists of all terms of (id, text), by shard; a row with a null term has the shard's ids and norms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, own = TaskContext.get().partitionId() << 24, _Shard()
        for batch in batches:
            for piece in slices(batch, "text"):
                own.add(piece)
                if own.held >= shard_bytes:
                    yield own.lists(shard, corpus)
                    shard, own = shard + 1, _Shard()
        if own.ids:
            yield own.lists(shard, corpus)

    return docs.mapInArrow(run, INDEX)


class Postings:
    """One list of a shard, unpacked block by block as it is needed."""

    def __init__(self, row: dict, norms: np.ndarray) -> None:
        self.size, self.top, self.weight, self.norms = row["size"], row["top"], row["weight"], norms
        self.firsts = np.frombuffer(row["firsts"], "<u4").astype(np.int64)
        self.tops = np.frombuffer(row["tops"], "<u4").astype(np.int64)
        self.gaps = np.frombuffer(row["gaps"], f"<u{row['gap_bytes']}")
        self.counts = np.frombuffer(row["counts"], f"<u{row['count_bytes']}")
        # A packed block reads as its first document throughout, so that numbers always ascend.
        self.docs = np.repeat(self.firsts, BLOCK)[: self.size]
        self.scores = np.zeros(self.size, np.int64)
        self.packed = np.ones(len(self.firsts), bool)

    @property
    def bound(self) -> int:
        return self.weight * self.top

    def unpack(self, blocks: np.ndarray) -> None:
        blocks = blocks[self.packed[blocks]]
        if not len(blocks):
            return
        at = blocks[:, None] * BLOCK + np.arange(BLOCK)
        inside = at < self.size
        at[~inside] = self.size - 1
        docs = np.where(inside, self.gaps[at].astype(np.int64), 0).cumsum(axis=1) + self.firsts[blocks][:, None]
        at, docs = at[inside], docs[inside]
        self.docs[at] = docs
        self.scores[at] = self.weight * _factor(self.counts[at].astype(np.int64), self.norms[docs])
        self.packed[blocks] = False

    def between(self, low: int, high: int) -> slice:
        """Postings of documents low .. high - 1."""
        a = max(0, int(np.searchsorted(self.firsts, low, "right")) - 1)
        b = int(np.searchsorted(self.firsts, high))
        self.unpack(np.arange(a, b))
        a, b = a * BLOCK, min(b * BLOCK, self.size)
        own = self.docs[a:b]
        return slice(a + int(np.searchsorted(own, low)), a + int(np.searchsorted(own, high)))

    def block_bounds(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The block each document would stand in, and the most it can add."""
        block = np.searchsorted(self.firsts, docs, "right") - 1
        return block, np.where(block >= 0, self.weight * self.tops[block], 0)

    def look_up(self, docs: np.ndarray, block: np.ndarray) -> np.ndarray:
        self.unpack(np.unique(block[block >= 0]))
        at = np.minimum(np.searchsorted(self.docs, docs), self.size - 1)
        return np.where(self.docs[at] == docs, self.scores[at], 0)


def best(lists: list[Postings], n_docs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and scores of the k best documents, best first, equal scores by number."""
    lists = sorted(lists, key=lambda p: p.bound)
    reach = np.cumsum([p.bound for p in lists]) if lists else np.zeros(0, np.int64)
    docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    low, width, least = 0, WINDOWS[0], 1
    while low < n_docs:
        essential = int(np.searchsorted(reach, least))
        if essential == len(lists):
            break
        high = min(low + width, n_docs)
        sums = np.zeros(high - low, np.int64)
        for p in lists[essential:]:
            own = p.between(low, high)
            sums[p.docs[own] - low] += p.scores[own]
        found = np.flatnonzero(sums)
        score, found = sums[found], found + low
        for k_th in range(essential - 1, -1, -1):
            p, rest = lists[k_th], reach[k_th - 1] if k_th else 0
            open_ = score + reach[k_th] >= least
            score, found = score[open_], found[open_]
            block, most = p.block_bounds(found)
            open_ = score + most + rest >= least
            score, found, block = score[open_], found[open_], block[open_]
            if not len(found):
                break
            score = score + p.look_up(found, block)
        good = score >= least
        docs, scores = np.append(docs, found[good]), np.append(scores, score[good])
        order = np.lexsort((docs, -scores))[:k]
        docs, scores = docs[order], scores[order]
        # Later documents have larger ids, so they have to be better than the last one held.
        least = int(scores[-1]) + 1 if len(docs) == k else 1
        low, width = high, min(2 * width, WINDOWS[1])
    return docs, scores


def query_terms(queries: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, term) without repeats."""
    words = F.regexp_extract_all(lower_ascii(F.col(text_col)), F.lit(WORD), F.lit(0))
    rows = queries.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("item"), F.explode(words).alias("term"))
    return rows.distinct()


def search(
    docs: DataFrame,
    queries: DataFrame,
    k: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    query_id: str = "item_id",
    query_text: str = "text",
    shard_bytes: int = SHARD_BYTES,
    query_terms_a_task: int = QUERY_TERMS,
) -> DataFrame:
    """(item, rank, id, score): the ``k`` best documents of every query."""
    rows = docs.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")
    )
    corpus = corpus_size(rows)
    index = staged(build_index(rows, corpus, shard_bytes), "search-index")
    asked = staged(query_terms(queries, query_id, query_text), "search-queries")
    parts = asked.count() // query_terms_a_task + 1
    lists = lookup_join(index.filter(F.col("term").isNotNull()), asked.select("term").distinct(), "term", "inner")
    held = lists.groupBy("term").agg(F.sum("size").alias("df"))
    weight = F.floor(1000 * F.log((2.0 * corpus.docs + 2) / (2 * F.col("df") + 1))).alias("weight")
    # Queries are dealt out in blocks; a list goes once to every block that asks for it.
    block = F.pmod(F.xxhash64("item"), F.lit(parts)).alias("block")
    wanted = asked.select("term", "item", block).groupBy("term", "block").agg(F.collect_list("item").alias("items"))
    wanted = wanted.join(held.select("term", weight), "term")
    columns = [c.split()[0] for c in LIST_COLUMNS.split(", ")]
    work = lists.join(wanted, "term").select("shard", "block", "items", "weight", *columns)
    every = F.explode(F.sequence(*[F.lit(n).cast("bigint") for n in (0, parts - 1)])).alias("block")
    empty = F.lit(None).cast(work.schema["items"].dataType).alias("items")
    shards = index.filter(F.col("term").isNull()).select(
        "shard", every, empty, F.lit(0).cast("bigint").alias("weight"), *columns
    )
    kind = asked.schema["item"].dataType

    def answer(group: pa.Table) -> pa.Table:
        entries = group.to_pylist()
        own = next(e for e in entries if e["items"] is None)
        ids, norms = (np.frombuffer(own[c], "<i8") for c in ("gaps", "counts"))
        by_item: dict[object, list[Postings]] = {}
        for e in entries:
            if e["items"] is not None:
                postings = Postings(e, norms)
                for item in e["items"]:
                    by_item.setdefault(item, []).append(postings)
        out = [(item, best(held, len(ids), k)) for item, held in by_item.items()]
        count = [len(docs) for _, (docs, _) in out]
        items = [item for (item, _), n in zip(out, count) for _ in range(n)]
        found = np.concatenate([np.zeros(0, np.int64), *[docs for _, (docs, _) in out]])
        scores = np.concatenate([np.zeros(0, np.int64), *[s for _, (_, s) in out]])
        item_type = group.schema.field("items").type.value_type
        return pa.table({"item": pa.array(items, item_type), "id": ids[found], "score": scores})

    heaps = work.unionByName(shards).groupBy("shard", "block").applyInArrow(
        answer, f"item {kind.simpleString()}, id bigint, score bigint"
    )
    order = Window.partitionBy("item").orderBy(F.desc("score"), "id")
    ranked = heaps.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("item", "rank", "id", "score")


SEARCH_SQL = """
with terms as (
    select doc_id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term
    from documents),
counts as (select doc_id, term, count(*) as tf from terms group by all),
lengths as (select doc_id, cast(sum(tf) as bigint) as n from counts group by doc_id),
total as (select count(*) as docs, cast(sum(n) as bigint) as terms from lengths),
norms as (select doc_id, 100 - 90 + ((90 * n * docs) // terms) as m from lengths, total),
weights as (
    select term, cast(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) as bigint) as w
    from counts, total group by term, docs),
asked as (
    select distinct item_id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term
    from benchmark),
scored as (
    select item_id, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) as bigint) as score
    from asked join weights using (term) join counts using (term) join norms using (doc_id)
    group by item_id, doc_id),
ranked as (
    select *, row_number() over (partition by item_id order by score desc, doc_id) as rank
    from scored where score > 0)
select item_id, cast(rank as integer) as rank, doc_id, score from ranked where rank <= 10
"""
