"""Exact removal of repeated byte strings, from maximal repeats in enhanced suffix arrays.

A byte goes if a string of ``size`` bytes that covers it also starts in a document with a smaller id. The work is spread by
*anchors*: of the ``GRAM``-byte grams in a window of ``size`` bytes the one with the least hash. Equal windows have
equal anchors wherever they stand, so windows that share an anchor meet in one bucket and no match crosses
buckets. Neighbouring windows with one anchor form a run, the unit that is moved.

1. Every document gives its runs: anchor, hash of the run's bytes, place, number of windows. Equal runs are one repeat
   group; the least id keeps it, the other documents lose it whole. Within a slice of texts that is settled before
   anything moves, so of a passage that very many documents share a slice sends one document's run.
2. Where an anchor has runs of different bytes, one document for each of them is asked for the bytes.
3. Over these a task builds a suffix array with common-prefix lengths and scans it with a stack: an interval of
   suffixes with at least ``size`` common bytes whose left neighbours differ is a maximal repeat, with all its places.
   In every document but the least of the group its bytes go. Suffixes that start with different ``size`` bytes have no
   such repeat in common, so a large bucket is sorted in passes of about ``PASS`` suffixes, dealt by those bytes.
4. The spans of a document are merged and cut out of its text.

The number of buckets follows the bytes of the texts, so a bucket's share does not grow with the corpus.
Runs and spans move as packed arrays, a row per slice of text and bucket. Steps are written to the shared folder, and
shuffle files behind a written step are given back.

A run has at most ``RUN`` windows; longer ones (one letter repeated) are cut, which only makes more of them.

Defined results: a null or empty text has no bytes and no spans; texts shorter than ``size`` keep all; equal texts lose
everything but in the smallest id; rows with a null id keep their text and are no source for others; rows
that share an id count as one document: what is found in any of them is cut from each, as far as it reaches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavelane.llm.common import as_bytes, give_back, map_slices, partitions, staged

SIZE = 50
GRAM = 20
RUN = 64
# Larger slices than elsewhere: each one writes its own rows for every bucket.
SLICE_BYTES = 8 << 20

# Text per bucket, where shuffle partitions are too few for less.
BUCKET_BYTES = 16 << 20
# Suffixes sorted at a time.
PASS = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(32)


def text_runs(texts: list[bytes], size: int, gram: int) -> tuple[np.ndarray, ...]:
    """(anchor, hash of the bytes, text number, start, windows) of the runs of some texts."""
    lengths = np.array([len(t) for t in texts], np.int64)
    long = np.flatnonzero(lengths >= size)
    raw = np.frombuffer(b"".join(texts[k] for k in long), np.uint8)
    n = len(raw)
    if not n:
        empty = np.zeros(0, np.int64)
        return empty.astype(np.uint64), empty.astype(np.uint64), empty, empty, empty
    lengths = lengths[long]
    begins = np.cumsum(lengths) - lengths
    back = _powers(_INVERSE, n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, n), out=sums[1:])
    least = _mix((sums[gram:] - sums[:-gram]) * back[: n - gram + 1])
    width, reach = size - gram + 1, 1
    while reach * 2 <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < width:
        least = np.minimum(least[: reach - width], least[width - reach :])
    # Windows that start in one text and end in the next are none.
    inside = np.zeros(n + 1, np.int8)
    inside[begins] += 1
    inside[begins + lengths - size + 1] -= 1
    valid = np.cumsum(inside)[: len(least)] > 0
    first = np.zeros(len(least), bool)
    first[begins] = True
    new = valid.copy()
    new[1:] &= (least[1:] != least[:-1]) | first[1:]
    start = np.flatnonzero(new)
    count = np.append(0, np.cumsum(valid))
    windows = count[np.append(start[1:], len(least))] - count[start]
    pieces = -(-windows // RUN)
    if (pieces > 1).any():
        part = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        windows = np.minimum(np.repeat(windows, pieces) - part * RUN, RUN)
        start = np.repeat(start, pieces) + part * RUN
    whole = _mix((sums[start + windows + size - 1] - sums[start]) * back[start] + windows.astype(np.uint64))
    text = np.searchsorted(begins, start, side="right") - 1
    return least[start], whole, long[text], start - begins[text], windows


# --- packed arrays: (dtype, planes) per column, planes of equal bytes compress better -----

# Runs of one anchor are told apart by the hash of their bytes alone, so all of it is kept.
_RUN_TYPES = (("u8", 5), ("u8", 8), ("i8", 8), ("u8", 4), ("u8", 1))
_SPAN_TYPES = (("i8", 8), ("u8", 4), ("u8", 4), ("i8", 4))


def _pack(columns: tuple[np.ndarray, ...], types: tuple[tuple[str, int], ...]) -> bytes:
    """Low bytes of integer columns, byte plane by byte plane."""
    out = [np.int64(len(columns[0])).tobytes()]
    for column, (kind, width) in zip(columns, types):
        raw = np.ascontiguousarray(column.astype(f"<{kind}")).view(np.uint8).reshape(-1, 8)
        out.append(np.ascontiguousarray(raw[:, :width].T).tobytes())
    return b"".join(out)


def _unpack(blobs: list[bytes], types: tuple[tuple[str, int], ...]) -> tuple[np.ndarray, ...]:
    parts: list[list[np.ndarray]] = [[] for _ in types]
    for blob in blobs:
        n, at = int(np.frombuffer(blob, np.int64, 1)[0]), 8
        for out, (kind, width) in zip(parts, types):
            planes = np.frombuffer(blob, np.uint8, n * width, at).reshape(width, n)
            at += n * width
            full = np.zeros((n, 8), np.uint8)
            full[:, :width] = planes.T
            column = full.view(f"<{kind}").reshape(n)
            # Signed columns narrower than a word hold small numbers from -1 on.
            out.append(np.where(column == (1 << 8 * width) - 1, -1, column) if kind == "i8" and width < 8 else column)
    return tuple(np.concatenate(p) if p else np.zeros(0, k) for p, (k, _) in zip(parts, types))


def _dealt(key: np.ndarray, columns: tuple[np.ndarray, ...], types) -> Iterator[tuple[int, bytes]]:
    """(key, packed rows) for every key."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    cuts = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key)) if len(key) else np.zeros(1, int)
    columns = tuple(c[order] for c in columns)
    for a, b in zip(cuts, cuts[1:]):
        yield int(key[a]), _pack(tuple(c[a:b] for c in columns), types)


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names)


_KEYED = ["key", "data"], [pa.int32(), pa.binary()]


def _later_in_slice(anchor: np.ndarray, whole: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which runs equal one of a document with a smaller id among these."""
    if not len(doc):
        return np.zeros(0, bool)
    # Equal runs have equal hashes and lie together; runs apart that share a hash only make more groups of less rows.
    order = np.argsort(whole)
    anchor, whole, doc = anchor[order], whole[order], doc[order]
    new = np.append(True, (anchor[1:] != anchor[:-1]) | (whole[1:] != whole[:-1]))
    least = np.minimum.reduceat(doc, np.flatnonzero(new))
    later = np.empty(len(doc), bool)
    later[order] = doc > least[np.cumsum(new) - 1]
    return later


def _equal_runs(blobs: list[bytes], bucket: int, parts: int) -> Iterator[tuple[int, bytes]]:
    """Spans of runs that a smaller document has too, and requests for the bytes of the others."""
    anchor, whole, doc, start, windows = _unpack(blobs, _RUN_TYPES)
    order = np.lexsort((start, doc, whole, anchor))
    anchor, whole, doc, start, windows = (c[order] for c in (anchor, whole, doc, start, windows))
    new_anchor = np.append(True, anchor[1:] != anchor[:-1])
    new_class = new_anchor | np.append(True, whole[1:] != whole[:-1])
    group, kind = np.cumsum(new_anchor) - 1, np.cumsum(new_class) - 1
    firsts = np.flatnonzero(new_anchor)
    several = (np.minimum.reduceat(doc, firsts) < np.maximum.reduceat(doc, firsts))[group]
    classes = np.add.reduceat(new_class.astype(np.int64), firsts)[group]
    later = doc > doc[np.flatnonzero(new_class)][kind]
    asked = several & (classes > 1) & ~later
    chosen = later | asked
    where = np.where(asked, bucket, -1)[chosen]
    doc, start, windows = doc[chosen], start[chosen], windows[chosen]
    yield from _dealt(doc % parts, (doc, start, windows, where), _SPAN_TYPES)


def _seven(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Seven symbols from each place on as one number; nothing counts behind a zero."""
    word, live = np.zeros(len(at), np.int64), np.ones(len(at), bool)
    for k in range(7):
        symbol = text[at + k].astype(np.int64)
        live &= symbol > 0
        word = word << 9 | symbol * live
    return word


def enhanced_suffix_array(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of the suffixes, length of the prefix each one shares with the one before).

    ``text`` has bytes plus 1 and ends in zeros; suffix k is text[starts[k]:ends[k]], and ends stand before a zero.
    Sorted by seven symbols at a time, of which later ones only matter where the earlier ones are tied.
    """
    n = len(starts)
    order, common = np.arange(n), np.zeros(n, np.int64)
    first = np.zeros(n, bool)
    first[:1] = True
    depth = 0
    tied = np.arange(n)
    while len(tied) > 1:
        at = np.minimum(starts[order[tied]] + depth, ends[order[tied]])
        key = _seven(text, at)
        group = np.cumsum(first[tied])
        inner = np.lexsort((key, group))
        order[tied] = order[tied[inner]]
        key = key[inner]
        split = np.zeros(len(tied), bool)
        split[1:] = (key[1:] != key[:-1]) & (group[1:] == group[:-1])
        cut = np.flatnonzero(split)
        apart = key[cut] ^ key[cut - 1]
        equal = sum((apart < (1 << 9 * (7 - k))).astype(np.int64) for k in range(1, 7))
        common[tied[cut]] = depth + equal
        first[tied[cut]] = True
        # A zero in the key is the end of a suffix: equal ones are equal to their ends.
        over = key & 511 == 0
        stop = np.flatnonzero(over & ~split & ~np.append(True, group[1:] != group[:-1]))
        common[tied[stop]] = (ends - starts)[order[tied[stop]]]
        first[tied[stop]] = True
        open_ = ~first[tied] | np.append(~first[tied][1:] & (tied[1:] == tied[:-1] + 1), False)
        tied = tied[open_]
        depth += 7
    return order, common


def maximal_repeats(common: np.ndarray, left: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """(first row, last row, length) of the intervals of at least ``size`` common bytes with different left neighbours.

    A stack holds the open intervals of the common-prefix tree; each is closed once.
    """
    changes = np.cumsum(np.append(0, left[1:] != left[:-1])).tolist()
    out: list[tuple[int, int, int]] = []
    rows = np.flatnonzero(common >= size)
    if not len(rows):
        return out
    lengths = common[rows].tolist()
    stack: list[tuple[int, int]] = []

    def close(last: int, down_to: int) -> int:
        begin = last
        while stack and stack[-1][0] > down_to:
            length, begin = stack.pop()
            if changes[last] > changes[begin]:
                out.append((begin, last, length))
        return begin

    before = -1
    for row, length in zip(rows.tolist(), lengths):
        if row != before + 1:
            close(before, 0)
            begin = row - 1
        else:
            begin = row - 1
            if stack and stack[-1][0] > length:
                begin = close(row - 1, length)
        if not stack or stack[-1][0] < length:
            stack.append((length, begin))
        before = row
    close(before, 0)
    return out


def _different_runs(blobs: list[bytes], size: int, parts: int, most: int = PASS) -> Iterator[tuple[int, bytes]]:
    """Spans that the runs of one bucket share with runs of smaller documents."""
    heads, bodies = zip(*(_contexts(blob) for blob in blobs))
    docs, offsets, lengths = np.concatenate(heads, axis=1)
    begins = np.cumsum(lengths + 1) - lengths - 1
    text = np.zeros(int((lengths + 1).sum()) + 7, np.int16)
    filled = np.ones(len(text) - 7, bool)
    filled[begins + lengths] = False
    text[:-7][filled] = np.frombuffer(b"".join(bodies), np.uint8)
    text[:-7][filled] += 1
    del filled, bodies
    windows = lengths - size + 1
    upto = np.cumsum(windows)
    total = int(upto[-1])

    def placed(suffixes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        run = np.searchsorted(upto, suffixes, side="right")
        return run, suffixes - upto[run] + windows[run]

    passes = -(-total // most)
    share = np.zeros(total, np.uint16)
    for low in range(0, total if passes > 1 else 0, most):
        run, inner = placed(np.arange(low, min(low + most, total)))
        share[low : low + most] = _start_hash(text, begins[run] + inner, size) % np.uint64(passes)
    for turn in range(passes):
        run, inner = placed(np.flatnonzero(share == turn))
        starts = begins[run] + inner
        order, common = enhanced_suffix_array(text, starts, (begins + lengths)[run])
        # What stands before a run belongs to another bucket: its first suffix differs from all others there.
        left = np.where(inner > 0, text[np.maximum(starts - 1, 0)].astype(np.int64), -1 - run)[order]
        found = maximal_repeats(common, left, size)
        if not found:
            continue
        lows, highs, length = (np.array(c, np.int64) for c in zip(*found))
        count = highs - lows + 1
        group = np.repeat(np.arange(len(found)), count)
        row = np.arange(len(group)) - np.repeat(np.cumsum(count) - count, count) + lows[group]
        suffix = order[row]
        doc = docs[run[suffix]]
        least = np.minimum.reduceat(doc, np.cumsum(count) - count)
        later = doc > least[group]
        suffix, reach = suffix[later], length[group[later]]
        # Of one place only the longest repeat counts.
        longest = np.zeros(len(run), np.int64)
        np.maximum.at(longest, suffix, reach)
        hit = np.flatnonzero(longest)
        spans = docs[run[hit]], offsets[run[hit]] + inner[hit], longest[hit] - size + 1, np.full(len(hit), -1)
        yield from _dealt(spans[0] % parts, spans, _SPAN_TYPES)


def _start_hash(text: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """A hash of the ``size`` symbols from each place on."""
    if size < 7:
        return _mix((_seven(text, at) >> 9 * (7 - size)).astype(np.uint64))
    h = np.zeros(len(at), np.uint64)
    for k in (*range(0, size - 7, 7), size - 7):
        h = _mix((h ^ _seven(text, at + k).astype(np.uint64)) * np.uint64(_BASE))
    return h


def _contexts(blob: bytes) -> tuple[np.ndarray, bytes]:
    """(ids, offsets and lengths of the runs in a blob, their bytes one after another)."""
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    return np.frombuffer(blob, np.int64, 3 * n, 8).reshape(3, n), blob[8 + 24 * n :]


def _by_key(df: DataFrame, key: str, function, schema: str) -> DataFrame:
    """Apply ``function(key, table)`` to the rows of each key; a key's rows are one bucket's share."""

    def run(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([function(table.column(key)[0].as_py(), table)])

    return df.groupBy(key).applyInArrow(run, schema)


def removed_spans(
    docs: DataFrame, size: int = SIZE, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, starts, ends): the merged removed byte spans of every document that has any."""
    spark = docs.sparkSession
    texts = docs.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")
    )
    size_of = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(partitions(spark, 2), -(-size_of // BUCKET_BYTES))

    def runs(piece: pa.RecordBatch) -> pa.RecordBatch:
        ids = piece.column(0).to_numpy(zero_copy_only=False)
        anchor, whole, text, start, windows = text_runs(as_bytes(piece.column(1)), size, gram)
        doc = ids[text]
        later = _later_in_slice(anchor, whole, doc)
        spans = doc[later], start[later], windows[later], np.full(int(later.sum()), -1)
        done = [(key, data, True) for key, data in _dealt(spans[0] % parts, spans, _SPAN_TYPES)]
        anchor, rest = anchor[~later], (c[~later] for c in (whole, doc, start, windows))
        bucket = (anchor % np.uint64(parts)).astype(np.int64)
        dealt = _dealt(bucket, (anchor >> np.uint64(24), *rest), _RUN_TYPES)
        names, types = _KEYED
        return _batch([*done, *((key, data, False) for key, data in dealt)], [*names, "done"], [*types, pa.bool_()])

    def equal(bucket: int, table: pa.Table) -> pa.RecordBatch:
        done = table.column("done")
        open_ = table.filter(pc.invert(done)).column("data").to_pylist()
        spans = [(bucket, data) for data in table.filter(done).column("data").to_pylist()]
        return _batch([*spans, *(_equal_runs(open_, bucket, parts) if open_ else ())], *_KEYED)

    packed = map_slices(texts, runs, "key int, data binary, done boolean", most=SLICE_BYTES)
    first = staged(_by_key(packed, "key", equal, "key int, data binary"), "substring-runs")
    give_back(spark)

    def requests(part: int, table: pa.Table) -> pa.RecordBatch:
        doc, start, windows, bucket = _unpack(table.column("data").to_pylist(), _SPAN_TYPES)
        asked = bucket >= 0
        doc, start, windows, bucket = doc[asked], start[asked], windows[asked], bucket[asked]
        order = np.lexsort((start, doc))
        doc, start, windows, bucket = doc[order], start[order], windows[order], bucket[order]
        cuts = np.append(np.flatnonzero(np.append(True, doc[1:] != doc[:-1])), len(doc)) if len(doc) else [0]
        rows = [(int(doc[a]), start[a:b], windows[a:b], bucket[a:b]) for a, b in zip(cuts, cuts[1:])]
        lists = [pa.list_(pa.int64())] * 3
        return _batch(rows, ["id", "starts", "windows", "buckets"], [pa.int64(), *lists])

    wanted = _by_key(first, "key", requests, "id bigint, starts array<bigint>, windows array<bigint>, buckets array<bigint>")

    def contexts(piece: pa.RecordBatch) -> pa.RecordBatch:
        by: dict[int, list[tuple[int, int, bytes]]] = {}
        columns = [piece.column(k).to_pylist() for k in (0, 2, 3, 4)]
        for text, doc, starts, windows, buckets in zip(as_bytes(piece.column(1)), *columns):
            for a, n, bucket in zip(starts, windows, buckets):
                end = a + n + size - 1
                if end <= len(text):
                    by.setdefault(bucket, []).append((doc, a, text[a:end]))
        rows = []
        for bucket, found in by.items():
            head = np.array([[d, a, len(x)] for d, a, x in found], np.int64).T
            data = np.int64(len(found)).tobytes() + np.ascontiguousarray(head).tobytes()
            rows.append((bucket, data + b"".join(x for *_, x in found)))
        return _batch(rows, *_KEYED)

    def different(bucket: int, table: pa.Table) -> pa.RecordBatch:
        return _batch(list(_different_runs(table.column("data").to_pylist(), size, parts)), *_KEYED)

    asked = texts.join(wanted, "id").select("id", "text", "starts", "windows", "buckets")
    bytes_of = map_slices(asked, contexts, "key int, data binary", most=SLICE_BYTES)
    second = staged(_by_key(bytes_of, "key", different, "key int, data binary"), "substring-repeats")
    give_back(spark)

    def merged(part: int, table: pa.Table) -> pa.RecordBatch:
        doc, start, windows, bucket = _unpack(table.column("data").to_pylist(), _SPAN_TYPES)
        gone = bucket < 0
        doc, start, end = doc[gone], start[gone].astype(np.int64), (start + windows)[gone].astype(np.int64) + size - 1
        order = np.lexsort((start, doc))
        doc, start, end = doc[order], start[order], end[order]
        rows = []
        cuts = np.append(np.flatnonzero(np.append(True, doc[1:] != doc[:-1])), len(doc)) if len(doc) else [0]
        for a, b in zip(cuts, cuts[1:]):
            reach = np.maximum.accumulate(end[a:b])
            new = np.append(True, start[a + 1 : b] > reach[:-1])
            rows.append((int(doc[a]), start[a:b][new], reach[np.append(new[1:], True)]))
        return _batch(rows, ["id", "starts", "ends"], [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())])

    both = first.unionByName(second)
    return _by_key(both, "key", merged, "id bigint, starts array<bigint>, ends array<bigint>")


def without_repeats(
    docs: DataFrame, size: int = SIZE, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, n_bytes, starts, ends, kept): the removed spans and the remaining bytes of every document."""
    spans = removed_spans(docs, size, gram, id_col, text_col).withColumnRenamed("id", "_id")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    joined = rows.join(spans, F.col("id") == F.col("_id"), "left").select("id", "text", "starts", "ends")

    def cut(piece: pa.RecordBatch) -> pa.RecordBatch:
        kept, sizes, firsts, lasts = [], [], [], []
        for text, starts, ends in zip(
            as_bytes(piece.column(1)), piece.column(2).to_pylist(), piece.column(3).to_pylist()
        ):
            spans = [(a, min(b, len(text))) for a, b in zip(starts or (), ends or ()) if a < len(text)]
            edges = [0, *(x for s in spans for x in s), len(text)]
            kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
            sizes.append(len(text))
            firsts.append([a for a, _ in spans])
            lasts.append([b for _, b in spans])
        lists = pa.list_(pa.int64())
        columns = [pa.array(sizes, pa.int64()), pa.array(firsts, lists), pa.array(lasts, lists), pa.array(kept, pa.binary())]
        return pa.record_batch([piece.column(0), *columns], ["id", "n_bytes", "starts", "ends", "kept"])

    kind = rows.schema["id"].dataType.simpleString()
    return map_slices(
        joined, cut, f"id {kind}, n_bytes bigint, starts array<bigint>, ends array<bigint>, kept binary"
    )
