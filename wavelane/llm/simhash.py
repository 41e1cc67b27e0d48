"""SimHash near-duplicates found in a Gray-ordered, hierarchical index.

A fingerprint has one bit per majority of its shingles' hash bits. Two documents are linked when their
fingerprints differ in at most ``max_bits`` bits, and components of links are the duplicate groups.

Only distinct fingerprints take part. Cut into ``max_bits + 1`` blocks, two linked fingerprints agree on
one block at least, so every block value is a bucket and no link is lost. A bucket with very many
fingerprints is cut again in the same way on its remaining bits. Inside a task the rows of its buckets are sorted
by Gray rank, where runs with equal leading bits are the nodes of a tree. The tree is
joined with itself from the top: a pair of nodes carries the differences counted so far and
is dropped, with everything below, as soon as they exceed the limit; a pair that can no longer exceed it is linked as a whole;
and a pair whose members are all linked already is skipped. A bucket gives a spanning forest, never its pairs.

Defined results: a null or empty text has fingerprint zero, linked like any other; equal texts have equal fingerprints and are
one group; rows with a null id get a fingerprint and no component; rows that repeat an id all stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavelane.functions.joins import lookup_join
from wavelane.llm.common import LOWER, as_bytes, map_slices, partitions, staged
from wavelane.operators.components import component_stars

# Above this many distinct fingerprints a bucket is cut again; the links stay the same.
BUCKET_ROWS = 4096
# Odd factors, each of which puts 64-bit hashes into another order.
_FACTORS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(1, 17)], np.uint64)
# Rows a task gathers before it joins the buckets it has.
BLOCK_ROWS = 200_000
# Node pairs expanded at a time.
PAIR_ROWS = 1 << 19

# Bits of each level of the tree: (shift, mask).
_LEVELS = (*((k, 255) for k in range(56, 0, -8)), (4, 15), (0, 15))


def text_fingerprint(text: bytes, width: int) -> int:
    """SimHash of the ``width``-word shingles, repeats included; fewer words are one shingle, none give 0."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate([len(w) + 1 for w in words]))
    starts = [0, *ends[:-1]]
    spans = zip(starts, ends[width - 1 :]) if len(words) > width else [(0, len(joined) + 1)]
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(joined[a : b - 1], 42) for a, b in spans])
    count = len(hashes) // 8
    rows = np.frombuffer(hashes, np.uint8).reshape(count, 8)
    ones = np.zeros(64, np.int64)
    for k in range(0, count, 4096):
        ones += np.unpackbits(rows[k : k + 4096], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > count).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, body, fp): a hash of every text and its signed 64-bit fingerprint."""

    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        found = [text_fingerprint(t, width) for t in as_bytes(piece.column(2))]
        return pa.record_batch([*piece.columns[:2], pa.array(found, pa.int64())], ["id", "body", "fp"])

    return map_slices(_with_body(docs, id_col, text_col), run, "id bigint, body bigint, fp bigint")


def _with_body(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col)
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("body"), text.alias("text"))


def _split(bits: list[int], parts: int) -> list[list[int]]:
    cuts = [len(bits) * k // parts for k in range(parts + 1)]
    return [bits[a:b] for a, b in zip(cuts, cuts[1:])]


def _mask(bits: list[int]) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >> 63 else value


def _bands(masks: list[tuple[int, int]]) -> Column:
    """One (band, shared) row per mask: the bits a linked fingerprint has to share."""
    return F.inline(
        F.array(
            *[
                F.struct(F.lit(n).alias("band"), F.col("fp").bitwiseAND(F.lit(m)).alias("shared"))
                for n, m in masks
            ]
        )
    )


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """Position of a bit pattern in the reflected Gray sequence."""
    rank = fp.copy()
    for k in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(k)
    return rank


class _Forest:
    """Union-find over rows, working on arrays of pairs; the root is the smallest row."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.parent[a], self.parent[b]
            open_ = ra != rb
            a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
            np.minimum.at(self.parent, np.maximum(ra, rb), np.minimum(ra, rb))
            self.flatten()

    def flatten(self) -> None:
        while True:
            up = self.parent[self.parent]
            if np.array_equal(up, self.parent):
                return
            self.parent = up


def _ranges(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry its numbers start .. start+count-1: (entry, number)."""
    entry = np.repeat(np.arange(len(count)), count)
    first = np.cumsum(count) - count
    return entry, np.arange(len(entry)) - first[entry] + start[entry]


def forest(bucket: np.ndarray, fp: np.ndarray, limit: int) -> np.ndarray:
    """For rows with equal ``bucket`` the smallest row each one is linked with.

    ``bucket`` numbers the buckets; rows must be sorted by (bucket, Gray rank) and distinct.
    """
    n = len(fp)
    groups = _Forest(n)
    if n < 2:
        return groups.parent
    # Nodes of a level are the runs of rows with the same bucket and leading bits.
    firsts = []
    same = np.zeros(n, bool)
    same[1:] = bucket[1:] == bucket[:-1]
    step = np.zeros(n, np.uint64)
    step[1:] = fp[1:] ^ fp[:-1]
    firsts.append(np.flatnonzero(~same))
    for shift, _ in _LEVELS:
        firsts.append(np.flatnonzero(~(same & (step >> np.uint64(shift) == 0))))
    kids = []
    for upper, lower in zip(firsts, firsts[1:]):
        at = np.searchsorted(lower, upper)
        kids.append((at, np.diff(np.append(at, len(lower)))))
    roots = np.arange(len(firsts[0]))
    stack = [(0, roots, roots, np.zeros(len(roots), np.int64))]
    while stack:
        level, a, b, seen = stack.pop()
        if level >= 2 and len(a) > 4096:
            lows = np.minimum.reduceat(groups.parent, firsts[level])
            highs = np.maximum.reduceat(groups.parent, firsts[level])
            done = (lows[a] == highs[a]) & (lows[b] == highs[b]) & (lows[a] == lows[b])
            a, b, seen = a[~done], b[~done], seen[~done]
        at, count = kids[level]
        cost = np.cumsum(count[a] * count[b])
        if len(a) > 1 and cost[-1] > PAIR_ROWS:
            half = max(1, min(len(a) - 1, int(np.searchsorted(cost, PAIR_ROWS))))
            stack.append((level, a[half:], b[half:], seen[half:]))
            a, b, seen = a[:half], b[:half], seen[:half]
        if not len(a):
            continue
        pair, flat = _ranges(np.zeros(len(a), np.int64), count[a] * count[b])
        x = at[a][pair] + flat // count[b][pair]
        y = at[b][pair] + flat % count[b][pair]
        shift, mask = _LEVELS[level]
        rows = firsts[level + 1]
        ordered = x <= y
        x, y, pair = x[ordered], y[ordered], pair[ordered]
        diff = seen[pair] + np.bitwise_count((fp[rows[x]] ^ fp[rows[y]]) >> np.uint64(shift) & np.uint64(mask))
        near = diff <= limit
        x, y, diff = x[near], y[near], diff[near]
        # Fewer bits left than differences allowed: all below is linked, whatever it is.
        sure = diff + shift <= limit
        if sure.any():
            ends = np.append(rows[1:], n)
            for node in (x[sure], y[sure]):
                entry, row = _ranges(rows[node], ends[node] - rows[node])
                groups.link(rows[node][entry], row)
            groups.link(rows[x[sure]], rows[y[sure]])
        if not sure.all():
            stack.append((level + 1, x[~sure], y[~sure], diff[~sure]))
    return groups.parent


def _join_blocks(limit: int):
    """Over rows sorted by bucket: gather whole buckets, join them, give (member, root) edges."""

    def edges(block: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(block)
        band, shared, fp, v = (t.column(k).to_numpy() for k in ("band", "shared", "fp", "v"))
        fp = fp.astype(np.int64).view(np.uint64)
        order = np.lexsort((gray_rank(fp), shared, band))
        band, shared, fp, v = band[order], shared[order], fp[order], v[order]
        new = np.ones(len(fp), bool)
        new[1:] = (band[1:] != band[:-1]) | (shared[1:] != shared[:-1])
        root = forest(np.cumsum(new), fp, limit)
        own = np.flatnonzero(root != np.arange(len(root)))
        yield pa.record_batch([pa.array(v[own]), pa.array(v[root[own]])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if count > BLOCK_ROWS:
                # Everything before the last bucket that the batch begins with is complete.
                key = (batch.column("band"), batch.column("shared"))
                last = (held[-1].column("band")[-1], held[-1].column("shared")[-1])
                same = np.logical_and(
                    key[0].to_numpy() == last[0].as_py(), key[1].to_numpy() == last[1].as_py()
                )
                cut = int(np.argmin(same)) if not same.all() else batch.num_rows
                if cut < batch.num_rows:
                    yield from edges([*held, batch.slice(0, cut)])
                    held, count, batch = [], 0, batch.slice(cut)
            held.append(batch)
            count += batch.num_rows
        if held:
            yield from edges(held)

    return run


def links(fps: DataFrame, max_bits: int = 4, agree: int = 1, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(a, b) edges that connect just what is linked, from (fp, v) with distinct ``fp``.

    Joined over all buckets they have the components of all links of at most ``max_bits`` bits. A
    bucket shares ``agree`` of ``max_bits + agree`` blocks: more of them make more and smaller buckets.
    """
    spark = fps.sparkSession
    whole = list(range(64))
    first, second = [], {}
    for n, blocks in enumerate(combinations(_split(whole, max_bits + agree), agree)):
        bits = [b for block in blocks for b in block]
        first.append((n, _mask(bits)))
        rest = [b for b in whole if b not in bits]
        second[n] = [
            (100 * (n + 1) + k, _mask(bits + more)) for k, more in enumerate(_split(rest, max_bits + 1))
        ]
    rows = fps.select("fp", "v", _bands(first))
    hot = rows.groupBy("band", "shared").count().filter(F.col("count") > bucket_rows)
    hot = hot.select("band", "shared", F.lit(True).alias("hot"))
    marked = lookup_join(rows, hot, ["band", "shared"])
    again = F.coalesce(
        *[F.when(F.col("band") == n, F.array(*[
            F.struct(F.lit(k).alias("band"), F.col("fp").bitwiseAND(F.lit(m)).alias("shared"))
            for k, m in second[n]
        ])) for n, _ in first]
    )
    own = F.array(F.struct("band", "shared"))
    spread = marked.select("fp", "v", F.inline(F.when(F.col("hot"), again).otherwise(own)))
    placed = spread.repartition(partitions(spark), "band", "shared").sortWithinPartitions("band", "shared")
    return placed.mapInArrow(_join_blocks(max_bits), "a bigint, b bigint")


def groups(fps: DataFrame, max_bits: int = 4, agree: int = 1) -> DataFrame:
    """(fp, component): the smallest id reachable from each fingerprint of (id, fp) rows."""
    distinct = staged(
        fps.filter(F.col("id").isNotNull()).groupBy("fp").agg(F.min("id").alias("v")), "simhash-distinct"
    )
    edges = links(distinct, max_bits, agree).select(
        F.lit(0).cast("bigint").alias("batch_id"),
        F.greatest("a", "b").alias("task_id"),
        F.least("a", "b").alias("centre"),
    )
    stars = component_stars(edges).select(F.col("hi").alias("v"), F.col("lo").alias("least"))
    return distinct.join(stars, "v", "left").select("fp", F.coalesce("least", "v").alias("component"))


def near_duplicates(
    docs: DataFrame, width: int = 5, max_bits: int = 4, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, fp, component) of every row with an id; the component is its smallest id."""
    fps = staged(fingerprints(docs, width, id_col, text_col), "simhash")
    # A fingerprint shared by very many documents is a hot key of this join; AQE splits it.
    component = F.when(F.col("id").isNotNull(), F.col("component")).alias("component")
    return fps.join(groups(fps, max_bits), "fp", "left").select("id", "fp", component)


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """The distinct hashes of a text's shingles, as ``text_fingerprint`` takes them."""
    words = text.translate(LOWER).split()
    found = {xxhash.xxh64_digest(b" ".join(words[k : k + width]), 42) for k in range(max(1, len(words) - width + 1))}
    return np.frombuffer(b"".join(found), np.int64) if words else np.zeros(0, np.int64)


def _minima(hashes: np.ndarray) -> np.ndarray:
    """Least hash under each order; an empty set has zeros."""
    if not len(hashes):
        return np.zeros(len(_FACTORS), np.int64)
    return (hashes.view(np.uint64)[:, None] * _FACTORS).min(axis=0).view(np.int64)


def _verified(pairs: DataFrame, of: DataFrame, similarity: float) -> DataFrame:
    """Edges between the (node, other) pairs whose shingles reach ``similarity``."""
    own = of.select("node", F.col("shingles").alias("own"))
    others = of.select(F.col("node").alias("other"), F.col("shingles").alias("theirs"))
    compared = pairs.distinct().join(own, "node").join(others, "other")
    both = F.size(F.array_intersect("own", "theirs"))
    union = F.size("own") + F.size("theirs") - both
    return compared.filter(both >= similarity * union).select(
        F.lit(0).cast("bigint").alias("batch_id"),
        F.greatest("node", "other").alias("task_id"),
        F.least("node", "other").alias("centre"),
    )


def _candidates(rows: DataFrame, similarity: float) -> DataFrame:
    """(node, other): all pairs of a component, from different groups, that can reach ``similarity``.

    A prefix-filtered join over (component, node, group, shingles): ordered by the number of texts of the component that
    hold them, rarest first, two sets with so much in common share one of their first shingles, and
    what follows the first common one on either side suffices for the overlap. Under each shingle the largest group
    is met by the others only, so one group of very many texts costs its size.
    """
    held = rows.select("component", "node", "group", F.explode("shingles").alias("shingle"))
    often = held.groupBy("component", "shingle").agg(F.count("node").alias("n"))
    ranked = held.join(often, ["component", "shingle"]).groupBy("component", "node", "group").agg(
        F.sort_array(F.collect_list(F.struct("n", "shingle"))).alias("ordered")
    )
    ranked = ranked.select("component", "node", "group", F.size("ordered").alias("size"), F.expr(
        f"slice(ordered, 1, cast(floor(size(ordered) * (1 - {similarity}D) + 1e-6) as int) + 1)"
    ).alias("prefix"))
    # A shingle that one text alone holds is met by none.
    probes = ranked.select("component", "node", "group", "size", F.posexplode("prefix").alias("at", "entry"))
    probes = staged(
        probes.filter(F.col("entry.n") > 1).select("component", "node", "group", "size", "at", F.col("entry.shingle").alias("shingle")),
        "simhash-prefixes",
    )
    key = ["component", "shingle"]
    largest = probes.groupBy(*key, "group").agg(F.count("node").alias("n")).groupBy(*key).agg(
        F.max(F.struct("n", "group"))["group"].alias("main"), F.count("group").alias("groups")
    )
    several = largest.filter(F.col("groups") > 1).select(*key, "main")
    met = probes.join(several, key).filter(F.col("group") != F.col("main"))
    theirs = probes.select(*key, *[F.col(c).alias(f"_{c}") for c in ("node", "group", "size", "at")])
    size, other, at, its = (F.col(c) for c in ("size", "_size", "at", "_at"))
    left = F.least(size - at, other - its)
    pairs = met.join(theirs, key).filter(
        (F.col("group") != F.col("_group"))
        & ((F.col("_group") == F.col("main")) | (F.col("group") < F.col("_group")))
        & (F.least(size, other) >= similarity * F.greatest(size, other) - 1e-6)
        & ((1 + similarity) * left >= similarity * (size + other) - 1e-6)
    )
    return pairs.select("node", F.col("_node").alias("other")).distinct()


def deduplicated(
    docs: DataFrame,
    width: int = 5,
    max_bits: int = 8,
    similarity: float = 0.8,
    agree: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``docs`` without near-duplicates: of every group the smallest id stays, with all columns.

    Components of linked fingerprints are candidates. Inside one, texts that share at least ``similarity`` of the
    shingles (Jaccard) are joined; what hangs together is a group. To begin with, texts with an equal minimum of their
    shingle hashes, under any of ``len(_FACTORS)`` orders, are compared with the smallest id among them, which leaves few
    groups; an exact join then finds all pairs between different ones. Equal texts share one verdict, so
    copies are compared once. Rows with a null id stay; rows that share id and text stay or go together.
    """
    fps = staged(fingerprints(docs, width, id_col, text_col).filter(F.col("id").isNotNull()), "simhash")
    members = fps.join(groups(fps, max_bits, agree), "fp").groupBy("component", "body").agg(F.min("id").alias("least"))
    bodies = staged(members, "simhash-bodies")
    several = bodies.groupBy("component").count().filter(F.col("count") > 1).select("component")
    asked = bodies.join(several, "component").select("component", "body", F.col("least").alias("id"))

    def shingles(piece: pa.RecordBatch) -> pa.RecordBatch:
        found = [shingle_hashes(t, width) for t in as_bytes(piece.column(3))]
        lists = pa.array(found, pa.list_(pa.int64()))
        marks = pa.array([_minima(f) for f in found], pa.list_(pa.int64()))
        return pa.record_batch([*piece.columns[:3], lists, marks], ["component", "body", "id", "shingles", "marks"])

    texts = asked.join(_with_body(docs, id_col, text_col), ["id", "body"]).select("component", "body", "id", "text")
    schema = "component bigint, body bigint, id bigint, shingles array<bigint>, marks array<bigint>"
    # Rows that repeat an id and its text give one row here.
    sets = staged(map_slices(texts, shingles, schema).dropDuplicates(["component", "body"]), "simhash-shingles")
    node = F.struct("id", "body")
    marked = sets.select("component", node.alias("node"), F.posexplode("marks").alias("k", "mark"))
    heads = marked.groupBy("component", "k", "mark").agg(F.min("node").alias("head"), F.count("node").alias("n"))
    pairs = marked.join(heads.filter(F.col("n") > 1), ["component", "k", "mark"]).filter(F.col("node") != F.col("head"))
    of = sets.select("component", node.alias("node"), "shingles")
    first = staged(component_stars(_verified(pairs.select("node", F.col("head").alias("other")), of, similarity)), "simhash-heads")
    # Pairs inside a group decide nothing any more; all others of a candidate component are still open.
    placed = of.join(first.select(F.col("hi").alias("node"), F.col("lo").alias("group")), "node", "left")
    placed = placed.withColumn("group", F.coalesce("group", "node"))
    apart = placed.groupBy("component").agg(F.min("group").alias("one"), F.max("group").alias("two"))
    still = placed.join(apart.filter(F.col("one") != F.col("two")).select("component"), "component")
    rest = staged(_candidates(staged(still, "simhash-open"), similarity), "simhash-pairs")
    linked = first.select("batch_id", F.col("hi").alias("task_id"), F.col("lo").alias("centre"))
    edges = staged(linked.unionByName(_verified(rest, of, similarity)), "simhash-edges")
    dropped = component_stars(edges).select(F.col("hi.id").alias("least"), F.col("hi.body").alias("body"))
    fate = bodies.join(dropped.withColumn("gone", F.lit(True)), ["least", "body"], "left")
    # A text that stays is kept under its smallest id.
    stays = fate.filter(F.col("gone").isNull()).select(F.col("least").alias("_least"), F.col("body").alias("_kept"))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
        F.col(id_col).alias("_least"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_kept"),
    )
    kept = rows.filter(F.col("_least").isNotNull()).join(stays, ["_least", "_kept"], "left_semi")
    return kept.unionByName(rows.filter(F.col("_least").isNull())).select("_row.*")


def fingerprint_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
