"""Similarity join of word n-gram sets by Jaccard, with documents of equal prefix and size joined as one group.

A text's set has its distinct ``width``-word shingles, as 64-bit hashes. Equal sets are one *node*. All sets are sorted by one global
order, shingles met rarely first: by the count of the shingle's cell in a sketch of fixed size that counts every document,
then by hash. Any fixed order makes the join exact; the counts only keep common shingles out of the prefixes. Two sets that are
similar enough have a common shingle in their prefixes, sizes near each other, and enough left behind the first common place.

Nodes with the same prefix and size make a *group*, and groups are joined, not nodes. First every group meets one other, the
head it shares most of its prefix with; pairs of members are verified on their whole sets, and what links makes components.
Pairs inside a component decide nothing any more. So the join proper takes groups by component: under each shingle the
largest component is met by the others only, pairs pass the size filter and one by their common shingles and places, and are
expanded to members and verified. Members of one group that are still in different components are joined in the same way, by
the shingles that follow their prefix.

Defined results: null and blank texts have no shingles and are linked with nothing; a text of fewer words than ``width`` is one
shingle; rows that repeat an id are documents of their own, named by it; rows with a null id get a size and no component, and link
nothing; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavelane.llm.common import LOWER, as_bytes, map_slices, partitions, slices, staged
from wavelane.operators.components import component_stars

# Cells of the sketch, and cells in one of its blocks.
CELL_BITS = 20
BLOCK_CELLS = 1 << 12
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def shingle_hashes(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts): the shingles of each text, repeats included, one text after the other."""
    split = [t.translate(LOWER).split() for t in texts]
    count = np.array([len(s) for s in split], np.int64)
    coded = pa.array(chain.from_iterable(split), pa.binary()).dictionary_encode()
    known = np.array([xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)
    words = known[coded.indices.to_numpy()]
    windows = np.where(count > 0, np.maximum(count - width + 1, 1), 0)
    doc = np.repeat(np.arange(len(split)), windows)
    at = np.arange(len(doc)) + (np.cumsum(count) - count - np.cumsum(windows) + windows)[doc]
    hashes = np.minimum(count, width).astype(np.uint64)[doc]
    # Texts that are too short end before the last of these words; theirs are taken one by one.
    reach = np.minimum(at, max(len(words) - width, 0))
    for k in range(min(width, len(words))):
        hashes *= _MULTIPLIER
        hashes += words[reach + k]
    begin, first = np.cumsum(count) - count, np.cumsum(windows) - windows
    for n in np.flatnonzero((count > 0) & (count < width)).tolist():
        own = int(count[n])
        for word in words[begin[n] : begin[n] + count[n]].tolist():
            own = (own * int(_MULTIPLIER) + word) & 0xFFFFFFFFFFFFFFFF
        hashes[first[n]] = own
    return _mixed(hashes), windows


def shingle_sets(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, sizes): the distinct shingles of each text, sorted by hash, one text after the other."""
    hashes, windows = shingle_hashes(texts, width)
    ends = np.cumsum(windows)
    for a, b in zip((ends - windows).tolist(), ends.tolist()):
        hashes[a:b].sort()
    new = np.ones(len(hashes), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    new[(ends - windows)[windows > 0]] = True
    size = np.diff(np.append(0, np.cumsum(new))[np.append(0, ends)])
    return hashes[new], size


def cell_counts(rows: DataFrame, width: int, cell_bits: int = CELL_BITS) -> np.ndarray:
    """Shingles of all texts by cell: an array of fixed size, summed up on Spark block by block."""
    shift = np.uint64(64 - cell_bits)
    block = min(BLOCK_CELLS, 1 << cell_bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << cell_bits, np.int64)
        for batch in batches:
            for piece in slices(batch, "text"):
                hashes, _ = shingle_hashes(as_bytes(piece.column("text")), width)
                total += np.bincount((hashes >> shift).astype(np.int64), minlength=len(total))
        kind = np.min_scalar_type(int(total.max()))
        cells = [part.astype(kind).tobytes() for part in total.reshape(-1, block)]
        columns = [pa.array(range(len(cells)), pa.int64()), pa.array([kind.itemsize] * len(cells), pa.int32()), pa.array(cells)]
        yield pa.record_batch(columns, ["block", "bytes", "cells"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for n, size, cells in zip(*(c.to_pylist() for c in batch.columns)):
                sums[n] = sums.get(n, 0) + np.frombuffer(cells, f"<u{size}").astype(np.int64)
        names = ["block", "cells"]
        yield pa.record_batch([pa.array(sums, pa.int64()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names)

    parts = rows.mapInArrow(count, "block bigint, bytes int, cells binary")
    summed = parts.repartition(partitions(rows.sparkSession), "block").mapInArrow(add, "block bigint, cells binary")
    total = np.zeros(1 << cell_bits, np.int64)
    for r in summed.collect():
        total[r.block * block : (r.block + 1) * block] = np.frombuffer(r.cells, np.int64)
    return total


def _often(hashes: np.ndarray, cells: np.ndarray) -> np.ndarray:
    return cells[(hashes >> np.uint64(64 - len(cells).bit_length() + 1)).astype(np.int64)]


def _prefix_sizes(size: np.ndarray, percent: int) -> np.ndarray:
    return size - (percent * size + 99) // 100 + np.minimum(size, 1)


def _ordered_sets(rows: DataFrame, width: int, percent: int, cells: Broadcast) -> DataFrame:
    """(id, text_hash, n, body, head, prefix): each set's size, digests of all of it and of its prefix, and the prefix."""

    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        hashes, size = shingle_sets(as_bytes(piece.column("text")), width)
        often, least = _often(hashes, cells.value), _prefix_sizes(size, percent)
        begin = np.cumsum(size) - size
        bodies, heads, prefixes = [], [], []
        for a, n, m in zip(begin.tolist(), size.tolist(), least.tolist()):
            own = hashes[a : a + n]
            own = own[np.argsort(often[a : a + n], kind="stable")[:m]]
            bodies.append(xxhash.xxh3_128_digest(hashes[a : a + n].tobytes()))
            heads.append(xxhash.xxh3_128_digest(own.tobytes()))
            prefixes.append(own.view(np.int64))
        columns = [pa.array(size), pa.array(bodies), pa.array(heads), pa.array(prefixes, pa.list_(pa.int64()))]
        return pa.record_batch([*piece.columns[:2], *columns], ["id", "text_hash", "n", "body", "head", "prefix"])

    schema = "id bigint, text_hash bigint, n bigint, body binary, head binary, prefix array<bigint>"
    return map_slices(rows, run, schema)


def _of_one_row(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` with the columns of its document; rows that repeat an id and its text count once."""
    # Grouped as the join has placed it: no further shuffle.
    return rows.join(wanted, ["id", "text_hash"]).dropDuplicates(["id", "text_hash"])


def _whole_sets(rows: DataFrame, members: DataFrame, pairs: DataFrame, width: int) -> DataFrame:
    """(node, shingles) of the nodes in ``pairs``, from one document each."""

    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        hashes, size = shingle_sets(as_bytes(piece.column("text")), width)
        offsets = pa.array(np.append(0, np.cumsum(size)), pa.int32())
        sets = pa.ListArray.from_arrays(offsets, pa.array(hashes.view(np.int64)))
        return pa.record_batch([piece.column(0), sets], ["node", "shingles"])

    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    texts = _of_one_row(rows, members.select("node", "id", "text_hash").join(nodes, "node"))
    return staged(map_slices(texts.select("node", "text"), run, "node bigint, shingles array<bigint>"), "join-wanted")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Edges between the pairs (a, b) of nodes that are similar enough."""
    own = sets.select(F.col("node").alias("a"), F.col("shingles").alias("own"))
    others = sets.select(F.col("node").alias("b"), F.col("shingles").alias("theirs"))
    both = F.size(F.array_intersect("own", "theirs"))
    union = F.size("own") + F.size("theirs") - both
    linked = pairs.join(own, "a").join(others, "b").filter(100 * both >= percent * union)
    return linked.select(
        F.lit(0).cast("bigint").alias("batch_id"),
        F.greatest("a", "b").alias("task_id"),
        F.least("a", "b").alias("centre"),
    )


def _unordered(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _met(groups: DataFrame) -> DataFrame:
    """(shingle, group, n, at): prefix places of groups whose shingle other groups have in theirs as well."""
    places = groups.select("group", "n", F.posexplode("prefix").alias("at", "shingle"))
    several = places.groupBy("shingle").count().filter(F.col("count") > 1).select("shingle")
    return places.join(several, "shingle").select("shingle", "group", "n", "at")


def _head_pairs(met: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Every member of a group with the first member of the group's head, and with the first of its own.

    The head is the group that comes first under most of its prefix shingles, if those are a fair share of the prefix:
    a good guess, and no more, since all other pairs are still looked at later, across groups and inside them.
    """
    # Firsts are taken by steps of size, so that most members can reach theirs. First under a shingle is the group with
    # the fewest rarer ones before it: the text that others are variants of has none of its own.
    band = F.floor(F.log(F.col("n")) / np.log(100 / percent)).alias("band")
    firsts = met.groupBy("shingle", band).agg(F.min(F.struct("at", "group"))["group"].alias("head"))
    shared = met.select("*", band).join(firsts, ["shingle", "band"]).filter(F.col("group") != F.col("head"))
    often = shared.groupBy("group", "n", "head").count()
    best = often.groupBy("group", "n").agg(F.max(F.struct("count", "head")).alias("best"))
    asked = best.filter(400 * F.col("best.count") >= (100 - percent) * F.col("n")).select("group", "best.head")
    out = members.join(asked, "group").select("node", "head")
    own = members.select("node", F.col("group").alias("head"))
    return out.union(own).filter(F.col("node") != F.col("head")).select(*_unordered("node", "head")).distinct()


def _group_pairs(units: DataFrame, percent: int) -> DataFrame:
    """Pairs of (group, component) units of two groups that can hold similar members, by prefix, size and place.

    ``units`` has (shingle, group, component, n, at). A pair is a candidate by a common shingle behind which enough is left on
    both sides. Then all its common prefix shingles are counted; any others stand behind the last of them.
    """
    sizes = units.groupBy("shingle", "component").count()
    main = sizes.groupBy("shingle").agg(
        F.max(F.struct("count", "component"))["component"].alias("main"), F.count("component").alias("components")
    )
    several = main.filter(F.col("components") > 1).select("shingle", "main")
    asking = units.join(several, "shingle").filter(F.col("component") != F.col("main"))
    theirs = units.select("shingle", *[F.col(c).alias(f"_{c}") for c in ("group", "component", "n", "at")])
    n, m = F.col("n"), F.col("_n")
    # The component that comes first asks; the most frequent one of a shingle is only asked. A pair may be asked from one
    # side under some shingles and from the other under others, so its sides are put in order.
    turned = F.col("component") < F.col("_component")
    met = asking.join(theirs, "shingle").filter(
        ((F.col("_component") == F.col("main")) | turned)
        & (F.col("component") != F.col("_component"))
        & (F.col("group") != F.col("_group"))
        & (100 * F.least(n, m) >= percent * F.greatest(n, m))
        & ((100 + percent) * F.least(n - F.col("at"), m - F.col("_at")) >= percent * (n + m))
    )
    names = ("group", "component", "n")
    sides = [F.struct(*names), F.struct(*[F.col(f"_{c}").alias(c) for c in names])]
    x, y = F.when(turned, sides[0]).otherwise(sides[1]), F.when(turned, sides[1]).otherwise(sides[0])
    own, other = ["group", "component"], ["_group", "_component"]
    pairs = met.select(*[x[c].alias(c) for c in (*own, "n")], *[y[c].alias(f"_{c}") for c in (*own, "n")]).distinct()
    places = units.select(*own, "shingle", "at")
    theirs = units.select(*[F.col(c).alias(f"_{c}") for c in own], "shingle", F.col("at").alias("_at"))
    counted = pairs.join(places, own).join(theirs, [*other, "shingle"]).groupBy(*own, "n", *other, "_n").agg(
        F.count("at").alias("common"), F.max("at").alias("at"), F.max("_at").alias("_at")
    )
    most = F.col("common") + F.least(n - F.col("at"), m - F.col("_at")) - 1
    return counted.filter((100 + percent) * most >= percent * (n + m)).select(*own, *other)


def _inner_pairs(placed: DataFrame, sets: DataFrame, percent: int, cells: Broadcast) -> DataFrame:
    """Pairs (node, _node) of one group's members in different components that can be similar.

    They share their prefix and have one size, so similar ones have another shingle in common just behind it, among as many as may
    differ and one. With places counted from there, the filters for pairs of groups hold for them as well.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column("shingles")
            size = pc.list_value_length(found).to_numpy().astype(np.int64)
            hashes = found.flatten().to_numpy().view(np.uint64)
            often, begin = _often(hashes, cells.value), _prefix_sizes(size, percent)
            differ = size - -(-2 * percent * size // (100 + percent))
            # Sets of which no shingle may differ are equal, and one node.
            end = np.where(differ > 0, begin + differ + 1, begin)
            behind = []
            for a, n, k, m in zip((np.cumsum(size) - size).tolist(), size.tolist(), begin.tolist(), end.tolist()):
                order = np.argsort(often[a : a + n], kind="stable")[k:m]
                behind.append(hashes[a : a + n][order].view(np.int64))
            columns = [*batch.columns[:3], pa.array(size), pa.array(behind, pa.list_(pa.int64()))]
            yield pa.record_batch(columns, ["node", "family", "component", "n", "behind"])

    parts = placed.groupBy("group").agg(F.min("component").alias("least"), F.max("component").alias("most"))
    several = placed.join(parts.filter("least < most").select("group"), "group").select("node", "group", "component")
    schema = "node bigint, family bigint, component bigint, n bigint, behind array<bigint>"
    rows = several.join(sets, "node").select("node", "group", "component", "shingles").mapInArrow(run, schema)
    each = rows.select("family", F.col("node").alias("group"), "component", "n", F.posexplode("behind").alias("at", "own"))
    units = staged(each.withColumn("shingle", F.struct("family", "own")).drop("family", "own"), "join-behind")
    return _group_pairs(units, percent).select(F.col("group").alias("node"), F.col("_group").alias("_node"))


def similar_components(
    docs: DataFrame,
    width: int = 5,
    percent: int = 80,
    id_col: str = "doc_id",
    text_col: str = "text",
    cell_bits: int = CELL_BITS,
) -> DataFrame:
    """(id, n, component): the set size of every row, and the smallest id reachable by links of ``percent`` or more."""
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash"), text.alias("text")
    )
    cells = rows.sparkSession.sparkContext.broadcast(cell_counts(rows, width, cell_bits))
    found = staged(_ordered_sets(rows, width, percent, cells), "join-sets")
    linkable = found.filter((F.col("n") > 0) & F.col("id").isNotNull())
    one = linkable.groupBy("body").agg(
        F.min(F.struct("id", "text_hash")).alias("one"), F.first("n").alias("n"), F.first("head").alias("head")
    )
    # Numbers given out once: the table is written before they are read.
    nodes = staged(one.select(F.monotonically_increasing_id().alias("node"), "body", "one.*", "n", "head"), "join-nodes")
    firsts = nodes.groupBy("n", "head").agg(F.min("node").alias("group"))
    members = staged(nodes.join(firsts, ["n", "head"]).select("node", "group", "id", "text_hash"), "join-members")
    leaders = members.filter(F.col("node") == F.col("group")).select("group", "id", "text_hash")
    groups = _of_one_row(found.select("id", "text_hash", "n", "prefix"), leaders)
    met = staged(_met(groups.select("group", "n", "prefix")), "join-places")
    heads = staged(_head_pairs(met, members, percent), "join-heads")
    sets = _whole_sets(rows, members, heads, width)
    first = staged(_verified(heads, sets, percent), "join-first")
    stars = component_stars(first).select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    placed = members.join(stars, "node", "left").select("node", "group", F.coalesce("component", "node").alias("component"))
    placed = staged(placed, "join-placed")
    units = met.join(placed.select("group", "component").distinct(), "group")
    apart = staged(_group_pairs(units, percent), "join-groups")
    theirs = placed.select(*[F.col(c).alias(f"_{c}") for c in placed.columns])
    expanded = apart.join(placed, ["group", "component"]).join(theirs, ["_group", "_component"])
    # The first pairs have one side in every member of a group of several, so their sets are at hand.
    inner = _inner_pairs(placed, sets, percent, cells)
    pairs = expanded.select("node", "_node").union(inner).select(*_unordered("node", "_node"))
    rest = pairs.distinct().join(heads, ["a", "b"], "left_anti")
    rest = staged(rest, "join-pairs")
    more = _verified(rest, _whole_sets(rows, members, rest, width), percent)
    edges = staged(first.unionByName(more), "join-edges")
    stars = component_stars(edges).select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    rooted = nodes.select("node", "body", "id").join(stars, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("id").alias("component"))
    named = rooted.join(least, "root").select("body", "component")
    component = F.when(F.col("id").isNotNull(), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")))
    return found.select("id", "n", "body").join(named, "body", "left").select("id", "n", component.alias("component"))


COMPONENTS_SQL = """
with words as (
    select doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w
    from documents),
shingles as (
    select doc_id, array_to_string(w, ' ') as shingle from words where len(w) between 1 and 4
    union
    select doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
    from words where len(w) >= 5),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
common as (
    select a.doc_id as a, b.doc_id as b, count(*) as n
    from shingles a join shingles b using (shingle) where a.doc_id < b.doc_id group by all),
links as (
    select a, b from common c join sizes x on x.doc_id = a join sizes y on y.doc_id = b
    where 100 * c.n >= 80 * (x.n + y.n - c.n)),
both_ways as (select a, b from links union all select b, a from links),
reach as (
    with recursive r(doc_id, other) as (
        select a, b from both_ways
        union
        select r.doc_id, e.b from r join both_ways e on e.a = r.other)
    select doc_id, min(other) as other from r group by doc_id)
select w.doc_id, coalesce(n, 0) as n_shingles, least(w.doc_id, coalesce(other, w.doc_id)) as component_id
from words w left join sizes using (doc_id) left join reach using (doc_id)
"""
