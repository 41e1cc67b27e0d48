"""The conflict graph: tasks are vertices, an edge joins two tasks that share a resource.

Resource buckets stand for cliques. Everything except the explicit edge listing works on the
bucket rows (task, resource), whose number is the size of the footprint; a bucket of k tasks
is never expanded to its k(k-1)/2 pairs for a count, a degree or a component.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavelane.functions.joins import lookup_join
from wavelane.functions.ranking import rank_rows
from wavelane.operators.footprint import RESOURCE
from wavelane.session import cut_lineage, staged

BUCKET = ["batch_id", *RESOURCE]
VERTEX = ["batch_id", "task_id"]
SET = ["batch_id", "_set", "_set2"]

# Buckets of three tasks and more that are broadcast to find their rows: a key and two numbers each.
WIDE_BUCKETS = 500_000
# Buckets up to this size are compared pairwise when neighbours are counted.
PAIRWISE_BUCKET = 64
# Sets of larger buckets that one task takes the unions of, and how many of them at a time.
SET_ROWS = 200_000
UNION_ROWS = 1_024
# Large buckets of a task up to which their overlaps are counted subset by subset, and sets that one task counts at a time.
SUBSET_BUCKETS = 16
GROUP_ROWS = 100_000
# Rows shuffled at a time to count overlaps, and bytes of a table that one task reads on the way.
PASS_ROWS = 16_000_000
SPLIT = "16m"
BLOCK_ENTRIES = 1_000_000
# Words of 64 bits in a chunk's bitmap.
CHUNK_WORDS = 32_768 // 64
# Rows of one bucket tile in the edge listing.
TILE_ROWS = 4_096


def hot_buckets(fp: DataFrame, max_bucket_size: int = 10_000) -> DataFrame:
    """Report of resources touched by more tasks than the cap; nothing is dropped."""
    return (
        fp.groupBy(*BUCKET)
        .agg(F.count(F.lit(1)).alias("bucket_size"))
        .filter(F.col("bucket_size") > max_bucket_size)
    )


def shared_rows(fp: DataFrame) -> DataFrame:
    """Footprint rows of resources with at least two tasks: the only ones that matter.

    The footprint is shuffled once, for the sizes. Of a bucket of two the least and the greatest task are all it holds; the
    rows of larger ones are looked up, by a broadcast while they are few.
    """
    sizes = fp.dropna(subset=BUCKET).groupBy(*BUCKET).agg(
        F.count(F.lit(1)).alias("bucket_size"), F.min("task_id").alias("centre"), F.max("task_id").alias("_last")
    )
    sizes = staged(sizes.filter(F.col("bucket_size") > 1), "bucket-sizes", SPLIT)
    two = F.col("bucket_size") == 2
    both = sizes.filter(two).select(
        *BUCKET, F.explode(F.array("centre", "_last")).alias("task_id"), "bucket_size", "centre"
    )
    more = lookup_join(fp.select(*BUCKET, "task_id"), sizes.filter(~two).drop("_last"), BUCKET, "inner", WIDE_BUCKETS)
    return both.unionByName(more)


def bucket_pairs(shared: DataFrame, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(batch_id, resource, u, v) with u < v for every two tasks of a bucket.

    The listing is as large as the graph is dense. A large bucket is cut into tiles and each
    pair of tiles is its own join key, so the work on it spreads over many tasks.
    """
    tiles = F.ceil(F.col("bucket_size") / tile_rows)
    tiled = (
        shared.select(
            *BUCKET,
            "task_id",
            F.pmod(F.xxhash64("task_id"), tiles).alias("tile"),
            F.explode(F.sequence(F.lit(0).cast("bigint"), tiles - 1)).alias("other"),
        )
        .withColumn("lo", F.least("tile", "other"))
        .withColumn("hi", F.greatest("tile", "other"))
        .drop("other")
    )
    left = tiled.withColumnsRenamed({"task_id": "u", "tile": "tu"})
    right = tiled.withColumnsRenamed({"task_id": "v", "tile": "tv"})
    across = ((F.col("tu") == F.col("lo")) & (F.col("tv") == F.col("hi"))) | (
        (F.col("tu") == F.col("hi")) & (F.col("tv") == F.col("lo"))
    )
    return (
        left.join(right, [*BUCKET, "lo", "hi"])
        .filter((F.col("u") < F.col("v")) & across)
        .select(*BUCKET, "u", "v")
    )


def conflict_edges(shared: DataFrame, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Every conflicting pair once, as (batch_id, u, v) with u < v.

    Only for users who want the edges themselves; no other operator builds on this listing.
    """
    return bucket_pairs(shared, tile_rows).select("batch_id", "u", "v").distinct()


def edge_shared_resources(shared: DataFrame, tile_rows: int = TILE_ROWS) -> DataFrame:
    """The resources behind each edge, one row per (edge, resource)."""
    return bucket_pairs(shared, tile_rows).select("batch_id", "u", "v", *RESOURCE)


def adjacency(edges: DataFrame) -> DataFrame:
    """Each edge in both directions."""
    return edges.select("batch_id", F.col("u").alias("task_id"), F.col("v").alias("neighbour")).union(
        edges.select("batch_id", F.col("v"), F.col("u"))
    )


def _numbered_buckets(large: DataFrame) -> DataFrame:
    """Footprint rows with the number of their bucket, ``_id``, from 1 in each batch; small buckets come first."""
    order = [F.col(c).asc() for c in ("bucket_size", *RESOURCE)]
    # One row stands for a bucket, so that few are shuffled.
    firsts = large.filter(F.col("task_id").eqNullSafe(F.col("centre"))).select(*BUCKET, "bucket_size").distinct()
    buckets = rank_rows(firsts, ["batch_id"], order, "_id").select(*BUCKET, F.col("_id").cast("int").alias("_id"))
    return lookup_join(large.drop("centre"), buckets, BUCKET, "inner", WIDE_BUCKETS)


def _union_sizes(large: DataFrame, sets: DataFrame, set_rows: int) -> DataFrame:
    """(batch_id, _set, _set2, _union): tasks of ``large`` that any bucket of a set holds.

    Buckets are bitmaps over chunks of task numbers. A chunk's bitmaps meet the sets, ``set_rows`` of them at a time, in one
    task, which takes unions of rows of a bit matrix; sets go only to chunks where one of their buckets has members.
    """
    tasks = rank_rows(large.select(*VERTEX).distinct(), ["batch_id"], [F.col("task_id").asc()], "_n")
    chunk = F.expr("bitmap_bucket_number(_n)").alias("_chunk")
    bitmaps = cut_lineage(
        large.join(tasks, VERTEX)
        .groupBy("batch_id", "_id", chunk)
        .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(_n))").alias("_bits"))
    )
    pieces = sets.count() // set_rows + 1
    placed = sets.select("*", F.explode("_names").alias("_id")).join(bitmaps.drop("_bits"), ["batch_id", "_id"])
    piece = F.pmod("_set", F.lit(pieces)).cast("int").alias("_piece")
    asked = placed.select("batch_id", "_chunk", piece, "_set", "_set2", "_names").distinct()
    asked = asked.withColumn("_id", F.lit(None).cast("int")).withColumn("_bits", F.lit(None).cast("binary"))
    read = bitmaps.join(placed.select("batch_id", "_id", "_chunk", piece).distinct(), ["batch_id", "_id", "_chunk"])
    rows = asked.unionByName(read, allowMissingColumns=True)

    def count(group: pa.Table) -> pa.Table:
        is_set = pc.is_null(group.column("_id"))
        matrix, wanted = group.filter(pc.invert(is_set)), group.filter(is_set)
        ids = matrix.column("_id").to_numpy()
        order = np.argsort(ids)
        bits = np.frombuffer(b"".join(matrix.column("_bits").to_pylist()), np.uint64).reshape(len(ids), -1)[order]
        # A row of zeros stands for buckets without members in this chunk.
        bits = np.vstack([bits, np.zeros((1, CHUNK_WORDS), np.uint64)])
        names = wanted.column("_names").combine_chunks()
        size = pc.list_value_length(names).to_numpy()
        flat, ids = names.flatten().to_numpy(), ids[order]
        at = np.minimum(np.searchsorted(ids, flat), len(ids) - 1)
        at = np.where(ids[at] == flat, at, len(ids))
        ends = np.cumsum(size)
        found = []
        for a in range(0, len(size), UNION_ROWS):
            part = slice(a, a + UNION_ROWS)
            first = ends[a] - size[a]
            held = bits[at[first : ends[part][-1]]]
            found.append(np.bitwise_count(np.bitwise_or.reduceat(held, ends[part] - size[part] - first, axis=0)).sum(axis=1))
        keys = wanted.select(["batch_id", "_set", "_set2"])
        counts = np.concatenate([np.zeros(0, np.int64), *found]).astype(np.int64)
        return keys.append_column("_union", pa.array(counts))

    kind = sets.schema["batch_id"].dataType.simpleString()
    counted = rows.groupBy("batch_id", "_chunk", "_piece").applyInArrow(
        count, f"batch_id {kind}, _set bigint, _set2 int, _union bigint"
    )
    return counted.groupBy("batch_id", "_set", "_set2").agg(F.sum("_union").alias("_union"))


def _shared_again(group: pa.Table) -> pa.Table:
    """Per row (``_owner``, ``_rest``): tasks of other sets that also hold the owner and further buckets of ``_rest``, with the
    sign of inclusion and exclusion.

    Subsets grow by one bucket a level, and only from those that another set holds as well: the rest adds nothing.
    """
    owner = group.column("_owner").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    rest = group.column("_rest").combine_chunks()
    weight, size = group.column("_w").to_numpy(), pc.list_value_length(rest).to_numpy()
    flat, ends = rest.flatten().to_numpy().astype(np.int64), np.cumsum(size)
    sign, again = group.column("_sign").to_numpy().astype(np.int64), np.zeros(len(size), np.int64)
    row = np.repeat(np.arange(len(size)), size)
    left = [(row, np.arange(len(flat)), owner[row], 1)]
    while left:
        row, at, code, turn = left.pop()
        _, code = np.unique(code * (flat.max() + 1) + flat[at], return_inverse=True)
        others = np.bincount(code, weights=weight[row])[code].astype(np.int64) - weight[row]
        again += turn * sign * np.bincount(row, weights=others, minlength=len(size)).astype(np.int64)
        held = others > 0
        row, at, code = row[held], at[held], code[held]
        # Subsets with the same start stay together; blocks of them are done one after another.
        grown = np.cumsum(np.bincount(code, weights=ends[row] - at - 1)) if len(at) else np.zeros(1)
        block = (grown // BLOCK_ENTRIES).astype(np.int64)
        for k in np.unique(block):
            own = block[code] == k
            r, a, c = row[own], at[own], code[own]
            more = ends[r] - a - 1
            if more.sum():
                start = np.repeat(a + 1 - (np.cumsum(more) - more), more)
                left.append((np.repeat(r, more), start + np.arange(len(start)), np.repeat(c, more), -turn))
    return group.select(["_num"]).append_column("_again", pa.array(again))


def _counted_again(sets: DataFrame, group_rows: int, pass_rows: int) -> DataFrame:
    """(batch_id, _set, _set2, _again): by how much the sizes of a set's buckets exceed the size of their union.

    Inclusion and exclusion over the tasks that hold two, three ... buckets of the set; those with the very same set, ``alike``,
    are in all of its subsets and need no listing. A task's subsets are counted where their
    first bucket is, ``_held``; where more than ``group_rows`` sets meet, where their first two are, and so on. About
    ``pass_rows`` rows are shuffled at a time, and sets go by numbers, which are smaller than their hashes.
    """
    sets = staged(sets.select("*", F.monotonically_increasing_id().alias("_num")), "degree-weights", SPLIT)

    def deeper(rows: DataFrame) -> DataFrame:
        each = rows.select("batch_id", "_num", "_w", "_held", "_rest", F.posexplode("_rest").alias("_at", "_id"))
        return each.select(
            "batch_id", "_num", "_w", F.concat("_held", F.array("_id")).alias("_held"),
            F.slice("_rest", F.col("_at") + 2, F.size("_rest")).alias("_rest"),
        )

    place = ["batch_id", "_held"]
    sign = F.when(F.size("_held") % 2 == 0, 1).otherwise(-1).cast("bigint")
    found, read = [], []

    def keep(rows: DataFrame) -> None:
        found.append(staged(rows.filter("_again != 0"), "degree-again", SPLIT))

    def count(rows: DataFrame, n: int) -> None:
        owner = F.concat_ws(" ", F.col("batch_id").cast("string"), F.col("_held").cast("array<string>"))
        sent = rows.select("_num", "_w", owner.alias("_owner"), (-sign).alias("_sign"), "_rest")
        part = F.pmod(F.xxhash64("_owner"), F.lit(4 * n // group_rows + 1))
        passes = n // pass_rows + 1
        for k in range(passes):
            own = sent.filter(F.pmod(F.hash("_owner"), F.lit(passes)) == k) if passes > 1 else sent
            keep(own.groupBy(part.alias("_part")).applyInArrow(_shared_again, "_num bigint, _again bigint"))

    rows = deeper(sets.select("batch_id", "_num", "_w", F.array().cast("array<int>").alias("_held"), F.col("_names").alias("_rest")))
    while True:
        open_rows = rows.filter(F.size("_rest") > 0)
        sizes = staged(open_rows.groupBy(*place).count(), "degree-places", SPLIT)
        n, most = sizes.agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.max("count"), F.lit(0))).first()
        if most <= group_rows:
            count(open_rows, n)
            break
        hot = cut_lineage(sizes.filter(F.col("count") > group_rows).select(*place))
        count(open_rows.join(hot, place, "left_anti"), n)
        rows = staged(deeper(open_rows.join(hot, place, "left_semi")), "degree-rows", SPLIT, [*read, sizes])
        read = [rows]
        totals = rows.groupBy(*place).agg(F.sum("_w").alias("_n"))
        keep(rows.join(totals, place).select("_num", (sign * (F.col("_n") - F.col("_w"))).alias("_again")))
    alike = sets.select("_num", ((F.col("_w") - 1) * (F.size("_names") - 1)).alias("_again")).filter("_again != 0")
    summed = reduce(DataFrame.unionByName, found, alike).groupBy("_num").agg(F.sum("_again").alias("_again"))
    summed = staged(summed, "degree-again", SPLIT, [*found, *read, sizes])
    return staged(sets.select(*SET, "_num").join(summed, "_num").drop("_num"), "degree-again", SPLIT, [summed, sets])


def _through_large(
    large: DataFrame, narrow: DataFrame, set_rows: int, subset_buckets: int, group_rows: int, pass_rows: int
) -> DataFrame:
    """(batch_id, task_id, _through_large): neighbours of a task in its large buckets.

    Overlaps of up to ``subset_buckets`` buckets are counted, at a cost in proportion to the tasks. Tasks in more buckets ask
    bitmaps; their part in the neighbourhoods of the others comes from bitmaps of these tasks alone.
    """
    wide = F.size("_names") > subset_buckets
    few, many = narrow.filter(~wide), narrow.filter(wide)
    weighted = few.filter(F.size("_names") > 1).groupBy(*SET).agg(F.first("_names").alias("_names"), F.count(F.lit(1)).alias("_w"))
    again = _counted_again(weighted, group_rows, pass_rows)
    if many.isEmpty():
        return few.join(again, SET, "left").select(
            *VERTEX, (F.col("_ends") - F.coalesce("_again", F.lit(0))).alias("_through_large")
        )
    asking = many.select(*VERTEX)
    of_many = cut_lineage(large.select(*VERTEX, "_id").join(asking, VERTEX, "left_semi"))
    beside = of_many.groupBy("batch_id", "_id").agg(F.count(F.lit(1)).alias("_beside"))
    ends = (
        few.select(*VERTEX, F.explode("_names").alias("_id"))
        .join(beside, ["batch_id", "_id"])
        .groupBy(*VERTEX)
        .agg(F.sum("_beside").alias("_beside"))
    )
    sets = [cut_lineage(x.select(*SET, "_names").dropDuplicates(SET)) for x in (few.join(ends, VERTEX, "left_semi"), many)]
    of_few = _union_sizes(of_many, sets[0], set_rows)
    part = few.join(again, SET, "left").join(ends, VERTEX, "left").join(of_few, SET, "left")
    seen = [F.coalesce(c, F.lit(0)) for c in ("_again", "_beside", "_union")]
    parts = part.select(*VERTEX, (F.col("_ends") - seen[0] - seen[1] + seen[2]).alias("_through_large"))
    whole = many.join(_union_sizes(large.select(*VERTEX, "_id"), sets[1], set_rows), SET)
    return parts.unionByName(whole.select(*VERTEX, (F.col("_union") - 1).alias("_through_large")))


def degrees(
    shared: DataFrame,
    pairwise_bucket: int = PAIRWISE_BUCKET,
    set_rows: int = SET_ROWS,
    subset_buckets: int = SUBSET_BUCKETS,
    group_rows: int = GROUP_ROWS,
    pass_rows: int = PASS_ROWS,
) -> DataFrame:
    """Distinct neighbours of every task that has any, exact and without hot pair lists.

    Small buckets are self-joined, which costs at most ``pairwise_bucket`` rows per footprint row. The large buckets a
    task is in make a set, and tasks with the same set have as many neighbours through it: the sizes of its buckets less
    what they count twice. Pairs found both ways are counted once, on the large side.
    """
    rows = shared.select(*BUCKET, "task_id", "bucket_size", "centre")
    large = rows.filter(F.col("bucket_size") > pairwise_bucket)
    small = rows.filter(F.col("bucket_size") <= pairwise_bucket)
    if large.isEmpty():
        return _count_pairs(_pairs(small, small))
    large = _numbered_buckets(large)
    # Two hashes of a set (96 bits) travel in its place.
    named = large.groupBy(*VERTEX).agg(
        F.sort_array(F.collect_list("_id")).alias("_names"), F.sum(F.col("bucket_size") - 1).alias("_ends")
    )
    narrow = named.select("*", F.xxhash64("_names").alias("_set"), F.hash("_names").alias("_set2"))
    narrow = staged(narrow, "degree-sets", SPLIT)
    through_large = _through_large(large, narrow, set_rows, subset_buckets, group_rows, pass_rows)
    if small.isEmpty():
        return through_large.withColumnRenamed("_through_large", "degree")
    listed = _pairs(small, small).distinct()
    of_u = narrow.select("batch_id", F.col("task_id").alias("u"), F.col("_names").alias("_nu"))
    of_v = narrow.select("batch_id", F.col("task_id").alias("v"), F.col("_names").alias("_nv"))
    beyond = (
        listed.join(of_u, ["batch_id", "u"], "left")
        .join(of_v, ["batch_id", "v"], "left")
        .filter(~F.coalesce(F.arrays_overlap("_nu", "_nv"), F.lit(False)))
    )
    direct = beyond.groupBy("batch_id", F.col("u").alias("task_id")).agg(
        F.count(F.lit(1)).alias("_direct")
    )
    return through_large.join(direct, VERTEX, "full").select(
        *VERTEX,
        (
            F.coalesce("_through_large", F.lit(0)) + F.coalesce("_direct", F.lit(0))
        ).alias("degree"),
    )


def _pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    a = left.select(*BUCKET, F.col("task_id").alias("u"))
    b = right.select(*BUCKET, F.col("task_id").alias("v"))
    return a.join(b, BUCKET).filter(F.col("u") != F.col("v")).select("batch_id", "u", "v")


def _count_pairs(pairs: DataFrame) -> DataFrame:
    return (
        pairs.distinct()
        .groupBy("batch_id", F.col("u").alias("task_id"))
        .agg(F.count(F.lit(1)).alias("degree"))
    )


def task_degrees(vertices: DataFrame, degree: DataFrame) -> DataFrame:
    """Degree of every task, 0 for those without conflicts."""
    return vertices.select(*VERTEX).join(degree, VERTEX, "left").select(
        *VERTEX, F.coalesce("degree", F.lit(0).cast("bigint")).alias("degree")
    )


def edge_counts(degree: DataFrame) -> DataFrame:
    """Distinct conflicts per batch: every edge shows up in two degrees."""
    return degree.groupBy("batch_id").agg(
        F.floor(F.sum("degree") / 2).cast("bigint").alias("conflicts_detected")
    )
