"""Connected components of the conflict graph by alternating star contraction.

Each bucket is a star around its smallest task, so the input has one row per footprint row.
A *large star* step hangs every larger neighbour of a node on the node's smallest neighbour,
a *small star* step does so with the smaller ones; alternating them turns every component
into one star around its smallest member (Kiveris et al., SoCC 2014).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavelane.functions.ranking import rank_rows
from wavelane.operators.graph import VERTEX
from wavelane.session import cut_lineage


def star_edges(shared: DataFrame) -> DataFrame:
    """(batch_id, hi, lo): every task of a bucket linked to the bucket's smallest task."""
    return (
        shared.filter(F.col("task_id") != F.col("centre"))
        .select("batch_id", F.col("task_id").alias("hi"), F.col("centre").alias("lo"))
        .distinct()
    )


def _contract(edges: DataFrame) -> DataFrame:
    """One large and one small star step; ``moved`` marks edges that either step changed."""
    # Partial minima are taken before the shuffle, so a node with very many neighbours costs
    # one row per map task; the join back only meets one row per node.
    ends = edges.select("batch_id", F.col("lo").alias("node"), F.col("hi").alias("other")).union(
        edges.select("batch_id", "hi", "lo")
    )
    lowest = ends.groupBy("batch_id", F.col("node").alias("lo")).agg(
        F.least(F.min("other"), F.first("node")).alias("root")
    )
    hung = edges.join(lowest, ["batch_id", "lo"]).select(
        "batch_id", "hi", F.col("root").alias("lo"), (F.col("root") != F.col("lo")).alias("moved")
    )

    # The smaller neighbours of a node and the node itself move to the smallest of them.
    roots = hung.groupBy("batch_id", "hi").agg(F.min("lo").alias("root"))
    near = hung.join(roots, ["batch_id", "hi"])
    kept = F.struct(F.col("hi"), F.col("root").alias("lo"), F.col("moved"))
    two = F.array(
        F.struct(F.col("hi"), F.col("root").alias("lo"), F.lit(True).alias("moved")),
        F.struct(F.col("lo").alias("hi"), F.col("root").alias("lo"), F.lit(True).alias("moved")),
    )
    out = F.when(F.col("root") != F.col("lo"), two).otherwise(F.array(kept))
    return (
        near.select("batch_id", F.inline(out))
        .groupBy("batch_id", "hi", "lo")
        .agg(F.bool_or("moved").alias("moved"))
    )


def component_stars(shared: DataFrame) -> DataFrame:
    """(batch_id, hi, lo) with lo the smallest member of hi's component, hi > lo."""
    edges = cut_lineage(star_edges(shared))
    while not edges.isEmpty():
        edges = cut_lineage(_contract(edges))
        if edges.filter("moved").isEmpty():
            break
    return edges.select("batch_id", "hi", "lo")


def connected_components(vertices: DataFrame, stars: DataFrame) -> DataFrame:
    """(batch_id, task_id, component): the component is named by its smallest task."""
    found = stars.select("batch_id", F.col("hi").alias("task_id"), "lo")
    return (
        vertices.select(*VERTEX)
        .join(found, VERTEX, "left")
        .select(*VERTEX, F.coalesce("lo", "task_id").alias("component"))
    )


def component_sizes(components: DataFrame) -> DataFrame:
    return components.groupBy("batch_id", "component").agg(
        F.count(F.lit(1)).alias("component_size")
    )


def component_ids(members: DataFrame) -> DataFrame:
    """Number the components of each batch by their smallest task: ``component-0`` onwards.

    Takes the rows left after admission, because numbering only counts admitted components.
    """
    labels = members.select("batch_id", "component").distinct()
    ranked = rank_rows(labels, ["batch_id"], [F.col("component")], "_rank")
    return ranked.select(
        "batch_id",
        "component",
        F.concat(F.lit("component-"), (F.col("_rank") - 1).cast("string")).alias("component_id"),
    )
