"""Distributed connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stage, stage


def _smallest(edges: DataFrame) -> DataFrame:
    """(u, m): each node's smallest neighbour; map-side combined, then written, so
    that the join with it has plain exchanges whose hot nodes AQE can split."""
    return stage(edges.groupBy("u").agg(F.min("v").alias("m")), "star")


def _large_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every larger neighbour of a node points to the node's smallest one."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = _smallest(both)
    out = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
    return out.distinct(), low


def _small_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The node and its smaller neighbours point to the smallest of these."""
    low = _smallest(edges)
    moved = edges.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v"))).distinct(), low


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node that has an edge to another one.

    The component is its smallest node. Loops and edges with a null end are
    ignored; repeated edges count once. Each half step is written to the shared
    checkpoint folder, which cuts lineage; the rounds end when the edges, by then
    a star for each component, no longer change. Nothing is gathered: a step is a
    map-side combined minimum and a join.
    """
    pair = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a <> b")
    now = stage(pair.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    while True:
        print_of = now.agg(F.count(F.lit(1)).alias("n"),
                           F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (print_of["n"], print_of["s"]) == seen or not print_of["n"]:
            break
        seen = (print_of["n"], print_of["s"])
        for step in (_large_star, _small_star):
            made, low = step(now)
            after = stage(made, "edges")
            drop_stage(now, low)
            now = after
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
