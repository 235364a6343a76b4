"""Connected components of a distributed edge list by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _minimum(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the node's smallest neighbour (itself included)."""
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = _minimum(both).select("u", F.least("u", "m").alias("m"))
    return (
        both.join(low, "u")
        .filter("v > u")
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .filter("u <> v")
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node's smaller neighbours, and the node, to the smallest of them. Edges have u > v."""
    low = _minimum(edges)
    joined = edges.join(low, "u")
    hung = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
    return hung.unionAll(low.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node that has an edge, but the smallest of each component.

    ``edges`` holds two long columns ``u`` and ``v``; loops, repeats and null ends are ignored.
    ``component`` is the smallest node reachable. Every round is written to the shared folder,
    so neither lineage nor driver memory grows; the number of rounds grows with the logarithm
    of the nodes. An edge list without edges gives an empty frame.
    """
    edges = edges.filter("u is not null and v is not null and u <> v")
    current = materialize(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc"
    )

    def state(df: DataFrame) -> tuple:
        row = df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return row[0], row[1]

    before = state(current)
    for _ in range(max_rounds):
        if not before[0]:
            break
        after_large = materialize(_large_star(current), "cc")
        step = materialize(_small_star(after_large), "cc")
        discard(after_large)
        now = state(step)
        discard(current)
        current = step
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("connected components did not settle")
    return current.select(F.col("u").alias("node"), F.col("v").alias("component"))
