"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import Workspace


def connected(edges: DataFrame, work: Workspace, name: str) -> DataFrame:
    """``node, root``: the smallest node of the component of every node of the edges ``a, b`` (longs).

    Each round points a node's larger neighbours, then its smaller ones, at the smallest of them, and writes
    the edges. Rounds grow with the logarithm of the longest path; minima are combined before a shuffle, so a
    node with very many neighbours is no bottleneck. Nodes whose only edge is to themselves are kept.
    """
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    stars = work.stage(f"{name}-0", _ordered(edges.where("a <> b")))
    state, step = None, 0
    while True:
        new = _state(stars)
        if new == state or not new[0]:
            break
        state, step = new, step + 1
        both = stars.union(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _toward(both).where("b > a").select("b", "least").where("b <> least")
        stars = _ordered(large.select(F.col("b").alias("a"), F.col("least").alias("b")))
        small = _toward(stars)
        stars = small.select(F.col("b").alias("a"), F.col("least").alias("b")).union(small.select("a", F.col("least").alias("b")))
        stars = work.stage(f"{name}-{step}", _ordered(stars.where("a <> b")))
    return nodes.join(stars.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left").select(
        "node", F.coalesce("root", "node").alias("root")
    )


def _ordered(edges: DataFrame) -> DataFrame:
    """Distinct edges from the larger to the smaller node."""
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _toward(edges: DataFrame) -> DataFrame:
    """Each edge with the smallest of node ``a`` and all its neighbours."""
    least = edges.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("least"))
    return edges.join(least, "a")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
