"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Nodes with more than this share of all edges get their least neighbour by a broadcast of at most twice its inverse rows.
HOT_SHARE = 0.001


def _state(edges: DataFrame) -> tuple:
    """Count and order-free sums of the edges: equal when a round changed nothing."""
    mixed = F.xxhash64("u", "v").cast("decimal(20,0)")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(mixed)).first())


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): for each node of an edge (u, v) the least node of its component.

    Each step keeps only the least neighbour of a node and joins it back to the edges,
    so no neighbour list is ever held; a node with very many edges is served by a
    broadcast of bounded size. Every round is written to the shared folder.
    Self loops and repeated edges do no harm; no edges give no rows.
    """
    now = stored(_oriented(edges), "edges")
    state = _state(now)
    for _ in range(max_rounds):
        if not state[0]:
            break
        now = stored(_large_star(now, state[0]), "edges")
        now = stored(_small_star(now, state[0]), "edges")
        before, state = state, _state(now)
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    # The edges are stars now: each node beside its least node.
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _oriented(edges: DataFrame) -> DataFrame:
    """Distinct edges with u > v."""
    return edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _with_least(edges: DataFrame, least: DataFrame, n_edges: int) -> DataFrame:
    """The edges with ``m``, the entry of ``u`` in ``least`` (u, m, n): hot entries are broadcast, the others joined by a shuffle."""
    limit = max(1000, int(n_edges * HOT_SHARE))
    hot = least.where(F.col("n") > limit).select("u", F.col("m").alias("hot_m"))  # at most 2 * n_edges / limit rows
    known = edges.join(F.broadcast(hot), "u", "left")
    cold = known.where("hot_m IS NULL").drop("hot_m").join(least.where(F.col("n") <= limit).select("u", "m"), "u")
    return known.where("hot_m IS NOT NULL").withColumnRenamed("hot_m", "m").unionByName(cold)


def _large_star(edges: DataFrame, n_edges: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
    return _with_least(both.where("v > u"), least, n_edges).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame, n_edges: int) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    moved = _with_least(edges, least, n_edges).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
