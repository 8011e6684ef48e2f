"""Connected patterns of a co-occurrence graph, read off what each example has on its connected sets of items."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import spread, stored
from .graphs import edge_sets, neighbours

#: The pairs of this many items fit into the bits of a long.
MOST_NODES = 11


def connected_patterns(edge_examples: DataFrame, example: str, min_support: int, most_nodes: int = 4) -> DataFrame:
    """(n_nodes, n_edges, nodes, edges, support): the closed connected patterns of up to ``most_nodes`` items (11 at most).

    ``edge_examples`` (example, i, j) with i < j; repeated rows count once, rows with a null don't. An example
    supports a pattern if it has all of the pattern's edges; patterns need more than ``min_support`` examples. A
    pattern is closed if every further edge between its items loses examples, so one whose
    examples all have such an edge is left to the pattern with that edge. (A search that
    takes edges off and stops where nothing is gained finds only closed patterns, but not
    all: it can't pass a step without gain.) Single items have no edges. ``nodes`` is
    sorted, ``edges`` an array of (i, j) sorted likewise. An empty table gives none.

    Each example's edges are one array, and examples with the same edges one row. The connected
    sets of its items are made from it, once each, and what edges it has on a set is a mask of
    pairs; examples are counted for each set and mask. The closed patterns of a set are the intersections of its masks, their
    support the counts of the masks that contain them.
    """
    if most_nodes > MOST_NODES:
        raise ValueError(f"patterns of more than {MOST_NODES} items")
    e = stored(edge_examples.select(F.col(example).alias("example"), "i", "j").na.drop().distinct(), "pattern-edges")
    strong = stored(e.groupBy("i", "j").agg(F.count(F.lit(1)).alias("support")).where(F.col("support") > min_support), "pattern-table")
    held = edge_sets(e, "example", strong).withColumn("all_nodes", F.array_distinct(F.flatten(F.transform("edges", lambda x: F.array(x["i"], x["j"])))))
    step, sets = _roots(stored(held, "pattern-examples")), []
    for n in range(2, most_nodes + 1):
        step = _grown(step)
        sets.append(step.select(F.array_sort("nodes").alias("nodes"), "edges", "n").select("nodes", _mask(n).alias("mask"), "n"))
    counts = [stored(s.groupBy("nodes", "mask").agg(F.sum("n").alias("n")), "pattern-masks") for s in sets]
    found = [_closed(c, n, min_support, dict(e.dtypes)["i"]) for n, c in enumerate(counts, 2)]
    return reduce(DataFrame.unionByName, [_single_items(e, min_support), *found])


def _roots(held: DataFrame) -> DataFrame:
    """(edges, n, root, nodes, seen, next): each example's sets of one item; what was seen are its items and their neighbours, what comes next those neighbours after the root."""
    root = held.select("edges", "n", F.explode("all_nodes").alias("root")).withColumn("_near", neighbours(F.col("edges"), F.col("root")))
    return root.select("edges", "n", "root", F.array("root").alias("nodes"), F.concat(F.array("root"), "_near").alias("seen"), F.filter("_near", lambda x: x > F.col("root")).alias("next"))


def _grown(step: DataFrame) -> DataFrame:
    """The sets with one item more. A set is made once: from its least item, by neighbours that come after the one taken or that only the one taken has."""
    taken = step.select("*", F.posexplode("next").alias("_at", "_node")).withColumn("_near", neighbours(F.col("edges"), F.col("_node")))
    new = F.filter(F.array_except("_near", "seen"), lambda x: x > F.col("root"))
    left = F.slice("next", F.col("_at") + 2, F.size("next"))
    return taken.select("edges", "n", "root", F.concat("nodes", F.array("_node")).alias("nodes"), F.array_union("seen", "_near").alias("seen"), F.concat(left, new).alias("next"))


def _mask(n: int) -> Column:
    """Which pairs of the ``n`` sorted nodes are edges, as bits in the order of the pairs."""
    has = lambda p, q: F.exists("edges", lambda x: (x["i"] == F.get("nodes", F.lit(p))) & (x["j"] == F.get("nodes", F.lit(q))))
    bits = [F.when(has(p, q), F.lit(1 << b)).otherwise(F.lit(0)).cast("long") for b, (p, q) in enumerate(combinations(range(n), 2))]
    return reduce(Column.__add__, bits)


def closed_masks(counts: dict[int, int], n: int, min_support: int) -> list[tuple[int, int]]:
    """(mask, support): the intersections of the masks that connect all ``n`` nodes, in more than ``min_support`` examples."""
    pairs, closed = list(combinations(range(n), 2)), set()
    for had in counts:
        closed |= {had & c for c in closed} | {had}

    def connects(mask: int) -> bool:
        reached = {0}
        for _ in range(n):
            reached |= {x for b, p in enumerate(pairs) if mask >> b & 1 and reached & set(p) for x in p}
        return len(reached) == n

    support = {c: sum(k for had, k in counts.items() if had & c == c) for c in sorted(closed)}
    return [(c, k) for c, k in support.items() if k > min_support and connects(c)]


def _closed(counts: DataFrame, n: int, min_support: int, kind: str) -> DataFrame:
    """The closed patterns of all sets of ``n`` items; the masks of a set are one row."""

    def run(masks: pd.Series, sizes: pd.Series) -> pd.Series:
        return pd.Series([[{"mask": m, "support": k} for m, k in closed_masks(dict(zip(ms.tolist(), ks.tolist(), strict=True)), n, min_support)] for ms, ks in zip(masks, sizes, strict=True)], dtype=object)

    closed = F.pandas_udf(run, "array<struct<mask:long,support:long>>")
    rows = spread(counts, "nodes").groupBy("nodes").agg(F.collect_list(F.struct("mask", "n")).alias("_m"))
    # A set's support is at most its examples.
    rows = rows.where(F.aggregate("_m", F.lit(0).cast("long"), lambda s, m: s + m["n"]) > min_support)
    each = rows.select("nodes", F.explode(closed(F.col("_m.mask"), F.col("_m.n"))).alias("_p"))
    ends = F.array(*[F.struct(F.lit(1 << b).cast("long").alias("bit"), F.lit(p).alias("p"), F.lit(q).alias("q")) for b, (p, q) in enumerate(combinations(range(n), 2))])
    edges = F.transform(F.filter(ends, lambda x: F.col("_p.mask").bitwiseAND(x["bit"]) != 0), lambda x: F.struct(F.get("nodes", x["p"]).alias("i"), F.get("nodes", x["q"]).alias("j")))
    return each.select(F.size("nodes").alias("n_nodes"), edges.cast(f"array<struct<i:{kind},j:{kind}>>").alias("edges"), "nodes", F.col("_p.support").alias("support")).select("n_nodes", F.size("edges").alias("n_edges"), "nodes", "edges", "support")


def _single_items(e: DataFrame, min_support: int) -> DataFrame:
    kind = dict(e.dtypes)["i"]
    held = spread(e.select("example", F.explode(F.array("i", "j")).alias("node")), "example").distinct().groupBy("node").agg(F.count(F.lit(1)).alias("support"))
    none = F.array().cast(f"array<struct<i:{kind},j:{kind}>>")
    return held.where(F.col("support") > min_support).select(F.lit(1).alias("n_nodes"), F.lit(0).alias("n_edges"), F.array("node").alias("nodes"), none.alias("edges"), "support")
