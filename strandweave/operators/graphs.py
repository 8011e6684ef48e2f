"""Co-occurrence graphs and patterns as node and edge tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import spread, stored
from .stats import add_fisher


def nodes(presence: DataFrame, example: str, item: str) -> DataFrame:
    """(item, n_examples): support of each item over distinct examples."""
    return presence.select(example, item).distinct().groupBy(item).agg(F.count(F.lit(1)).alias("n_examples"))


def pairs(presence: DataFrame, example: str, item: str) -> DataFrame:
    """(example, i, j) with i < j: two items in one example.

    An example of n items has n (n - 1) / 2 pairs, which is what is asked for; the
    items are a vocabulary of some hundreds, so that is bounded for any example.
    """
    items = spread(presence.select(example, item).where(F.col(example).isNotNull() & F.col(item).isNotNull()), example).groupBy(example).agg(F.array_sort(F.collect_set(item)).alias("_items"))
    first = items.select(example, "_items", F.posexplode("_items").alias("_at", "i"))
    return first.select(example, "i", F.explode(F.slice("_items", F.col("_at") + 2, F.size("_items"))).alias("j"))


def edge_sets(e: DataFrame, example: str, strong: DataFrame) -> DataFrame:
    """(edges, n): the sets of edges (i, j), of those in ``strong``, that examples have, as sorted arrays, and how many examples have each. A set has as many edges as its example pairs of items at most."""
    kept = e.join(strong.select("i", "j"), ["i", "j"]).where(F.col(example).isNotNull())
    held = spread(kept.select(example, "i", "j"), example).groupBy(example).agg(F.array_sort(F.collect_set(F.struct("i", "j"))).alias("edges"))
    return spread(held.select("edges"), "edges").groupBy("edges").agg(F.count(F.lit(1)).alias("n"))


def neighbours(edges: Column, node: Column) -> Column:
    """The other ends of the edges (an array of i, j) at a node."""
    return F.transform(F.filter(edges, lambda x: (x["i"] == node) | (x["j"] == node)), lambda x: F.when(x["i"] == node, x["j"]).otherwise(x["i"]))


def cooccurrence(presence: DataFrame, example: str, item: str, min_examples: int = 0, max_p: float | None = None) -> DataFrame:
    """Edges (i, j) with the number of shared examples, expected number under independence, odds ratio and two-sided exact p."""
    n = nodes(presence, example, item)
    total = presence.select(example).distinct().agg(F.count(F.lit(1)).alias("total"))
    edges = pairs(presence, example, item).groupBy("i", "j").agg(F.count(F.lit(1)).alias("both")).where(F.col("both") > min_examples)
    joined = edges.join(n.toDF("i", "n_i"), "i").join(n.toDF("j", "n_j"), "j").crossJoin(F.broadcast(total))
    table = joined.select("i", "j", "both", (F.col("n_i") - F.col("both")).alias("only_i"), (F.col("n_j") - F.col("both")).alias("only_j"), (F.col("total") - F.col("n_i") - F.col("n_j") + F.col("both")).alias("neither"), (F.col("n_i") * F.col("n_j") / F.col("total")).alias("expected"))
    tested = add_fisher(table, "both", "only_i", "only_j", "neither")
    return tested if max_p is None else tested.where(F.col("p") < max_p)


def chains(edge_examples: DataFrame, example: str, min_support: int) -> DataFrame:
    """Connected patterns of three items, a - b - c through two edges, with the number of examples that hold both edges.

    Edges below the support are dropped before they are joined (no pattern has more
    support than its edges).
    """
    distinct = edge_examples.select(example, "i", "j").distinct()
    support = distinct.groupBy("i", "j").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_support).select("i", "j")
    edges = distinct.join(support, ["i", "j"])
    both = edges.select(example, F.col("i").alias("a"), F.col("j").alias("b")).unionByName(edges.select(example, F.col("j").alias("a"), F.col("i").alias("b")))
    other = both.withColumnRenamed("a", "c")
    found = both.join(other, [example, "b"]).where("a < c")
    return found.groupBy("a", "b", "c").agg(F.count(F.lit(1)).alias("support")).where(F.col("support") >= min_support)  # an example has each pattern once


def patterns(edge_examples: DataFrame, example: str, min_support: int) -> DataFrame:
    """Connected patterns of up to three items: (kind, a, b, c, support), kind being node, edge, chain (a - b - c, a < c) or triangle.

    ``edge_examples`` (example, i, j) with i < j. An example supports a pattern if it has
    all its edges; patterns need more than ``min_support``. A chain whose ends are
    joined by an edge of the graph counts beside its triangle only if it has other examples.
    """
    e = stored(edge_examples.select(example, "i", "j").distinct(), "edges")
    edges = stored(e.groupBy("i", "j").agg(F.count(F.lit(1)).alias("support")).where(F.col("support") > min_support), "edge-support")
    none = F.lit(None).cast(dict(e.dtypes)["i"])
    ends = spread(e.select(example, F.explode(F.array("i", "j")).alias("a")), example).distinct()
    of_node = ends.groupBy("a").agg(F.count(F.lit(1)).alias("support")).where(F.col("support") > min_support).select(F.lit("node").alias("kind"), "a", none.alias("b"), none.alias("c"), "support")
    of_edge = edges.select(F.lit("edge").alias("kind"), F.col("i").alias("a"), F.col("j").alias("b"), none.alias("c"), "support")
    # No pattern has more support than its edges. What examples hold is read off their arrays of edges: a chain's ends are joined or not.
    held = edge_sets(e, example, edges)
    turned = F.explode(F.flatten(F.transform("edges", lambda x: F.array(F.struct(x["i"].alias("a"), x["j"].alias("b")), F.struct(x["j"].alias("a"), x["i"].alias("b"))))))
    at = held.select("edges", "n", turned.alias("_x")).select("n", "_x.a", "_x.b", neighbours(F.col("edges"), F.col("_x.b")).alias("_c"), neighbours(F.col("edges"), F.col("_x.a")).alias("_near"))
    found = at.select("n", "a", "b", F.explode(F.filter("_c", lambda c: c > F.col("a"))).alias("c"), "_near").select("n", "a", "b", "c", F.array_contains("_near", F.col("c")).alias("_joined"))
    counts = found.groupBy("a", "b", "c").agg(F.sum("n").alias("support"), F.sum(F.when(F.col("_joined"), F.col("n")).otherwise(0)).alias("_full")).where(F.col("support") > min_support)
    counts = stored(counts, "chains")
    of_chain = counts.where("_full <> support").select(F.lit("chain").alias("kind"), "a", "b", "c", "support")
    triangles = counts.where((F.col("a") < F.col("b")) & (F.col("b") < F.col("c")) & (F.col("_full") > min_support))
    of_triangle = triangles.select(F.lit("triangle").alias("kind"), "a", "b", "c", F.col("_full").alias("support"))
    return reduce(DataFrame.unionByName, [of_node, of_edge, of_chain, of_triangle])


def merge_graphs(graphs: list[DataFrame], keys: list[str], count: str, mean: str) -> DataFrame:
    """Union of node or edge tables: counts added, means weighed by them."""
    whole = graphs[0]
    for g in graphs[1:]:
        whole = whole.unionByName(g, allowMissingColumns=True)
    return whole.groupBy(*keys).agg(F.sum(count).alias(count), F.try_divide(F.sum(F.col(count) * F.col(mean)), F.sum(count)).alias(mean), F.count(F.lit(1)).alias("n_graphs"))


def adjacency(counts: DataFrame, i: str, j: str, n: str) -> DataFrame:
    """Both directions of pair totals."""
    flat = counts.select(F.col(i).alias("a"), F.col(j).alias("b"), n)
    return flat.unionByName(flat.select(F.col("b").alias("a"), F.col("a").alias("b"), n)).groupBy("a", "b").agg(F.sum(n).alias(n))


def in_every_run(rows: DataFrame, key: str, run: str) -> DataFrame:
    """Keys that occur in all runs."""
    runs = rows.agg(F.count_distinct(run).alias("_runs"))
    return rows.groupBy(key).agg(F.count_distinct(run).alias("_n")).crossJoin(F.broadcast(runs)).where("_n = _runs").select(key)
