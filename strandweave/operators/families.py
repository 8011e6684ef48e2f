"""Families of motifs (or other items of a dimension): Ward's agglomeration over a table of distances, in rounds.

In a round all pairs that are each other's nearest merge at once. For linkages that don't
bring clusters nearer by merging others, Ward's among them, that gives the merges of the plain
loop that takes the nearest pair each time, in some log n rounds of joins and sums.
A cluster is named by its least member.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import stored
from .motifs import Pwm, best_alignment


def similarities(spark: SparkSession, pwms: list[Pwm], least_overlap: int = 3) -> DataFrame:
    """(a, b, r) for all pairs a < b of motifs (numbers in the list): the best correlation over offsets, weighed by the overlap's share of the shorter one.

    The motifs are a dimension that each task gets; their pairs, which grow with its square, are dealt out.
    """
    held = spark.sparkContext.broadcast(pwms)

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(r=[best_alignment(held.value[a], held.value[b], least_overlap)[0] for a, b in zip(pdf["a"], pdf["b"], strict=True)])

    n = len(pwms)
    pairs = spark.range(max(0, n - 1)).select(F.col("id").alias("a"), F.explode(F.sequence(F.col("id") + 1, F.lit(n - 1).cast("long"))).alias("b"))
    return pairs.repartition(max(1, n * n // 20_000), "a", "b").mapInPandas(align, "a long, b long, r double")


def _both(pairs: DataFrame) -> DataFrame:
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "d"))


def _merged_side(rows: DataFrame, sizes: DataFrame, other_sizes: DataFrame, merges: DataFrame) -> DataFrame:
    """(a, b, d) with merged clusters for the first side, by the update of Lance and Williams; ``sizes`` (cluster, n) are those of the first side before, ``other_sizes`` those of the second."""
    to = merges.select(F.col("right").alias("a"), F.col("left").alias("to"))
    named = rows.join(to, "a", "left").withColumn("to", F.coalesce("to", "a")).join(sizes.toDF("a", "n_a"), "a").join(other_sizes.toDF("b", "n_b"), "b")
    sums = named.groupBy("to", "b").agg(
        F.sum((F.col("n_a") + F.col("n_b")) * F.col("d")).alias("s"), F.sum("n_a").alias("n"), F.first("n_b").alias("n_b"), F.count(F.lit(1)).alias("k"), F.first("d").alias("d")
    )
    inner = merges.select(F.col("left").alias("to"), F.col("d").alias("between"))
    updated = (F.col("s") - F.col("n_b") * F.coalesce("between", F.lit(0.0))) / (F.col("n") + F.col("n_b"))
    return sums.join(inner, "to", "left").select(F.col("to").alias("a"), "b", F.when(F.col("k") == 1, F.col("d")).otherwise(updated).alias("d"))


def agglomerated(pairs: DataFrame, items: DataFrame, item: str, until: float | None = None, most_rounds: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """Ward's merges of all items, and the order of leaves.

    ``pairs`` (a < b, d): squared distances of all pairs of ``items``. Returns (round, left,
    right, d, n_left, n_right), a row a merge, and (item, cluster, place): the last cluster of each
    item and its place in it, where the left side (that with the least member) of a merge
    comes first. With ``until`` no pair further apart merges. Of equally near clusters the one
    with the lesser name is taken. One item has no merge; no items give no rows.
    """
    now = stored(pairs.select("a", "b", F.col("d").cast("double").alias("d")), "distances")
    leaves = stored(items.select(F.col(item).alias("item"), F.col(item).alias("cluster"), F.lit(0).cast("long").alias("place")).distinct(), "leaves")
    sizes = _sizes(leaves)
    spark, done, schema = pairs.sparkSession, [], None
    for k in range(1, most_rounds):
        nearest = _both(now).groupBy("a").agg(F.min(F.struct("d", "b")).alias("m")).select("a", F.col("m.b").alias("b"), F.col("m.d").alias("d"))
        back = nearest.select(F.col("b").alias("a"), F.col("a").alias("b"))
        met = nearest.where("a < b").join(back, ["a", "b"])
        if until is not None:
            met = met.where(F.col("d") <= until)
        met = met.join(sizes.toDF("a", "n_left"), "a").join(sizes.toDF("b", "n_right"), "b")
        merges = stored(met.select(F.lit(k).alias("round"), F.col("a").alias("left"), F.col("b").alias("right"), "d", "n_left", "n_right"), "merges")
        schema = merges.schema
        if not merges.head(1):
            break
        done.append(merges)
        gone = merges.select(F.col("left").alias("a"), F.col("right").alias("b"))
        inside = gone.unionByName(gone.select(F.col("b").alias("a"), F.col("a").alias("b")))
        one = _merged_side(_both(now).join(inside, ["a", "b"], "left_anti"), sizes, sizes, merges)
        leaves = stored(_placed(leaves, merges), "leaves")
        new = _sizes(leaves)
        # Then the second side, whose partners have their new sizes already.
        two = _merged_side(one.select(F.col("b").alias("a"), F.col("a").alias("b"), "d"), sizes, new, merges)
        now = stored(two.where("a < b"), "distances")
        sizes = new
    else:
        raise RuntimeError("the agglomeration did not settle")
    out = spark.createDataFrame([], schema)
    for merges in done:
        out = out.unionByName(merges)
    return out, leaves


def _sizes(leaves: DataFrame) -> DataFrame:
    return leaves.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


def _placed(leaves: DataFrame, merges: DataFrame) -> DataFrame:
    into = merges.select(F.col("right").alias("cluster"), "left", "n_left")
    moved = leaves.join(into, "cluster", "left")
    return moved.select("item", F.coalesce("left", "cluster").alias("cluster"), (F.col("place") + F.coalesce("n_left", F.lit(0))).alias("place"))


def strongest_of_families(merges: DataFrame, like: DataFrame, signal: DataFrame) -> DataFrame:
    """(item): what stays when families are reduced along the merges, strongest first.

    A cluster stands for one item until it meets a cluster that it isn't like: of two
    representatives in ``like`` (a < b, those alike) the one of the greater signal stands for both (the
    left one of equals), of others both stay, and no cluster above stands for anything.
    ``signal`` has (item, signal) of all items.
    """
    stands = stored(signal.select(F.col("item").alias("cluster"), F.col("item").alias("rep"), "signal"), "stands")
    kept: list[DataFrame] = []
    for k in range(1, (merges.agg(F.max("round")).first()[0] or 0) + 1):
        here = merges.where(F.col("round") == k).select("left", "right")
        sides = [stands.select(F.col("cluster").alias(s), F.struct("signal", F.col("rep").alias("item")).alias(f"{s}_of")) for s in ("left", "right")]
        met = here.join(sides[0], "left").join(sides[1], "right")
        pair = [F.least("left_of.item", "right_of.item"), F.greatest("left_of.item", "right_of.item")]
        known = like.select(F.col("a").alias("p"), F.col("b").alias("q"), F.lit(True).alias("alike"))
        met = stored(met.withColumn("p", pair[0]).withColumn("q", pair[1]).join(known, ["p", "q"], "left").withColumn("alike", F.coalesce("alike", F.lit(False))), "met")
        kept += [met.where(~F.col("alike")).select(F.col(f"{s}_of.item").alias("item")).where("item IS NOT NULL") for s in ("left", "right")]
        wins = F.when(F.col("alike"), F.when(F.col("right_of.signal") > F.col("left_of.signal"), F.col("right_of")).otherwise(F.col("left_of")))
        risen = met.select(F.col("left").alias("cluster"), wins.alias("w")).select("cluster", F.col("w.item").alias("rep"), F.col("w.signal").alias("signal"))
        touched = met.select(F.explode(F.array("left", "right")).alias("cluster"))
        stands = stored(stands.join(touched, "cluster", "left_anti").unionByName(risen), "stands")
    out = stands.where("rep IS NOT NULL").select(F.col("rep").alias("item"))
    for part in kept:
        out = out.unionByName(part)
    return out.distinct()
