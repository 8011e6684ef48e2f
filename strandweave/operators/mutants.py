"""Mutants of motif sites: where to mutate, what to put there, and what to mask.

Sites are rows (example, motif, pos, present). Windows of width w around a position c
cover c - w//2 .. c + (w-1)//2. Positions up to ``EDGE`` are never mutated.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scores import dilate

EDGE = 10


def strongest_nearby(sites: DataFrame, importances: DataFrame, keys: list[str], example: str, width: int = 10) -> DataFrame:
    """Sites moved to the position of the greatest importance above 0 (of equals the lowest) in the window around them; a window without any leaves its site in place.

    ``sites``: keys (example and motif), pos, present; ``importances``: example, pos, value.
    """
    near = sites.select(*keys, F.col("pos").alias("_site"), F.explode(F.sequence(F.col("pos") - width // 2, F.col("pos") + (width - 1) // 2)).alias("pos"))
    best = F.max(F.struct("value", (-F.col("pos")).alias("minus")))
    moved = near.join(importances.where("value > 0"), [example, "pos"]).groupBy(*keys, "_site").agg(best.alias("_b"))
    return sites.join(moved.withColumnRenamed("_site", "pos"), [*keys, "pos"], "left").withColumn("pos", F.coalesce(-F.col("_b.minus"), "pos")).drop("_b")


def strongest_in(sites: DataFrame, importance: Callable[[Column], Column], length: str, width: int = 10) -> DataFrame:
    """The same where a row tells the importance at a position (from an array or by rule) and its sequence's length: positions are never rows."""
    last = F.least(F.col("pos") + (width - 1) // 2, F.col(length) - 1)
    places = F.sequence(F.greatest(F.col("pos") - width // 2, F.lit(0)), F.greatest(last, F.lit(0)))
    window = F.transform(places, lambda p: F.struct(importance(p).alias("value"), (-p).alias("minus")))
    best = F.array_max(F.filter(window, lambda x: (x["value"] > 0) & (-x["minus"] < F.col(length))))
    return sites.withColumn("pos", F.coalesce(-best["minus"], F.col("pos")))


def importance_in(importance: Callable[[Column], Column], position: Column, length: Column) -> Column:
    """The importance at a position of the row's sequence, 0 where there is none."""
    return F.coalesce(F.when((position >= 0) & (position < length), importance(position)), F.lit(0))


def mutable(sites: DataFrame) -> DataFrame:
    """Sites that are there and not at the edge."""
    return sites.where(F.col("present") & (F.col("pos") > EDGE))


def _written(seq: Column, changes: Column) -> Column:
    """The sequence with each change (pos, base) written over it."""
    return F.aggregate(changes, seq, lambda acc, c: F.overlay(acc, c["base"], (c["pos"] + 1).cast("int")))


def point_mutants(seqs: DataFrame, sites: DataFrame, replacements: DataFrame, example: str, motif: str, seq: str) -> DataFrame:
    """(example, motif, seq) for each motif of ``sites``: the bases at its mutable sites replaced by those of ``replacements`` (example, pos, base); unchanged where there is none."""
    changes = mutable(sites).select(example, motif, "pos").distinct().join(replacements, [example, "pos"])
    listed = changes.groupBy(example, motif).agg(F.array_sort(F.collect_list(F.struct("pos", "base"))).alias("_c"))  # as many as a motif has sites
    return _applied(seqs, sites, listed, example, motif, seq)


def _applied(seqs: DataFrame, sites: DataFrame, changes: DataFrame, example: str, motif: str, seq: str) -> DataFrame:
    every = sites.select(example, motif).distinct().join(changes, [example, motif], "left").join(seqs.select(example, seq), example)
    return every.select(example, motif, F.when(F.col("_c").isNotNull(), _written(F.col(seq), F.col("_c"))).otherwise(F.col(seq)).alias(seq))


def shuffle_mutants(seqs: DataFrame, sites: DataFrame, example: str, motif: str, seq: str, length: int, seed: str, width: int = 10) -> DataFrame:
    """(example, motif, seq) for each motif: the bases in the windows around its mutable sites put in hashed order, all others unchanged. ``length`` bounds positions."""
    inside = dilate(mutable(sites), [example, motif], "pos", width, length)
    hashed = F.md5(F.concat_ws(":", F.col(example).cast("string"), F.col(motif).cast("string"), F.col("pos").cast("string"), F.lit(seed)))
    listed = inside.join(seqs.select(example, F.length(seq).alias("_n")), example).where("pos < _n").groupBy(example, motif).agg(
        F.array_sort(F.collect_list("pos")).alias("_to"), F.array_sort(F.collect_list(F.struct(hashed.alias("order"), "pos"))).alias("_from")
    )
    with_seq = listed.join(seqs.select(example, seq), example)
    base = lambda p: F.substring(F.col(seq), (p + 1).cast("int"), F.lit(1))
    changes = F.zip_with("_to", "_from", lambda to, of: F.struct(to.alias("pos"), base(of["pos"]).alias("base")))
    return _applied(seqs, sites, with_seq.select(example, motif, changes.alias("_c")), example, motif, seq)


def blanking_masks(sites: DataFrame, keys: list[str], length: int, width: int = 14) -> DataFrame:
    """(keys, pos): the positions around mutable sites that scoring leaves out."""
    return dilate(mutable(sites), keys, "pos", width, length)


def importance_at(variants: DataFrame, importances: DataFrame, example: str, position: str, value: str) -> DataFrame:
    """Variants with the importance at their position, 0 where there is none."""
    at = importances.select(example, F.col("pos").alias(position), F.col("value").alias(value))
    return variants.join(at, [example, position], "left").withColumn(value, F.coalesce(value, F.lit(0)))
