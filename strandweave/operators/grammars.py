"""Grammars: weights on motifs and on pairs of motifs, and what simulations of them show."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def grammar_scores(features: DataFrame, pointwise: DataFrame, pairwise: DataFrame, example: str, motif: str, value: str) -> DataFrame:
    """(example, grammar, score): sum of weight * value over motifs plus sum of weight * value_i * value_j over ordered pairs.

    ``features`` are sparse; ``pointwise`` (grammar, motif, weight) and ``pairwise``
    (grammar, i, j, weight) are dimension tables. Examples without any of a grammar's
    motifs have no row for it.
    """
    x = features.select(example, motif, value)
    single = x.join(pointwise, motif).select(example, "grammar", (F.col("weight") * F.col(value)).alias("_s"))
    first = x.withColumnsRenamed({motif: "i", value: "_xi"}).join(pairwise, "i")
    double = first.join(x.withColumnsRenamed({motif: "j", value: "_xj"}), [example, "j"]).select(example, "grammar", (F.col("weight") * F.col("_xi") * F.col("_xj")).alias("_s"))
    return single.unionByName(double).groupBy(example, "grammar").agg(F.sum("_s").alias("score"))


def simulation_effects(scores: DataFrame, design: list[str], sample: str, embedded: str, value: str) -> DataFrame:
    """(design, effect, n): mean over samples of the score with the motifs less that of the same background without. ``embedded`` is a boolean column."""
    wide = scores.groupBy(*design, sample).agg(F.max(F.when(F.col(embedded), F.col(value))).alias("_with"), F.max(F.when(~F.col(embedded), F.col(value))).alias("_without"))
    return wide.groupBy(*design).agg(F.avg(F.col("_with") - F.col("_without")).alias("effect"), F.count(F.lit(1)).alias("n"))


def paired_effects(rows: DataFrame, design: list[str], embedded: str, background: str) -> DataFrame:
    """The same where each row holds both scores of a sample: nothing is shuffled but sums by design."""
    return rows.groupBy(*design).agg(F.avg(F.col(embedded) - F.col(background)).alias("effect"), F.count(F.lit(1)).alias("n"))


def directed_edges(deltas: DataFrame, example: str, driver: str, responder: str, value: str, min_examples: int) -> DataFrame:
    """(driver, responder, n_examples, delta): what mutating the driver does to the responder, over examples in which it does anything; no loops."""
    changed = deltas.where((F.col(value) != 0) & (F.col(driver) != F.col(responder)))
    edges = changed.groupBy(driver, responder).agg(F.count_distinct(example).alias("n_examples"), F.avg(value).alias("delta"))
    return edges.where(F.col("n_examples") > min_examples)
