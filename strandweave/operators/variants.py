"""Variants: alleles on strided windows, differences, annotation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sequences as fx


def windows(variants: DataFrame, length: int, stride: int, n: int) -> DataFrame:
    """Each variant (chrom, pos from 1) on ``n`` windows of ``length`` shifted by ``stride`` around it: start, stop, offset (place of the variant in the window)."""
    shift = F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (i - (n - 1) // 2) * stride))
    rows = variants.withColumn("shift", shift)
    start = F.col("pos") - 1 - length // 2 + F.col("shift")
    return rows.withColumn("start", start).withColumn("stop", start + length).withColumn("offset", F.col("pos") - 1 - F.col("start"))


def tiling_bed(variants: DataFrame, size: int) -> DataFrame:
    return variants.select("chrom", F.greatest(F.col("pos") - size, F.lit(0)).alias("start"), F.col("pos").alias("stop"), "id")


def alleles(rows: DataFrame, seq: str, offset: str) -> DataFrame:
    """Two rows a variant: the sequence with the first base of ref and of alt at the offset."""
    pair = F.explode(F.array(F.struct(F.lit("ref").alias("allele"), F.substring("ref", 1, 1).alias("base")), F.struct(F.lit("alt").alias("allele"), F.substring("alt", 1, 1).alias("base"))))
    return rows.withColumn("_a", pair).withColumn("allele", F.col("_a.allele")).withColumn(seq, fx.splice(F.col(seq), F.col("_a.base"), F.col(offset))).drop("_a")


def paired(scores: DataFrame, keys: list[str], allele: str, value: str) -> DataFrame:
    """ref and alt values side by side, and their difference."""
    wide = scores.groupBy(*keys).pivot(allele, ["ref", "alt"]).agg(F.first(value))
    return wide.withColumn("diff", F.col("alt") - F.col("ref"))


def significant(differences: DataFrame, value: str, sds: float = 2.0, centred: bool = False) -> DataFrame:
    """Rows whose difference is beyond ``sds`` deviations (of 0, or of the mean if centred)."""
    limits = differences.agg(F.stddev_pop(value).alias("_sd"), F.avg(value).alias("_m"))
    middle = F.col("_m") if centred else F.lit(0.0)
    return differences.crossJoin(F.broadcast(limits)).where(F.abs(F.col(value) - middle) > sds * F.col("_sd")).drop("_sd", "_m")
