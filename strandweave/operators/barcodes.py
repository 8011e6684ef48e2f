"""Codes that keep their distance: near pairs by pigeonhole segments, and a greedy choice in rounds."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sequences as fx
from ..sources.shared import stored


def segment_bounds(length: int, distance: int) -> list[tuple[int, int]]:
    """(start from 0, size) of as many segments as the distance, as even as can be."""
    if distance > length:
        raise ValueError(f"codes of {length} places can't be {distance} apart")
    cuts = [length * i // distance for i in range(distance + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def segment_size(n_codes: int, spare: int = 2) -> int:
    """Bases a segment so that about 4 ** ``spare`` of ``n_codes`` random codes share one."""
    return max(3, math.ceil(math.log(max(n_codes, 1), 4)) - spare)


def near_pairs(codes: DataFrame, number: str, code: str, length: int, distance: int) -> DataFrame:
    """(low, high): numbers of codes of one length that differ in fewer than ``distance`` places, the lower first; equal codes too.

    Codes that differ in fewer than ``distance`` places agree in one of as many segments at least, so
    segments are join keys and no code meets one that it shares no segment with. A pair comes
    from the first segment that it shares. Codes of another length and null ones are left out; ``number`` must be unique.
    """
    bounds = segment_bounds(length, distance)
    parts = F.array(*[F.struct(F.lit(i).alias("part"), F.substring(code, a + 1, size).alias("bases")) for i, (a, size) in enumerate(bounds)])
    rows = codes.where(F.length(code) == length).select(F.col(number).alias("n"), F.col(code).alias("c"), F.explode(parts).alias("s")).select("n", "c", "s.*")
    a, b = (rows.select(F.col("n").alias(f"{x}_n"), F.col("c").alias(f"{x}_c"), "part", "bases") for x in "ab")

    def agree(i: int) -> Column:
        start, size = bounds[i]
        return F.substring("a_c", start + 1, size) == F.substring("b_c", start + 1, size)

    first = reduce(lambda ok, i: ok & ((F.col("part") <= i) | ~agree(i)), range(distance - 1), F.lit(True))
    met = a.join(b, ["part", "bases"]).where((F.col("a_n") < F.col("b_n")) & first)
    return met.where(fx.hamming(F.col("a_c"), F.col("b_c")) < distance).select(F.col("a_n").alias("low"), F.col("b_n").alias("high"))


def greedy_rejects(pairs: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """(number): what the greedy choice in order of numbers leaves out, because a lower number near it was chosen.

    In each round the codes that have no lower code near them any more are chosen and those
    near them go. A round is a table in the shared folder; rounds are as many as the longest
    run of codes that wait for one another.
    """
    left, gone = stored(pairs, "near-codes"), []
    for _ in range(most_rounds):
        if not left.head(1):
            return reduce(DataFrame.unionByName, gone) if gone else left.select(F.col("high").alias("number"))
        free = left.select("low").distinct().join(left.select(F.col("high").alias("low")), "low", "left_anti")
        rejected = stored(left.join(free, "low", "left_semi").select(F.col("high").alias("number")).distinct(), "near-codes")
        gone.append(rejected)
        rest = left.join(rejected.withColumnRenamed("number", "high"), "high", "left_anti")
        left = stored(rest.join(rejected.withColumnRenamed("number", "low"), "low", "left_anti").select("low", "high"), "near-codes")
    raise RuntimeError("the choice of codes did not settle")


def distant_codes(codes: DataFrame, number: str, code: str, length: int, distance: int) -> DataFrame:
    """The codes (columns kept) that the greedy choice in order of numbers keeps: any two of them differ in at least ``distance`` places."""
    rejects = greedy_rejects(near_pairs(codes, number, code, length, distance)).withColumnRenamed("number", number)
    return codes.where(F.length(code) == length).join(rejects, number, "left_anti")
