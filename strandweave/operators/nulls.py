"""Many matched null samples in one pass: each background row carries the numbers of the samples that it is in."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import spread, stored
from .ranges import null_safe_join, percentiles, with_ranges, with_ranks
from .stats import bin_of


@functools.cache
def multipliers(n: int) -> list[int]:
    """The ``n`` greatest primes below 2^31, falling. None divides the size of a cell below that, so each steps through all its rows."""
    out, at = [], 2**31 - 1
    while len(out) < n:
        if all(at % k for k in range(3, int(at**0.5) + 1, 2)):
            out.append(at)
        at -= 2
    return out


def _number(*parts: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 13), 16, 10).cast("long")


def matched_nulls(targets: DataFrame, background: DataFrame, item: str, key: str, measures: list[str], bins: int, n_nulls: int) -> DataFrame:
    """(item, key, nulls): background rows with the numbers (from 0) of the null samples of the item that they are in.

    Both tables have item, key and the measures. A cell is a bin of each measure, between quantiles of
    the item's own targets; each null takes from each cell, without replacement, as many background rows as it
    has targets, or all if these are fewer. Rows outside the bins or with a null measure are in no
    sample; rows in none are left out. Targets without background in their cell are matched by nothing.

    A cell's background rows are put in a hashed order once, null k takes those whose
    place r has (p_k * r + offset_k) mod size below the wanted number: a permutation of
    places for each null, so each null by itself is a uniform draw. Rows are never multiplied by the nulls.
    """
    shares = [i / bins for i in range(bins + 1)]
    cut = [f"_bin_{m}" for m in measures]
    names = [f"_edges_{m}" for m in measures]
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(m).cast("double").alias("x")) for i, m in enumerate(measures)])).alias("_each")
    one = percentiles(targets.select(item, each).select(item, F.col("_each.i").alias("_measure"), F.col("_each.x").alias("_v")), [item, "_measure"], "_v", shares, "_edges")
    edges = stored(one.groupBy(item).agg(*[F.max(F.when(F.col("_measure") == i, F.col("_edges"))).alias(n) for i, n in enumerate(names)]), "null-edges")

    def binned(rows: DataFrame) -> DataFrame:
        met = null_safe_join(rows.select(item, key, *measures), edges, [item])
        return met.select(item, key, *[bin_of(F.col(m).cast("double"), F.col(e)).alias(b) for m, e, b in zip(measures, names, cut, strict=True)]).na.drop(subset=cut)

    placed = stored(binned(background), "null-background")
    wanted = binned(targets).groupBy(item, *cut).agg(F.count(F.lit(1)).alias("_wanted"))
    sizes = placed.groupBy(item, *cut).agg(F.count(F.lit(1)).alias("_size"))
    offsets = F.transform(F.sequence(F.lit(0), F.lit(n_nulls - 1)), lambda k: F.pmod(_number(F.col(item), *[F.col(b) for b in cut], k), F.col("_size")))
    cells = stored(null_safe_join(wanted, sizes, [item, *cut]).withColumn("_offsets", offsets), "null-cells")
    ordered = with_ranks(placed.withColumn("_h", _number(F.col(key), F.col(item))), [item, *cut], "_h", [key], ordinal="_r")
    numbered = spread(ordered.select(item, key, *cut, (F.col("_r") - 1).cast("long").alias("_r")), item, key)
    met = null_safe_join(numbered, cells, [item, *cut]).select(item, key, *cut, "_r", "_size", "_wanted", F.posexplode("_offsets").alias("_null", "_offset"))
    step = F.get(F.array(*[F.lit(p) for p in multipliers(n_nulls)]).cast("array<bigint>"), F.col("_null"))
    inside = met.where((step * F.col("_r") + F.col("_offset")) % F.col("_size") < F.col("_wanted"))
    # A row's nulls are in one task already: nothing is shuffled here, unless the cells are too many to be sent to all tasks.
    return inside.groupBy(item, key, *cut, "_r").agg(F.sort_array(F.collect_list("_null")).alias("nulls")).select(item, key, "nulls")


def medians(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, _null, _m): the exact median of each null's values in each group; rows have the keys, the value and ``nulls``, the numbers of the nulls that they are in.

    A group's rows are cut into ranges of values once for all its nulls, and each null's rows in
    each range are counted. Only in the ranges that hold a null's middle ranks is
    a row multiplied by its nulls, so few are: nulls that are drawn alike have medians close together.
    """
    ranged = stored(with_ranges(rows.select(*keys, F.col(value).cast("double").alias("_x"), "nulls").where("_x IS NOT NULL"), keys, "_x"), "null-ranges")
    sizes = ranged.select(*keys, "_range", F.explode("nulls").alias("_null")).groupBy(*keys, "_null", "_range").agg(F.count(F.lit(1)).alias("_size"))
    null = Window.partitionBy(*keys, "_null")
    upto = F.sum("_size").over(null.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ends = sizes.withColumn("_upto", upto).withColumn("_before", F.col("_upto") - F.col("_size")).withColumn("_n", F.sum("_size").over(null))
    middle = [F.floor((F.col("_n") + 1) / 2), F.floor(F.col("_n") / 2) + 1]  # ranks from 1, equal where the number is odd
    holds = [(F.col("_before") < r) & (r <= F.col("_upto")) for r in middle]
    needed = stored(ends.where(holds[0] | holds[1]).select(*keys, "_null", "_range", "_before", "_n"), "null-places")

    wanted = needed.groupBy(*keys, "_range").agg(F.collect_set("_null").alias("_wanted"))  # as many entries as nulls
    met = null_safe_join(ranged, wanted, [*keys, "_range"]).select(*keys, "_range", "_x", F.explode(F.array_intersect("nulls", "_wanted")).alias("_null"))
    counts = met.groupBy(*keys, "_null", "_range", "_x").agg(F.count(F.lit(1)).alias("_size"))
    inside = Window.partitionBy(*keys, "_null", "_range").orderBy("_x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = null_safe_join(counts.withColumn("_in", F.sum("_size").over(inside)), needed, [*keys, "_null", "_range"])
    placed = ranked.withColumn("_upto", F.col("_before") + F.col("_in")).withColumn("_before", F.col("_upto") - F.col("_size"))
    halves = placed.select(*keys, "_null", "_x", F.explode(F.array(*[F.when(h, F.lit(0.5)) for h in holds])).alias("_half")).where("_half IS NOT NULL")
    return halves.groupBy(*keys, "_null").agg(F.sum(F.col("_x") * F.col("_half")).alias("_m"))


def compared(targets: DataFrame, drawn: DataFrame, values: DataFrame, item: str, key: str, measure: str, value: str) -> DataFrame:
    """(item, measure, n, observed, n_nulls, p, null_median): each item's median over its targets, the share of its nulls whose median is at least that, and the median of the nulls' medians.

    ``drawn`` is what ``matched_nulls`` gives, ``values`` (key, measure, value) any number of signals, which are joined once,
    not once a null. Null values don't count; an item without nulls, or a measure without values, has no row.
    """
    seen = targets.select(item, key).join(values, key).where(F.col(value).isNotNull())
    observed = percentiles(seen, [item, measure], value, [0.5], "_m").select(item, measure, F.get("_m", 0).alias("observed"))
    counts = seen.groupBy(item, measure).agg(F.count(F.lit(1)).alias("n"))
    rows = stored(spread(drawn, key).join(spread(values, key), key).select(item, measure, value, "nulls"), "null-values")
    each = medians(rows, [item, measure], value)
    both = null_safe_join(null_safe_join(each, observed, [item, measure]), counts, [item, measure])
    middle = F.percentile("_m", F.lit(0.5))  # of as many values as nulls
    out = both.groupBy(item, measure, "n", "observed").agg(F.count(F.lit(1)).alias("n_nulls"), F.avg((F.col("_m") >= F.col("observed")).cast("double")).alias("p"), middle.alias("null_median"))
    return out.select(item, measure, "n", "observed", "n_nulls", "p", "null_median")
