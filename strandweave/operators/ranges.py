"""Ranks, numbers and percentiles of large groups, by ranges of values: no group has to fit into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored

#: Into how many ranges of values a group is cut, so that one large group spreads over many tasks.
RANGES = 32


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys meet; the columns of ``left``, then the others of ``right``."""
    other = right.select(*[F.col(k).alias(f"_key_{k}") if k in keys else F.col(k) for k in right.columns])
    met = F.lit(True)
    for k in keys:
        met = met & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    return left.join(other, met, how).drop(*[f"_key_{k}" for k in keys])


def with_ranges(df: DataFrame, keys: list[str], value: str, ranges: int = RANGES) -> DataFrame:
    """Add ``_range``: which of the group's value ranges (cut at approximate quantiles) a row lies in. Equal values share a range; null keys are a group, null values lie in the first range.

    The cuts are stored: where they fall depends on the order in which tasks end, and
    all branches of a plan must have the same.
    """
    shares = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    cuts = df.groupBy(*keys).agg(F.percentile_approx(value, shares).alias("_cuts"))
    return null_safe_join(df, stored(cuts, "cuts"), keys).withColumn("_range", F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col(value))), F.lit(0))).drop("_cuts")


def with_ranks(df: DataFrame, keys: list[str], value: str, tie: list[str] | None = None, average: str | None = None, ordinal: str | None = None) -> DataFrame:
    """Add ranks from 1 within each group: ``average`` (equal values share their mean rank) and ``ordinal`` (ties by ``tie``).

    A group is ranked range by range; the ranks before a range are a sum over at most
    RANGES rows, so no group has to fit into one task. Average ranks are those of the
    distinct values, counted on the map side and joined back. Null keys are a group;
    without keys the table is one.
    """
    if not keys:
        return with_ranks(df.withColumn("_all", F.lit(0)), ["_all"], value, tie, average, ordinal).drop("_all")
    out = df
    if average:
        counts = _with_offsets(df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n")), keys, value, F.sum("_n"))
        lower = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        ranked = counts.select(*keys, value, (F.col("_before") + lower + (F.col("_n") + 1) / 2).alias(average))
        out = null_safe_join(out, ranked, [*keys, value])
    if ordinal:
        inside = Window.partitionBy(*keys, "_range").orderBy(value, *(tie or []))
        out = _with_offsets(out, keys, value, F.count(F.lit(1))).withColumn(ordinal, F.col("_before") + F.row_number().over(inside)).drop("_range", "_before")
    return out


def _with_offsets(df: DataFrame, keys: list[str], value: str, size: Column) -> DataFrame:
    """Add ``_range`` and ``_before``: what the group's ranges before it add up to in ``size``."""
    rows = with_ranges(df, keys, value)
    sizes = rows.groupBy(*keys, "_range").agg(size.alias("_size"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0))).drop("_size")
    return null_safe_join(rows, offsets, [*keys, "_range"])


def at_ranks(df: DataFrame, keys: list[str], value: str, wanted: DataFrame) -> DataFrame:
    """(keys, _r, value): the values at the wanted ranks (keys, _r: distinct, from 1) of each group; none where a group has fewer rows.

    The ranges of a group are counted, and only those that hold a wanted rank are sorted.
    """
    rows = with_ranges(df.select(*keys, value), keys, value)
    sizes = rows.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_size"))
    upto = F.sum("_size").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ends = sizes.withColumn("_upto", upto).withColumn("_before", F.col("_upto") - F.col("_size"))
    needed = null_safe_join(wanted, ends, keys).where((F.col("_r") > F.col("_before")) & (F.col("_r") <= F.col("_upto"))).select(*keys, "_range", "_r", "_before")
    ranges = needed.select(*keys, "_range").distinct()
    inside = null_safe_join(rows, ranges, [*keys, "_range"]).withColumn("_place", F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(value)).cast("long"))
    places = needed.withColumn("_place", F.col("_r") - F.col("_before")).select(*keys, "_range", "_place", "_r")
    return null_safe_join(inside, places, [*keys, "_range", "_place"]).select(*keys, "_r", value)


def percentiles(df: DataFrame, keys: list[str], value: str | Column, shares: list[float], name: str = "percentiles") -> DataFrame:
    """(keys, ``name``: array): exact percentiles of each group's values, interpolated between neighbours; null values don't count.

    Only the rows at the wanted ranks are brought together.
    """
    x = F.col(value) if isinstance(value, str) else value
    grouped = keys or ["_all"]
    rows = df.withColumn("_all", F.lit(0)).select(*grouped, x.cast("double").alias("_x")).where("_x IS NOT NULL")
    wanted = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(s)).alias("share")) for i, s in enumerate(shares)]))
    places = rows.groupBy(*grouped).agg(F.count(F.lit(1)).alias("_n")).withColumn("_w", wanted).withColumn("_at", F.col("_w.share") * (F.col("_n") - 1))
    places = places.withColumn("_up", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("_r", (F.floor("_at") + F.col("_up") + 1).cast("long"))
    weight = F.when(F.col("_up") == 1, F.col("_at") - F.floor("_at")).otherwise(1 - F.col("_at") + F.floor("_at"))
    found = at_ranks(rows, grouped, "_x", places.select(*grouped, "_r").distinct())
    met = null_safe_join(found, places.select(*grouped, "_r", F.col("_w.i").alias("_i"), weight.alias("_weight")), [*grouped, "_r"])
    each = met.groupBy(*grouped, "_i").agg(F.sum(F.col("_x") * F.col("_weight")).alias("_v"))
    out = each.groupBy(*grouped).agg(F.array_sort(F.collect_list(F.struct("_i", "_v"))).alias("_a"))  # as many entries as shares
    return out.select(*keys, F.col("_a._v").alias(name))


def kth_greatest(df: DataFrame, keys: list[str], value: str, k: DataFrame, name: str) -> DataFrame:
    """(keys, ``name``): the k-th greatest value of each group, k from ``k`` (keys, k); 0 where k exceeds the group's rows."""
    wanted = k.select(*keys, F.col("k").cast("long").alias("_r")).distinct()
    found = at_ranks(df.select(*keys, (-F.col(value)).alias("_v")), keys, "_v", wanted).select(*keys, (-F.col("_v")).alias(name))
    return null_safe_join(k.select(*keys), found, keys, "left").withColumn(name, F.coalesce(name, F.lit(0.0)))
