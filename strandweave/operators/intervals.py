"""Interval algebra on (chrom, start, stop) tables, 0-based and half-open."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import spread, stored

#: Width of the bins that overlap joins use as an equality key: a few times a usual interval.
BIN = 1024
#: Width of the stretches that merging handles on their own.
STRETCH = 1 << 16


def _bins(start: Column, stop: Column, width: int) -> Column:
    return F.explode(F.sequence(F.floor(start / width), F.floor((stop - 1) / width)))


def overlap_join(a: DataFrame, b: DataFrame, bin_width: int = BIN, min_fraction: float = 0.0) -> DataFrame:
    """All pairs of an interval of ``a`` and one of ``b`` on the same chromosome that share a base.

    Columns of a come as ``a_<name>``, those of b as ``b_<name>``, plus ``overlap`` (bases).
    ``min_fraction`` keeps pairs whose overlap is at least that share of a. Both sides
    are cut into bins, joined on (chrom, bin), and a pair is kept only in the bin of
    its first shared base, so no pair appears twice and nothing needs a distinct.
    Empty intervals share no base.
    """
    left = a.where("stop > start").select(*[F.col(c).alias(f"a_{c}") for c in a.columns])
    right = b.where("stop > start").select(*[F.col(c).alias(f"b_{c}") for c in b.columns])
    left = left.withColumn("bin", _bins(F.col("a_start"), F.col("a_stop"), bin_width))
    right = right.withColumn("bin", _bins(F.col("b_start"), F.col("b_stop"), bin_width))
    pairs = left.join(right, (F.col("a_chrom") == F.col("b_chrom")) & (left["bin"] == right["bin"]) & (F.col("a_start") < F.col("b_stop")) & (F.col("b_start") < F.col("a_stop")))
    first = F.greatest("a_start", "b_start")
    overlap = F.least("a_stop", "b_stop") - first
    pairs = pairs.where(left["bin"] == F.floor(first / bin_width)).withColumn("overlap", overlap)
    if min_fraction:
        pairs = pairs.where(F.col("overlap") >= min_fraction * (F.col("a_stop") - F.col("a_start")))
    return pairs.select(*left.columns[:-1], *right.columns[:-1], "overlap")


def count_overlaps(a: DataFrame, b: DataFrame, name: str = "n_overlaps", bin_width: int = BIN, min_fraction: float = 0.0) -> DataFrame:
    """``a`` with the number of overlapping intervals of ``b`` (0 too). Counted once for each distinct interval of a."""
    places = a.select("chrom", "start", "stop").distinct()
    pairs = overlap_join(places, b.select("chrom", "start", "stop"), bin_width, min_fraction)
    counts = pairs.groupBy("a_chrom", "a_start", "a_stop").agg(F.count(F.lit(1)).alias(name)).toDF("chrom", "start", "stop", name)
    return a.join(counts, ["chrom", "start", "stop"], "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("long")).select(*a.columns, name)


def without_overlap(a: DataFrame, b: DataFrame, bin_width: int = BIN) -> DataFrame:
    """Intervals of ``a`` that no interval of ``b`` touches."""
    return count_overlaps(a, b, "_hits", bin_width).where("_hits = 0").drop("_hits")


def superset_negatives(positives: DataFrame, superset: DataFrame, legacy: bool = False) -> DataFrame:
    """Regions of the superset that hold no positive; ``legacy`` swaps the roles."""
    return without_overlap(positives, superset) if legacy else without_overlap(superset, positives)


def slop(a: DataFrame, by: int, sizes: DataFrame | None = None) -> DataFrame:
    """Widen on both sides, clipped at 0 and, with ``sizes`` (chrom, size: one row a chromosome), at the end."""
    out = a.withColumn("start", F.greatest(F.col("start") - by, F.lit(0).cast("long"))).withColumn("stop", F.col("stop") + by)
    if sizes is None:
        return out
    return out.join(sizes, "chrom").withColumn("stop", F.least("stop", "size")).select(*a.columns)


def summits(peaks: DataFrame, offset: str) -> DataFrame:
    """The one base of each peak that its summit offset points to."""
    at = F.col("start") + F.col(offset)
    return peaks.withColumn("stop", at + 1).withColumn("start", at)


def flanks(a: DataFrame, width: int, left: int, right: int) -> DataFrame:
    """``left`` and ``right`` neighbouring windows of the given width; starts are clipped at 0, ends aren't."""
    steps = [(-(i + 1) * width, -i * width, "start") for i in range(left)] + [(i * width, (i + 1) * width, "stop") for i in range(right)]
    windows = F.array(*[F.struct(F.greatest(F.col(at) + lo, F.lit(0).cast("long")).alias("start"), (F.col(at) + hi).alias("stop")) for lo, hi, at in steps])
    rest = [c for c in a.columns if c not in ("start", "stop")]
    return a.select(*rest, F.explode(windows).alias("w")).select(*rest, "w.start", "w.stop").where("stop > start").select(*a.columns)


def tile(a: DataFrame, bin_size: int = 200, stride: int = 50) -> DataFrame:
    """Bins of ``bin_size`` every ``stride`` from the start of each interval, as long as a bin's first half begins inside; ``region`` columns keep the interval."""
    last = F.col("stop") - bin_size // 2 - 1
    rows = a.where(last >= F.col("start")).withColumnRenamed("start", "region_start").withColumnRenamed("stop", "region_stop")
    starts = F.explode(F.sequence(F.col("region_start"), F.col("region_stop") - bin_size // 2 - 1, F.lit(stride).cast("long")))
    return rows.withColumn("start", starts).withColumn("stop", F.col("start") + bin_size)


def context_fits(bins: DataFrame, sizes: DataFrame, extension: int) -> DataFrame:
    """Bins whose context of ``extension`` bases on both sides lies within the chromosome."""
    kept = bins.join(sizes, "chrom").where((F.col("start") - extension >= 0) & (F.col("stop") + extension <= F.col("size")))
    return kept.select(*bins.columns)


def merge(a: DataFrame, gap: int = 0, stretch: int = STRETCH, by: tuple[str, ...] = ("chrom",)) -> DataFrame:
    """Union of overlapping or book-ended intervals (or those at most ``gap`` apart): by, start, stop, n (intervals merged).

    Rows are handled in stretches of the chromosome, so a large chromosome spreads over
    many tasks. What one stretch has to know of those before it (how far they reach,
    and where the island that reaches into it began) is one row a stretch.
    """
    keys = list(by)
    rows = spread(a.where("stop > start").select(*keys, "start", "stop", F.floor(F.col("start") / stretch).alias("_part")), *keys, "_part")
    reach = rows.groupBy(*keys, "_part").agg(F.max("stop").alias("_reach"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    reach = reach.withColumn("_carry", F.max("_reach").over(earlier)).drop("_reach")
    inside = Window.partitionBy(*keys, "_part").orderBy("start", "stop")
    marked = rows.join(reach, [*keys, "_part"]).withColumn(
        "_so_far", F.greatest(F.coalesce(F.max("stop").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-(2**62))), F.coalesce("_carry", F.lit(-(2**62))))
    )
    marked = marked.withColumn("_opens", (F.col("start") > F.col("_so_far") + gap).cast("long"))
    marked = marked.withColumn("_local", F.sum("_opens").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    parts = marked.groupBy(*keys, "_part", "_local").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.count(F.lit(1)).alias("n"))
    last = parts.groupBy(*keys, "_part").agg(F.max("_local").alias("_last"))
    anchor = last.withColumn("_anchor", F.last(F.when(F.col("_last") > 0, F.struct("_part", "_last")), ignorenulls=True).over(earlier)).drop("_last")
    joined = parts.join(anchor, [*keys, "_part"])
    island = F.when(F.col("_local") > 0, F.struct(F.col("_part"), F.col("_local").alias("_last"))).otherwise(F.col("_anchor"))
    return spread(joined.withColumn("_island", island), *keys, "_island").groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.sum("n").alias("n")).drop("_island")


def complement(a: DataFrame, sizes: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """The gaps between intervals, from 0 to each chromosome's size; chromosomes without intervals are one gap.

    Handled in stretches like ``merge``: a stretch knows of those before it where the last interval stops.
    """
    merged = merge(a, stretch=stretch).select("chrom", "start", "stop")
    edges = sizes.select("chrom", F.col("size").alias("start"), F.col("size").alias("stop"))
    rows = merged.join(F.broadcast(sizes.select("chrom")), "chrom", "left_semi").unionByName(edges).withColumn("_part", F.floor(F.col("start") / stretch))  # one row a chromosome
    earlier = Window.partitionBy("chrom").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy("chrom", "_part").agg(F.max("stop").alias("_stop")).withColumn("_carry", F.max("_stop").over(earlier)).drop("_stop")
    inside = Window.partitionBy("chrom", "_part").orderBy("start", "stop")
    gaps = rows.join(carried, ["chrom", "_part"]).select("chrom", F.coalesce(F.lag("stop").over(inside), "_carry", F.lit(0).cast("long")).alias("from"), F.col("start").alias("to"))
    return gaps.where("to > from").toDF("chrom", "start", "stop")


def liftover(a: DataFrame, chain: DataFrame) -> DataFrame:
    """Map intervals that lie within one block of ``chain`` (chrom, start, stop, to_chrom, to_start) to its coordinates; others are lost."""
    blocks = overlap_join(a, chain).where("b_start <= a_start AND a_stop <= b_stop")
    moved = F.col("b_to_start") - F.col("b_start")
    named = [F.col(f"a_{c}").alias(c) for c in a.columns if c not in ("chrom", "start", "stop")]
    return blocks.select(F.col("b_to_chrom").alias("chrom"), (F.col("a_start") + moved).alias("start"), (F.col("a_stop") + moved).alias("stop"), *named)


def mean_signal(a: DataFrame, track: DataFrame, value: str = "value", covered_only: bool = False) -> DataFrame:
    """Distinct intervals of ``a`` with size, covered, sum and mean of a track: over the whole interval (missing is 0), or over covered bases."""
    places = a.select("chrom", "start", "stop").distinct()
    pairs = overlap_join(places, track.select("chrom", "start", "stop", value))
    sums = pairs.groupBy("a_chrom", "a_start", "a_stop").agg(F.sum("overlap").alias("covered"), F.sum(F.col("overlap") * F.col(f"b_{value}")).alias("sum"))
    out = places.join(sums.withColumnsRenamed({"a_chrom": "chrom", "a_start": "start", "a_stop": "stop"}), ["chrom", "start", "stop"], "left").fillna(0, ["covered", "sum"])
    over = F.col("covered") if covered_only else F.col("stop") - F.col("start")
    return out.withColumn("mean", F.coalesce(F.try_divide(F.col("sum"), over), F.lit(0.0)))


def signal_around(points: DataFrame, track: DataFrame, before: int, after: int, step: int, value: str = "value") -> DataFrame:
    """Track values in steps around points (chrom, center, name): name, place (step number from the left), sum, n."""
    windows = points.select("chrom", (F.col("center") - before).alias("start"), (F.col("center") + after).alias("stop"), "center", "name")
    pairs = overlap_join(windows, track.select("chrom", F.col("start"), (F.col("start") + 1).alias("stop"), value))
    place = F.floor((F.col("b_start") - F.col("a_start")) / step)
    return pairs.groupBy(F.col("a_name").alias("name"), place.alias("place")).agg(F.sum(f"b_{value}").alias("sum"), F.count(F.lit(1)).alias("n"))


def random_intervals(sizes: DataFrame, n: int, width: int, seed: str, exclude: DataFrame | None = None, oversample: float = 2.0, most_rounds: int = 12, partial: bool = False) -> DataFrame:
    """``n`` intervals placed by hash along the joined chromosomes, none touching ``exclude``: draws that cross an end or hit it are rejected.

    As many draws are made as the free places ask for, and twice as many where too few
    of them are left; the first draws stay the same. Where no place is free it is an
    error, or with ``partial`` there are no intervals.
    """
    total = sizes.agg(F.sum("size")).first()[0] or 0
    gaps = (sizes.select("chrom", F.lit(0).cast("long").alias("start"), F.col("size").alias("stop")) if exclude is None else complement(exclude, sizes)).where(F.col("stop") - F.col("start") >= width)
    gaps = stored(gaps, "gaps")
    places = gaps.agg(F.sum(F.col("stop") - F.col("start") - width + 1)).first()[0] or 0
    for k in range(most_rounds if places else 0):
        draws = placed_at_random(sizes, int(n * oversample * max(total / places, 1.0) * 2**k), width, seed)
        inside = overlap_join(draws, gaps).where("b_start <= a_start AND a_stop <= b_stop").select(*[F.col(f"a_{c}").alias(c) for c in draws.columns])
        out = inside.orderBy("id").limit(n)
        if out.count() == n:
            return out
    if partial and not places:
        return placed_at_random(sizes, 0, width, seed)
    raise ValueError(f"{n} intervals of {width} bases don't fit")


def placed_at_random(sizes: DataFrame, n_draws: int, width: int, seed: str, exclude: DataFrame | None = None) -> DataFrame:
    """(id, chrom, start, stop): what is left of so many draws without those that cross an end or touch ``exclude``."""
    ends = sizes.withColumn("end", F.sum("size").over(Window.orderBy("chrom"))).withColumn("begin", F.col("end") - F.col("size"))  # one row a chromosome
    total = sizes.agg(F.sum("size").alias("total"))
    draws = sizes.sparkSession.range(n_draws).crossJoin(F.broadcast(total))
    at = F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.col("id").cast("string"), F.lit(seed))), 1, 14), 16, 10).cast("long"), F.col("total"))
    placed = draws.withColumn("at", at).join(F.broadcast(ends), (F.col("at") >= F.col("begin")) & (F.col("at") < F.col("end")))
    out = placed.select("id", "chrom", (F.col("at") - F.col("begin")).alias("start"), (F.col("at") - F.col("begin") + width).alias("stop"), "size").where("stop <= size").drop("size")
    return out if exclude is None else without_overlap(out, exclude)


def combined_negatives(positives: DataFrame, sizes: DataFrame, superset: DataFrame, n: int, seed: str, width: int = 200) -> DataFrame:
    """Merged union of flank, superset and random negatives without the positives; where these leave no room there are no random ones."""
    parts = [
        flanks(positives.select("chrom", "start", "stop"), width, 2, 2),
        superset_negatives(positives, superset).select("chrom", "start", "stop"),
        random_intervals(sizes, n, width, seed, exclude=positives, partial=True).select("chrom", "start", "stop"),
    ]
    return without_overlap(merge(reduce(DataFrame.unionByName, parts)).select("chrom", "start", "stop"), positives)


def metadata(bins: DataFrame, extension: int) -> Column:
    """``region=chr:s-e;active=chr:s-e;features=chr:s-e`` of tiled bins."""

    def at(start: Column, stop: Column) -> Column:
        return F.format_string("%s:%d-%d", F.col("chrom"), start, stop)

    return F.concat(
        F.lit("region="), at(F.col("region_start"), F.col("region_stop")), F.lit(";active="), at(F.col("start"), F.col("stop")),
        F.lit(";features="), at(F.col("start") - extension, F.col("stop") + extension),
    )


def parse_metadata(text: Column, key: str) -> Column:
    """The interval struct (chrom, start, stop) under a key of a metadata string, or null."""
    place = F.try_element_at(F.str_to_map(text, F.lit(";"), F.lit("=")), F.lit(key))
    return F.when(
        place.isNotNull(),
        F.struct(
            F.substring_index(place, ":", 1).alias("chrom"),
            F.regexp_extract(place, r":(\d+)-", 1).cast("long").alias("start"),
            F.regexp_extract(place, r"-(\d+)$", 1).cast("long").alias("stop"),
        ),
    )


def centres_from_headers(lines: DataFrame, line: str, width: int) -> DataFrame:
    """(chrom, start, stop): windows of ``width`` around the middle of the place that a FASTA header names (``...chrom:start-stop``); none before the chromosome's start."""
    place = [F.regexp_extract(line, r"([^:\s>]+):(\d+)-(\d+)", i) for i in (1, 2, 3)]
    middle = F.floor((place[1].cast("long") + place[2].cast("long")) / 2)
    rows = lines.where(F.col(line).startswith(">")).select(place[0].alias("chrom"), (middle - width // 2).alias("start"), (middle + width // 2).alias("stop"))
    return rows.where("start >= 0")


def fold_of_chromosomes(counts: list[tuple[str, int]], folds: int) -> dict[str, int]:
    """Chromosomes to folds: the largest seed one fold each, the others go to the least loaded. The list has one entry a chromosome."""
    order = sorted(counts, key=lambda x: (-x[1], x[0]))
    loads, out = [0] * folds, {}
    for i, (chrom, n) in enumerate(order):
        fold = i if i < folds else min(range(folds), key=lambda k: (loads[k], k))
        out[chrom] = fold
        loads[fold] += n
    return out


def track_from_windows(windows: DataFrame, value: str, stride: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean over all windows that cover a stretch of ``stride`` bases; zero means are left out."""
    steps = F.explode(F.sequence(F.col("start"), F.col("stop") - 1, F.lit(stride).cast("long")))
    out = windows.select(*by, "chrom", steps.alias("at"), value).groupBy(*by, "chrom", "at").agg(F.avg(value).alias(value))
    return out.where(F.col(value) != 0).select(*by, "chrom", F.col("at").alias("start"), (F.col("at") + stride).alias("stop"), value)
