"""Statistics: ranks, quantile maps, matched backgrounds, tests, thresholds."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import spread, stored
from .ranges import null_safe_join, percentiles, with_ranges, with_ranks  # noqa: F401
from .scores import hash_rank


def correlations(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Pearson and Spearman (Pearson of average ranks) of each group."""
    ranked = with_ranks(with_ranks(df, keys, x, average="_rx"), keys, y, average="_ry")
    return ranked.groupBy(*keys).agg(F.corr(x, y).alias("pearson"), F.corr("_rx", "_ry").alias("spearman"))


def pair_correlations(df: DataFrame, example: str, item: str, value: str) -> DataFrame:
    """Pearson of all pairs of items (i < j) over the examples both have, from sums of products."""
    a = df.select(example, F.col(item).alias("i"), F.col(value).cast("double").alias("x"))
    b = df.select(example, F.col(item).alias("j"), F.col(value).cast("double").alias("y"))
    return a.join(b, example).where("i < j").groupBy("i", "j").agg(F.corr("x", "y").alias("r"), F.count(F.lit(1)).alias("n"))


def strong_pairs(pairs: DataFrame, least_r: float, least_t: float) -> DataFrame:
    """Pairs (r, n) whose correlation and its t statistic reach the thresholds in size."""
    t = F.when(F.abs("r") < 1, F.col("r") * F.sqrt((F.col("n") - 2) / (1 - F.col("r") * F.col("r")))).otherwise(F.signum("r") * float("inf"))
    return pairs.where((F.abs("r") >= least_r) & (F.abs(t) >= least_t))


def interpolated(values: DataFrame, curve: DataFrame, keys: list[str], x: str, curve_x: str, curve_y: str, out: str, curve_y_left: str | None = None) -> DataFrame:
    """Piecewise linear value of ``curve`` (keys, x, y) at each row's x, flat beyond its ends.

    The neighbours come from one pass over both tables in either direction: the last
    curve point at or before x and the first one at or after it. Both frames grow by a
    row at a time, so time grows with the rows. A group is cut into ranges of x, and what a range has to
    know of the others (the last point before it, the first one behind it) is a row a range,
    so no group has to fit into one task. A curve that jumps has one row for its
    x, with the y to the right of it in ``curve_y`` and to the left in ``curve_y_left``.
    """
    point = F.struct(F.col(curve_x).cast("double").alias("x"), F.col(curve_y).cast("double").alias("y"), F.col(curve_y_left or curve_y).cast("double").alias("left"))
    c = curve.select(*keys, F.col(curve_x).cast("double").alias("_x"), point.alias("_point"))
    rows = values.select("*", F.col(x).cast("double").alias("_x")).unionByName(c, allowMissingColumns=True)
    rows = spread(with_ranges(stored(rows, "curve-rows"), keys, "_x"), *keys, "_range")
    ends = rows.groupBy(*keys, "_range").agg(F.max("_point").alias("_most"), F.min("_point").alias("_least"))
    along = Window.partitionBy(*keys).orderBy("_range")
    ends = ends.withColumn("_below", F.last("_most", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1)))
    ends = ends.withColumn("_above", F.first("_least", ignorenulls=True).over(along.rowsBetween(1, Window.unboundedFollowing))).select(*keys, "_range", "_below", "_above")
    before = Window.partitionBy(*keys, "_range").orderBy("_x").rangeBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(*keys, "_range").orderBy(F.col("_x").desc()).rangeBetween(Window.unboundedPreceding, 0)
    near = rows.withColumn("_lo", F.last("_point", ignorenulls=True).over(before)).withColumn("_hi", F.last("_point", ignorenulls=True).over(after)).where(F.col("_point").isNull())
    near = null_safe_join(near, ends, [*keys, "_range"])
    near = near.withColumn("_lo", F.coalesce("_lo", F.when(F.col("_x").isNotNull(), F.col("_below")))).withColumn("_hi", F.coalesce("_hi", "_above"))
    lo, hi = F.col("_lo"), F.col("_hi")
    share = F.coalesce(F.try_divide(F.col("_x") - lo["x"], hi["x"] - lo["x"]), F.lit(0.0))
    value = F.when(lo.isNull(), hi["left"]).when(hi.isNull(), lo["y"]).otherwise(lo["y"] + share * (hi["left"] - lo["y"]))
    return near.withColumn(out, value).select(*values.columns, out)


def rank_curve(xs: DataFrame, ys: DataFrame, keys: list[str], x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """(keys, x, y, left): the curve through (r-th least x, r-th least y) of each group, one row for each x.

    ``ys`` is ranked within ``by`` (by default the same keys); of the ranks that share
    an x, y is the last and left the first one's.
    """
    over = keys if by is None else by
    ranked = with_ranks(xs.select(*keys, F.col(x).cast("double").alias("x")), keys, "x", ordinal="_r")
    other = with_ranks(ys.select(*over, F.col(y).cast("double").alias("y")), over, "y", ordinal="_r")
    return null_safe_join(ranked, other, [*over, "_r"]).groupBy(*keys, "x").agg(F.max("y").alias("y"), F.min("y").alias("left"))


def _equally_many(rows: DataFrame, task: str) -> None:
    """ValueError unless all tasks have equally many rows: ranks of one would meet no rank of another."""
    sizes = rows.groupBy(task).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("least"), F.max("n").alias("most")).first()
    if sizes.least != sizes.most:
        raise ValueError(f"tasks have between {sizes.least} and {sizes.most} rows, not equally many")


def normalised_to_reference(signals: DataFrame, reference: DataFrame, task: str, value: str, out: str) -> DataFrame:
    """Signals of each task mapped to the distribution that the reference rows of all tasks have in common, as log2, with what isn't above 1 set to 0.

    The common distribution is, rank by rank, the mean over tasks; tasks must have
    equally many reference rows (else ValueError). Values between reference values are interpolated.
    """
    _equally_many(reference, task)
    ranked = with_ranks(reference.select(task, F.col(value).cast("double").alias("x")), [task], "x", ordinal="_r")
    means = ranked.groupBy("_r").agg(F.avg("x").alias("_t"))
    curve = ranked.join(means, "_r").groupBy(task, "x").agg(F.max("_t").alias("y"), F.min("_t").alias("left"))
    mapped = interpolated(signals, curve.withColumnsRenamed({"x": "_cx", "y": "_cy", "left": "_cl"}), [task], value, "_cx", "_cy", out, "_cl")
    return mapped.withColumn(out, F.when(F.col(out) > 1, F.log2(out)).otherwise(0.0))


def logits_to_labels(logits: DataFrame, sample_logits: DataFrame, sample_labels: DataFrame, model: str, task: str, value: str, label: str, key: str) -> DataFrame:
    """(key, task, value): logits mapped by rank to the labels of a sample, for each model and task, then averaged over models. The order within a model and task stays."""
    curve = rank_curve(sample_logits, sample_labels, [model, task], value, label, by=[task])
    mapped = interpolated(logits, curve.withColumnsRenamed({"x": "_cx", "y": "_cy", "left": "_cl"}), [model, task], value, "_cx", "_cy", "_mapped", "_cl")
    return mapped.groupBy(key, task).agg(F.avg("_mapped").alias(value))


def quantile_normalised(signals: DataFrame, item: str, task: str, value: str, out: str) -> DataFrame:
    """Tasks brought to one distribution: each value's rank within its task takes the mean, over tasks, of that rank's values.

    Equal values take the mean of their ranks' targets. Tasks must have equally many rows (else ValueError).
    """
    _equally_many(signals, task)
    ranked = with_ranks(signals, [task], value, [item], ordinal="_r")
    target = ranked.groupBy("_r").agg(F.avg(value).alias("_t"))
    means = ranked.join(target, "_r").groupBy(task, value).agg(F.avg("_t").alias(out))
    return signals.join(means, [task, value])


def quantile_bins(df: DataFrame, value: str, n: int) -> DataFrame:
    """One row with the ``n`` + 1 edges of equally filled bins, interpolated at i * count / n."""
    return percentiles(df, [], value, [i / n for i in range(n + 1)], "edges")


def bin_of(value: Column, edges: Column) -> Column:
    """Number of the bin [edge i, edge i+1) that holds the value, the last bin closed; null outside."""
    place = F.size(F.filter(edges, lambda e: e <= value)) - 1
    inside = (value >= F.element_at(edges, 1)) & (value <= F.element_at(edges, -1))
    return F.when(inside, F.least(place, F.size(edges) - 2))


def matched_sample(foreground: DataFrame, background: DataFrame, key: str, bins: list[str], seeds: int, per: float = 1.0) -> DataFrame:
    """(seed, key, bins): for each seed as many background rows of each bin as the foreground has (times ``per``), picked by hash.

    Bins that the background can't fill give all they have. Rows with null bins match nothing.

    Before rows are ranked, those far beyond the wanted rank by their hash are left out;
    that a bin then has too few is less likely than 1 in 10^20.
    """
    wanted = foreground.groupBy(*bins).agg(F.ceil(F.count(F.lit(1)) * per).alias("_wanted"))
    sizes = background.groupBy(*bins).agg(F.count(F.lit(1)).alias("_size"))
    share = (F.col("_wanted") + 12 * F.sqrt("_wanted") + 100) / F.col("_size")
    rows = background.select(key, *bins).join(wanted.join(sizes, bins).withColumn("_share", share), bins).withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))))
    place = F.conv(F.substring(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.col("seed").cast("string"))), 1, 13), 16, 10).cast("double") / float(2**52)
    rows = rows.where(place <= F.col("_share"))
    return rows.withColumn("_r", hash_rank(["seed", *bins], key, "seed")).where(F.col("_r") <= F.col("_wanted")).select("seed", key, *bins)


def matched_with_replacement(foreground: DataFrame, background: DataFrame, key: str, bins: list[str], seeds: int) -> DataFrame:
    """(seed, bins, draw, key): for each seed and foreground row of a cell one background row of that cell, drawn by hash; cells without background give none. ``key`` is a number."""
    numbered = with_ranks(background.select(key, *bins), bins, key, ordinal="_r").withColumn("_r", F.col("_r").cast("long"))
    sizes = background.groupBy(*bins).agg(F.count(F.lit(1)).alias("_size"))
    wanted = foreground.groupBy(*bins).agg(F.count(F.lit(1)).alias("_wanted")).join(sizes, bins)
    draws = wanted.withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1)))).withColumn("draw", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_wanted"))))
    number = F.conv(F.substring(F.md5(F.concat_ws(":", *[F.col(b).cast("string") for b in bins], F.col("seed").cast("string"), F.col("draw").cast("string"))), 1, 13), 16, 10).cast("long")
    picked = draws.withColumn("_r", F.pmod(number, F.col("_size")) + 1)
    return picked.join(numbered, [*bins, "_r"]).select("seed", *bins, "draw", key)


def empirical_p(observed: DataFrame, nulls: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, p): the share of null values that are at least the observed one."""
    met = null_safe_join(nulls.select(*keys, F.col(value).alias("_null")), observed, keys)
    return met.groupBy(*keys, value).agg(F.avg((F.col("_null") >= F.col(value)).cast("double")).alias("p"))


def median_of_medians(rows: DataFrame, keys: list[str], sample: str, value: str) -> DataFrame:
    """(keys, median): the median over samples of each sample's median."""
    each = percentiles(rows, [*keys, sample], value, [0.5], "_m").withColumn("_m", F.get("_m", 0))
    return percentiles(each, keys, "_m", [0.5], "median").withColumn("median", F.get("median", 0))


def permutation_p(rows: DataFrame, key: str, values: str, n: int, permutations: int) -> DataFrame:
    """(place, mean, p): for each of ``n`` places of an array the mean, and how often it isn't above the mean of values taken from a random place of each row.

    Rows are multiplied by the permutations and summed on the map side; only
    ``permutations`` means and ``n`` means are shuffled.
    """
    draws = rows.select(key, values, F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))).alias("_b"))
    place = F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.col("_b").cast("string"))), 1, 8), 16, 10).cast("long"), F.lit(n)).cast("int")
    nulls = draws.groupBy("_b").agg(F.avg(F.get(values, place)).alias("_null"))
    means = rows.select(F.posexplode(values).alias("place", "_v")).groupBy("place").agg(F.avg("_v").alias("mean"))
    met = means.crossJoin(F.broadcast(nulls))  # n x permutations rows
    return met.groupBy("place", "mean").agg(F.avg((F.col("mean") - F.col("_null") <= 0).cast("double")).alias("p"))


def bootstrap_difference(foreground: DataFrame, sampled: DataFrame, item: str, value: str) -> DataFrame:
    """Per item: foreground mean, mean of the samples' means, and p = share of samples with foreground - sample <= 0. ``sampled`` has a seed column."""
    fg = foreground.groupBy(item).agg(F.avg(value).alias("fg"))
    bg = sampled.groupBy(item, "seed").agg(F.avg(value).alias("bg"))
    joined = fg.join(bg, item)
    return joined.groupBy(item).agg(F.first("fg").alias("fg"), F.avg("bg").alias("bg"), F.avg((F.col("fg") - F.col("bg") <= 0).cast("double")).alias("p"))


def sign_flip(df: DataFrame, items: list[str], key: str, value: str, permutations: int) -> DataFrame:
    """Per group of ``items`` the observed sum and the two-tailed share of hashed sign flips at least as far out."""
    flips = df.withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))))
    sign = F.when(F.substring(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.col("seed").cast("string"))), 1, 1) < "8", 1).otherwise(-1)
    sums = flips.groupBy(*items, "seed").agg(F.sum(sign * F.col(value)).alias("_s"))
    observed = df.groupBy(*items).agg(F.sum(value).alias("observed"))
    return null_safe_join(sums, observed, items).groupBy(*items).agg(F.first("observed").alias("observed"), F.avg((F.abs("_s") >= F.abs("observed")).cast("double")).alias("p"))


def fdr_threshold(p_values: DataFrame, p: str, fdr: float, bins: int = 50) -> float:
    """The left edge up to which p-values are kept: histogram over the observed range, null level from the bins before the last, first edge whose q reaches ``fdr``.

    One aggregation to at most ``bins`` rows; the rest is arithmetic on those.
    """
    lo, hi = p_values.agg(F.min(p), F.max(p)).first()
    if lo is None or lo == hi:
        return lo if lo is not None else 0.0
    width = (hi - lo) / bins
    place = F.least(F.floor((F.col(p) - lo) / width), F.lit(bins - 1))
    counts = {r.b: r.n for r in p_values.groupBy(place.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()}
    heights = [counts.get(i, 0) for i in range(bins)]
    null = sum(heights[-4:-1]) / 3
    total = 0
    for i, h in enumerate(heights):
        total += h
        if total and min(1.0, null * (i + 1) / total) >= fdr:
            return lo + i * width
    return hi


#: Counts this far (in logarithms) below the likeliest one have probabilities that a double holds as 0.
VANISHED = 760.0


def _log_likelihoods(population: int, successes: int, draws: int) -> tuple[int, np.ndarray]:
    """The least count, and from it on the logarithm of each hypergeometric count's probability over that of the likeliest.

    Counts fall off on both sides of the likeliest; those whose probability isn't 0 as a
    double lie within a few dozen deviations, however large the population. They are
    summed up from the likeliest by quotients of neighbours, without factorials.
    """
    least, most = max(0, draws + successes - population), min(successes, draws)
    mode = min(max((draws + 1) * (successes + 1) // (population + 2), least), most)

    def side(length: int, quotient: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        parts, at, log = [], 0, 0.0
        while at < length and log > -VANISHED:
            logs = log + np.cumsum(np.log(quotient(np.arange(at, min(at + 4096, length), dtype=float))))
            parts.append(logs)
            at, log = at + len(logs), float(logs[-1])
        return np.concatenate(parts) if parts else np.zeros(0)

    def up(i: np.ndarray) -> np.ndarray:
        x = mode + i
        return (successes - x) * (draws - x) / ((x + 1) * (population - successes - draws + x + 1))

    def down(i: np.ndarray) -> np.ndarray:
        x = mode - i
        return x * (population - successes - draws + x) / ((successes - x + 1) * (draws - x + 1))

    below, above = side(mode - least, down), side(most - mode, up)
    return mode - len(below), np.concatenate([below[::-1], [0.0], above])


def hypergeometric_tail(hits: int, population: int, successes: int, draws: int) -> float:
    """P(X >= hits)."""
    first, logs = _log_likelihoods(population, successes, draws)
    shares = np.exp(logs)
    return min(1.0, float(shares[max(hits - first, 0) :].sum() / shares.sum()))


def fisher_two_sided(a: int, b: int, c: int, d: int) -> float:
    """Two-sided exact p of a 2 x 2 table: all tables at most as likely."""
    first, logs = _log_likelihoods(a + b + c + d, a + b, a + c)
    if not first <= a < first + len(logs):
        return 0.0
    shares = np.exp(logs)
    return min(1.0, float(shares[logs <= logs[a - first] + 1e-7].sum() / shares.sum()))


def add_fisher(df: DataFrame, a: str, b: str, c: str, d: str) -> DataFrame:
    """Add odds ratio and two-sided p from four count columns."""

    def run(w: pd.Series, x: pd.Series, y: pd.Series, z: pd.Series) -> pd.Series:
        return pd.Series([fisher_two_sided(*map(int, t)) for t in zip(w, x, y, z, strict=True)])

    odds = F.try_divide(F.col(a).cast("double") * F.col(d), F.col(b).cast("double") * F.col(c))
    return df.withColumn("odds_ratio", odds).withColumn("p", F.pandas_udf(run, "double")(a, b, c, d))


def add_hypergeometric(df: DataFrame, hits: str, population: str, successes: str, draws: str) -> DataFrame:
    """Add p = P(X >= hits)."""

    def run(w: pd.Series, x: pd.Series, y: pd.Series, z: pd.Series) -> pd.Series:
        return pd.Series([hypergeometric_tail(*map(int, t)) for t in zip(w, x, y, z, strict=True)])

    return df.withColumn("p", F.pandas_udf(run, "double")(hits, population, successes, draws))


def signed_rank(df: DataFrame, keys: list[str], diff: str) -> DataFrame:
    """Wilcoxon signed rank: sum of positive ranks of |diff| (zeros left out) and its normal z."""
    used = df.where(F.col(diff) != 0).withColumn("_a", F.abs(F.col(diff)))
    ranked = with_ranks(used, keys, "_a", average="_r")
    n = F.count(F.lit(1))
    w = F.sum(F.when(F.col(diff) > 0, F.col("_r")).otherwise(0.0))
    return ranked.groupBy(*keys).agg(n.alias("n"), w.alias("w_plus"), F.try_divide(w - n * (n + 1) / 4, F.sqrt(n * (n + 1) * (2 * n + 1) / 24)).alias("z"))


def rank_sum(df: DataFrame, keys: list[str], value: str, positive: Column) -> DataFrame:
    """Mann-Whitney U of the positives and its normal z (no tie correction)."""
    ranked = with_ranks(df.withColumn("_p", positive.cast("long")), keys, value, average="_r")
    n1, n0 = F.sum("_p"), F.sum(1 - F.col("_p"))
    u = F.sum(F.col("_r") * F.col("_p")) - n1 * (n1 + 1) / 2
    return ranked.groupBy(*keys).agg(n1.alias("n1"), n0.alias("n0"), u.alias("u"), F.try_divide(u - n1 * n0 / 2, F.sqrt(n1 * n0 * (n1 + n0 + 1) / 12)).alias("z"))


def trimmed_deviation(df: DataFrame, keys: list[str], value: str, share: float = 0.75) -> DataFrame:
    """Population deviation of the values whose size is at most the ``share`` percentile of sizes and not 0."""
    limits = percentiles(df, keys, F.abs(value), [share], "_limit").withColumn("_limit", F.get("_limit", 0))
    kept = null_safe_join(df, limits, keys).where((F.abs(value) <= F.col("_limit")) & (F.col(value) != 0))
    return kept.groupBy(*keys).agg(F.stddev_pop(value).alias("sd"), F.count(F.lit(1)).alias("n"))
