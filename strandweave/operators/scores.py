"""Score tables in long form: (example, [task,] position, value), most values zero and left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import kth_greatest, null_safe_join


def top_k_with_ties(df: DataFrame, keys: list[str], value: Column, k: int) -> DataFrame:
    """Rows whose absolute value is among the k greatest of their group; ties at the border stay."""
    rank = F.rank().over(Window.partitionBy(*keys).orderBy(F.abs(value).desc()))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")


def null_thresholds(nulls: DataFrame, keys: list[str], value: str, share: float, cells: DataFrame | None = None) -> DataFrame:
    """The k-th greatest absolute value of each group's null scores, k = floor(share * n), at least 1.

    n is the number of rows, or for sparse scores that of all cells, zeros included:
    ``cells`` (keys, cells). Where k exceeds the rows present the threshold is 0.
    """
    sizes = nulls.groupBy(*keys).agg(F.count(F.lit(1)).alias("cells")) if cells is None else cells
    k = sizes.select(*keys, F.greatest(F.floor(F.col("cells") * share), F.lit(1)).alias("k"))
    return kth_greatest(nulls.select(*keys, F.abs(F.col(value)).cast("double").alias("_a")), keys, "_a", k, "threshold")


def above_null(scores: DataFrame, thresholds: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Scores strictly beyond their group's threshold on either side; a group without nulls has the threshold 0."""
    limit = F.coalesce("threshold", F.lit(0.0))
    return null_safe_join(scores, thresholds, keys, "left").where((F.col(value) > limit) | (F.col(value) < -limit)).drop("threshold")


def above_gaussian(scores: DataFrame, keys: list[str], value: str, sds: float = 3.0) -> DataFrame:
    """Scores above mean + sds * population deviation of their group."""
    limits = scores.groupBy(*keys).agg((F.avg(value) + sds * F.stddev_pop(value)).alias("_limit"))
    return scores.join(limits, keys).where(F.col(value) > F.col("_limit")).drop("_limit")


def denoise(scores: DataFrame, keys: list[str], position: str, value: str, length: int, half: int = 3, least: int = 2) -> DataFrame:
    """Keep scores with enough neighbours of the same sign: in the centred window, n * width >= least * (cells inside 0..length-1)."""
    width = 2 * half + 1
    window = Window.partitionBy(*keys).orderBy(position).rangeBetween(-half, half)
    cells = F.least(F.col(position) + half, F.lit(length - 1)) - F.greatest(F.col(position) - half, F.lit(0)) + 1

    def enough(sign: int) -> Column:
        return F.sum((F.signum(F.col(value)) == sign).cast("long")).over(window) * width >= least * cells

    marked = scores.where(F.col(value) != 0).withColumn("_plus", enough(1)).withColumn("_minus", enough(-1))
    return marked.where(((F.col(value) > 0) & F.col("_plus")) | ((F.col(value) < 0) & F.col("_minus"))).drop("_plus", "_minus")


def dilate(sites: DataFrame, keys: list[str], position: str, width: int, length: int) -> DataFrame:
    """Every position that a window of the given width, (width-1)//2 to the right and width//2 to the left of it, covers."""
    spread = F.explode(F.sequence(F.greatest(F.col(position) - width // 2, F.lit(0)), F.least(F.col(position) + (width - 1) // 2, F.lit(length - 1))))
    return sites.select(*keys, spread.alias(position)).distinct()


def moving_average(df: DataFrame, keys: list[str], order: list[str], value: str, half: int) -> Column:
    """Centred mean over the rows present."""
    return F.avg(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(-half, half))


def arg_max_position(scores: DataFrame, keys: list[str], position: str, value: str, shift: int = 0) -> DataFrame:
    """Greatest value of each group and its position (the lowest of equals) plus ``shift``."""
    best = F.max(F.struct(F.col(value).alias("value"), (-F.col(position)).alias("minus")))
    return scores.groupBy(*keys).agg(best.alias("_b")).select(*keys, F.col("_b.value").alias("value"), (shift - F.col("_b.minus")).alias("position"))


def divided_by(present: DataFrame, example: str, item: str, required: DataFrame, cluster: str) -> DataFrame:
    """(example, cluster) where the example has every item that the cluster requires. ``required`` (cluster, item) is a dimension table."""
    needed = required.groupBy(cluster).agg(F.count_distinct(item).alias("_needed"))
    found = present.select(example, item).distinct().join(required, item).groupBy(example, cluster).agg(F.count_distinct(item).alias("_found"))
    return found.join(needed, cluster).where("_found = _needed").select(example, cluster)


def normalise_to_logits(scores: DataFrame, logits: DataFrame, keys: list[str], value: str, tiny: float = 1e-7) -> DataFrame:
    """Values times logit over the sum of absolute values of their group; 0 where that sum vanishes. ``logits``: keys, logit."""
    sums = scores.groupBy(*keys).agg(F.sum(F.abs(value)).alias("_size"))
    scaled = F.when(F.col("_size") <= tiny, 0.0).otherwise(F.try_divide(F.col(value) * F.col("logit"), F.col("_size")))
    return scores.join(sums, keys).join(logits, keys).withColumn(value, scaled).drop("_size", "logit")


def importance_filter(scores: DataFrame, example: str, task: str, value: str, cutoff: int) -> DataFrame:
    """Examples of which some task has more than ``cutoff`` non-zero positions."""
    return scores.where(F.col(value) != 0).groupBy(example, task).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > cutoff).select(example).distinct()


def aligned(scores: DataFrame, anchors: DataFrame, example: str, position: str, reach: int) -> DataFrame:
    """Positions relative to each example's anchor (example, anchor), within reach."""
    moved = scores.join(anchors, example).withColumn(position, F.col(position) - F.col("anchor")).drop("anchor")
    return moved.where(F.abs(position) <= reach)


def hash_rank(keys: list[str], *parts: Column | str) -> Column:
    """Random but repeatable order in each group: md5 of the parts joined by colons."""
    text = F.concat_ws(":", *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts])
    return F.row_number().over(Window.partitionBy(*keys).orderBy(F.md5(text)))


def poisson_limits(scores: DataFrame, keys: list[str], value: str, share: float) -> DataFrame:
    """(keys, limit): the least count, 1 at least, whose Poisson probability of at most that many, at the group's mean, reaches 1 - share.

    Terms are summed in log space up to mean + 12 deviations + 20, beyond which nothing
    that a double can tell is left.
    """
    means = scores.groupBy(*keys).agg(F.avg(value).cast("double").alias("_m")).withColumn("_top", F.ceil(F.col("_m") + 12 * F.sqrt("_m") + 20).cast("int"))
    start = F.struct(F.lit(0).alias("k"), (-F.col("_m")).alias("log_p"), F.exp(-F.col("_m")).alias("sum"))

    def step(acc: Column, k: Column) -> Column:
        log_p = acc["log_p"] + F.ln(F.col("_m") / k)
        done = (acc["sum"] >= 1 - share) & (acc["k"] > 0)
        return F.struct(F.when(done, acc["k"]).otherwise(k).alias("k"), log_p.alias("log_p"), F.when(done, acc["sum"]).otherwise(acc["sum"] + F.exp(log_p)).alias("sum"))

    found = F.aggregate(F.sequence(F.lit(1), F.col("_top")), start, step, lambda acc: acc["k"])
    return means.select(*keys, F.when(F.col("_m") > 0, found).otherwise(1).alias("limit"))
