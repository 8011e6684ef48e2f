"""Model metrics from (task, label, score) rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranges import with_ranges


def curve(df: DataFrame, task: str, label: str, score: str) -> DataFrame:
    """One row a task and distinct score, from the greatest down: true and false positives at that threshold, precision, recall, false positive rate, and the last three at the point before (``_before``).

    Rows are counted by distinct score, scores are cut into ranges, and what precedes a
    range is a sum over few rows, so no task's scores have to fit into one partition.
    """
    y = F.col(label).cast("long")
    points = with_ranges(df.groupBy(task, score).agg(F.sum(y).alias("_p"), F.sum(1 - y).alias("_n")), [task], score)
    above = Window.partitionBy(task).orderBy(F.col("_range").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(task)
    ranges = points.groupBy(task, "_range").agg(F.sum("_p").alias("_rp"), F.sum("_n").alias("_rn")).select(
        task, "_range", *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}_above") for c in ("_rp", "_rn")], F.sum("_rp").over(whole).alias("_all_p"), F.sum("_rn").over(whole).alias("_all_n")
    )
    down = Window.partitionBy(task, "_range").orderBy(F.col(score).desc()).rowsBetween(Window.unboundedPreceding, 0)
    counted = points.join(ranges, [task, "_range"]).withColumn("tp", F.col("_rp_above") + F.sum("_p").over(down)).withColumn("fp", F.col("_rn_above") + F.sum("_n").over(down))
    tp, fp = F.col("tp"), F.col("fp")
    tp0, fp0 = tp - F.col("_p"), fp - F.col("_n")
    return counted.select(
        task, score, "tp", "fp",
        F.try_divide(tp, tp + fp).alias("precision"), F.try_divide(tp, F.col("_all_p")).alias("recall"), F.try_divide(fp, F.col("_all_n")).alias("fpr"),
        F.coalesce(F.try_divide(tp0, tp0 + fp0), F.lit(1.0)).alias("precision_before"), F.try_divide(tp0, F.col("_all_p")).alias("recall_before"), F.try_divide(fp0, F.col("_all_n")).alias("fpr_before"),
    )


def area(points: DataFrame, task: str, x: str, y: str, name: str) -> DataFrame:
    """Trapezoid area under a curve: each point with the one before it."""
    step = (F.col(x) - F.col(f"{x}_before")) * (F.col(y) + F.col(f"{y}_before")) / 2
    return points.groupBy(task).agg(F.sum(step).alias(name))


def ranking_metrics(df: DataFrame, task: str, label: str, score: str, floors: tuple[float, ...] = (0.9,)) -> DataFrame:
    """auroc, auprc (trapezoid) and recall at the smallest threshold with each precision floor."""
    points = curve(df, task, label, score)
    out = area(points, task, "fpr", "recall", "auroc").join(area(points, task, "recall", "precision", "auprc"), task)
    for floor in floors:
        best = points.groupBy(task).agg(F.coalesce(F.min_by("recall", F.when(F.col("precision") >= floor, F.col(score))), F.lit(0.0)).alias(f"recall_at_{round(floor * 100)}"))
        out = out.join(best, task)
    return out


def recall_fdr_thresholds(df: DataFrame, task: str, label: str, score: str, recall: float, fdr: float) -> DataFrame:
    """(task, at_recall, at_fdr): the greatest threshold whose recall reaches ``recall``, and the least whose precision reaches 1 - ``fdr`` (the greatest score where none does)."""
    points = curve(df, task, label, score)
    at_fdr = F.coalesce(F.min(F.when(F.col("precision") >= 1 - fdr, F.col(score))), F.max(score))
    return points.groupBy(task).agg(F.max(F.when(F.col("recall") >= recall, F.col(score))).alias("at_recall"), at_fdr.alias("at_fdr"))


def classification_counts(df: DataFrame, task: str, label: str, score: str, at: float) -> DataFrame:
    """n, positives, accuracy and mean squared error of each task, and of all (task null)."""
    y, right = F.col(label).cast("double"), (F.col(score) >= at).cast("int") == F.col(label)
    return df.rollup(task).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("positives"), F.avg(right.cast("double")).alias("accuracy"), F.avg((y - F.col(score)) * (y - F.col(score))).alias("mse")
    )


def regression_metrics(df: DataFrame, task: str, truth: str, predicted: str) -> DataFrame:
    t, p = F.col(truth).cast("double"), F.col(predicted).cast("double")
    return df.groupBy(task).agg(F.avg((t - p) * (t - p)).alias("mse"), F.corr(t, p).alias("pearson"), (1 - F.try_divide(F.sum((t - p) * (t - p)), F.var_pop(t) * F.count(F.lit(1)))).alias("r2"))


def bucketed_auc(df: DataFrame, task: str, label: str, score: str, buckets: int = 100) -> DataFrame:
    """AUROC from counts in equal buckets of a score in [0, 1]: what a running metric keeps."""
    b = F.least(F.floor(F.col(score) * buckets), F.lit(buckets - 1)) / buckets
    return area(curve(df.withColumn("_b", b), task, label, "_b"), task, "fpr", "recall", "auroc")
