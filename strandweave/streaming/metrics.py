"""Running counts and metrics over streams, as ordinary aggregates on unbounded tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed_counts(events: DataFrame, width: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts and sums by event type in event-time windows; rows later than ``late`` are left out."""
    ts = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return ts.groupBy(F.window("ts", width, slide), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def session_counts(events: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    ts = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return ts.groupBy("user_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n"))


def running_score_buckets(predictions: DataFrame, buckets: int = 100) -> DataFrame:
    """What a running AUC keeps: positives and negatives by task and score bucket; ``running_auc`` makes the area of it."""
    b = F.least(F.floor(F.col("score") * buckets), F.lit(buckets - 1)).alias("bucket")
    y = F.col("label").cast("long")
    return predictions.groupBy("task", b).agg(F.sum(y).alias("positives"), F.sum(1 - y).alias("negatives"))


def running_auc(buckets: DataFrame) -> DataFrame:
    """(task, auroc) from counts by task and bucket (a state of at most as many rows as buckets a task), by trapezoids from the greatest score down."""
    down = Window.partitionBy("task").orderBy(F.col("bucket").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("task")
    above = F.coalesce(F.sum("positives").over(down), F.lit(0))
    rows = buckets.select("task", "positives", "negatives", above.alias("_above"), F.sum("positives").over(whole).alias("_p"), F.sum("negatives").over(whole).alias("_n"))
    step = F.col("negatives") * (F.col("_above") + F.col("positives") / 2)
    return rows.groupBy("task").agg(F.try_divide(F.sum(step), F.max("_p") * F.max("_n")).alias("auroc"))


def running_table(df: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Keep the current rows of a running aggregate as the in-memory table ``name``, until the source is used up."""
    return df.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def to_parquet(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append finished windows to a table, exactly once, until the source is used up."""
    return df.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
