"""Running metrics of predictions on a stream, kept by key, with an end."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .metrics import running_auc, running_score_buckets

BUCKETS = 100
STATE = "n long, sx double, sy double, sxx double, syy double, sxy double, squared double, positives array<long>, negatives array<long>, latest long"
METRICS = "n long, mse double, pearson double, auroc double, ended boolean"


def _metrics(state: tuple, ended: bool) -> dict:
    n, sx, sy, sxx, syy, sxy, squared, positives, negatives, _ = state
    over = (n * sxx - sx * sx) * (n * syy - sy * sy)
    down_p, down_n = np.array(positives)[::-1], np.array(negatives)[::-1]
    pairs = float(down_p.sum()) * float(down_n.sum())
    area = float((down_n * (np.cumsum(down_p) - down_p / 2)).sum())
    return {"n": n, "mse": squared / n, "pearson": (n * sxy - sx * sy) / math.sqrt(over) if over > 0 else None, "auroc": area / pairs if pairs else None, "ended": ended}


def running_metrics(predictions: DataFrame, key: str, gap: str = "1 hour", late: str = "1 hour", buckets: int = BUCKETS) -> DataFrame:
    """(key, n, mse, pearson, auroc, ended): for each key with new rows its metrics over all rows so far; once more, with ``ended``, when the key has had none for ``gap`` of event time.

    ``predictions``: a stream of key, ts, score (0 to 1) and label (0 or 1). Rows whose ts
    lies more than ``late`` behind the greatest seen in earlier batches are left out; a key
    that has ended is forgotten and begins anew with its next row. Rows with a null score or label don't
    count, rows with a null key are a key. The state of a key is of fixed size: sums, and the
    numbers of positives and negatives in ``buckets`` buckets of the score.
    """
    wait = int(pd.Timedelta(gap).total_seconds() * 1000)

    def run(of: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            found = _metrics(state.get, True)
            state.remove()
            yield pd.DataFrame([{"key": of[0]} | found])
            return
        now = list(state.get) if state.exists else [0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, [0] * buckets, [0] * buckets, 0]
        positives, negatives, before = np.array(now[7]), np.array(now[8]), now[0]
        for pdf in batches:
            # Spark itself lets rows pass that only the last batch has made late.
            pdf = pdf[pdf["ts"].map(lambda t: t.timestamp() * 1000) >= state.getCurrentWatermarkMs()]
            if not len(pdf):
                continue
            x, y = pdf["score"].to_numpy(float), pdf["label"].to_numpy(float)
            now[0] += len(x)
            for i, more in enumerate((x.sum(), y.sum(), x @ x, y @ y, x @ y, ((x - y) ** 2).sum()), 1):
                now[i] += float(more)
            bucket = np.minimum(np.floor(x * buckets).astype(int), buckets - 1)
            positives += np.bincount(bucket[y > 0], minlength=buckets)
            negatives += np.bincount(bucket[y <= 0], minlength=buckets)
            now[9] = max(now[9], int(pdf["ts"].max().timestamp() * 1000))
        if now[0] == before:
            return
        now[7], now[8] = positives.tolist(), negatives.tolist()
        state.update(tuple(now))
        state.setTimeoutTimestamp(max(now[9] + wait, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([{"key": of[0]} | _metrics(tuple(now), False)])

    rows = predictions.select(F.col(key).alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("score").cast("double").alias("score"), F.col("label").cast("double").alias("label"))
    rows = rows.where("score IS NOT NULL AND label IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", late)
    kind = dict(predictions.dtypes)[key]
    out = rows.groupBy("key").applyInPandasWithState(run, f"key {kind}, {METRICS}", STATE, "update", GroupStateTimeout.EventTimeTimeout)
    return out.withColumnRenamed("key", key)


def metrics_so_far(predictions: DataFrame, key: str, buckets: int = BUCKETS) -> DataFrame:
    """What running_metrics says of a table at its end: (key, n, mse, pearson, auroc)."""
    rows = predictions.where("score IS NOT NULL AND label IS NOT NULL AND ts IS NOT NULL").withColumn("task", F.col(key))
    x, y = F.col("score").cast("double"), F.col("label").cast("double")
    error: Column = (x - y) * (x - y)
    sums = rows.groupBy("task").agg(F.count(F.lit(1)).alias("n"), F.avg(error).alias("mse"), F.corr(x, y).alias("pearson"))
    areas = running_auc(running_score_buckets(rows, buckets)).withColumnRenamed("task", "_task")
    return sums.join(areas, F.col("task").eqNullSafe(F.col("_task")), "left").select(F.col("task").alias(key), "n", "mse", "pearson", "auroc")


def replayed(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Run until the source is used up; each batch's rows are written below ``path`` with the number of their batch, over what a failed attempt may have left."""

    def keep(rows: DataFrame, batch: int) -> None:
        rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{path}/part={batch}")

    stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
