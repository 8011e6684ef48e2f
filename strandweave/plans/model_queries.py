"""Queries of scoring, ensembles and baselines."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import layers as ly
from ..operators import models as mo
from .proxies import CUBE, SEQ_SQL, cube, seqs, table

QUERIES, ORACLES = {}, {}


def _linear():
    """A model with fixed weights: place + 1 over a hundred."""
    weights = (np.arange(64) + 1) / 100
    return lambda batch: np.stack([np.stack(batch["embedding"].to_numpy()).astype(float) @ weights, -np.stack(batch["embedding"].to_numpy()).astype(float) @ weights], axis=1)


def model_scores(spark, d):
    """L6, 2.17: scores of a pluggable model."""
    out = mo.score(table(spark, d, "embeddings"), _linear, ["embedding"], "logits")
    return out.select("vec_id", F.round(F.get("logits", 0), 4).alias("logit"))


def ensemble_mean(spark, d):
    """Mean of three models with its interval."""
    c = cube(spark, d).select("vec_id", "dim", F.col("value").cast("double").alias("value"))
    runs = [c.withColumn("value", F.col("value") * k) for k in (1, 2, 3)]
    out = mo.ensemble(runs, ["vec_id", "dim"], "value")
    return out.select("vec_id", "dim", *[F.round(x, 5).alias(x) for x in ("value", "low", "high")])


def forest_baseline(spark, d):
    """Random forest on array features, trained on four fifths of the rows."""
    e = table(spark, d, "embeddings").withColumn("label", F.col("label").cast("double"))
    out = mo.random_forest(e.where("vec_id % 5 <> 0"), e.where("vec_id % 5 = 0"), "embedding", "label", trees=20)
    return out.select("vec_id", "label", "prediction")


#: A scorer of two filters of three bases, rectified, averaged and weighed; weights are quarters, so sums are exact.
FILTERS = np.array([[[0.5, -0.25, 0.0, -0.5], [0.25, 0.75, -0.25, -0.5], [-0.5, 0.25, 0.5, 0.0]], [[-0.25, 0.5, -0.5, 0.75], [0.0, -0.5, 0.75, 0.25], [0.5, -0.25, 0.0, -0.75]]])
SHIFTS, OUT, OUT_SHIFT = (-0.25, 0.25), (1.5, -0.75), 0.25
SCORER = [ly.Conv(FILTERS, np.array(SHIFTS)), ly.Relu(), ly.Mean(), ly.Dense(np.array([OUT]), np.array([OUT_SHIFT]))]


def sequence_importances(spark, d):
    """Whole texts through a layered scorer and back: output, sum of gradient times input, the strongest place and how many speak for the task."""
    out = ly.with_importances(seqs(spark, d).withColumn("n", F.length("seq")), SCORER, "seq")
    # Times the number of windows they are sums of quarters of sixteenths, so equal ones are equal in any order of adding.
    i = F.transform("importances", lambda x: F.round(x * F.greatest(F.col("n") - 2, F.lit(1)), 6))
    out = out.withColumn("i", i)
    top, windows = F.array_max("i"), F.coalesce(F.greatest(F.col("n") - 2, F.lit(1)), F.lit(1))
    # Sums of such numbers are exact, and so the quotient is the one that SQL rounds; likewise for the output.
    total = F.aggregate("i", F.lit(0.0), lambda a, x: a + x) / windows
    logit = F.round((F.col("logit") - OUT_SHIFT) * windows, 6) / windows + OUT_SHIFT
    return out.select("doc_id", F.round(logit, 6).alias("logit"), F.round(total, 6).alias("sum"), top.alias("top"), F.array_position("i", top).alias("place"), F.size(F.filter("i", lambda x: x > 0)).cast("long").alias("n_for"))


def multiplier_importances(spark, d):
    """Multipliers against two shuffles of each whole text and mean gradients along the way from nothing; the first sum to the difference from the shuffles' outputs (tested against loops, no SQL twin)."""
    keys = F.array(*[F.concat_ws(":", F.col("doc_id").cast("string"), F.lit(str(k)), F.lit("shuffle")) for k in (1, 2)])
    windows = F.coalesce(F.greatest(F.length("seq") - 2, F.lit(1)), F.lit(1))
    s = seqs(spark, d).select("doc_id", "seq", windows.alias("windows"), keys.alias("keys"))
    both = ly.importance_totals(s, SCORER, "seq", {"against": "multipliers", "along": "path"}, shuffles="keys", steps=8)
    # Times the number of windows all are sums of 128ths, which have seven places, so equal ones are equal in any order of adding.
    return both.select("doc_id", *[F.round(F.round(F.col(c) * F.col("windows"), 7) / F.col("windows"), 6).alias(c) for c in ("logit", "against", "along")])


def trained_scorer(spark, d):
    """A scorer with a hidden layer trained on two tasks of the embeddings under the positives-focused loss, with early stopping; logits of all rows (tested against a loop, no SQL twin)."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding", (F.col("label") % 2).alias("a"), (F.col("label") % 3 == 0).cast("int").alias("b"))
    valid = F.pmod(F.xxhash64("vec_id"), F.lit(5)) == 0
    rng = np.random.default_rng(1)
    start = [ly.Mean(), ly.Dense(rng.normal(size=(8, 64)) / 8, np.zeros(8)), ly.Relu(), ly.Dense(rng.normal(size=(2, 8)) / 3, np.zeros(2))]
    task, positive = ly.task_weights(e.where(~valid), ["a", "b"])
    network, _ = ly.trained(e.where(~valid), e.where(valid), start, ly.one_place, "embedding", ["a", "b"], ly.Loss(positive=positive, task=task), rounds=10, rate=0.05)
    out = mo.score(e, lambda: lambda batch: np.stack([ly.activations(network, ly.one_place(x))[-1] for x in batch["embedding"]]), ["embedding"], "logits")
    return out.select("vec_id", "a", "b", *[F.round(F.get("logits", k), 6).alias(f"logit_{t}") for k, t in enumerate("ab")])


#: The scorer above in SQL: the filters' values at each place, and from those that pass the rectifier the importance of each base.
_CELLS = ", ".join(f"({f}, {w}, '{'ACGT'[b]}', {FILTERS[f, w, b]}::DOUBLE)" for f in range(2) for w in range(3) for b in range(4))
IMPORTANCES = f"""WITH seqs AS ({SEQ_SQL}), cells(f, w, base, v) AS (VALUES {_CELLS}), outs(f, shift, weight) AS (VALUES (0, {SHIFTS[0]}::DOUBLE, {OUT[0]}::DOUBLE), (1, {SHIFTS[1]}, {OUT[1]})),
  letters AS (SELECT doc_id, length(seq) AS len, unnest(range(0, length(seq))) AS p, unnest(string_split(seq, '')) AS base FROM seqs WHERE length(seq) > 0),
  touched AS (SELECT l.doc_id, l.len, l.p, l.p - w AS spot, f, v FROM letters l JOIN cells c ON l.base = c.base WHERE l.p - w >= 0 AND l.p - w <= l.len - 3),
  sums AS (SELECT doc_id, spot, f, sum(v) AS s FROM touched GROUP BY ALL),
  places AS (SELECT l.doc_id, p AS spot, o.f, l.len, o.weight, coalesce(s.s, 0) + o.shift AS value FROM letters l CROSS JOIN outs o LEFT JOIN sums s ON s.doc_id = l.doc_id AND s.spot = l.p AND s.f = o.f WHERE l.p <= l.len - 3),
  logits AS (SELECT doc_id, sum(weight * greatest(value, 0)) / any_value(len - 2) + {OUT_SHIFT} AS logit FROM places GROUP BY doc_id),
  each AS (SELECT t.doc_id, t.p, sum(t.v * x.weight) AS v FROM touched t JOIN places x ON x.doc_id = t.doc_id AND x.spot = t.spot AND x.f = t.f WHERE x.value > 0 GROUP BY ALL),
  whole AS (SELECT l.doc_id, l.p, l.len, round(coalesce(e.v, 0), 6) AS v FROM letters l LEFT JOIN each e ON e.doc_id = l.doc_id AND e.p = l.p)
SELECT s.doc_id, round(coalesce(logit, {OUT_SHIFT}), 6) AS logit, round(coalesce(sum(v), 0) / greatest(any_value(length(seq)) - 2, 1), 6) AS sum, max(v) AS top, (arg_min(p, (-v, p)) + 1)::BIGINT AS place, count(*) FILTER (v > 0) AS n_for
FROM seqs s LEFT JOIN logits g ON g.doc_id = s.doc_id LEFT JOIN whole w ON w.doc_id = s.doc_id GROUP BY s.doc_id, logit"""

ORACLES["sequence_importances"] = IMPORTANCES
QUERIES |= {f.__name__: f for f in (sequence_importances, multiplier_importances, trained_scorer)}
QUERIES |= {f.__name__: f for f in (model_scores, ensemble_mean, forest_baseline)}
ORACLES["model_scores"] = f"SELECT vec_id, round(sum(value::DOUBLE * dim / 100), 4) AS logit FROM ({CUBE}) GROUP BY vec_id"
ORACLES["ensemble_mean"] = f"SELECT vec_id, dim, round(avg(v * k), 5) AS value, round(avg(v * k) - 2.576 * stddev_pop(v * k) / sqrt(3), 5) AS low, round(avg(v * k) + 2.576 * stddev_pop(v * k) / sqrt(3), 5) AS high FROM (SELECT vec_id, dim, value::DOUBLE AS v FROM ({CUBE})), (VALUES (1), (2), (3)) t(k) GROUP BY ALL"
