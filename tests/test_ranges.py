"""Values at wanted ranks and percentiles against numpy, with null keys, ties, hot groups and empty tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandweave.operators import ranges


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    groups = [("hot", 4000), ("small", 3), (None, 500), ("same", 200)]
    return [(g, 7.0 if g == "same" else r.choice([r.gauss(0, 1), float(r.randrange(4))])) for g, n in groups for _ in range(n)]


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "g string, x double").repartition(5)


def test_values_at_ranks(spark, rows, frame):
    wanted = [(g, k) for g in ("hot", "small", None, "same", "absent") for k in (1, 2, 3, 77, 200, 3999, 4000, 4001)]
    got = {(r.g, r["_r"]): r.x for r in ranges.at_ranks(frame, ["g"], "x", spark.createDataFrame(wanted, "g string, _r long")).collect()}
    expected = {}
    for g, k in wanted:
        mine = sorted(x for h, x in rows if h == g)
        if k <= len(mine):
            expected[g, k] = mine[k - 1]
    assert got == expected


def test_percentiles_and_kth_greatest(spark, rows, frame):
    shares = [0.0, 0.1, 0.5, 0.975, 1.0]
    for r in ranges.percentiles(frame.withColumn("x", F.when(F.rand(1) < 2, F.col("x"))), ["g"], "x", shares).collect():
        assert r.percentiles == pytest.approx(np.quantile([x for h, x in rows if h == r.g], shares).tolist())
    whole = ranges.percentiles(frame, [], "x", shares).collect()
    assert len(whole) == 1 and whole[0].percentiles == pytest.approx(np.quantile([x for _, x in rows], shares).tolist())
    k = spark.createDataFrame([("hot", 40), ("small", 9), (None, 1), ("same", 200), ("absent", 1)], "g string, k long")
    got = {r.g: r.t for r in ranges.kth_greatest(frame, ["g"], "x", k, "t").collect()}
    hot, none = sorted((x for h, x in rows if h == "hot"), reverse=True), max(x for h, x in rows if h is None)
    assert got == {"hot": hot[39], "small": 0.0, None: none, "same": 7.0, "absent": 0.0}


def test_empty(spark, frame):
    none = frame.limit(0)
    assert ranges.percentiles(none, ["g"], "x", [0.5]).collect() == []
    assert ranges.at_ranks(none, ["g"], "x", spark.createDataFrame([("a", 1)], "g string, _r long")).collect() == []
