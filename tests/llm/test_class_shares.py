"""The quality classifier keeps to the class shares of all labels when the bound on its sample binds."""

import random

import pandas as pd

from strandweave.llm import quality


def test_votes_keep_the_class_shares(spark, monkeypatch):
    r = random.Random(4)
    words = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(1500):
        kind = r.random()
        label = int(kind >= 0.1)
        told = ["spam", "spam", "click"] if kind < 0.05 else []  # half of the bad texts look like good ones
        rows.append((i, " ".join(r.choices(words, k=30) + told), label))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    share = sum(y for *_, y in rows) / len(rows)
    kept, right = {}, {}
    for bound in (quality.SAMPLE_A_CLASS, 60):
        monkeypatch.setattr(quality, "SAMPLE_A_CLASS", bound)
        held = quality.quality_scores(docs, labels).where("held_out").toPandas().merge(pd.DataFrame(rows, columns=["doc_id", "text", "label"]), on="doc_id")
        kept[bound], right[bound] = held.predicted.mean(), (held.predicted == held.label).mean()
        assert abs(held.score.mean() - share) < 0.08
    whole, bounded = kept.values()
    assert abs(whole - bounded) < 0.04
    assert min(right.values()) > 0.9


def test_weights_are_one_at_natural_shares():
    import numpy as np

    model = quality.QualityModel(np.zeros(1), np.zeros((1, 1)), np.eye(4), np.array([1.0, 1.0, 1.0, 0.0]), 0.75)
    assert np.allclose(model.vote_weights, 1)
    model.prior = 0.9
    model.weigh()
    assert np.isclose((model.vote_weights * model.labels).sum() / model.vote_weights.sum(), 0.9)
