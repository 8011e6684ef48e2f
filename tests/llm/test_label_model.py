"""The generative label model against plain loops, and what the classifier learns from it."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandweave.llm import toxicity

MID = "/root/testdata/sf0.01"


def drawn(n, seed=1):
    """Votes of six voters: the first four speak for class 1, 1 follows 0 within the classes; the last two speak against."""
    r, out = random.Random(seed), {}
    for _ in range(n):
        y = r.random() < 0.25
        v = [r.random() < (0.6 if y else 0.05)]
        v.append(r.random() < ((0.9 if v[0] else 0.3) if y else (0.7 if v[0] else 0.02)))
        v += [r.random() < (0.5 if y else 0.04), r.random() < (0.4 if y else 0.03)]
        v += [r.random() < (0.02 if y else 0.4), r.random() < (0.05 if y else 0.3)]
        mask = sum(b << i for i, b in enumerate(v))
        out[mask] = out.get(mask, 0) + 1
    return out


def start():
    sums = np.zeros((2, 7, 7))
    sums[0, -1, -1], sums[1, -1, -1] = 0.9, 0.1
    sums[0, -1, :4], sums[1, -1, :4], sums[0, -1, 4:6], sums[1, -1, 4:6] = 0.09, 0.03, 0.2, 0.01
    return toxicity.maximised(1000 * sums, np.full(6, -1), 4, 0.25)


def chance(model, bits, y):
    """P(y, votes) by the definition."""
    p = model.prior if y else 1 - model.prior
    for j, b in enumerate(bits):
        parent = model.parents[j]
        rate = model.rates[y, int(bits[parent]) if parent >= 0 else 0, j]
        p *= rate if b else 1 - rate
    return p


@pytest.fixture(scope="module")
def votes(spark):
    counts = drawn(4000)
    return counts, spark.createDataFrame(list(counts.items()), "mask long, n long").repartition(3)


def test_moments_by_loops(votes):
    counts, frame = votes
    model = start()
    model.parents = np.array([-1, 0, -1, -1, -1, 4])
    model.rates[1, 1, 1] = 0.8
    sums, likelihood = toxicity.expected_moments(frame, model)
    expected, total = np.zeros((2, 7, 7)), 0.0
    for mask, n in counts.items():
        bits = [mask >> i & 1 for i in range(6)]
        joint = [chance(model, bits, y) for y in (0, 1)]
        total += n * math.log(sum(joint))
        for y in (0, 1):
            full = np.array([*bits, 1.0])
            expected[y] += n * joint[y] / sum(joint) * np.outer(full, full)
    assert np.allclose(sums, expected) and likelihood == pytest.approx(total)


def test_likelihood_grows_and_settles(votes):
    _, frame = votes
    model, seen = start(), []
    for _ in range(8):
        sums, likelihood = toxicity.expected_moments(frame, model)
        seen.append(likelihood)
        model = toxicity.maximised(sums, model.parents, 4)
    # Pseudo-counts and the rule on signs may cost a trace once it has settled.
    assert all(b >= a - 0.5 for a, b in itertools.pairwise(seen)) and seen[-1] > seen[0] + 10


def test_fit_finds_classes_and_dependence(votes, monkeypatch):
    counts, frame = votes
    monkeypatch.setattr(toxicity.maximised, "__defaults__", (4, None, None))
    model = toxicity.fit_label_model(frame, start())
    assert frozenset((0, 1)) in {frozenset((j, int(p))) for j, p in enumerate(model.parents) if p >= 0}
    assert model.prior == pytest.approx(0.25)
    marginal = lambda y, j: sum(chance(model, bits, y) for bits in itertools.product((0, 1), repeat=6) if bits[j]) / (model.prior if y else 1 - model.prior)
    # Half of what they started at, 0.3, and half of the votes' own 0.6, 0.5, 0.4.
    assert [marginal(1, j) for j in (0, 2, 3)] == pytest.approx([0.45, 0.4, 0.35], abs=0.06)
    assert [marginal(0, j) for j in (4, 5)] == pytest.approx([0.4, 0.3], abs=0.05)
    masks = np.array(list(counts))
    bits = toxicity.unpack(masks, 6)
    by_hand = [chance(model, b, 1) / (chance(model, b, 0) + chance(model, b, 1)) for b in bits.astype(int)]
    assert np.allclose(model.posterior(bits), by_hand)


def test_objective_by_loops_rises_in_every_round(votes, monkeypatch):
    """Each step taken raises the stated objective, which is recomputed here vote by vote; the sums are the same on the driver and in Spark."""
    counts, frame = votes
    monkeypatch.setattr(toxicity.maximised, "__defaults__", (4, None, None))
    heard = []
    model = toxicity.fit_label_model(frame, start(), heard)
    rounds = [list(g) for new, g in itertools.groupby(heard, lambda x: x is None) if not new]
    assert sum(map(len, rounds)) > 5 and all(b >= a for r in rounds for a, b in itertools.pairwise(r))
    first, n = start(), sum(counts.values())
    total = sum(k * math.log(sum(chance(model, [mask >> i & 1 for i in range(6)], y) for y in (0, 1))) for mask, k in counts.items())
    for y in (0, 1):
        for j in range(6):
            u = int(model.parents[j])
            for fires in (0, 1) if u >= 0 else (0,):
                texts = toxicity.PSEUDO + (y * toxicity.ANCHOR * n * first.shares[1]) * ((first.rates[1, 0, u] if fires else 1 - first.rates[1, 0, u]) if u >= 0 else 1)
                a, p = first.rates[y, 0, j], model.rates[y, fires, j]
                total += texts * (a * math.log(p) + (1 - a) * math.log(1 - p))
    total += toxicity.ANCHOR * n * first.shares[1] * math.log(model.shares[1])
    assert total == pytest.approx(rounds[-1][-1])
    monkeypatch.setattr(toxicity, "MASKS_AT_HAND", 0)
    again = toxicity.fit_label_model(frame, start())
    assert np.allclose(again.rates, model.rates) and (again.parents == model.parents).all()


def test_a_labelled_row_counts_once(spark):
    """k copies of a labelled text weigh k, not k times k."""
    rows = [(i, 0, "the same boilerplate") for i in range(91)] + [(100 + i, i % 2, f"other text {i} idiot") for i in range(90)]
    votes = toxicity.sample_votes(spark.createDataFrame(rows, "doc_id long, label int, text string"), toxicity.Voters()).collect()
    assert {(r.mask, r.label): r.n for r in votes} == {(0, 0): 91, (1, 0): 45, (1, 1): 45}


def test_voters_never_speak_against_their_class():
    sums = np.zeros((2, 7, 7))
    sums[:, -1, -1] = 100
    sums[0, -1, :6] = [50, 1, 1, 1, 1, 50]
    sums[1, -1, :6] = [10, 9, 9, 9, 9, 10]
    model = toxicity.maximised(sums, np.full(6, -1), 4)
    assert model.rates[0, 0, 0] == model.rates[1, 0, 0] and model.rates[0, 0, 4] == model.rates[1, 0, 4]
    assert model.rates[1, 0, 1] > model.rates[0, 0, 1] and model.rates[0, 0, 5] > model.rates[1, 0, 5]


@pytest.fixture(scope="module")
def fitted(spark):
    docs, labels = spark.read.parquet(f"{MID}/documents.parquet"), spark.read.parquet(f"{MID}/labels.parquet")
    return docs, labels, *toxicity.labelled_by_votes(docs, labels)


def test_predictions_follow_the_label_model(fitted):
    docs, _, names, voters, masks, label_model = fitted
    sample = toxicity.stored(toxicity.posterior_sample(masks, label_model), "t")
    real = toxicity.fit_classifier(docs, names, voters, sample, label_model.prior)
    flat = toxicity.fit_classifier(docs, names, voters, sample.withColumn("posterior", F.lit(label_model.prior)), label_model.prior)
    n = lambda m: toxicity.score(docs, m).where("toxicity >= 0.3").count()
    posterior = sample.where("posterior >= 0.5").count()
    assert n(flat) == 0 and 0.5 * posterior <= n(real) <= 2 * posterior


def test_posteriors_mark_toxic_documents(fitted):
    docs, labels, _, _, masks, label_model = fitted
    rows = masks.join(docs.select(F.xxhash64("text").alias("text_hash"), "doc_id"), "text_hash").join(labels, "doc_id").toPandas()
    p = label_model.posterior(toxicity.unpack(rows["mask"].to_numpy(np.int64)))
    assert ((p >= 0.5) & (rows["toxic"] == 0)).sum() <= 0.03 * (rows["toxic"] == 0).sum()
    assert ((p >= 0.5) & (rows["toxic"] == 1)).sum() >= 0.5 * (rows["toxic"] == 1).sum()


def test_sample_is_weighed_back(fitted, monkeypatch):
    _, _, _, _, masks, label_model = fitted
    monkeypatch.setattr(toxicity, "POSTERIORS_A_SIDE", 20)
    sample = toxicity.posterior_sample(masks, label_model).toPandas()
    p = label_model.posterior(toxicity.unpack(masks.where("usable").toPandas()["mask"].to_numpy(np.int64)))
    for side in (False, True):
        assert (sample["posterior"] >= 0.5).eq(side).sum() == 20
        assert sample.loc[(sample["posterior"] >= 0.5) == side, "weight"].sum() == pytest.approx(((p >= 0.5) == side).sum())


def test_kinds_of_toxic_texts_are_told_apart(spark):
    """Two kinds that share no voter, one much rarer: the rare one isn't taken for clean."""
    r, counts = random.Random(3), {}
    for _ in range(6000):
        u = r.random()
        rates = [0.6] * 5 + [0.0] * 3 if u < 0.1 else [0.0] * 5 + [0.7] * 3 if u < 0.115 else [0.003] * 8
        mask = sum((r.random() < p) << i for i, p in enumerate(rates))
        counts[mask] = counts.get(mask, 0) + 1
    sums = np.zeros((3, 9, 9))
    sums[:, -1, -1] = [90, 8, 2]
    sums[0, -1, :8], sums[1, -1, :5], sums[2, -1, 5:8] = 0.5, 4, 1
    start = toxicity.maximised(sums, np.full(8, -1))
    model = toxicity.fit_label_model(spark.createDataFrame(list(counts.items()), "mask long, n long"), start)
    bits = np.array([[1, 1, 0, 1, 0, 0, 0, 0], [0, 0, 0, 0, 0, 1, 1, 0], [0] * 8], float)
    assert (model.posterior(bits) > 0.9).tolist() == [True, True, False] and model.prior == pytest.approx(0.115, abs=0.02)


def test_groups_of_voters():
    at = len(toxicity.LEXICON)
    rows = np.zeros((4, toxicity.VOTERS))
    rows[0, [0, 1]] = rows[1, [1, 2]] = rows[2, [at, at + 1]] = 1
    rows[3, toxicity.TOXIC_VOTERS - 1] = 1
    assert toxicity.voter_groups(rows, np.array([9.0, 9, 4, 7])) == [[0, 1, 2], [at, at + 1]]


def test_toxic_documents_of_every_language(spark):
    """Not only those of the language of the lexicon."""
    data = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    rows = toxicity.toxicity_scores(docs, labels).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").join(labels, "doc_id").toPandas()
    assert rows[rows.toxic == 0].predicted.mean() <= 0.01
    for lang, part in rows[rows.toxic == 1].groupby("lang"):
        assert part.predicted.mean() >= 0.6, lang


def test_repeated_stems():
    voters = toxicity.Voters(["+abc", "=abcx"])
    voters.prepare()
    at = len(toxicity.LEXICON)
    assert voters.mask("abcd abce abcd") == 0 and voters.mask("abcd abce, abcf") == 1 << at and voters.mask("abcx") == 2 << at
    model = toxicity.ToxicityModel({"+abc": 1.0, "=abcx": 1.0}, 0.0)
    model.prepare()
    for text in ("abcd abce abcd", "abcd abce, abcf", "abcx abcy abcz"):
        assert model.present(text) == {i for i, n in enumerate(model.places) if n in toxicity.names_in(text)}


def test_votes_of_patterns():
    voters = toxicity.Voters(["=qqq"], ["=zzz"])
    voters.prepare()
    bits = lambda text: {i for i in range(toxicity.VOTERS) if voters.mask(text) >> i & 1}
    at = len(toxicity.LEXICON) + toxicity.STEM_VOTERS
    assert bits("nothing here") == set() and bits("You IDIOT") == {0, at + 1} and bits("no!! nooooo w*t") == {at, at + 2, at + 3}
    assert bits("qqq zzz") == {len(toxicity.LEXICON), toxicity.TOXIC_VOTERS}
    assert max(bits("10 km https://x Copyright")) == toxicity.VOTERS - 1 and toxicity.VOTERS < 63
