"""Fast similarity sketches, and near-duplicates by them against plain loops."""

import random
from fractions import Fraction

import numpy as np
import pytest

from strandweave.llm import blocks, minhash


@pytest.mark.parametrize("n", [1, 2, 5, 40, 300, 5000])
def test_every_coordinate_is_filled(n):
    rng = np.random.default_rng(n)
    sketch, elements = minhash.FastSketch(), np.unique(rng.integers(0, 1 << 63, n, np.uint64))
    whole = sketch.of(elements)
    assert (whole != minhash._EMPTY).all() and (whole >> np.uint64(32) < 2 * minhash.SIZE).all()
    sketch.enough = n  # one round at a time
    assert (sketch.of(elements) == whole).all() and (sketch.of(elements[::-1].copy()) == whole).all()
    # Each round's value is the least of the shingles that fall into the bin: a plain loop.
    for bin_, value in list(enumerate(whole))[:: minhash.SIZE // 6]:
        for i in range(2 * minhash.SIZE):
            h = minhash._mixed(elements * sketch.factors[i] + sketch.terms[i])
            at = (h >> np.uint64(32)) * np.uint64(minhash.SIZE) >> np.uint64(32) == bin_ if i < minhash.SIZE else np.full(len(h), i - minhash.SIZE == bin_)
            if at.any():
                assert value == (h[at] & np.uint64(0xFFFFFFFF)).min() | np.uint64(i) << np.uint64(32)
                break


def test_agreement_concentrates():
    rng, sketch, shares = np.random.default_rng(1), minhash.FastSketch(), []
    for n in [5, 10, 100, 1000] * 40:  # 4 of 5: exactly 0.8
        common, a, b = (rng.integers(0, 1 << 63, k, np.uint64) for k in (n * 8 // 10, n // 10, n // 10)) if n > 5 else (rng.integers(0, 1 << 63, 4, np.uint64), rng.integers(0, 1 << 63, 1, np.uint64), np.zeros(0, np.uint64))
        shares.append((sketch.of(np.r_[common, a]) == sketch.of(np.r_[common, b])).mean())
    # Independent trials would have a standard deviation of 0.0258.
    assert abs(np.mean(shares) - 0.8) < 0.01 and np.std(shares) < 0.032 and min(shares) > 0.68


def shingles(text):
    w = [x for x in "".join(c.lower() if c.isascii() else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ") if x]
    return frozenset(tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))) if w else frozenset()


def brute(docs):
    sets, head = [shingles(t) for _, t in docs], list(range(len(docs)))

    def find(a):
        while head[a] != a:
            a = head[a]
        return a

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and 100 * len(a & b) >= 80 * len(a | b):
                head[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[find(i)] = min(least.get(find(i), (True, 0)), (d is None, d or 0))
    heads = [least[find(i)] for i in range(len(docs))]
    return [(d, len(sets[i]), None if heads[i][0] else heads[i][1]) for i, (d, _) in enumerate(docs)]


@pytest.mark.parametrize("block", [minhash.SIZE, 8])
def test_equals_loops(spark, monkeypatch, block):
    monkeypatch.setattr(blocks, "BLOCK", block)
    r = random.Random(block)
    docs = []
    for family in range(12):
        base = [f"W{r.randrange(10**6)}" for _ in range(r.choice([1, 3, 4, 6, 30, 90, 200]))]
        for _ in range(r.choice([1, 2, 9, 25])):
            words = list(base)
            for _ in range(r.randint(0, max(1, len(words) // 25))):
                words[r.randrange(len(words))] = f"x{r.randrange(10**6)}"
            docs.append((r.randrange(-(10**6), 10**6), r.choice([" ", "\n", "\v \t"]).join(words).swapcase()))
    docs += [(5, None), (6, ""), (7, " \n\t"), (8, " "), (9, "É x y z"), (10, "é x y z"), docs[0], docs[0], (None, docs[0][1]), (None, "nobody"), (None, "nobody"), ((1 << 62) + 9, "a b c d e"), (-(1 << 63), "A B C D E")]
    d = spark.createDataFrame([(i, t, 1, "r", 2) for i, t in docs], "doc_id long, text string, n_shingles int, rep string, block int").repartition(3)
    got = minhash.near_copies(d).collect()
    assert sorted(((x.doc_id, x.n_shingles, x.component_id) for x in got), key=repr) == sorted(brute(docs), key=repr)
    assert all(x.kept == (x.doc_id == x.component_id) for x in got if x.doc_id is not None)
    assert [x.kept for x in got if x.doc_id is None and x.component_id is None] == [True, True]


def test_a_hot_text_and_many_near_copies(spark):
    r = random.Random(8)
    base = [f"w{i}" for i in range(200)]
    docs = [(i, "the same words in every row") for i in range(2000)]
    for i in range(2000, 3000):
        words = list(base)
        for _ in range(3):
            words[r.randrange(len(words))] = f"x{r.randrange(10**6)}"
        docs.append((i, " ".join(words)))
    docs += [(5000, "the same words in this row"), (5001, None), (5002, None)]
    got = {x.doc_id: x.component_id for x in minhash.near_copies(spark.createDataFrame(docs, "doc_id long, text string").repartition(6)).collect()}
    assert {got[i] for i in range(2000)} == {0} and {got[i] for i in range(2000, 3000)} == {2000} and [got[i] for i in (5000, 5001, 5002)] == [5000, 5001, 5002]


def test_bound_is_exact(spark):
    """16 of 20 shingles shared is a link, 15 of 20 isn't."""
    w = [f"w{i}" for i in range(60)]
    near, far = w[:19] + ["p", "q"], w[:18] + ["p", "q", "r"]
    for other, linked in ((near, True), (far, False)):
        a, b = shingles(" ".join(w[:21])), shingles(" ".join(other))
        share = Fraction(len(a & b), len(a | b))
        got = minhash.near_copies(spark.createDataFrame([(1, " ".join(w[:21])), (2, " ".join(other))], "doc_id long, text string"), threshold=share if linked else share + Fraction(1, 1000)).collect()
        assert {x.component_id for x in got} == ({1} if linked else {1, 2})
