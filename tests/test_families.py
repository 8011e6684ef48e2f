"""Agglomeration, order of leaves and reduction of motifs against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandweave.operators import families
from strandweave.operators.motifs import best_alignment, from_probabilities
from strandweave.sources import readers, writers


def loop(d, until=None):
    """Nearest pair by nearest pair: merges (left, right, d, n_left, n_right), and the order of each cluster's leaves."""
    d, size, order, out = d.copy(), dict.fromkeys(range(len(d)), 1), {i: [i] for i in range(len(d))}, []
    while len(size) > 1:
        near, i, j = min((d[a, b], a, b) for a in size for b in size if a < b)
        if until is not None and near > until:
            break
        for k in size:
            if k not in (i, j):
                n = size[i] + size[j] + size[k]
                d[i, k] = d[k, i] = ((size[i] + size[k]) * d[i, k] + (size[j] + size[k]) * d[j, k] - size[k] * near) / n
        out.append((i, j, near, size[i], size[j]))
        order[i] += order.pop(j)
        size[i] += size.pop(j)
    return out, order


def same(spark, d, until=None):
    n = len(d)
    pairs = spark.createDataFrame([(a, b, float(d[a, b])) for a in range(n) for b in range(a + 1, n)], "a long, b long, d double").repartition(3)
    merges, leaves = families.agglomerated(pairs, spark.range(n), "id", until)
    expected, order = loop(d, until)
    got = sorted(((r.left, r.right, r.n_left, r.n_right, r.d) for r in merges.collect()), key=lambda r: (r[4], r[:2]))
    assert [g[:4] for g in got] == [(i, j, a, b) for i, j, _, a, b in expected]
    assert [g[4] for g in got] == pytest.approx([e[2] for e in expected])
    assert {(r.cluster, r.place): r.item for r in leaves.collect()} == {(c, k): x for c, xs in order.items() for k, x in enumerate(xs)}
    return merges


@pytest.fixture(scope="module")
def motifs(tmp_path_factory):
    """Two hundred motifs of twenty kinds, from a file."""
    rng = np.random.default_rng(4)
    kinds = [rng.dirichlet([0.3] * 4, rng.integers(6, 12)) for _ in range(20)]
    made = [from_probabilities(f"m{i}", 0.9 * kinds[i % 20] + 0.1 * rng.dirichlet([1] * 4, len(kinds[i % 20]))) for i in range(200)]
    path = tmp_path_factory.mktemp("motifs") / "m.homer"
    writers.write_pwms(made, str(path))
    lines = [f">m{i}" if line.startswith(">") else line for i, line in _numbered(path.read_text().splitlines())]
    return readers.read_pwms(lines, probabilities=True)


def _numbered(lines):
    i = -1
    for line in lines:
        i += line.startswith(">")
        yield i, line


def test_two_hundred_motifs(spark, motifs):
    assert len(motifs) == 200
    like = families.similarities(spark, motifs).toPandas()
    assert len(like) == 19_900
    d = np.zeros((200, 200))
    d[like.a, like.b] = d[like.b, like.a] = 1 - like.r
    r = random.Random(1)
    for k in r.sample(range(19_900), 30):
        row = like.iloc[k]
        assert row.r == best_alignment(motifs[int(row.a)], motifs[int(row.b)])[0]
    merges = same(spark, d)
    signal = spark.createDataFrame([(i, float(i * 37 % 101)) for i in range(200)], "item long, signal double")
    alike = spark.createDataFrame(like[like.r >= 0.5][["a", "b"]])
    kept = {x.item for x in families.strongest_of_families(merges, alike, signal).collect()}
    stands, marked, close = {i: i for i in range(200)}, set(), set(map(tuple, like[like.r >= 0.5][["a", "b"]].to_numpy().tolist()))
    for i, j, *_ in loop(d)[0]:
        a, b = stands[i], stands.pop(j)
        if a is not None and b is not None and (min(a, b), max(a, b)) in close:
            stands[i] = b if b * 37 % 101 > a * 37 % 101 else a
        else:
            marked |= {a, b} - {None}
            stands[i] = None
    assert kept == marked | ({*stands.values()} - {None}) and 10 <= len(kept) < 150


def test_cut_ties_and_few_items(spark):
    points = np.array([0.0, 1, 10, 11, 30, 31.5, 100])
    d = (points[:, None] - points[None, :]) ** 2
    same(spark, d)
    assert same(spark, d, until=5).count() == 3
    square = np.array([[0, 1, 2, 1], [1, 0, 1, 2], [2, 1, 0, 1], [1, 2, 1, 0]], float)  # all neighbours equally near
    pairs = spark.createDataFrame([(a, b, float(square[a, b])) for a in range(4) for b in range(a + 1, 4)], "a long, b long, d double")
    merges, leaves = families.agglomerated(pairs, spark.range(4), "id")
    assert sorted((r.left, r.right) for r in merges.collect()) == [(0, 1), (0, 2), (2, 3)] and leaves.select("cluster").distinct().count() == 1
    none = pairs.limit(0)
    merges, leaves = families.agglomerated(none, spark.range(1), "id")
    assert merges.collect() == [] and [tuple(r) for r in leaves.collect()] == [(0, 0, 0)]
    merges, leaves = families.agglomerated(none, spark.range(0), "id")
    assert merges.collect() == [] and leaves.collect() == []
    one = families.strongest_of_families(merges, pairs.select("a", "b"), spark.range(1).select(F.col("id").alias("item"), F.lit(1.0).alias("signal")))
    assert [r.item for r in one.collect()] == [0]
