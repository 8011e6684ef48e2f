"""Matched nulls in one pass: sizes by cell, no row twice, and the comparison against plain medians."""

import random
import statistics
from collections import Counter

import pytest

from strandweave.operators import nulls


@pytest.fixture(scope="module")
def tables(spark):
    r = random.Random(3)
    targets = [(m, i, r.randint(2, 9), r.randint(0, 40)) for m in ("a", "b") for i in range(40)]
    # A third of the background shares one value of both measures; some lie outside all bins or lack a measure.
    background = [(m, i, 5 if i % 3 == 0 else r.randint(0, 12), 20 if i % 3 == 0 else r.choice([None, *range(0, 50)])) for m in ("a", "b") for i in range(1000, 1600)]
    values = [(i, s, r.choice([None, r.random(), float(i % 7)])) for i in [*range(40), *range(1000, 1600)] for s in ("x", "y")]
    schema = "item string, id long, score long, gc long"
    return targets, background, values, spark.createDataFrame(targets, schema).repartition(3), spark.createDataFrame(background, schema).repartition(3), spark.createDataFrame(values, "id long, measure string, value double")


def quantiles(xs, n):
    xs = sorted(xs)
    out = []
    for i in range(n + 1):
        at = i / n * (len(xs) - 1)
        low = int(at)
        out.append(xs[low] + (at - low) * (xs[min(low + 1, len(xs) - 1)] - xs[low]))
    return out


def cell(row, edges):
    out = []
    for v, e in zip(row[2:], edges[row[0]], strict=True):
        if v is None or not e[0] <= v <= e[-1]:
            return None
        out.append(min(sum(x <= v for x in e) - 1, len(e) - 2))
    return (row[0], *out)


def test_draws_and_comparison(tables):
    targets, background, values, t, b, v = tables
    drawn = nulls.matched_nulls(t, b, "item", "id", ["score", "gc"], 4, 30)
    edges = {m: [quantiles([x[k] for x in targets if x[0] == m], 4) for k in (2, 3)] for m in ("a", "b")}
    wanted = Counter(c for x in targets if (c := cell(x, edges)))
    cells = {(x[0], x[1]): cell(x, edges) for x in background}
    sizes = Counter(c for c in cells.values() if c)
    rows = drawn.collect()
    assert len({(x.item, x.id) for x in rows}) == len(rows) and all(len(set(x.nulls)) == len(x.nulls) for x in rows)
    got = Counter((cells[x.item, x.id], k) for x in rows for k in x.nulls)
    assert got == {(c, k): min(n, sizes[c]) for c, n in wanted.items() if sizes[c] for k in range(30)}

    value = {(i, s): y for i, s, y in values if y is not None}
    out = {(x.item, x.measure): x for x in nulls.compared(t, drawn, v, "item", "id", "measure", "value").collect()}
    assert out.keys() == {(m, s) for m in "ab" for s in "xy"}
    for (m, s), x in out.items():
        seen = [value[i, s] for item, i, *_ in targets if item == m and (i, s) in value]
        medians = [statistics.median(value[y.id, s] for y in rows if y.item == m and k in y.nulls and (y.id, s) in value) for k in range(30)]
        assert (x.n, x.n_nulls) == (len(seen), 30)
        assert (x.observed, x.p, x.null_median) == pytest.approx((statistics.median(seen), sum(y >= statistics.median(seen) for y in medians) / 30, statistics.median(medians)))


def test_each_row_is_drawn_alike(spark):
    """One cell of 200 rows, 20 wanted: over 128 nulls each row is in about 12.8, and two nulls share about 2."""
    t = spark.createDataFrame([("a", i, 1) for i in range(20)], "item string, id long, score long")
    b = spark.createDataFrame([("a", i, 1) for i in range(200)], "item string, id long, score long")
    sets = Counter()
    members = {}
    for x in nulls.matched_nulls(t, b, "item", "id", ["score"], 1, 128).collect():
        sets[x.id] = len(x.nulls)
        for k in x.nulls:
            members.setdefault(k, set()).add(x.id)
    assert sum(sets.values()) == 128 * 20 and len(sets) == 200 and max(sets.values()) < 30
    shared = [len(members[i] & members[j]) for i in members for j in members if i < j]
    assert 1.8 < statistics.mean(shared) < 2.2


def test_nothing(spark):
    t = spark.createDataFrame([], "item string, id long, score long")
    assert nulls.matched_nulls(t, t, "item", "id", ["score"], 4, 5).collect() == []


def test_multipliers():
    assert nulls.multipliers(3) == [2147483647, 2147483629, 2147483587]


def test_rows_are_not_multiplied_by_nulls(tables, spark, monkeypatch):
    """drawn rows are spread over all partitions, met with their values and stored once each, not once a null."""
    *_, t, b, v = tables
    held = {}
    keep = nulls.stored
    monkeypatch.setattr(nulls, "stored", lambda df, name: held.setdefault(name, keep(df, name)))
    drawn = nulls.matched_nulls(t, b, "item", "id", ["score", "gc"], 4, 30)
    assert "REPARTITION_BY_NUM" in drawn._jdf.queryExecution().executedPlan().toString()
    rows = drawn.collect()
    assert sum(len(x.nulls) for x in rows) > 2 * len(rows)
    assert nulls.compared(t, drawn, v, "item", "id", "measure", "value").count() == 4
    assert held["null-values"].count() == 2 * len(rows)


def test_same_row_twice(spark):
    """Equal background rows are two rows of the cell: together they are in as many nulls as two others."""
    t = spark.createDataFrame([("a", i, 1) for i in range(3)], "item string, id long, score long")
    b = spark.createDataFrame([("a", i // 2, 1) for i in range(12)], "item string, id long, score long")
    rows = nulls.matched_nulls(t, b, "item", "id", ["score"], 1, 40).collect()
    assert len(rows) == 12 and Counter(k for x in rows for k in x.nulls) == {k: 3 for k in range(40)}


def test_medians(spark):
    """medians of overlapping nulls, with ties, far outliers, groups that are null and values that are missing."""
    r = random.Random(8)
    rows = [(g, r.choice([None, 3.0, r.random() * 9, 1e300, -1e300, float("inf")]), sorted(r.sample(range(20), r.randint(1, 5)))) for g in ("a", None) for _ in range(300)]
    rows.append(("one", 4.0, [7]))
    want = {}
    for g, x, ks in rows:
        for k in ks if x is not None else []:
            want.setdefault((g, k), []).append(x)
    found = nulls.medians(spark.createDataFrame(rows, "g string, x double, nulls array<int>").repartition(3), ["g"], "x").collect()
    assert {(x.g, x._null): x._m for x in found} == pytest.approx({k: statistics.median(xs) for k, xs in want.items()}) and len(found) == len(want)
