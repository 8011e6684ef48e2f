"""Steps whose tasks must not grow with the table: rows spread over all partitions, groups cut into ranges, files into parts."""

import random

import numpy as np

from strandweave.functions import sequences as fx
from strandweave.operators import intervals, stats
from strandweave.plans import stacks
from strandweave.sources import readers


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_merged_rows_are_spread(spark):
    """the sorts of a stretch's rows are those of one of all partitions, at any size of the table."""
    r = random.Random(4)
    rows = [("c", s, s + r.randrange(1, 90_000 if i == 7 else 40)) for i, s in enumerate(r.randrange(300_000) for _ in range(3000))]
    merged = intervals.merge(spark.createDataFrame(rows, "chrom string, start long, stop long"))
    assert "REPARTITION_BY_NUM" in plan(merged)
    want = []
    for _, a, b in sorted(rows):
        if want and a <= want[-1][1]:
            want[-1] = (want[-1][0], max(b, want[-1][1]), want[-1][2] + 1)
        else:
            want.append((a, b, 1))
    assert sorted((x.start, x.stop, x.n) for x in merged.collect()) == want


def test_fasta_in_parts_of_few_lines(spark, tmp_path, monkeypatch):
    """records that reach over several parts of a block, and parts with several records."""
    r = random.Random(6)
    seqs = {f"s{i}": "".join(r.choice("ACGT") for _ in range(n)) for i, n in enumerate([5, 700, 61, 120, 1, 333])}
    lines = [line for k, s in seqs.items() for line in [f">{k} x", *[s[at : at + 60] for at in range(0, len(s), 60)]]]
    (tmp_path / "a.fa").write_text("\n".join(lines) + "\n")
    monkeypatch.setattr(readers, "LINES", 4)
    got = {}
    for x in sorted(readers.read_fasta(spark, str(tmp_path / "a.fa"), 50).collect(), key=lambda x: x.chunk):
        got[x.chrom] = got.get(x.chrom, "") + x.seq
    assert got == seqs


def test_interpolation_by_ranges(spark):
    """no group's rows are one task's; points of the curve are found over empty ranges."""
    r = np.random.default_rng(3)
    xs = np.sort(r.normal(size=5))
    values = spark.createDataFrame([("k", float(v)) for v in [*r.normal(size=400), *xs, -9.0, 9.0]] + [("other", 0.5), ("k", None)], "g string, v double")
    curve = spark.createDataFrame([("k", float(x), float(i * i)) for i, x in enumerate(xs)], "g string, x double, y double")
    out = stats.interpolated(values, curve, ["g"], "v", "x", "y", "m")
    assert "hashpartitioning(g" in plan(out) and "_range" in plan(out).split("Window", 1)[1]
    for row in out.collect():
        if row.g == "k" and row.v is not None:
            assert abs(row.m - np.interp(row.v, xs, np.arange(5.0) ** 2)) < 1e-9
        elif row.g == "other":
            assert row.m is None


def test_texts_of_one_length_are_shuffled_together(spark):
    """the same shuffles as one by one, and one pass over the fragments for all three kinds."""
    r = random.Random(8)
    texts = [None, "", *["".join(r.choice("ACGT") for _ in range(n)) for n in [60] * 30 + [7, 7, 61, 1]]]
    keys = [None if i % 9 == 5 else f"k{i}" for i in range(len(texts))]
    want = [t if t is None or k is None else fx.shuffled_blocks(t, k) for t, k in zip(texts, keys, strict=True)]
    assert fx.shuffled_texts(texts, keys) == want
    frame = spark.createDataFrame([(k or "x", t) for t, k in zip(texts, keys, strict=True)], "id string, s string")
    assert plan(stacks.library_controls(frame, "id", "s", "ACGTAA", 20, 30)).count("Scan") == 1
