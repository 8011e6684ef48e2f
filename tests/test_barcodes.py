"""Near pairs and the greedy choice of codes against plain loops."""

import itertools
import random

import pytest

from strandweave.operators import barcodes


def apart(a, b):
    return sum(x != y for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize(("length", "distance", "alphabet"), [(6, 3, "ACGT"), (9, 4, "AC"), (5, 1, "AC"), (5, 5, "ACG"), (7, 2, "AC")])
def test_near_pairs_and_choice(spark, length, distance, alphabet):
    r = random.Random(length * distance)
    codes = [(i, "".join(r.choice(alphabet) for _ in range(length))) for i in r.sample(range(-500, 5000), 150)]
    frame = spark.createDataFrame([*codes, (9000, "AC"), (9001, None)], "id long, code string").repartition(4)
    near = sorted((a, b) for (a, x), (b, y) in itertools.combinations(sorted(codes), 2) if apart(x, y) < distance)
    found = barcodes.near_pairs(frame, "id", "code", length, distance)
    assert sorted((p.low, p.high) for p in found.collect()) == near
    chosen = []
    for i, code in sorted(codes):
        if all(apart(code, c) >= distance for _, c in chosen):
            chosen.append((i, code))
    assert sorted(map(tuple, barcodes.distant_codes(frame, "id", "code", length, distance).collect())) == chosen


def test_a_run_of_codes_that_wait_for_one_another(spark):
    """0 keeps 1 out, which lets 2 in, and so on."""
    pairs = spark.createDataFrame([(i, i + 1) for i in range(7)], "low long, high long")
    assert sorted(r.number for r in barcodes.greedy_rejects(pairs).collect()) == [1, 3, 5, 7]
    assert barcodes.greedy_rejects(pairs.limit(0)).collect() == []
    with pytest.raises(RuntimeError, match="settle"):
        barcodes.greedy_rejects(pairs, most_rounds=2)


def test_segments():
    assert barcodes.segment_bounds(8, 3) == [(0, 2), (2, 3), (5, 3)] and barcodes.segment_bounds(3, 3) == [(0, 1), (1, 1), (2, 1)]
    with pytest.raises(ValueError, match="apart"):
        barcodes.segment_bounds(2, 3)
    assert barcodes.segment_size(0) == 3 and barcodes.segment_size(4**9) == 7
