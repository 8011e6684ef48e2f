"""Importance resampling: CRC algebra against zlib, draws against plain loops."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandweave.llm import importance

SHIFTS = importance.Shifts()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=40) | st.binary(min_size=500, max_size=900), max_size=12), st.integers(1, 5))
def test_run_crcs_are_those_of_the_strings(words, n):
    found = list(importance.run_crcs(words, n, SHIFTS))
    for k, crcs in enumerate(found, 1):
        assert crcs.tolist() == [zlib.crc32(b" ".join(words[i : i + k])) for i in range(len(words) - k + 1)]
    assert len(found) == max(1, min(n, len(words)))


def brute(docs, target, max_n, buckets, min_words, percent, seed):
    def features(text):
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, max_n + 1) for i in range(len(w) - n + 1)]

    s, t = (Counter(b for x in texts for b in features(x)[1]) for texts in ([d[1] for d in docs], target))
    n_s, n_t = s.total() + buckets, t.total() + buckets
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * n_s / ((s[b] + 1) * n_t))) for b in s}
    out = []
    for doc_id, text in docs:
        n_words, f = features(text)
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n_words, None])
    ranked = sorted((r for r in out if r[4] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for k, r in enumerate(ranked[: len(ranked) * percent // 100], 1):
        r[5] = k
    return sorted((tuple(r) for r in out), key=repr)


@pytest.mark.parametrize("max_n", [1, 3])
def test_draws_equal_loops(spark, max_n):
    r = random.Random(max_n)
    vocabulary = [f"wörd{i}" for i in range(40)] + ["Big", "X9", "a-b", "ſ", "İ"]
    docs = [(i, " ".join(r.choices(vocabulary, k=r.choice([0, 3, 25, 60])))) for i in range(-20, 180)]
    docs += [(7, docs[30][1]), (7, docs[30][1]), (7, docs[31][1]), (None, docs[3][1]), (None, None), (900, None), (901, "\u0000 --- "), (902, "big " * 5000)]
    target = ["wörd1 wörd2 wörd1", None, "", "Big wörd3"]
    t = spark.createDataFrame([(x,) for x in target], "text string")
    d = spark.createDataFrame([(i, x, 1, 1, "u") for i, x in docs], "doc_id long, text string, weight int, score int, row string").repartition(4)
    scored = importance.importance_scores(d, t, max_n, 50)
    got = importance.drawn(scored, 30, 20).select("doc_id", "n_features", "weight", "score", "n_words", "rank").collect()
    assert sorted(map(tuple, got), key=repr) == brute(docs, target, max_n, 50, 20, 30, importance.SEED)
    kept = importance.resampled(d, t, max_n, 50, percent=30)
    assert kept.columns == d.columns
    assert Counter(x.doc_id for x in kept.collect()) == Counter(x[0] for x in brute(docs, target, max_n, 50, 20, 30, importance.SEED) if x[5])


def test_no_target_and_equal_rows(spark):
    none = spark.createDataFrame([], "text string")
    docs = spark.createDataFrame([(1, "w " * 30)] * 2000 + [(2, "v " * 30)], "doc_id long, text string").repartition(8)
    out = importance.drawn(importance.importance_scores(docs, none)).where("rank IS NOT NULL").collect()
    assert sorted(r["rank"] for r in out) == list(range(1, 201))
    assert importance.bucket_gains(np.zeros(3, np.int64), np.zeros(3, np.int64)).tolist() == [0, 0, 0]
