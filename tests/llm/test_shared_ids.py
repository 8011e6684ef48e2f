"""Different texts under one doc_id stay different documents."""

import random
from collections import Counter

from strandweave.llm import jaccard


def text_of(r):
    return " ".join(f"w{r.randrange(10**6)}" for _ in range(40))


def test_texts_under_one_id(spark):
    r = random.Random(1)
    hot = [text_of(r) for _ in range(30)]
    near = [t + " tail" for t in hot[:10]]
    rows = [(0, t) for t in hot + near] + [(0, hot[0])] + [(7, hot[29]), (8, hot[28].upper())] + [(i, text_of(r)) for i in range(20, 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = [x.text for x in jaccard.one_of_each(docs).collect()]
    assert len(kept) == 40
    classes = Counter(t.lower().removesuffix(" tail") for t in kept)
    assert set(classes.values()) == {1}
    assert set(classes) == {t.lower().removesuffix(" tail") for _, t in rows}
    links = Counter(x.n_links for x in jaccard.near_duplicates(docs).collect())
    # hot[0] twice with one near text; nine pairs; two exact pairs; eighteen and ten alone.
    assert links == Counter({2: 3, 1: 18 + 4, 0: 18 + 10})


def test_rows_repeated_very_often(spark, monkeypatch):
    r = random.Random(4)
    same, near = text_of(r), text_of(r)
    rows = [(1, same)] * 1500 + [(1, same + " tail"), (2, near), (3, near + " tail"), (4, text_of(r))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(x.text for x in jaccard.one_of_each(docs).collect()) == sorted([same if jaccard_head(docs, 1) else same + " tail", near, rows[-1][1]])
    links = Counter(x.n_links for x in jaccard.near_duplicates(docs).collect())
    assert links == Counter({1500: 1501, 1: 2, 0: 1})


def jaccard_head(docs, doc_id):
    """Whether the repeated text, not the near one, leads the class: the order of equal identifiers is that of their text hashes."""
    hashes = docs.where(f"doc_id = {doc_id}").selectExpr("text LIKE '% tail' AS near", "xxhash64(text) AS h").distinct().orderBy("h").first()
    return not hashes.near


def test_two_texts_in_two_classes_under_one_id(spark):
    r = random.Random(9)
    a, b = text_of(r), text_of(r)
    docs = spark.createDataFrame([(1, a), (1, b), (2, a), (3, b)], "doc_id long, text string")
    out = jaccard.near_duplicates(docs).collect()
    assert len({x.class_key for x in out}) == 2 and sorted(x.text for x in jaccard.one_of_each(docs).collect()) == sorted([a, b])


def test_any_identifier_is_one(spark):
    """Identifiers at the ends of 64 bits stay apart from rows without one."""
    r = random.Random(3)
    a, b, c = text_of(r), text_of(r), text_of(r)
    ids = [(1 << 62) + 5, (1 << 63) - 1, -(1 << 63)]
    rows = [*zip(ids, (a, b, c), strict=True), (None, a), (None, b + " tail"), (None, "alone " * 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = jaccard.near_duplicates(docs).collect()
    assert sorted(x.doc_id for x in out if x.doc_id is not None) == sorted(ids)
    classes = {x.doc_id: x.class_id for x in out if x.doc_id is not None}
    assert all(classes[i] == i for i in ids)
    assert sum(x.keep for x in out) == 4 and sorted(x.text for x in jaccard.one_of_each(docs).collect()) == sorted([a, b, c, rows[-1][1]])
