"""The matched prefix is shortened by prediction and measurement; a recall that the trees can't reach is an error."""

import random
from collections import Counter

import pytest

from strandweave.llm import blocks, jaccard


def test_depth_or_error():
    assert jaccard.matched_depth(0.8) == 8
    with pytest.raises(ValueError, match="recall"):
        jaccard.matched_depth(0.1)


def test_measurement_shortens_the_prefix():
    s = 0.8
    assert jaccard.matched_depth(s, measured=[1.0] * jaccard.DEEPEST) == 8
    assert jaccard.matched_depth(s, measured=[1.0] * 7 + [0.99] * 3) == 7
    assert jaccard.matched_depth(s, 0.95) == jaccard.DEEPEST
    assert jaccard.matched_depth(s, 0.95, measured=[1.0] * 6 + [0.9] * 4) == 6


def test_paths_share_what_the_sorted_labels_share(spark):
    """The walk over ranges finds for each path the longest prefix that it shares with any other, and neighbours that share it."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    classes = jaccard.stored(jaccard.exact_classes(jaccard.signatures(docs, jaccard.WORDS)), "t")
    found = jaccard.trie_paths(classes, 3).toPandas()
    size, deepest = jaccard.DEEPEST * jaccard.VALUE, jaccard.DEEPEST
    every = [(t, bytes(r.signature)[t * size : (t + 1) * size], r.rep.uid) for r in classes.where("n_shingles > 0").collect() for t in range(jaccard.TREES)]

    def sharers(depth):
        counts = Counter((t, label[: depth * jaccard.VALUE]) for t, label, _ in every)
        return {(t, u) for t, label, u in every if counts[t, label[: depth * jaccard.VALUE]] > 1}

    for depth in (3, 6, 8, deepest):
        walked = {(r.tree, r.uid) for r in found[found.depth >= depth].itertuples()}
        assert sharers(depth) <= walked and len(walked - sharers(depth)) <= 2 * 4  # the ends of four ranges
    assert found.next_uid.notna().sum() > 0


def test_recall_on_pairs_of_the_corpus(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    classes = jaccard.stored(jaccard.exact_classes(jaccard.signatures(docs, jaccard.WORDS)), "t")
    found = jaccard.measured_recall(docs, jaccard.stored(jaccard.trie_paths(classes, 6), "t"), jaccard.WORDS, jaccard.THRESHOLD)
    assert len(found) == jaccard.DEEPEST and found == sorted(found, reverse=True) and found[5] == 1.0
    apart = spark.createDataFrame([(1, "a b c"), (2, "d e f")], "doc_id long, text string")
    classes = jaccard.stored(jaccard.exact_classes(jaccard.signatures(apart, 5)), "t")
    assert jaccard.measured_recall(apart, jaccard.stored(jaccard.trie_paths(classes, 6), "t"), 5, jaccard.THRESHOLD) is None


def test_a_long_chain_costs_what_its_links_cost(spark):
    """Texts that overlap with their neighbours only: one group, but each text is compared with few blocks."""
    r = random.Random(2)
    words = [f"w{r.randrange(10**7)}" for _ in range(100 + 6 * 3000)]
    rows = [(i, " ".join(words[6 * i : 6 * i + 100])) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    classes = jaccard.stored(jaccard.exact_classes(jaccard.signatures(docs, 5)), "t")
    nodes = jaccard.stored(jaccard.matched_nodes(classes, jaccard.trie_paths(classes, 6), jaccard.matched_depth(0.8)), "t")
    groups = blocks.components(nodes.where("rep <> first").selectExpr("rep AS u", "first AS v"))
    layout = jaccard.stored(blocks.block_layout(classes, groups, jaccard.first_label()), "t")
    assert layout.select("component").distinct().count() <= 3
    met = [len(x.others) for x in blocks.reached_blocks(nodes, layout).collect()]
    assert layout.select("block").distinct().count() >= 8 and sum(met) <= 8 * len(rows)
    got = {x.doc_id: x for x in jaccard.near_duplicates(docs).collect()}
    # 90 of 102 shingles are shared with the next text, 84 of 108 with the one after it.
    assert all(got[i].n_links == (1 if i in (0, 2999) else 2) and got[i].class_id == 0 for i in range(3000))
