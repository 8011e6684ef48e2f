"""Connected patterns against a plain enumeration of edge sets."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from strandweave.operators import graphs, patterns


def connected(edges):
    reached, left = set(edges[0]), set(edges)
    while near := {e for e in left if reached & set(e)}:
        left -= near
        reached |= {n for e in near for n in e}
    return not left


def plain(examples, min_support, most_nodes):
    """Each set of edges on few nodes, its examples, and whether another edge of its nodes is in all of them."""
    graph = sorted({e for es in examples.values() for e in es})
    support, out = {}, set()
    for k in range(1, most_nodes * (most_nodes - 1) // 2 + 1):
        for edges in itertools.combinations(graph, k):
            nodes = tuple(sorted({n for e in edges for n in e}))
            if len(nodes) <= most_nodes and connected(edges):
                support[edges] = (nodes, frozenset(x for x, es in examples.items() if set(edges) <= es))
    for edges, (nodes, held) in support.items():
        inside = [e for e in graph if set(e) <= set(nodes) and e not in edges]
        if len(held) > min_support and not any(all(e in examples[x] for x in held) for e in inside):
            out.add((nodes, edges, len(held)))
    for node in {n for e in graph for n in e}:
        held = sum(any(node in e for e in es) for es in examples.values())
        if held > min_support:
            out.add(((node,), (), held))
    return out


def taken(frame):
    return {(tuple(r.nodes), tuple(tuple(e) for e in r.edges), r.support) for r in frame.collect()}


@pytest.mark.parametrize(("seed", "items", "share", "least", "most_nodes"), [(1, 5, 0.6, 1, 4), (2, 5, 0.9, 0, 4), (3, 6, 0.45, 2, 3), (4, 5, 0.8, 3, 5)])
def test_equal_to_enumeration(spark, seed, items, share, least, most_nodes):
    r = random.Random(seed)
    pairs = list(itertools.combinations("abcdef"[:items], 2))
    hub = set(r.sample(pairs, 4))  # a third of the examples are copies
    examples = {x: (hub if x % 3 == 0 else {p for p in pairs if r.random() < share}) for x in range(30)}
    rows = [(x, i, j) for x, es in examples.items() for i, j in es]
    frame = spark.createDataFrame([*rows, *rows[:9], (None, "a", "b"), (1, None, "b")], "x long, i string, j string").repartition(3)
    found = patterns.connected_patterns(frame, "x", least, most_nodes)
    assert taken(found) == plain(examples, least, most_nodes)
    assert all(r.n_nodes == len(r.nodes) and r.n_edges == len(r.edges) for r in found.collect())


def test_three_items_as_patterns(spark):
    r = random.Random(9)
    rows = [(x, i, j) for x in range(40) for i, j in itertools.combinations(range(6), 2) if r.random() < 0.5]
    frame = spark.createDataFrame(rows, "x long, i long, j long")

    def chained(p):
        return tuple(sorted((min(p.b, n), max(p.b, n)) for n in (p.a, p.c)))

    before = set()
    for p in graphs.patterns(frame, "x", 4).collect():
        edges = {"node": (), "edge": ((p.a, p.b),)}.get(p.kind) if p.kind in ("node", "edge") else chained(p) if p.kind == "chain" else ((p.a, p.b), (p.a, p.c), (p.b, p.c))
        before.add((tuple(sorted(n for n in (p.a, p.b, p.c) if n is not None)), edges, p.support))
    assert taken(patterns.connected_patterns(frame, "x", 4, 3)) == before


def test_nothing(spark):
    empty = spark.createDataFrame([], "x long, i string, j string")
    assert patterns.connected_patterns(empty, "x", 0).collect() == []


def test_pairs_and_patterns_make_no_joined_occurrences(spark):
    """What an example holds is read off its own array: the only joins meet the table of frequent edges."""
    rows = [(x, i, j) for x in range(9) for i in range(5) for j in range(i + 1, 5) if (x + i + j) % 3]
    frame = spark.createDataFrame([*rows, (None, 0, 1), (3, None, 2)], "x long, i long, j long")
    for found in (graphs.patterns(frame, "x", 1), patterns.connected_patterns(frame, "x", 1, 4)):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Join") == plan.count("Join Inner, ((i#") and "LeftOuter" not in plan
    items = frame.select("x", F.col("i").alias("item"))
    paired = graphs.pairs(items, "x", "item")
    assert "Join" not in paired._jdf.queryExecution().optimizedPlan().toString()
    names = {}
    for x, i, _ in rows:
        names.setdefault(x, set()).add(i)
    assert sorted(map(tuple, paired.collect())) == sorted((x, i, j) for x, s in names.items() for i in s for j in s if i < j)
    assert patterns.closed_masks({0b111: 2, 0b011: 3, 0b110: 4}, 3, 1) == [(0b011, 5), (0b110, 6), (0b111, 2)]


def test_each_example_has_a_connected_set_once(spark):
    """A hub with twelve ends: as many sets of four as three of its ends can be drawn."""
    frame = spark.createDataFrame([(x, 0, j) for x in range(2) for j in range(1, 13)], "x long, i long, j long")
    found = patterns.connected_patterns(frame, "x", 1, 4).groupBy("n_nodes").agg(F.count(F.lit(1)).alias("n"), F.max("support").alias("m")).collect()
    assert sorted(map(tuple, found)) == [(1, 13, 2), (2, 12, 2), (3, 66, 2), (4, 220, 2)]
