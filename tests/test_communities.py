"""Edge betweenness against enumerated paths, communities against a plain loop and a planted partition."""

import itertools
import random
from collections import deque

import numpy as np
import pytest

from strandweave.operators import communities as co


def all_shortest(n, edges, s, t):
    near = {i: [] for i in range(n)}
    for a, b in edges:
        near[a].append(b)
        near[b].append(a)
    depth, todo = {s: 0}, deque([s])
    while todo:
        x = todo.popleft()
        for y in near[x]:
            if y not in depth:
                depth[y] = depth[x] + 1
                todo.append(y)
    if t not in depth:
        return []
    paths = [[t]]
    for _ in range(depth[t]):
        paths = [[y, *p] for p in paths for y in near[p[0]] if depth.get(y) == depth[p[0]] - 1]
    return paths


def crossed_by_paths(n, edges):
    out = dict.fromkeys(edges, 0.0)
    for s, t in itertools.combinations(range(n), 2):
        paths = all_shortest(n, edges, s, t)
        for p in paths:
            for a, b in itertools.pairwise(p):
                out[min(a, b), max(a, b)] += 1 / len(paths)
    return out


def made(seed, n, m):
    r = random.Random(seed)
    return sorted(r.sample([(a, b) for a in range(n) for b in range(a + 1, n)], m))


@pytest.mark.parametrize("at_hand", [0, 10**9])
def test_betweenness_of_fifty_nodes(spark, monkeypatch, at_hand):
    monkeypatch.setattr(co, "STEPS_AT_HAND", at_hand)
    edges = made(3, 50, 90)
    found = co.edge_betweenness(spark, 50, np.array(edges), np.ones(90, bool), np.arange(50))
    expected = crossed_by_paths(50, edges)
    assert found == pytest.approx([expected[e] for e in edges])


def modularity(groups, edges):
    m, degree = len(edges), dict.fromkeys(itertools.chain(*groups), 0)
    for a, b in edges:
        degree[a] += 1
        degree[b] += 1
    return sum(sum(a in g and b in g for a, b in edges) / m - (sum(degree[x] for x in g) / (2 * m)) ** 2 for g in map(set, groups))


def parts_of(nodes, edges):
    left, out = set(nodes), []
    while left:
        todo, seen = [min(left)], {min(left)}
        while todo:
            x = todo.pop()
            for a, b in edges:
                if x in (a, b) and (y := a + b - x) in left and y not in seen:
                    seen.add(y)
                    todo.append(y)
        out.append(sorted(seen))
        left -= seen
    return out


def brute(nodes, edges, every):
    """Best of the whole component and of the best of its parts."""
    if len(nodes) == 1:
        return [nodes]
    mine = [e for e in edges if e[0] in nodes]
    while len(parts := parts_of(nodes, mine)) == 1:
        number = {x: i for i, x in enumerate(nodes)}
        crossed = crossed_by_paths(len(nodes), [(number[a], number[b]) for a, b in mine])
        top = max(crossed.values())
        mine.remove(next(e for e in mine if crossed[number[e[0]], number[e[1]]] >= top * (1 - 1e-9)))
    below = [g for p in parts for g in brute(p, mine, every)]
    own, split = (modularity(g + [[x] for x in {*itertools.chain(*every)} - {*nodes}], every) for g in ([nodes], below))
    return [nodes] if own >= split - 1e-12 else below


def groups_of(rows):
    out = {}
    for r in rows:
        out.setdefault(r.community, []).append(r.node)
    return sorted(sorted(g) for g in out.values())


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_a_loop(spark, seed):
    edges = made(seed, 22, 34)
    rows = co.communities(spark.createDataFrame([(b, a) for a, b in edges] + edges[:3] + [(5, 5), (None, 1)], "a long, b long")).collect()
    nodes = sorted({*itertools.chain(*edges)})
    expected = [g for p in parts_of(nodes, edges) for g in brute(p, edges, edges)]
    assert groups_of(rows) == sorted(expected)
    assert {round(r.modularity, 9) for r in rows} == {round(modularity(expected, edges), 9)}
    assert all(r.community == min(x.node for x in rows if x.community == r.community) for r in rows)


def test_planted_partition(spark):
    r, names = random.Random(7), [f"n{i:02d}" for i in range(48)]
    edges = [(names[i], names[j]) for i in range(48) for j in range(i + 1, 48) if r.random() < (0.6 if i // 12 == j // 12 else 0.02)]
    rows = co.communities(spark.createDataFrame(edges, "a string, b string")).collect()
    assert groups_of(rows) == [names[k : k + 12] for k in range(0, 48, 12)] and rows[0].modularity > 0.5


def test_odd_graphs(spark, monkeypatch):
    assert co.communities(spark.createDataFrame([], "a long, b long")).collect() == []
    assert groups_of(co.communities(spark.createDataFrame([(1, 2), (7, 9)], "a long, b long")).collect()) == [[1, 2], [7, 9]]
    monkeypatch.setattr(co, "MOST_EDGES", 1)
    with pytest.raises(ValueError, match="edges"):
        co.communities(spark.createDataFrame([(1, 2), (7, 9)], "a long, b long"))
