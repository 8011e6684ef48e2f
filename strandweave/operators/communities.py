"""Communities of a graph by edge betweenness: the edge that most shortest paths cross goes, round by round.

The graph is that of a dimension (motifs, tasks): its edges are counted before they are sent
to all tasks, the sources of shortest paths are what is dealt out. A component is split
on its own, since no path leaves it, and the tree of splits is cut where the sum of the
communities' modularity is greatest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Edges that are sent to all tasks at most; a graph of more is an error.
MOST_EDGES = 2_000_000
#: Up to so many steps (sources times edges) shortest paths are counted where they are, beyond that by Spark. The counts are the same.
STEPS_AT_HAND = 2_000_000


class Adjacency:
    """Neighbours of each node (0 to n - 1) with the number of the edge to them."""

    def __init__(self, n: int, ends: np.ndarray, live: np.ndarray):
        numbers = np.flatnonzero(live)
        a, b = ends[numbers].T
        start = np.argsort(np.r_[a, b], kind="stable")
        self.to, self.edge = np.r_[b, a][start], np.r_[numbers, numbers][start]
        self.first = np.searchsorted(np.r_[a, b][start], np.arange(n + 1))

    def paths_from(self, source: int, out: np.ndarray) -> None:
        """Add to each edge the share of shortest paths from the source to every other node that cross it."""
        n = len(self.first) - 1
        depth, paths, levels = np.full(n, -1), np.zeros(n), [np.array([source])]
        depth[source], paths[source] = 0, 1.0
        steps = []
        while len(levels[-1]):
            front = levels[-1]
            counts = self.first[front + 1] - self.first[front]
            at = np.repeat(self.first[front] - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(counts.sum())
            near, to, edge = np.repeat(front, counts), self.to[at], self.edge[at]
            new = np.unique(to[depth[to] < 0])
            depth[new] = len(levels)
            down = depth[to] == len(levels)
            near, to, edge = near[down], to[down], edge[down]
            np.add.at(paths, to, paths[near])
            steps.append((near, to, edge))
            levels.append(new)
        share = np.zeros(n)
        for near, to, edge in reversed(steps):
            crossed = paths[near] / paths[to] * (1 + share[to])
            np.add.at(out, edge, crossed)
            np.add.at(share, near, crossed)


def edge_betweenness(spark: SparkSession, n: int, ends: np.ndarray, live: np.ndarray, sources: np.ndarray) -> np.ndarray:
    """For each edge the number of pairs of ``sources`` whose shortest paths cross it, shared among equally short ones. Sources must be whole components."""
    total = np.zeros(len(ends))
    if len(sources) * int(live.sum()) <= STEPS_AT_HAND:
        graph = Adjacency(n, ends, live)
        for s in sources:
            graph.paths_from(s, total)
        return total / 2
    held = spark.sparkContext.broadcast((n, ends, live))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        graph, out = Adjacency(*held.value), np.zeros(len(held.value[1]))
        for pdf in batches:
            for s in pdf["source"]:
                graph.paths_from(s, out)
        some = np.flatnonzero(out)
        yield pd.DataFrame({"edge": some, "paths": out[some]})

    parts = max(1, min(len(sources), 4 * spark.sparkContext.defaultParallelism))
    shared = spark.createDataFrame(pd.DataFrame({"source": sources})).repartition(parts).mapInPandas(count, "edge long, paths double")
    for r in shared.groupBy("edge").agg(F.sum("paths").alias("paths")).collect():  # at most one row an edge
        total[r.edge] = r.paths
    held.destroy()
    return total / 2


def _components(nodes: np.ndarray, ends: np.ndarray, live: np.ndarray) -> list[np.ndarray]:
    """The components that the live edges leave of these nodes, each sorted, by least member."""
    label = {int(x): int(x) for x in nodes}

    def find(x: int) -> int:
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    for a, b in ends[live].tolist():
        if a in label and b in label:
            a, b = find(a), find(b)
            label[max(a, b)] = min(a, b)
    out: dict[int, list[int]] = {}
    for x in sorted(label):
        out.setdefault(find(x), []).append(x)
    return [np.array(v) for v in out.values()]


def modularity_of(nodes: np.ndarray, ends: np.ndarray, degree: np.ndarray) -> float:
    """What one community adds to the modularity of a partition of the whole graph."""
    mine = np.zeros(len(degree), bool)
    mine[nodes] = True
    m = len(ends)
    return float((mine[ends[:, 0]] & mine[ends[:, 1]]).sum()) / m - (float(degree[nodes].sum()) / (2 * m)) ** 2


def communities(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, community, modularity): community is its least node, modularity that of the whole partition.

    Edges have no direction; repeated ones and loops don't count, nodes are those of edges (any
    type that can be ordered, nulls left out). Of edges that equally many paths cross the first
    in order goes. Of a community and its parts of equal modularity the community stays.
    No edges give no rows; more than MOST_EDGES raise ValueError before any is collected.
    """
    spark = edges.sparkSession
    pairs = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()
    if pairs.limit(MOST_EDGES + 1).count() > MOST_EDGES:
        raise ValueError(f"more than {MOST_EDGES} edges")
    rows = pairs.orderBy("a", "b").collect()
    kind = pairs.schema["a"].dataType.simpleString()
    schema = f"node {kind}, community {kind}, modularity double"
    if not rows:
        return spark.createDataFrame([], schema)
    names = sorted({x for r in rows for x in r})
    number = {x: i for i, x in enumerate(names)}
    ends = np.array([[number[r.a], number[r.b]] for r in rows])
    degree = np.bincount(ends.ravel(), minlength=len(names)).astype(float)
    groups = split_and_joined(spark, len(names), ends, degree)
    whole = sum(modularity_of(g, ends, degree) for g in groups)
    return spark.createDataFrame([(names[i], names[g[0]], whole) for g in groups for i in g.tolist()], schema)


def split_and_joined(spark: SparkSession, n: int, ends: np.ndarray, degree: np.ndarray) -> list[np.ndarray]:
    """Split every component, edge by edge, down to single nodes; then keep of each split what adds more: the parts or the whole."""
    live = np.ones(len(ends), bool)
    tree: list[tuple[np.ndarray, list[int]]] = [(g, []) for g in _components(np.arange(n), ends, live)]
    roots, todo = list(range(len(tree))), [i for i, (g, _) in enumerate(tree) if len(g) > 1]
    while todo:
        # One round: every component that isn't split yet loses its most crossed edge.
        crossed = edge_betweenness(spark, n, ends, live, np.concatenate([tree[i][0] for i in todo]))
        owner = np.full(n, -1)
        for i in todo:
            owner[tree[i][0]] = i
        of_edge = np.where(live, owner[ends[:, 0]], -1)
        again = []
        for i in todo:
            mine = np.flatnonzero(of_edge == i)
            top = crossed[mine].max()
            live[mine[np.flatnonzero(crossed[mine] >= top * (1 - 1e-9))[0]]] = False
            parts = _components(tree[i][0], ends[mine], live[mine])
            if len(parts) == 1:
                again.append(i)
                continue
            for part in parts:
                tree[i][1].append(len(tree))
                if len(part) > 1:
                    again.append(len(tree))
                tree.append((part, []))
        todo = again
    best: list[tuple[float, list[np.ndarray]]] = [(0.0, [])] * len(tree)
    for i in reversed(range(len(tree))):
        nodes, parts = tree[i]
        own, below = modularity_of(nodes, ends, degree), sum(best[p][0] for p in parts)
        best[i] = (own, [nodes]) if not parts or own >= below - 1e-12 else (below, [g for p in parts for g in best[p][1]])
    return [g for i in roots for g in best[i][1]]
