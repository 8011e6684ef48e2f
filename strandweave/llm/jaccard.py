"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

Each distinct shingle set gets ``TREES`` labels of ``DEEPEST`` MinHash values, which are its
paths in as many prefix tries. All paths are laid out in sorted order, tree by tree: labels
with a long common prefix lie side by side, and a trie node at any depth is a stretch of
that order. One walk along it finds how deep each path shares its prefix with a
neighbour; paths that share none drop out. The matched prefix starts at the whole label
and is shortened value by value until the recall reaches the target: that of a pair at
the threshold, and that measured on pairs of the corpus, neighbours in the order, which are
verified first. The recall that counts is that of a pair at the threshold, so all texts
stop at one depth. What shares a node at that depth is verified exactly (see ``blocks``).
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import KEY, Shingles, exact_classes, joined_once, keyed, linked_classes, often_repeated, shared_nodes, signed
from .common import join_spread, shuffle_partitions, stored, whole_text

WORDS = 5
THRESHOLD = Fraction(4, 5)
TREES, DEEPEST = 48, 10
#: Bytes of a MinHash value in a label. Cut values only add candidates.
VALUE = 2
TARGET_RECALL = 0.9998
#: The recall is measured on at most so many pairs of the corpus, found so many values above the depth that a pair at the threshold asks for.
PAIRS, MARGIN = 512, 2


def predicted_recall(agreement: float, trees: int = TREES) -> float:
    """The chance that two texts meet in some tree if one tree's prefixes agree with this chance."""
    return 1 - (1 - agreement) ** trees


def matched_depth(threshold: float, target: float = TARGET_RECALL, trees: int = TREES, deepest: int = DEEPEST, measured: list[float] | None = None) -> int:
    """Shorten the prefix from ``deepest`` values until the target recall is reached.

    ``measured`` has for each depth from 1 on the measured recall of pairs; without it that
    of a pair at the threshold counts alone.
    """
    for depth in range(deepest, 0, -1):
        if predicted_recall(threshold**depth, trees) >= target and (measured is None or measured[depth - 1] >= target):
            return depth
    raise ValueError(f"{trees} trees can't reach a recall of {target} at a threshold of {threshold}")


class Forest:
    """The labels of a shingle set: for each tree ``deepest`` MinHash values, cut to ``VALUE`` big-endian bytes each."""

    def __init__(self, deepest: int = DEEPEST, trees: int = TREES):
        rng = np.random.default_rng(11)
        self.deepest, self.trees = deepest, trees
        self.xors = rng.integers(0, 1 << 32, (trees * deepest, 1), np.uint32)
        self.factors = rng.integers(0, 1 << 31, (trees * deepest, 1), np.uint32) * np.uint32(2) + np.uint32(1)

    def values(self, shingles: np.ndarray) -> np.ndarray:
        """trees x deepest numbers."""
        short = (shingles >> np.uint64(32)).astype(np.uint32)
        least = np.full(self.trees * self.deepest, 0xFFFFFFFF, np.uint32)
        for a in range(0, len(short), 512):
            part = (short[None, a : a + 512] ^ self.xors) * self.factors
            np.minimum(least, part.min(axis=1), out=least)
        # The least of many numbers begins with zeros: it is mixed before it is cut.
        with np.errstate(over="ignore"):
            least *= np.uint32(0x9E3779B1)
            least ^= least >> np.uint32(15)
            least *= np.uint32(0x85EBCA77)
        return (least >> np.uint32(16)).astype(">u2").reshape(self.trees, self.deepest)

    def labels(self, shingles: np.ndarray) -> bytes:
        return self.values(shingles).tobytes()


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """(KEY, n_shingles, set_key, signature) of each row: the signature is the labels of all trees."""

    def make():
        return Shingles(words), Forest().labels

    return signed(docs, make)


def first_label() -> Column:
    return F.substr("signature", F.lit(1), F.lit(DEEPEST * VALUE))


def trie_paths(classes: DataFrame, shortest: int) -> DataFrame:
    """(tree, label, KEY, depth, next_...): the paths that share ``shortest`` values at least with a neighbour in the sorted order.

    ``depth`` is the number of values shared with the nearer neighbour, the columns next_...
    are KEY of the following path where that shares ``shortest`` values. The first and last path
    of a range can't see one of their neighbours and stay. The order is one of (tree,
    label, KEY), so a node with very many paths spreads over many ranges.
    """
    size = DEEPEST * VALUE
    path = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.struct(t.alias("tree"), F.substr("signature", t * size + 1, F.lit(size)).alias("label")))
    paths = classes.where("n_shingles > 0").select("rep.*", F.explode(path).alias("path")).select("path.*", *KEY)
    order = ["tree", "label", *KEY]
    laid = paths.repartitionByRange(shuffle_partitions(classes.sparkSession), *order).sortWithinPartitions(*order)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, before = None, DEEPEST
        for pdf in batches:
            rows = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            held = rows.tail(1)
            labels = np.frombuffer(b"".join(rows["label"]), ">u2").reshape(len(rows), DEEPEST)
            tree = rows["tree"].to_numpy()
            equal = (labels[1:] == labels[:-1]) & (tree[1:] == tree[:-1])[:, None]
            shared = np.logical_and.accumulate(equal, axis=1).sum(axis=1)
            yield kept(rows.iloc[:-1], np.r_[before, shared][:-1], shared, rows.iloc[1:])
            before = shared[-1] if len(shared) else before
        if held is not None:
            yield kept(held, np.array([before]), np.array([DEEPEST]), None)

    def kept(rows: pd.DataFrame, before: np.ndarray, after: np.ndarray, following: pd.DataFrame | None) -> pd.DataFrame:
        out = rows.assign(depth=np.maximum(before, after).astype(np.int32))
        for k in KEY:
            out[f"next_{k}"] = None if following is None else pd.Series(following[k].to_numpy(), rows.index, object).where(after >= shortest)
        return out[np.maximum(before, after) >= shortest]

    return laid.mapInPandas(
        walk, "tree int, label binary, no_id boolean, uid long, text_hash long, depth int, next_no_id boolean, next_uid long, next_text_hash long"
    )


def measured_recall(docs: DataFrame, paths: DataFrame, words: int, threshold: Fraction) -> list[float] | None:
    """For each depth the share of verified pairs of the corpus that meet there in some tree; None without pairs at or above the threshold.

    The pairs are at most PAIRS, drawn by hash from all neighbours in the sorted order; their
    texts are broadcast by key and verified two by two.
    """
    mine, other = F.struct(*KEY), F.struct(*[F.col(f"next_{k}").alias(k) for k in KEY])
    near = paths.where("next_uid IS NOT NULL").select(F.least(mine, other).alias("a"), F.greatest(mine, other).alias("b")).distinct()
    picked = stored(near.orderBy(F.xxhash64("a", "b"), "a", "b").limit(PAIRS).withColumn("pair", F.monotonically_increasing_id()), "pairs")
    sides = picked.select("pair", "a.*").unionByName(picked.select("pair", "b.*"))
    texts = keyed(docs, whole_text().alias("text")).join(F.broadcast(sides.select(*KEY).distinct()), KEY).groupBy(*KEY).agg(F.first("text").alias("text"))

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        shingles, forest = Shingles(words), Forest()
        a, b = (shingles.of(t) for t in pdf["text"])
        both = len(np.intersect1d(a, b, assume_unique=True))
        linked = both * threshold.denominator >= (len(a) + len(b) - both) * threshold.numerator
        deep = np.logical_and.accumulate(forest.values(a) == forest.values(b), axis=1).sum(axis=1).max()
        return pd.DataFrame({"linked": [linked], "deep": [deep]})

    found = texts.join(F.broadcast(sides), KEY).groupBy("pair").applyInPandas(verify, "linked boolean, deep int")
    deep = [r.deep for r in found.where("linked").collect()]  # at most PAIRS numbers
    return [sum(d >= depth for d in deep) / len(deep) for depth in range(1, DEEPEST + 1)] if deep else None


def matched_nodes(classes: DataFrame, paths: DataFrame, depth: int) -> DataFrame:
    """(rep, node, first): each representative's nodes at this depth that it shares with another, and the least representative below each."""
    node = F.xxhash64("tree", F.substr("label", F.lit(1), F.lit(depth * VALUE)))
    return shared_nodes(paths.where(F.col("depth") >= depth).select(F.struct(*KEY).alias("rep"), node.alias("node")), TREES * classes.count())


def _decisions(docs: DataFrame, words: int, threshold: Fraction, target_recall: float) -> tuple[DataFrame, DataFrame | None]:
    """The columns of near_duplicates and KEY, which tells rows that share an identifier apart; and what often_repeated finds."""
    sigs = stored(signatures(docs, words), "signatures")
    hot = often_repeated(sigs)
    classes = stored(exact_classes(sigs), "classes")
    paths = stored(trie_paths(classes, max(1, matched_depth(float(threshold), target_recall) - MARGIN)), "paths")
    depth = matched_depth(float(threshold), target_recall, measured=measured_recall(docs, paths, words, threshold))
    nodes = stored(matched_nodes(classes, paths, depth), "nodes")
    counts, linked = linked_classes(docs, classes, nodes, first_label(), hot, lambda: Shingles(words), threshold)
    table = (
        classes.select("set_key", "rep", "copies")
        .join(counts, "rep", "left")
        .join(linked, "rep", "left")
        .select(
            "set_key",
            F.col("rep.uid").alias("exact_id"),
            F.coalesce("component", "rep").alias("head"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"),
            F.coalesce("texts", F.lit(0)).cast("long").alias("n_linked_texts"),
        )
    )
    copies = classes.select("set_key", F.col("copies").alias("_n"))
    decided = join_spread(sigs.select(*KEY, "set_key"), table, "set_key", copies, sigs.count()).select(
        F.when(~F.col("no_id"), F.col("uid")).alias("doc_id"), *KEY, F.col("head.uid").alias("class_id"),
        F.concat_ws(":", F.when(F.col("head.no_id"), F.lit("null")), F.hex("head.uid"), F.hex("head.text_hash")).alias("class_key"), "exact_id", "n_links", "n_linked_texts",
        (F.struct(*KEY) == F.col("head")).alias("keep"),
    )
    return decided, hot


def near_duplicates(docs: DataFrame, words: int = WORDS, threshold: Fraction = THRESHOLD, target_recall: float = TARGET_RECALL) -> DataFrame:
    """One row a document: doc_id, uid, class_id, class_key, exact_id, n_links, n_linked_texts, keep.

    Two documents are linked if the Jaccard index of their word shingles is at least the
    threshold. ``class_id`` is the least identifier reachable through links, ``class_key``
    tells classes apart whose least documents share an identifier, ``exact_id`` is
    the least one with the same shingle set, ``n_links`` the number of other rows linked
    (copies included), ``n_linked_texts`` that of other shingle sets, ``keep`` true for
    the row that stands for its class. Texts without words (null ones too) form one
    exact class; a row with a null doc_id is known by its text, with that text's hash as
    ``uid``, and comes after all identifiers, of which any 64-bit number may be one. Repeated rows
    are copies and each gets a row; rows that share a doc_id but not a text are told apart
    by their texts, so several of them can lead classes. Texts of any length are read
    whole; ties in the order of texts don't change results. An empty table stays empty;
    other columns are dropped.
    """
    return _decisions(docs, words, threshold, target_recall)[0].drop("no_id", "text_hash")


def one_of_each(docs: DataFrame, words: int = WORDS, threshold: Fraction = THRESHOLD, target_recall: float = TARGET_RECALL) -> DataFrame:
    """One document of each class of near-duplicates, with its columns: the one with the least identifier (and text hash), once. Cases as in near_duplicates."""
    decided, hot = _decisions(docs, words, threshold, target_recall)
    kept = stored(decided.where("keep").groupBy(*KEY).agg(F.count(F.lit(1)).alias("times")), "kept")
    rows = keyed(docs, F.struct("*").alias("row"))
    single, several = kept.where("times = 1").select(*KEY), kept.where("times > 1").select(*KEY)
    out = rows.join(single, KEY, "left_semi").select("row")
    if several.head(1):  # rows equal in both are copies of one text
        out = out.unionByName(joined_once(rows, several, hot, "row").select("row"))
    return out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
