"""Exact classes, candidate blocks and exact verification for operators on pairs of word-shingle sets.

Texts with equal sets of word shingles form one exact class and are represented by one
text. Texts below one node (of a trie, or of a band) are candidates. Candidates that hang
together are laid out in a sorted order, so that like texts lie side by side, and cut into
blocks of equal size. A text is compared with its own block and with the blocks that one
of its nodes reaches, so a long chain of texts costs what its links cost. Each pair of
blocks is verified exactly in one place, which yields counts and a spanning forest, never
the pairs themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BoundedCache, join_spread, shuffle_partitions, stored, whole_text
from .components import components

#: Texts in a block; a unit of verification holds two blocks at most.
BLOCK = 384
#: A node that several blocks share is looked up under so many keys, so a hot one spreads.
SALTS = 16
#: What tells a text apart, in order: rows with an identifier first (it is a number fixed by the text where it is null), then the text's hash.
KEY = ["no_id", "uid", "text_hash"]


class Shingles:
    """Sorted distinct 64-bit hashes of a text's word windows (white space cut, lower case). A text of fewer words is one window."""

    def __init__(self, words: int):
        self.words, self.cache = words, BoundedCache()
        self.factors = np.array([xxhash.xxh64_intdigest(f"factor {i}") | 1 for i in range(words)], np.uint64)

    @staticmethod
    def encoded(text: str) -> bytes:
        return text.encode("utf-8", "surrogatepass")

    def cut(self, text: str) -> list:
        return text.lower().split()

    def _hash(self, word) -> int:
        h = self.cache.get(word)
        if h is None:
            h = xxhash.xxh64_intdigest(word if isinstance(word, bytes) else self.encoded(word))
            self.cache.keep(word, h)
        return h

    def of(self, text: str) -> np.ndarray:
        words = self.cut(text)
        if not words:
            return np.zeros(0, np.uint64)
        if len(words) < self.words:
            return np.array([xxhash.xxh64_intdigest(b" ".join(words) if isinstance(words[0], bytes) else self.encoded(" ".join(words)))], np.uint64)
        known = self.cache.newer.get
        hashes = np.array([known(w) or self._hash(w) for w in words], np.uint64)
        n = len(words) - self.words + 1
        with np.errstate(over="ignore"):
            out = hashes[:n] * self.factors[0]
            for i in range(1, self.words):
                out += hashes[i : i + n] * self.factors[i]
            out ^= out >> np.uint64(32)
            out *= np.uint64(0x9E3779B97F4A7C15)
        return np.unique(out)


class AsciiShingles(Shingles):
    """Word windows by ASCII rules alone: white space is space, tab and the control characters between, and only A-Z have lower cases."""

    def cut(self, text: str) -> list:
        return self.encoded(text).lower().split()


def identifier() -> Column:
    """doc_id, or where that is null a number fixed by the text."""
    return F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(whole_text()))


def keyed(docs: DataFrame, *columns: Column) -> DataFrame:
    """KEY of each row, and further columns."""
    return docs.select(F.col("doc_id").cast("long").isNull().alias("no_id"), identifier().alias("uid"), F.xxhash64(whole_text()).alias("text_hash"), *columns)


def signed(docs: DataFrame, make: Callable[[], tuple[Shingles, Callable[[np.ndarray], bytes]]]) -> DataFrame:
    """(KEY, n_shingles, set_key, signature) of each row; set_key is a 128-bit hash of the shingle set.

    ``make`` gives, in each task, the shingles of a text and the signature of a set that isn't empty.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles, sign = make()
        last_key, last = None, None
        for pdf in batches:
            n, keys, signatures = [], [], []
            for text in pdf["text"]:
                found = shingles.of(text)
                key = xxhash.xxh128_digest(found.tobytes())
                if key != last_key:
                    last_key, last = key, sign(found) if len(found) else b""
                n.append(len(found))
                keys.append(key)
                signatures.append(last)
            yield pdf[KEY].assign(n_shingles=n, set_key=keys, signature=signatures)

    return keyed(docs, whole_text().alias("text")).mapInPandas(run, "no_id boolean, uid long, text_hash long, n_shingles int, set_key binary, signature binary")


def exact_classes(sigs: DataFrame) -> DataFrame:
    """One row a shingle set: ``rep``, its least KEY, the number of rows, of shingles and the signature. An identifier alone doesn't tell texts apart."""
    return sigs.groupBy("set_key").agg(
        F.min(F.struct(*KEY)).alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature")
    )


def shared_nodes(nodes: DataFrame, n_rows: int) -> DataFrame:
    """(rep, node, first): the nodes that a representative shares with another, and the least representative at each. ``n_rows`` is the number of rows of ``nodes`` (rep, node)."""
    shared = stored(nodes.groupBy("node").agg(F.min("rep").alias("first"), F.count(F.lit(1)).alias("_n")).where("_n > 1"), "shared-nodes")
    return join_spread(nodes, shared.drop("_n"), "node", shared, n_rows).select("rep", "node", "first")


def block_layout(classes: DataFrame, groups: DataFrame, label: Column) -> DataFrame:
    """(rep, component, copies, block): the members of all groups, sorted by group and ``label``, BLOCK by BLOCK."""
    members = groups.withColumnRenamed("node", "rep").join(classes.select("rep", "copies", label.alias("label")), "rep")
    order = ["component", "label", "rep"]
    laid = members.repartitionByRange(shuffle_partitions(classes.sparkSession), *order).sortWithinPartitions(*order)
    return laid.select("rep", "component", "copies", F.monotonically_increasing_id().alias("at")).withColumn("block", F.expr(f"at div {BLOCK}")).drop("at")


def reached_blocks(nodes: DataFrame, layout: DataFrame) -> DataFrame:
    """(rep, others): the blocks besides its own that a representative's nodes reach. Most nodes lie within a block and drop out."""
    placed = nodes.select("rep", "node").join(layout.select("rep", "block"), "rep")
    several = placed.groupBy("node").agg(F.collect_set("block").alias("blocks")).where(F.size("blocks") > 1)
    salted = several.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    keyed = placed.withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(SALTS)).cast("int"))
    found = keyed.join(salted, ["node", "salt"]).groupBy("rep", "block").agg(F.array_distinct(F.flatten(F.collect_list("blocks"))).alias("others"))
    return found.select("rep", F.array_remove("others", F.col("block")).alias("others"))


def _links(pdf: pd.DataFrame, shingles: Shingles, threshold: Fraction) -> pd.DataFrame | None:
    """Verify the texts of one group in one unit: all pairs within a block, or between two blocks."""
    pdf = pdf.sort_values(KEY)
    if len(pdf) < 2:
        return None
    sets = [shingles.of(t) for t in pdf["text"]]
    sizes = np.array([len(s) for s in sets], np.int64)
    rows = np.repeat(np.arange(len(sets)), sizes)
    _, columns, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts[columns] > 1
    rows, columns = rows[shared], columns[shared]
    common = np.zeros((len(sets), len(sets)), np.float32)
    if len(columns):
        places = np.cumsum(counts > 1) - 1  # shingles of one text only are left out
        columns = places[columns]
        order = np.argsort(columns, kind="stable")
        rows, columns = rows[order], columns[order]
        for a in range(0, int(columns[-1]) + 1, 4096):
            lo, hi = np.searchsorted(columns, [a, a + 4096])
            part = np.zeros((len(sets), min(4096, int(columns[-1]) + 1 - a)), np.float32)
            part[rows[lo:hi], columns[lo:hi] - a] = 1
            common += part @ part.T
    both = common.astype(np.int64)
    union = sizes[:, None] + sizes[None, :] - both
    linked = both * threshold.denominator >= union * threshold.numerator
    np.fill_diagonal(linked, False)
    if pdf["i"].iloc[0] != pdf["j"].iloc[0]:
        block = pdf["block"].to_numpy()
        linked &= block[:, None] != block[None, :]
    some = linked.any(axis=1)
    if not some.any():
        return None
    roots = _least_reachable(linked, np.arange(len(pdf)))  # rows are in order
    keys = {k: pdf[k].to_numpy() for k in KEY}
    return pd.DataFrame(keys | {f"root_{k}": v[roots] for k, v in keys.items()} | {"links": linked @ pdf["copies"].to_numpy(np.int64), "texts": linked.sum(axis=1)})[some]


def _least_reachable(linked: np.ndarray, names: np.ndarray) -> np.ndarray:
    """For each row the least name that it reaches through links."""
    out, todo = names.copy(), np.argsort(names)
    seen = np.zeros(len(names), bool)
    for start in todo:
        if seen[start]:
            continue
        front = np.zeros(len(names), bool)
        front[start] = True
        reached = front.copy()
        while front.any():
            front = linked[front].any(axis=0) & ~reached
            reached |= front
        seen |= reached
        out[reached] = names[start]
    return out


def often_repeated(sigs: DataFrame) -> DataFrame | None:
    """KEY of rows that are there so often that they would crowd a task: at most a thousand. None if there are none."""
    limit = max(1000, sigs.count() // 1000)
    hot = stored(sigs.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit).select(*KEY), "often")
    return F.broadcast(hot) if hot.head(1) else None


def joined_once(rows: DataFrame, members: DataFrame, hot: DataFrame | None, value: str) -> DataFrame:
    """The members (unique by KEY) with ``value`` of a row; rows equal in KEY are equal. Often repeated rows meet map side first, beside a broadcast of their members."""
    cold_rows, cold = (rows, members) if hot is None else (rows.join(hot, KEY, "left_anti"), members.join(hot, KEY, "left_anti"))
    rest = [c for c in members.columns if c not in KEY]
    once = [*[F.first(c).alias(c) for c in rest], F.first(value).alias(value)]
    out = cold_rows.join(cold, KEY).groupBy(*KEY).agg(*once)
    if hot is None:
        return out
    return out.unionByName(rows.join(F.broadcast(members.join(hot, KEY)), KEY).groupBy(*KEY).agg(*once))


def verified(docs: DataFrame, layout: DataFrame, reached: DataFrame, hot: DataFrame | None, shingles: Callable[[], Shingles], threshold: Fraction) -> DataFrame:
    """(rep, root, links, texts): per unit, of each representative with a link the least one it is linked with, the number of rows and of texts."""
    group = [F.col(f"component.{k}").alias(f"group_{k}") for k in KEY]
    members = layout.join(reached, "rep", "left").select(
        "rep.*", *group, "block", "copies", F.concat(F.array("block"), F.coalesce("others", F.array().cast("array<bigint>"))).alias("meets")
    )
    texts = joined_once(keyed(docs, whole_text().alias("text")), members, hot, "text")
    groups = [f"group_{k}" for k in KEY]
    rows = texts.select(*KEY, *groups, "block", "copies", "text", F.explode("meets").alias("meet")).select(
        F.least("block", "meet").alias("i"), F.greatest("block", "meet").alias("j"), *groups, "block", *KEY, "copies", "text"
    )

    unit = ["i", "j", *groups]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by, held, at = shingles(), [], None
        for pdf in batches:
            for k, part in pdf.groupby(unit, sort=False):
                if k != at:
                    if held and (out := _links(pd.concat(held), by, threshold)) is not None:
                        yield out
                    held, at = [], k
                held.append(part)
        if held and (out := _links(pd.concat(held), by, threshold)) is not None:
            yield out

    spread = rows.repartition(shuffle_partitions(docs.sparkSession), *unit).sortWithinPartitions(*unit)
    found = spread.mapInPandas(run, "no_id boolean, uid long, text_hash long, root_no_id boolean, root_uid long, root_text_hash long, links long, texts long")
    return found.select(F.struct(*KEY).alias("rep"), F.struct(*[F.col(f"root_{k}").alias(k) for k in KEY]).alias("root"), "links", "texts")


def linked_classes(docs: DataFrame, classes: DataFrame, nodes: DataFrame, label: Column, hot: DataFrame | None, shingles: Callable[[], Shingles], threshold: Fraction) -> tuple[DataFrame, DataFrame]:
    """Candidates (nodes: rep, node, first) to links: (rep, links, texts) and (rep, component) of each representative with a link."""
    groups = components(nodes.where("rep <> first").select(F.col("rep").alias("u"), F.col("first").alias("v")))
    layout = stored(block_layout(classes, groups, label), "layout")
    found = stored(verified(docs, layout, reached_blocks(nodes, layout), hot, shingles, threshold), "links")
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"), F.sum("texts").alias("texts"))
    return counts, components(found.select(F.col("rep").alias("u"), F.col("root").alias("v"))).withColumnRenamed("node", "rep")
