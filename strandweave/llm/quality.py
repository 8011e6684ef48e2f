"""Quality classifier: nearest-neighbour voting among labelled latent-semantic vectors.

Words and their punctuation and case patterns are hashed to ``SLOTS`` slots, weighted
by tf-idf (document frequencies over all documents) and projected to ``RANK``
dimensions by a singular value decomposition of a bounded labelled sample. The
sample's vectors are broadcast; every document is compared with all of them in
blocks, and the nearest vote with the square of their cosine, weighed by how much
rarer their class is in the sample than among all labels.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BoundedCache, fold, whole_text
from .labelled import labelled_sample, texts_of, usable_labels

SLOTS = 1 << 16
RANK = 48
#: The sample that the classifier is fitted on and that is broadcast: at most so many labelled rows of each class.
SAMPLE_A_CLASS = 2_000
NEIGHBOURS = 15
BLOCK = 512
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3


class TextFeatures:
    """Slots and counts of a text: each word (stripped, lower case), the punctuation around it, whether it is in capitals, and how often a word follows itself."""

    EDGES = ".,;:!?\"'()[]{}<>|*&$#%-_/\\~^=+`@"

    def __init__(self):
        self.cache = BoundedCache()
        self.repeats = [(level, self._slot(f"repeats {level}")) for level in (0.1, 0.3, 0.5)]

    @staticmethod
    def _slot(name: str) -> int:
        return xxhash.xxh32_intdigest(name.encode("utf-8", "surrogatepass")) % SLOTS

    def _slots(self, word: str) -> tuple[int, ...]:
        core = word.strip(self.EDGES)
        names = [f"w {core.lower()}"] if core else []
        edge = word.replace(core, " ", 1) if core else word
        if edge.strip():
            names.append(f"p {edge}")
        if len(core) > 1 and core.isupper():
            names.append("capitals")
        if core.isdigit():
            names.append("digits")
        return tuple(map(self._slot, names))

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        cache, newer, totals = self.cache, self.cache.newer, {}
        words = text.split()
        if again := sum(map(eq, words, words[1:])):
            for level, slot in self.repeats:
                if again >= level * len(words):
                    totals[slot] = again
        for word, n in Counter(words).items():
            if (slots := newer.get(word)) is None and (slots := cache.get(word)) is None:
                slots = self._slots(word)
                cache.keep(word, slots)
                newer = cache.newer
            for s in slots:
                totals[s] = totals.get(s, 0) + n
        return np.fromiter(totals.keys(), np.int64, len(totals)), np.fromiter(totals.values(), np.float32, len(totals))


def slot_document_counts(docs: DataFrame) -> np.ndarray:
    """In how many documents each slot occurs, over all documents; each task counts in one array of fixed size."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features, counts = TextFeatures(), np.zeros(SLOTS, np.int64)
        for pdf in batches:
            for text in pdf["text"]:
                counts[features.of(text)[0]] += 1
        used = np.flatnonzero(counts)
        yield pd.DataFrame({"slot": used, "n": counts[used]})

    out = np.zeros(SLOTS, np.int64)
    sums = docs.select(whole_text().alias("text")).mapInPandas(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    found = sums.toPandas()  # at most SLOTS rows, whatever the corpus
    out[found["slot"].to_numpy()] = found["n"].to_numpy()
    return out


class SparseRows:
    """Rows of (slots, values), with the two products that the decomposition needs."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]]):
        self.n = len(rows)
        self.slots = np.concatenate([s for s, _ in rows]).astype(np.int32)
        self.values = np.concatenate([v for _, v in rows]).astype(np.float32)
        self.of_row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(s) for s, _ in rows])
        self.by_slot = np.argsort(self.slots, kind="stable").astype(np.int32)

    def _sum(self, order: np.ndarray | None, keys: np.ndarray, other: np.ndarray, picks: np.ndarray, size: int) -> np.ndarray:
        """out[keys] += values * other[picks], for keys that are sorted in this order, in pieces."""
        out = np.zeros((size, other.shape[1]), np.float32)
        for a in range(0, len(keys), 100_000):
            part = slice(a, a + 100_000) if order is None else order[a : a + 100_000]
            k = keys[part]
            starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
            out[k[starts]] += np.add.reduceat(self.values[part, None] * other[picks[part]], starts, axis=0)
        return out

    def times(self, other: np.ndarray) -> np.ndarray:
        return self._sum(None, self.of_row, other, self.slots, self.n)

    def transposed_times(self, other: np.ndarray) -> np.ndarray:
        return self._sum(self.by_slot, self.slots, other, self.of_row, SLOTS)


def semantic_axes(rows: list[tuple[np.ndarray, np.ndarray]], rank: int) -> np.ndarray:
    """The leading right singular vectors (slots x rank), by a randomised range finder with one power step."""
    x = SparseRows(rows)
    start = np.random.default_rng(7).standard_normal((SLOTS, min(rank + 8, len(rows)))).astype(np.float32)
    q, _ = np.linalg.qr(x.times(start))
    del start
    q, _ = np.linalg.qr(x.times(x.transposed_times(q)))
    _, _, axes = np.linalg.svd(x.transposed_times(q).T, full_matrices=False)
    return np.ascontiguousarray(axes[:rank].T, np.float32)


def nearest(cosines: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest of each row in ascending order; of equal ones those that come first."""
    near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
    found = np.take_along_axis(cosines, near, axis=1)
    border = found.min(axis=1)[:, None]
    for i in np.flatnonzero((cosines == border).sum(axis=1) > (found == border).sum(axis=1)):
        near[i] = np.argsort(-cosines[i], kind="stable")[:k]
    return np.sort(near, axis=1)


@dataclass
class QualityModel:
    idf: np.ndarray
    axes: np.ndarray
    references: np.ndarray
    labels: np.ndarray
    prior: float

    def __post_init__(self):
        self.weigh()

    def weigh(self) -> None:
        """Weights that put the references' votes back to the class shares of all labels; their mean is one, and all are one where the sample has these shares."""
        good = self.labels > 0
        n1, n0 = int(good.sum()), int((~good).sum())
        both = n1 > 0 and n0 > 0
        self.vote_weights = np.where(good, self.prior / max(n1, 1), (1 - self.prior) / max(n0, 1)) * (n1 + n0) if both else np.ones(len(self.labels))

    def weighted(self, slots: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        values = (1 + np.log(counts)) * self.idf[slots]
        norm = float(np.sqrt((values**2).sum()))
        return slots, values / norm if norm else values

    def vector(self, slots: np.ndarray, counts: np.ndarray) -> np.ndarray:
        slots, values = self.weighted(slots, counts)
        out = values.astype(np.float64) @ self.axes[slots]
        norm = float(np.sqrt((out**2).sum()))
        return out / norm if norm else out

    def vote(self, vectors: np.ndarray) -> np.ndarray:
        """Scores of a block of unit vectors: exact cosines with all references, the nearest vote with their squared cosine."""
        if not len(self.references):
            return np.full(len(vectors), self.prior)
        # Double precision and a rounding far above its error: a text's score doesn't depend on the block that it is in.
        cosines = np.round(vectors @ self.references.T, 9)
        near = nearest(cosines, min(NEIGHBOURS, cosines.shape[1]))
        weights = np.maximum(np.take_along_axis(cosines, near, axis=1), 0) ** 2 * self.vote_weights[near]
        # The prior has the weight of a neighbour at cosine 0.1: it decides where nothing is near.
        return np.round(((weights * self.labels[near]).sum(axis=1) + 0.01 * self.prior) / (weights.sum(axis=1) + 0.01), 9)


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality") -> QualityModel:
    """Fit on all documents (document frequencies) and at most SAMPLE_A_CLASS labelled rows of each class."""
    counts = slot_document_counts(docs)
    n_docs = docs.count()
    idf = np.log((1 + n_docs) / (1 + counts)).astype(np.float32)
    features = TextFeatures()
    sample = texts_of(docs, labelled_sample(labels, target, FOLDS, HELD_OUT, SAMPLE_A_CLASS)).orderBy("doc_id")

    def featurise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [features.of(t) for t in pdf["text"]]
            yield pd.DataFrame({"label": pdf["label"], "slots": [s.astype(np.int32) for s, _ in made], "counts": [c for _, c in made]})

    picked = sample.mapInPandas(featurise, "label int, slots array<int>, counts array<float>").toPandas()  # bounded by SAMPLE_A_CLASS and SLOTS
    shares = usable_labels(labels, target, FOLDS, HELD_OUT).agg(F.avg(F.col("label").cast("double"))).first()[0]
    model = QualityModel(idf, np.zeros((SLOTS, 1), np.float32), np.zeros((0, 1)), np.zeros(0), 0.5 if shares is None else float(shares))
    rows = [(np.asarray(s, np.int32), np.asarray(c, np.float32)) for s, c in zip(picked["slots"], picked["counts"], strict=True)]
    keep = [i for i, (s, _) in enumerate(rows) if len(s)]
    if keep:
        model.axes = semantic_axes([model.weighted(*rows[i]) for i in keep], RANK)
        model.references = np.array([model.vector(*rows[i]) for i in keep])
        model.labels = picked["label"].to_numpy()[keep].astype(np.float64)
        model.weigh()
    return model


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """Add ``quality_score`` (0 to 1) to each document, from its text alone.

    Null texts count as empty and get the prior; equal texts get equal scores, as ties
    among neighbours go to the least doc_id; texts of any length are read whole; an empty
    table stays empty. Other columns stay, one named ``quality_score`` is replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fitted, features = held.value, TextFeatures()
        for texts in batches:
            out = []
            for a in range(0, len(texts), BLOCK):
                block = np.array([fitted.vector(*features.of(t)) for t in texts.iloc[a : a + BLOCK]])
                out.append(fitted.vote(block))
            yield pd.Series(np.clip(np.concatenate(out), 0, 1) if out else [], dtype=np.float64)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return docs.withColumn("quality_score", F.pandas_udf(run, "double")(whole_text()))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of each document; other columns are dropped.

    Null texts count as empty; a null doc_id has a null held_out; repeated rows get equal
    results; without labels every score is one half. An empty table stays empty.
    """
    return score(docs, fit(docs, labels)).select(
        "doc_id",
        (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"),
        F.col("quality_score").alias("score"),
        (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier predicts to be good, with their columns, whatever their names. Null and empty texts are kept if the prior reaches THRESHOLD; cases as in ``quality_scores``."""
    rows = docs.select(F.struct("*").alias("row"), F.col("text").alias("text"))
    kept = score(rows, fit(docs, labels)).where(F.col("quality_score") >= THRESHOLD)
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
