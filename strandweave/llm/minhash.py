"""MinHash near-duplicates by fast similarity sketching, banding and exact verification.

A sketch has ``SIZE`` coordinates. In round i each shingle is hashed into one bin with the
value (i, hash), and a bin keeps its least value; the first SIZE rounds place shingles
freely, each of the next SIZE rounds puts all of them into one bin of its own, so no
coordinate stays empty, however small the set. Rounds stop once all bins are filled:
that takes as many placements as the set has shingles, and some SIZE log SIZE, not their
product. Two sets agree at a coordinate with a chance that is their Jaccard index, and
the number of agreeing coordinates concentrates as that of independent trials does.
``BANDS`` bands of equal size are hashed; sets that share a band are candidates and
are verified exactly (see ``blocks``).
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import KEY, AsciiShingles, exact_classes, linked_classes, often_repeated, shared_nodes, signed
from .common import join_spread, stored

WORDS = 4
THRESHOLD = Fraction(80, 100)
#: A pair at the threshold shares no band with a chance of (1 - 0.8 ** 6) ** 40, some 5 in a million.
BANDS, ROWS = 40, 6
SIZE = BANDS * ROWS
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


class FastSketch:
    """Sketches of sets of 64-bit hashes."""

    def __init__(self, size: int = SIZE, bands: int = BANDS):
        rng = np.random.default_rng(13)
        self.size, self.bands = size, bands
        self.factors = rng.integers(0, 1 << 63, (2 * size, 1), np.uint64) * np.uint64(2) + np.uint64(1)
        self.terms = rng.integers(0, 1 << 63, (2 * size, 1), np.uint64)
        self.folds = rng.integers(0, 1 << 63, size // bands, np.uint64) * np.uint64(2) + np.uint64(1)
        #: So many placements fill all bins of nearly every set.
        self.enough = int(size * (math.log(size) + 3))

    def of(self, elements: np.ndarray) -> np.ndarray:
        """The coordinates of a set that isn't empty. How many rounds are taken at once doesn't change them."""
        out, size, low = np.full(self.size, _EMPTY), self.size, np.uint64(0xFFFFFFFF)
        step, start = max(1, -(-self.enough // len(elements))), 0
        while start < size and (out == _EMPTY).any():
            end = min(start + step, size)
            h = _mixed(elements[None, :] * self.factors[start:end] + self.terms[start:end])
            values = h & low | np.arange(start, end, dtype=np.uint64)[:, None] << np.uint64(32)
            np.minimum.at(out, ((h >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.intp).ravel(), values.ravel())
            start = end
        empty = np.nonzero(out == _EMPTY)[0]
        if len(empty):  # only sets so small that all SIZE rounds were too few
            rounds = empty + size
            h = _mixed(elements[None, :] * self.factors[rounds] + self.terms[rounds])
            out[empty] = (h & low).min(axis=1) | rounds.astype(np.uint64) << np.uint64(32)
        return out

    def band_keys(self, elements: np.ndarray) -> bytes:
        """A 64-bit number for each band, big-endian."""
        parts = self.of(elements).reshape(self.bands, -1)
        keys = _mixed((parts * self.folds).sum(axis=1, dtype=np.uint64) + np.arange(self.bands, dtype=np.uint64))
        return keys.astype(">u8").tobytes()


def sketches(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(KEY, n_shingles, set_key, signature) of each row: the signature is the keys of all bands."""

    def make():
        return AsciiShingles(words), FastSketch().band_keys

    return signed(docs, make)


def band_nodes(classes: DataFrame) -> DataFrame:
    """(rep, node, first): each representative's bands that it shares with another, and the least representative of each."""
    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.substr("signature", b * 8 + 1, F.lit(8))))
    return shared_nodes(classes.where("n_shingles > 0").select("rep", F.explode(keys).alias("node")), BANDS * classes.count())


def near_copies(docs: DataFrame, words: int = WORDS, threshold: Fraction = THRESHOLD) -> DataFrame:
    """One row a row of docs: doc_id, n_shingles, component_id, kept.

    Two documents are linked if the Jaccard index of their sets of word shingles is at
    least ``threshold``; links are confirmed on the full sets. ``component_id`` is the
    least doc_id reachable through links, the document's own included; ``kept`` is true
    where that is its own. Texts without words (null ones too) are linked with nothing.
    A null doc_id comes after all others and is known by its text: such a row's
    component_id is null unless it reaches an identifier, and it is kept where it is the
    first of its component. Rows that share a doc_id but not a text are linked each by
    its own text; rows equal in both are kept or not alike. Texts of any length are read
    whole. An empty table stays empty; other columns are dropped.
    """
    sigs = stored(sketches(docs, words), "sketches")
    some = sigs.where("n_shingles > 0")
    hot = often_repeated(some)
    classes = stored(exact_classes(some), "classes")
    nodes = stored(band_nodes(classes), "nodes")
    _, linked = linked_classes(docs, classes, nodes, F.substr("signature", F.lit(1), F.lit(8)), hot, lambda: AsciiShingles(words), threshold)
    heads = classes.select("set_key", "rep").join(linked, "rep", "left").select("set_key", F.coalesce("component", "rep").alias("head"))
    copies = classes.select("set_key", F.col("copies").alias("_n"))
    with_heads = join_spread(some, heads, "set_key", copies, some.count())
    alone = sigs.where("n_shingles = 0").withColumn("head", F.struct(*KEY))
    return with_heads.select(*KEY, "n_shingles", "head").unionByName(alone.select(*KEY, "n_shingles", "head")).select(
        F.when(~F.col("no_id"), F.col("uid")).alias("doc_id"),
        F.col("n_shingles").cast("long").alias("n_shingles"),
        F.when(~F.col("head.no_id"), F.col("head.uid")).alias("component_id"),
        F.when(F.col("no_id"), F.struct(*KEY) == F.col("head")).otherwise(~F.col("head.no_id") & (F.col("uid") == F.col("head.uid"))).alias("kept"),
    )


ORACLE_SQL = r"""
WITH RECURSIVE cut AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
               ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM cut),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common c JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c.n >= 80 * (x.n + y.n - c.n)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reached AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reached r JOIN both_ways e ON r.b = e.a),
least AS (SELECT a AS doc_id, min(b) AS m FROM reached GROUP BY a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(m, d.doc_id)) AS kept
FROM cut d LEFT JOIN sizes USING (doc_id) LEFT JOIN least USING (doc_id)
"""
