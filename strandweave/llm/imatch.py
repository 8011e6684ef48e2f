"""I-Match fingerprints: terms of a middling document frequency, sorted, hashed under several randomised lexicon subsets.

Document frequencies are exact, over all documents. At most 1 / (least share) times the
mean number of terms a document has can occur in that share of the documents or more, so
the lexicon is bounded by the length of documents, not by their number; that bound is
checked before the lexicon is broadcast.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BoundedCache, shuffle_partitions, stored, whole_text

#: Distinct terms that a task counts before it hands them on.
HELD_TERMS = 1_000_000
#: Terms of a lexicon (8 bytes each) that may be broadcast: a mean of 8,000 distinct terms a document at the band below.
LARGEST_LEXICON = 8_000_000
#: A term is in the lexicon if its idf, ln(documents / document frequency), lies in this band.
IDF_BAND = (math.log(10), math.log(1000))
#: Lexicon subset k keeps each term with chance 2^-RATES[k mod 8]; small subsets are what survives heavy edits.
SUBSETS, RATES = 32, (1, 3, 5, 6, 7, 7, 8, 8)
EDGES = ".,;:!?\"'()[]{}<>|*&$#%-_/\\"
NO_TERMS = "-" * 8
LEAST = -(2**63)


class Terms:
    """The hashed distinct terms of texts: lower case, cut at white space, stripped of punctuation."""

    def __init__(self):
        self.cache = BoundedCache()

    def of(self, text: str) -> np.ndarray:
        cache, newer, out = self.cache, self.cache.newer, set()
        for word in set(text.split()):
            if (h := newer.get(word)) is None and (h := cache.get(word)) is None:
                term = word.lower().strip(EDGES)
                h = xxhash.xxh64_intdigest(term.encode("utf-8", "surrogatepass")) if term else -1
                cache.keep(word, h)
                newer = cache.newer
            out.add(h)
        out.discard(-1)
        return np.fromiter(out, np.uint64, len(out))


def document_frequencies(docs: DataFrame) -> DataFrame:
    """(term, n): the number of documents that have a term (its hash). Each task adds up its own documents first."""

    def rows(terms: np.ndarray, counts: np.ndarray) -> Iterator[pd.DataFrame]:
        for a in range(0, len(terms), 50_000):
            yield pd.DataFrame({"term": terms[a : a + 50_000].view(np.int64), "n": counts[a : a + 50_000]})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        terms = Terms()
        held, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        pending: list[np.ndarray] = []
        size = 0
        for pdf in batches:
            for text in pdf["text"]:
                pending.append(terms.of(text))
                size += len(pending[-1])
                if size > HELD_TERMS:
                    held, counts = added(held, counts, pending)
                    pending, size = [], 0
                    if len(held) > HELD_TERMS:
                        yield from rows(held, counts)
                        held, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        yield from rows(*added(held, counts, pending))

    return docs.select(whole_text().alias("text")).mapInPandas(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def added(held: np.ndarray, counts: np.ndarray, pending: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct terms with their counts, after each of ``pending`` has been counted once."""
    if not pending:
        return held, counts
    new, n = np.unique(np.concatenate(pending), return_counts=True)
    every, place = np.unique(np.concatenate([held, new]), return_inverse=True)
    return every, np.bincount(place, weights=np.concatenate([counts, n]), minlength=len(every)).astype(np.int64)


def lexicon(docs: DataFrame, band: tuple[float, float] = IDF_BAND) -> bytes:
    """The terms within the band as sorted 64-bit hashes."""
    n_docs = docs.count()
    low, high = band
    idf = F.ln(F.lit(float(max(n_docs, 1))) / F.col("n"))
    inside = stored(document_frequencies(docs).where((idf >= low) & (idf <= high)).select("term"), "lexicon")
    size = inside.count()
    if size > LARGEST_LEXICON:
        raise ValueError(f"{size} terms lie within the band: documents are too long for it, take a narrower one")
    return np.sort(inside.toPandas()["term"].to_numpy(np.int64).view(np.uint64)).tobytes()


class Fingerprints:
    """Makes and compares the fingerprints of texts for one lexicon."""

    SEEDS = np.array([xxhash.xxh64_intdigest(f"subset {k}") for k in range(SUBSETS)], np.uint64)
    SHIFTS = np.array([64 - RATES[k % len(RATES)] for k in range(SUBSETS)], np.uint64)

    def __init__(self, lexicon: bytes):
        self.lexicon, self.terms = np.frombuffer(lexicon, np.uint64), Terms()

    def inside(self, terms: np.ndarray) -> np.ndarray:
        """Those of the lexicon, sorted."""
        if not len(self.lexicon):
            return terms[:0]
        place = np.minimum(np.searchsorted(self.lexicon, terms), len(self.lexicon) - 1)
        return np.sort(terms[self.lexicon[place] == terms])

    def of(self, text: str) -> str:
        """8 hexadecimal digits for each lexicon subset, dashes where no term is left; "=" and a hash of all terms where none is in the lexicon."""
        every = self.terms.of(text)
        kept = self.inside(every)
        if len(kept):
            with np.errstate(over="ignore"):
                mixed = (kept[:, None] ^ self.SEEDS[None, :]) * np.uint64(0x9E3779B97F4A7C15)
                mixed ^= mixed >> np.uint64(29)
                mixed *= np.uint64(0xBF58476D1CE4E5B9)
            chosen = (mixed >> self.SHIFTS) == 0
            full = chosen.any(axis=0)
            if full.any():
                return "".join([xxhash.xxh32_hexdigest(kept[chosen[:, k]].tobytes()) if full[k] else NO_TERMS for k in range(SUBSETS)])
        return "=" + hashlib.blake2b(np.sort(every).tobytes(), digest_size=16).hexdigest()


def likeness(a: str, b: str) -> float:
    """The share of equal parts among those where at least one fingerprint has terms."""
    if a == b:
        return 1.0
    if a[0] == "=" or b[0] == "=":
        return 0.0
    same = some = 0
    for at in range(0, 8 * SUBSETS, 8):
        x, y = a[at : at + 8], b[at : at + 8]
        if x != NO_TERMS or y != NO_TERMS:
            some += 1
            same += x == y
    return same / some


def fingerprint(docs: DataFrame, terms: bytes | None = None) -> DataFrame:
    """Add ``fingerprint`` to each document (a column of that name is replaced). Null texts count as empty; equal texts get equal fingerprints; an empty table stays empty."""
    held = docs.sparkSession.sparkContext.broadcast(terms if terms is not None else lexicon(docs))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        make = Fingerprints(held.value)
        for texts in batches:
            yield pd.Series([make.of(t) for t in texts], dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return docs.withColumn("fingerprint", F.pandas_udf(run, "string")(whole_text()))


def edited(text: str, following: str) -> str:
    """The text with its last half (rounded down) replaced by as much of the beginning of the next."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_next_bucket(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, guest, doc_id, mix, text): documents cut into ranges of (doc_id, mix), each range followed by a guest, the first document of the next range (of the first, after the last).

    ``mix`` is a hash of the text: it orders rows that share a doc_id, so that one with
    very many rows is cut as well.
    """
    rows = docs.select(F.coalesce(F.col("doc_id"), F.lit(LEAST)).cast("long").alias("doc_id"), whole_text().alias("text")).withColumn("mix", F.xxhash64("text"))
    quantiles = rows.approxQuantile("doc_id", [i / buckets for i in range(1, buckets)], 0.25 / buckets) if buckets > 1 else []
    # An identifier that is several quantiles has that many buckets' worth of rows: its hashes are cut evenly. Doubles are rounded, so cuts needn't be identifiers.
    ids, times = np.unique(np.array([int(min(q, 2.0**63 - 1024)) for q in quantiles], np.int64), return_counts=True)
    cuts = [(i, LEAST + (2**64 * k) // n) for i, n in zip(ids.tolist(), times.tolist(), strict=True) for k in range(n)]
    cut_ids, cut_mixes = np.array([c[0] for c in cuts], np.int64), np.array([c[1] for c in cuts], np.int64)

    def place(ids: pd.Series, mixes: pd.Series) -> pd.Series:
        i, m = ids.to_numpy(np.int64), mixes.to_numpy(np.int64)
        low, high = np.searchsorted(cut_ids, i, side="left"), np.searchsorted(cut_ids, i, side="right")
        out = high.copy()
        for a in np.unique(low[high > low + 1]):  # identifiers with several cuts
            mine = (low == a) & (high > low)
            out[mine] = a + np.searchsorted(cut_mixes[a : high[mine][0]], m[mine], side="right")
        return pd.Series(out.astype(np.int32))

    bucket = F.pandas_udf(place, "int")("doc_id", "mix")
    first = F.min(F.struct("doc_id", "mix")).alias("first")
    # One row a bucket: the number of buckets is set by the number of partitions.
    firsts = sorted((r.bucket, tuple(r["first"])) for r in rows.select("doc_id", "mix", bucket.alias("bucket")).groupBy("bucket").agg(first).collect())
    hosts = [(*first_row, firsts[i - 1][0]) for i, (_, first_row) in enumerate(firsts)]
    guests = F.broadcast(docs.sparkSession.createDataFrame(hosts, "doc_id long, mix long, host int"))
    own = F.struct(F.col("bucket"), F.lit(False).alias("guest"))
    guest = F.struct(F.col("host").alias("bucket"), F.lit(True).alias("guest"))
    placed = rows.withColumn("bucket", bucket).join(guests, ["doc_id", "mix"], "left")
    return placed.select("doc_id", "mix", "text", F.explode(F.when(F.col("host").isNull(), F.array(own)).otherwise(F.array(own, guest))).alias("p")).select("p.bucket", "p.guest", "doc_id", "mix", "text")


DIGEST = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edit_digests(docs: DataFrame) -> DataFrame:
    """Fingerprint each document and its edited text, and compare: with the edited text, and with the next document by doc_id.

    Null texts count as empty, a null doc_id as the least number; equal doc_ids are
    ordered by a hash of the text; the last document is followed by the first, one alone by itself.
    Texts of any length are read whole. An empty table stays empty; other columns are dropped.
    """
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    held = spark.sparkContext.broadcast(lexicon(docs))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        make = Fingerprints(held.value)
        bucket, waiting, done = None, None, False
        for pdf in batches:
            rows = []
            for b, guest, doc_id, text in zip(pdf["bucket"], pdf["guest"], pdf["doc_id"], pdf["text"], strict=True):
                if b != bucket:
                    bucket, waiting, done = b, None, False
                if done:
                    continue  # only the first guest follows
                mine = make.of(text)
                if waiting:
                    before_id, before, its = waiting
                    other = edited(before, text)
                    changed = make.of(other)
                    rows.append((None if before_id == LEAST else before_id, len(before), hashlib.sha256(other.encode("utf-8", "surrogatepass")).hexdigest(), its, changed, likeness(its, changed), likeness(its, mine)))
                waiting, done = (doc_id, text, mine), guest
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in DIGEST.split(", ")])
            yield out.assign(doc_id=pd.array([r[0] for r in rows], "Int64"))  # a null doesn't turn the others into doubles

    placed = with_next_bucket(docs, 4 * n)
    return placed.repartition(n, "bucket").sortWithinPartitions("bucket", "guest", "doc_id", "mix").mapInPandas(run, DIGEST)
