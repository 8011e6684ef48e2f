"""Target-distribution importance resampling over hashed n-grams, with CRC combination algebra.

A feature is a run of one to ``max_n`` words joined by one space; its bucket is the CRC-32
of its bytes modulo ``buckets``. The CRC of each word is computed once. That of a longer run
follows from those of its parts: appending bytes to a text multiplies its CRC by a power of
one matrix over GF(2), so ``crc(a + b) = shift(crc(a), len(b)) ^ crc(b)``, and no n-gram
string is ever made. Buckets are counted over the corpus and over a target; a document's
weight is the sum of its features' log ratios, and Gumbel noise fixed by its identifier
turns the highest scores into a draw without replacement in proportion to the weights.
"""

from __future__ import annotations

import itertools
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SQL_CRC, SQL_CRC_TABLE, shuffle_partitions, stored, whole_text

MAX_N, BUCKETS = 1, 10_000
MIN_WORDS, PERCENT, SEED = 20, 10, 2024
#: Fixed value: the reflected polynomial of CRC-32.
POLYNOMIAL = 0xEDB88320
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _times(columns: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A 32 x 32 matrix over GF(2), given by its columns, times each value."""
    out = np.zeros_like(values)
    for bit in range(32):
        out ^= np.where(values >> np.uint32(bit) & np.uint32(1), columns[bit], np.uint32(0))
    return out


class Shifts:
    """What zero bytes behind a text do to its CRC: one matrix for each power of two of them, as four tables of 256."""

    def __init__(self):
        one_bit = np.array([POLYNOMIAL, *[1 << i for i in range(31)]], np.uint32)
        self.columns = one_bit
        for _ in range(3):
            self.columns = _times(self.columns, self.columns)
        self.tables: list[np.ndarray] = []

    def table(self, power: int) -> np.ndarray:
        while len(self.tables) <= power:
            self.tables.append(np.stack([_times(self.columns, np.arange(256, dtype=np.uint32) << np.uint32(8 * j)) for j in range(4)]))
            self.columns = _times(self.columns, self.columns)
        return self.tables[power]

    def shift(self, crcs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Each CRC after as many bytes as its length says, but for the CRC of these bytes themselves."""
        out = crcs.copy()
        for power in range(int(lengths.max(initial=0)).bit_length()):
            at = np.nonzero(lengths >> power & 1)[0]
            table, v = self.table(power), out[at]
            out[at] = table[0][v & 255] ^ table[1][v >> 8 & 255] ^ table[2][v >> 16 & 255] ^ table[3][v >> 24]
        return out


def words_of(text: str) -> list[bytes]:
    """The words of a text, A-Z lower-cased, as UTF-8."""
    return WORD.findall(text.encode("utf-8", "surrogatepass").lower())


def run_crcs(words: list[bytes], max_n: int, shifts: Shifts) -> Iterator[np.ndarray]:
    """For n from 1 to ``max_n`` the CRC-32 of each run of n words joined by one space."""
    crcs = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
    yield crcs
    if max_n > 1:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        behind_space = shifts.shift(np.full(len(words), zlib.crc32(b" "), np.uint32), lengths) ^ crcs
        runs = crcs
        for n in range(2, min(max_n, len(words)) + 1):
            runs = shifts.shift(runs[:-1], 1 + lengths[n - 1 :]) ^ behind_space[n - 1 :]
            yield runs


def feature_buckets(words: list[bytes], max_n: int, buckets: int, shifts: Shifts) -> np.ndarray:
    return np.concatenate([crcs % np.uint32(buckets) for crcs in run_crcs(words, max_n, shifts)])


def bucket_counts(texts: DataFrame, max_n: int = MAX_N, buckets: int = BUCKETS) -> np.ndarray:
    """The number of features in each bucket, over all texts. Each task adds up its own; as many numbers as buckets reach the driver."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shifts, total = Shifts(), np.zeros(buckets, np.int64)
        for pdf in batches:
            for text in pdf["text"]:
                total += np.bincount(feature_buckets(words_of(text), max_n, buckets, shifts), minlength=buckets)
        some = np.nonzero(total)[0]
        yield pd.DataFrame({"bucket": some, "n": total[some]})

    rows = texts.where("text IS NOT NULL").select("text").mapInPandas(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in rows.collect():  # at most one row a bucket
        out[r.bucket] = r.n
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the log ratio of the smoothed shares that a bucket has in the target and in the corpus, rounded down."""
    n, all_corpus, all_target = len(corpus), float(corpus.sum() + len(corpus)), float(target.sum() + len(target))
    ratios = (float(target[b] + 1) * all_corpus / (float(corpus[b] + 1) * all_target) for b in range(n))
    return np.array([math.floor(1000 * math.log(x)) for x in ratios], np.int64)


def weighed(docs: DataFrame, gains: np.ndarray, max_n: int = MAX_N) -> DataFrame:
    """One struct column ``row`` with the columns of docs, beside n_words, n_features and weight: the sum of the gains of all features of the whole text."""
    held = docs.sparkSession.sparkContext.broadcast(gains)

    def weigh(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        shifts, by = Shifts(), held.value
        for texts in batches:
            words = [words_of(t) for t in texts]
            found = [feature_buckets(w, max_n, len(by), shifts) for w in words]
            yield pd.DataFrame({"n_words": [len(w) for w in words], "n_features": [len(f) for f in found], "weight": [int(by[f].sum()) for f in found]}, dtype=np.int64)

    weigh.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    told = F.pandas_udf(weigh, "n_words long, n_features long, weight long")(whole_text())
    return docs.select(F.struct("*").alias("row"), told.alias("told")).select("row", "told.*")


def gumbel(doc_id: Column, seed: int) -> Column:
    """1000 times a Gumbel number fixed by seed and identifier, rounded down. A null identifier counts as the empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    unit = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln(unit)))


def importance_scores(docs: DataFrame, target: DataFrame, max_n: int = MAX_N, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """``row`` (a struct of the columns of docs), doc_id, n_words, n_features, weight, score of each row of docs.

    ``target`` has the column text; all its texts and all of docs are counted, whole. Null
    texts have no features and weight 0, as have texts without words; rows with equal
    texts have equal weights, rows with equal identifiers the same noise; a null doc_id
    has the noise of the empty text. An empty corpus stays empty, an empty target gives
    smoothed shares. What reaches the driver is one number a bucket, twice.
    """
    gains = bucket_gains(bucket_counts(docs, max_n, buckets), bucket_counts(target, max_n, buckets))
    rows = weighed(docs, gains, max_n).withColumn("doc_id", F.col("row.doc_id"))
    return rows.withColumn("score", (F.col("weight") + gumbel(F.col("doc_id"), seed)).cast("long"))


def drawn(scored: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """Add ``rank``: 1, 2, 3, ... for the draw, null for the rest.

    Of the rows with at least ``min_words`` words (n_words), that many percent (rounded
    down) with the highest scores are drawn; ties go to the smaller doc_id (null last), then
    to fewer features, then to the smaller weight; rows that are equal in all these take their
    places in no fixed order. The order is one of ranges that rows without a difference
    share too, so no score, identifier or group of copies crowds a task.
    """
    fits = F.col("n_words") >= min_words
    spread = scored.withColumn("_fits", fits).withColumn("_at", F.monotonically_increasing_id())
    order = [F.col("_fits").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "n_features", "weight", "_at"]
    laid = spread.repartitionByRange(shuffle_partitions(scored.sparkSession), *order).sortWithinPartitions(*order)
    # The number within its partition is the low part of this id.
    laid = laid.withColumn("_part", F.spark_partition_id()).withColumn("_place", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    laid = stored(laid.drop("_at"), "drawn")
    sizes = {r["_part"]: r for r in laid.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("_fits").cast("long")).alias("fit")).collect()}  # one row a partition
    wanted = sum(r.fit for r in sizes.values()) * percent // 100
    parts = sorted(sizes)
    before = dict(zip(parts, itertools.accumulate((sizes[p].n for p in parts), initial=0), strict=False))
    offsets = scored.sparkSession.createDataFrame([(p, n) for p, n in before.items()], "_part int, _before long")
    rank = F.col("_before") + F.col("_place") + 1
    return laid.join(F.broadcast(offsets), "_part").withColumn("rank", F.when(F.col("_fits") & (rank <= wanted), rank)).drop("_part", "_place", "_before", "_fits")


def resampled(docs: DataFrame, target: DataFrame, max_n: int = MAX_N, buckets: int = BUCKETS, min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """The drawn rows of docs, with their columns. Cases as in importance_scores and drawn."""
    out = drawn(importance_scores(docs, target, max_n, buckets, seed), percent, min_words).where("rank IS NOT NULL")
    return out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def importance_digests(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_features, weight, score, rank of each row, by the production parameters. Cases as in importance_scores and drawn."""
    # Written once: the ranges of the draw are found by a pass of their own, which shouldn't read texts again.
    return drawn(stored(importance_scores(docs, target).drop("row"), "scored")).select("doc_id", "n_features", "weight", "score", "rank")


ORACLE_SQL = rf"""
WITH {SQL_CRC_TABLE},
lowered AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
wanted AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
each AS (SELECT doc_id, unnest(words) AS word FROM lowered),
vocabulary AS (SELECT word, {SQL_CRC.format(text="word")} % 10000 AS bucket FROM (SELECT word FROM each UNION SELECT word FROM wanted), crc_table),
corpus AS (SELECT bucket, count(*) AS s FROM each JOIN vocabulary USING (word) GROUP BY bucket),
target AS (SELECT bucket, count(*) AS t FROM wanted JOIN vocabulary USING (word) GROUP BY bucket),
gains AS (SELECT bucket, cast(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (SELECT coalesce(sum(s), 0) + 10000 FROM corpus)::DOUBLE
            / ((s + 1)::DOUBLE * (SELECT coalesce(sum(t), 0) + 10000 FROM target)::DOUBLE))) AS BIGINT) AS gain FROM corpus LEFT JOIN target USING (bucket)),
sums AS (SELECT doc_id, sum(gain) AS weight FROM each JOIN vocabulary USING (word) JOIN gains USING (bucket) GROUP BY doc_id),
scored AS (SELECT doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
             (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id::VARCHAR), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score
           FROM lowered LEFT JOIN sums USING (doc_id)),
places AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () * 10 // 100 AS k FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= k THEN place END AS rank FROM scored LEFT JOIN places USING (doc_id)
"""
