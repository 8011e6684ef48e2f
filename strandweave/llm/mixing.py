"""Mixing sources to target weights by Poisson replication, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions

#: Above this many sources the table of rates is joined by a shuffle instead of a broadcast.
MAX_BROADCAST_SOURCES = 10_000
#: 52 bits of an md5 make the uniform number.
UNIT = float(2**52)


def uniform(*parts: Column | str) -> Column:
    """A number in (0, 1) fixed by the parts: 13 hexadecimal digits of an md5, plus one half."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) if isinstance(p, Column) else F.lit(p) for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(UNIT)


def source_rates(docs: DataFrame, weights: dict[str, float] | None, power: float, total: float | None) -> DataFrame:
    """One row a source: its documents and the mean number of times that each is to appear.

    ``weights`` are target shares by source (missing sources get 0). Without them the
    share of a source is its count to the power ``power``: 1 keeps the corpus as it is,
    0 gives all sources the same share. ``total`` is the expected size of the mixture,
    by default the number of documents.
    """
    counts = docs.groupBy(F.col("source").alias("mix_source")).agg(F.count(F.lit(1)).alias("n_docs"))
    if weights is None:
        share = F.pow(F.col("n_docs").cast("double"), F.lit(float(power)))
    else:
        share = F.lit(0.0)
        for name, weight in weights.items():
            share = F.when(F.col("mix_source").eqNullSafe(F.lit(name)), F.lit(float(weight))).otherwise(share)
    counts = counts.withColumn("share", share)
    sums = counts.agg(F.sum("share").alias("all_shares"), F.sum("n_docs").alias("all_docs"))
    size = F.lit(float(total)) if total is not None else F.col("all_docs").cast("double")
    rate = F.coalesce(F.try_divide(F.col("share") * size, F.col("all_shares") * F.col("n_docs")), F.lit(0.0))
    # The sums are one row, whatever the input.
    return counts.crossJoin(F.broadcast(sums)).select("mix_source", rate.alias("rate"))


def poisson_cdf(rate: Column) -> Column:
    """Cumulated probabilities of 0, 1, 2, ... events, as far as they can matter for a 52-bit number."""
    top = F.ceil(rate + 12 * F.sqrt(rate) + 20).cast("int")
    steps = F.sequence(F.lit(0), top)
    grown = F.aggregate(
        steps,
        F.struct(F.lit(0.0).alias("log_factorial"), F.lit(0.0).alias("sum"), F.array().cast("array<double>").alias("cdf")),
        lambda acc, k: _next(acc, k, rate),
        lambda acc: acc["cdf"],
    )
    return F.when(rate > 0, grown).otherwise(F.array(F.lit(1.0)))


def _next(acc: Column, k: Column, rate: Column) -> Column:
    log_factorial = acc["log_factorial"] + F.when(k > 0, F.ln(F.greatest(k, F.lit(1)).cast("double"))).otherwise(0.0)
    total = acc["sum"] + F.exp(k * F.ln(rate) - rate - log_factorial)
    return F.struct(log_factorial.alias("log_factorial"), total.alias("sum"), F.concat(acc["cdf"], F.array(total)).alias("cdf"))


def mix(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    power: float = 0.5,
    total: float | None = None,
    seed: int = 17,
) -> DataFrame:
    """Repeat each document a Poisson number of times with the mean that its source's target weight asks for, and shuffle globally.

    Returns the columns of ``docs`` plus ``mix_copy`` (1, 2, ...) and ``mix_key`` (the
    place in the global order: rows come out range-partitioned and sorted by it).

    The count is the inverse of the Poisson distribution at a number hashed from seed
    and doc_id, so a rerun or a lost executor gives the same rows, and rows that share
    a doc_id share the count. A null source is a source of its own, a null doc_id
    hashes as "null", an empty table stays empty; columns of docs named mix_copy or
    mix_key give way. Documents are never shuffled by
    source: the rates are a table of one row a source, broadcast up to
    ``MAX_BROADCAST_SOURCES`` rows, beyond which an adaptive join splits hot sources.
    """
    rates = source_rates(docs, weights, power, total).select("mix_source", poisson_cdf(F.col("rate")).alias("mix_cdf"))
    n_sources = docs.agg(F.count_distinct(F.coalesce(F.col("source"), F.lit("null")))).first()[0]
    if n_sources <= MAX_BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    # The row travels as one struct, so its column names can't clash with those added here.
    rows = docs.select(F.struct("*").alias("mix_row"), F.col("source").alias("mix_of"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("mix_id"))
    u = uniform(f"{seed}", F.col("mix_id"))
    copies = (
        rows.join(rates, F.col("mix_of").eqNullSafe(F.col("mix_source")))
        .select("mix_row", "mix_id", F.size(F.filter("mix_cdf", lambda c: c < u)).alias("mix_count"))
        .where("mix_count > 0")
        .withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_count"))))
    )
    order = F.md5(F.concat_ws(":", F.lit(f"order{seed}"), "mix_id", F.col("mix_copy").cast("string")))
    out = shuffled(copies.select("mix_row", "mix_copy", order.alias("mix_key")), "mix_key")
    return out.select(*[F.col("mix_row").getField(c).alias(c) for c in docs.columns if c not in ("mix_copy", "mix_key")], "mix_copy", "mix_key")


def shuffled(df: DataFrame, key: str) -> DataFrame:
    """Order by an md5 ``key``: its values are even, so fixed cuts of the first 8 digits serve as range bounds and no sampling pass is needed."""
    n = shuffle_partitions(df.sparkSession)
    place = F.floor(F.conv(F.substring(key, 1, 8), 16, 10).cast("double") * n / float(2**32)).cast("int")
    return df.withColumn("mix_part", place).repartitionById(n, F.col("mix_part")).sortWithinPartitions(key).drop("mix_part")


ORACLE_SQL = """
WITH counts AS (SELECT source, count(*) AS n_docs, pow(count(*)::DOUBLE, 0.5) AS share FROM documents GROUP BY source),
rates AS (SELECT source, share * (SELECT sum(n_docs) FROM counts)::DOUBLE / ((SELECT sum(share) FROM counts) * n_docs) AS rate FROM counts),
steps AS (SELECT source, k, exp(k * ln(rate) - rate - lgamma(k + 1.0)) AS p
          FROM rates, LATERAL (SELECT unnest(range(0, cast(ceil(rate + 12 * sqrt(rate) + 20) AS BIGINT) + 1)) AS k)),
cdf AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM steps),
drawn AS (SELECT d.*, (('0x' || substr(md5('17:' || d.doc_id::VARCHAR), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u FROM documents d),
counted AS (SELECT w.doc_id, w.text, w.lang, w.source, w.n_chars, count(*) AS n
            FROM drawn w JOIN cdf ON w.source = cdf.source AND cdf.c < w.u
            GROUP BY ALL),
copies AS (SELECT doc_id, text, lang, source, n_chars, unnest(range(1, n + 1)) AS copy FROM counted)
SELECT doc_id, text, lang, source, n_chars, cast(copy AS INTEGER) AS mix_copy,
       md5('order17:' || doc_id::VARCHAR || ':' || copy::VARCHAR) AS mix_key
FROM copies
"""
