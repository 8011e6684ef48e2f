"""Sequence tables: lookup of intervals, mutants and combinations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sequences as fx
from .ranges import with_ranks


def chunked(seqs: DataFrame, name: str, seq: str, size: int) -> DataFrame:
    """(chrom, chunk, seq): whole sequences cut to rows of ``size`` bases, the form that lookups join."""
    return seqs.select(F.col(name).alias("chrom"), F.posexplode(fx.blocks(F.col(seq), size)).alias("chunk", "seq"))


def lookup(intervals: DataFrame, fasta: DataFrame, size: int, name: str = "sequence") -> DataFrame:
    """Bases of each interval from chunks of ``size`` bases; what the chunks don't cover is N.

    Interval rows are told apart by all their columns, which must be sortable.
    """
    keys = intervals.columns
    wanted = intervals.withColumn("chunk", F.explode(F.sequence(F.floor(F.greatest("start", F.lit(0)) / size), F.floor((F.col("stop") - 1) / size))))
    begin, end = F.greatest("start", F.col("chunk") * size), F.least("stop", (F.col("chunk") + 1) * size)
    piece = F.rpad(F.coalesce(F.substring("seq", (begin - F.col("chunk") * size + 1).cast("int"), (end - begin).cast("int")), F.lit("")), (end - begin).cast("int"), "N")
    pieces = wanted.join(fasta, ["chrom", "chunk"], "left").withColumn("_p", F.struct(F.col("chunk"), F.upper(piece).alias("s")))
    return pieces.groupBy(*keys).agg(F.array_sort(F.collect_set("_p")).alias("_p")).select(*keys, F.array_join(F.col("_p.s"), "").alias(name))


def shuffles(seqs: DataFrame, key: str, seq: str, n: int, size: int = 2, digests: bool = False) -> DataFrame:
    """The sequence (aux_idx 0) and ``n`` block shuffles of it, ordered by one md5 a sequence or with ``digests`` by one md5 a block."""
    rows = seqs.withColumn("aux_idx", F.explode(F.sequence(F.lit(0), F.lit(n))))
    keyed = F.when(F.col("aux_idx") != 0, F.concat_ws(":", F.col(key).cast("string"), F.col("aux_idx").cast("string")))
    return rows.withColumn(seq, fx.block_shuffle(F.col(seq), keyed, "shuffle", size, digests))


def combinations(seqs: DataFrame, sites: list[int], base: str, seq: str) -> DataFrame:
    """All 2^k mutants of the given positions: bit i of ``combo`` says whether position i holds ``base``."""
    rows = seqs.withColumn("combo", F.explode(F.sequence(F.lit(0), F.lit((1 << len(sites)) - 1))))
    out: Column = F.col(seq)
    for i, at in enumerate(sites):
        out = F.when(F.expr(f"(combo >> {i}) & 1") == 1, F.overlay(out, F.lit(base), F.lit(at + 1))).otherwise(out)
    return rows.withColumn(seq, out)


def kmer_counts(seqs: DataFrame, key: str, seq: str, k: int) -> DataFrame:
    return seqs.select(key, F.explode(fx.kmers(F.col(seq), k)).alias("kmer")).groupBy(key, "kmer").agg(F.count(F.lit(1)).alias("n"))


def deltas(rows: DataFrame, example: str, aux: str, value: str, extra: list[str]) -> DataFrame:
    """Each mutant's value minus that of its example's wild type (aux 0)."""
    wild = rows.where(F.col(aux) == 0).select(example, *extra, F.col(value).alias("_wild"))
    return rows.where(F.col(aux) != 0).join(wild, [example, *extra]).select(example, aux, *extra, (F.col(value) - F.col("_wild")).alias("delta"))


def epistasis(combos: DataFrame, example: str, combo: str, value: str) -> DataFrame:
    """expected = (01 - 00) + (10 - 00) and actual = 11 - 00 of each example, and their difference."""
    wide = combos.groupBy(example).pivot(combo, [0, 1, 2, 3]).agg(F.first(value))
    expected = (F.col("1") - F.col("0")) + (F.col("2") - F.col("0"))
    return wide.select(example, expected.alias("expected"), (F.col("3") - F.col("0")).alias("actual"), (F.col("3") - F.col("0") - expected).alias("diff"))


def barcoded(seqs: DataFrame, barcodes: DataFrame, key: str, per_sequence: int) -> DataFrame:
    """Give each sequence its next ``per_sequence`` barcodes (barcode, rank: numbered from 0 without gaps). Sequences are numbered in the order of a numeric key, range by range."""
    rows = with_ranks(seqs, [], key, ordinal="_n").withColumn("_n", F.col("_n") - 1).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(per_sequence - 1))))
    return rows.withColumn("rank", (F.col("_n") * per_sequence + F.col("copy")).cast("long")).join(barcodes, "rank").drop("_n")


def grammar_layouts(motifs: list[str], spacings: list[int]) -> list[tuple[str, str, int]]:
    """(first, second, gap) for all orders of two motifs and all spacings."""
    return [(a, b, g) for a in motifs for b in motifs if a != b for g in spacings]


def simulate_grammars(backgrounds: DataFrame, motifs: list[str], spacings: list[int], seq: str, at: int) -> DataFrame:
    """Every background with every order, orientation and spacing of two motifs written into it."""
    spark = backgrounds.sparkSession
    layouts = F.broadcast(spark.createDataFrame(grammar_layouts(motifs, spacings), "first string, second string, gap int"))
    turned = F.explode(F.array(F.lit("++"), F.lit("+-"), F.lit("-+"), F.lit("--"))).alias("orientation")
    rows = backgrounds.join(layouts, F.lit(True)).select("*", turned)  # as many rows as the design asks for

    def oriented(motif: str, place: int) -> Column:
        return F.when(F.substring("orientation", place, 1) == "+", F.col(motif)).otherwise(fx.reverse_complement(F.col(motif)))

    second_at = F.lit(at) + F.length("first") + F.col("gap")
    return rows.withColumn(seq, fx.splice(fx.splice(F.col(seq), oriented("first", 1), F.lit(at)), oriented("second", 2), second_at))
