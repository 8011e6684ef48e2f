"""Commands on files: each reads the domain's formats, runs a stack and writes a Parquet table."""

from __future__ import annotations

import argparse
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import metrics, models, motifs, sequences, variants
from .plans import stacks
from .sources import readers

COMMANDS: dict[str, tuple[Callable[[SparkSession, argparse.Namespace], DataFrame], list[tuple[tuple[str, ...], dict]]]] = {}


def command(name: str, *options: tuple[tuple[str, ...], dict]):
    def add(f):
        COMMANDS[name] = (f, list(options))
        return f

    return add


def option(*names: str, **rest) -> tuple[tuple[str, ...], dict]:
    return names, rest


def _named(files: list[str]) -> dict[str, str]:
    """``name=path`` arguments; a bare path is named by its file."""
    return {(f.split("=", 1)[0] if "=" in f else Path(f).name.split(".")[0]): f.split("=", 1)[-1] for f in files}


def _motifs(path: str) -> list[motifs.Pwm]:
    return readers.read_pwms(Path(path).read_text().splitlines())  # some hundred motifs


@command(
    "preprocess", option("--labels", nargs="+", required=True), option("--signals", nargs="*", default=[]), option("--sizes", required=True), option("--fasta"),
    option("--bin_size", type=int, default=200), option("--stride", type=int, default=50), option("--extension", type=int, default=400),
)
def preprocess(spark: SparkSession, given: argparse.Namespace) -> DataFrame:
    """Label and signal files to tiled, labelled and measured examples, with their sequences where a FASTA file is given."""
    labels = {n: readers.read(spark, "bed", p) for n, p in _named(given.labels).items()}
    signals = {n: readers.read(spark, "bedgraph", p) for n, p in _named(given.signals).items()}
    out = stacks.build_examples(labels, signals, readers.read_sizes(spark, given.sizes), given.bin_size, given.stride, given.extension)
    if not given.fasta:
        return out
    size = 10_000
    wide = out.select("chrom", (F.col("start") - given.extension).alias("start"), (F.col("stop") + given.extension).alias("stop"), "example_metadata")
    found = sequences.lookup(wide, readers.read(spark, "fasta", given.fasta, size=size), size).select("example_metadata", "sequence")
    return out.join(found, "example_metadata")


@command("scanmotifs", option("--examples", required=True), option("--motifs", required=True), option("--shuffles", type=int, default=7), option("--share", type=float, default=0.01))
def scanmotifs(spark: SparkSession, given: argparse.Namespace) -> DataFrame:
    """Hits of prepared motifs on both strands beyond each example's shuffles."""
    kernel = motifs.prepared(_motifs(given.motifs), both_strands=True)
    return stacks.motif_scores(spark.read.parquet(given.examples), "example_metadata", "sequence", kernel, given.shuffles, given.share)


@command("mutatemotifs", option("--examples", required=True), option("--motifs", required=True), option("--above", type=float, default=0.0))
def mutatemotifs(spark: SparkSession, given: argparse.Namespace) -> DataFrame:
    """Effect of blanking each example's best site of every motif on the sums of all motifs."""
    rows, pwms = spark.read.parquet(given.examples), _motifs(given.motifs)
    return stacks.mutation_effects(rows, "example_metadata", "sequence", motifs.scan(rows, "example_metadata", "sequence", pwms, given.above), pwms)


@command("simulategrammars", option("--backgrounds", required=True), option("--motif", nargs="+", required=True), option("--spacing", nargs="+", type=int, default=[5, 10]), option("--at", type=int, default=20))
def simulategrammars(spark: SparkSession, given: argparse.Namespace) -> DataFrame:
    """Every order, orientation and spacing of the motifs written into every background that has room."""
    longest = given.at + 2 * max(map(len, given.motif)) + max(given.spacing)
    rows = spark.read.parquet(given.backgrounds).where(F.length("sequence") >= longest)
    return sequences.simulate_grammars(rows, given.motif, given.spacing, "sequence", given.at)


@command("analyzevariants", option("--vcf", required=True), option("--fasta", required=True), option("--motifs", required=True), option("--length", type=int, default=200), option("--sds", type=float, default=2.0))
def analyzevariants(spark: SparkSession, given: argparse.Namespace) -> DataFrame:
    """(id, chrom, site, pwm_idx, ref, alt, diff): variants whose alleles change a motif's best score by more than some deviations."""
    size = 10_000
    fasta = readers.read(spark, "fasta", given.fasta, size=size)
    rows = variants.windows(readers.read(spark, "vcf", given.vcf), given.length, 0, 1).where("start >= 0").select("chrom", "start", "stop", "id", F.col("pos").alias("site"), "ref", "alt", "offset")
    both = variants.alleles(sequences.lookup(rows, fasta, size), "sequence", "offset")
    hits = motifs.scan(both, ["id", "chrom", "site", "allele"], "sequence", motifs.prepared(_motifs(given.motifs), both_strands=True), 0.0)
    best = hits.groupBy("id", "chrom", "site", "pwm_idx", "allele").agg(F.max("score").alias("score"))
    return variants.significant(variants.paired(best, ["id", "chrom", "site", "pwm_idx"], "allele", "score").fillna(0.0, ["ref", "alt"]).withColumn("diff", F.col("alt") - F.col("ref")), "diff", given.sds)


@command("evaluate", option("--predictions", required=True), option("--task", default="task"), option("--label", default="label"), option("--score", default="score"))
def evaluate(spark: SparkSession, given: argparse.Namespace) -> DataFrame:
    """Areas under ROC and PR curves and recall at a precision of 0.9, by task."""
    return metrics.ranking_metrics(spark.read.parquet(given.predictions), given.task, given.label, given.score)


@command("baseline", option("--train", required=True), option("--test", required=True), option("--features", default="features"), option("--label", default="label"), option("--num_trees", type=int, default=100))
def baseline(spark: SparkSession, given: argparse.Namespace) -> DataFrame:
    """A random forest's probabilities for the test table."""
    return models.random_forest(spark.read.parquet(given.train), spark.read.parquet(given.test), given.features, given.label, given.num_trees)
