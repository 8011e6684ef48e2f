"""Readers of the domain's text formats, as Spark scans."""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.intervals import tile
from ..operators.motifs import Pwm, from_probabilities
from .bigwig import read_bigwig
from .shared import spread

NARROW_PEAK = "chrom string, start long, stop long, name string, score int, strand string, signal double, p double, q double, summit long"


def read_bed(spark: SparkSession, path: str | list[str], schema: str = "chrom string, start long, stop long, name string") -> DataFrame:
    """BED lines (gzip too); lines with fewer columns give nulls."""
    return spark.read.csv(path, sep="\t", schema=schema, mode="PERMISSIVE", comment="#")


def read_narrow_peaks(spark: SparkSession, path: str) -> DataFrame:
    return read_bed(spark, path, NARROW_PEAK)


def read_tiled_bed(spark: SparkSession, path: str, bin_size: int, stride: int) -> DataFrame:
    return tile(read_bed(spark, path), bin_size, stride)


def read_bedgraph(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="chrom string, start long, stop long, value double", comment="t")


def read_sizes(spark: SparkSession, path: str) -> DataFrame:
    """Chromosome sizes without alternative contigs and chrM."""
    return spark.read.csv(path, sep="\t", schema="chrom string, size long").where(~F.col("chrom").contains("_") & (F.col("chrom") != "chrM"))


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, pos from 1, id, ref, alt, info); chromosomes get a chr prefix where it is missing."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").startswith("#") & (F.length("value") > 0))
    chrom = F.when(f[0].startswith("chr"), f[0]).otherwise(F.concat(F.lit("chr"), f[0]))
    return rows.select(chrom.alias("chrom"), f[1].cast("long").alias("pos"), f[2].alias("id"), f[3].alias("ref"), f[4].alias("alt"), F.get(f, 7).alias("info"))


#: Into parts of how many lines (a power of two) a block of a FASTA file is cut.
LINES = 1 << 15


def read_fasta(spark: SparkSession, path: str, size: int = 10_000) -> DataFrame:
    """(chrom, chunk, seq): sequences cut to chunks of ``size`` bases, upper case.

    Lines are read as rows in the order of their file blocks, which are cut into parts of
    LINES lines; what a part has to know of those before it (the record that reaches into it and
    how far that has come) is one row a part. No value is longer than a line or a chunk.
    """
    line, head = F.trim("value"), F.regexp_extract(F.trim("value"), r"^>(\S*)", 1)
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_i"),
        F.when(line.startswith(">"), head).alias("_h"), F.when(line.startswith(">"), F.lit("")).otherwise(F.upper(line)).alias("_s"),
    )
    # The low 33 bits number the lines of a task, which may read several files.
    lines = spread(lines.withColumn("_b", F.struct("_start", F.shiftright(F.col("_i").bitwiseAND(2**33 - 1), LINES.bit_length() - 1).alias("_n"))).drop("_start"), "_f", "_b")
    inside = Window.partitionBy("_f", "_b").orderBy("_i")
    rows = lines.withColumn("_k", F.count("_h").over(inside)).withColumn("_name", F.last("_h", ignorenulls=True).over(inside))
    rows = rows.withColumn("_at", F.coalesce(F.sum(F.length("_s")).over(Window.partitionBy("_f", "_b", "_k").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    whole = rows.groupBy("_f", "_b").agg(F.max("_k").alias("_n"), F.sum(F.length("_s")).alias("_all"), F.max_by("_name", "_i").alias("_last"), F.max_by(F.col("_at") + F.length("_s"), "_i").alias("_open"))
    earlier = Window.partitionBy("_f").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    blocks_before = whole.withColumn("_before", F.coalesce(F.sum("_all").over(earlier), F.lit(0)))
    began = F.when(F.col("_n") > 0, F.col("_before") + F.col("_all") - F.col("_open"))
    carried = blocks_before.withColumn("_began", F.last(began, ignorenulls=True).over(earlier)).withColumn("_from", F.last(F.when(F.col("_n") > 0, F.col("_last")), ignorenulls=True).over(earlier))
    placed = rows.join(carried.select("_f", "_b", "_from", (F.col("_before") - F.col("_began")).alias("_carry")), ["_f", "_b"]).where(F.length("_s") > 0)
    chrom = F.when(F.col("_k") > 0, F.col("_name")).otherwise(F.col("_from"))
    at = F.col("_at") + F.when(F.col("_k") > 0, 0).otherwise(F.coalesce("_carry", F.lit(0)))
    pieces = placed.select(chrom.alias("chrom"), at.alias("_at"), "_s").withColumn("chunk", F.explode(F.sequence(F.floor(F.col("_at") / size), F.floor((F.col("_at") + F.length("_s") - 1) / size))))
    begin = F.greatest(F.col("chunk") * size - F.col("_at"), F.lit(0))
    part = F.substring("_s", (begin + 1).cast("int"), ((F.col("chunk") + 1) * size - F.col("_at") - begin).cast("int"))
    cut = pieces.select("chrom", "chunk", F.struct((F.col("_at") + begin).alias("at"), part.alias("s")).alias("p"))
    return spread(cut, "chrom", "chunk").groupBy("chrom", "chunk").agg(F.array_sort(F.collect_list("p")).alias("_p")).select("chrom", F.col("chunk").cast("int").alias("chunk"), F.array_join(F.col("_p.s"), "").alias("seq"))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A TSV with header: doubles as float, integers as long, the rest as string."""
    raw = spark.read.csv(path, sep="\t", header=True, inferSchema=True)
    kinds = {"double": "float", "int": "long", "bigint": "long", "float": "float"}
    return raw.select(*[F.col(f"`{c}`").cast(kinds.get(t, "string")).alias(c.replace(".", "_")) for c, t in raw.dtypes])


def read_folder(spark: SparkSession, data_format: str, folder: str, pattern: str = "*", skip: str | None = "manifold", schema: str | None = None, **options) -> DataFrame:
    """All files below a folder whose name fits ``pattern``, but for those whose name holds ``skip``. A CSV-like format needs a schema."""
    reader = spark.read.format(data_format).options(pathGlobFilter=pattern, recursiveFileLookup="true", **options)
    out = (reader.schema(schema) if schema else reader).load(folder)
    return out if skip is None else out.where(~F.col("_metadata.file_name").contains(skip))


def read_summary_statistics(spark: SparkSession, path: str, columns: list[str], statistic: str = "Z") -> DataFrame:
    """Chosen columns of a TSV with header, without rows that lack the statistic."""
    return read_table(spark, path).select(*columns, F.col(statistic).cast("double").alias(statistic)).dropna(subset=[statistic])


def read_pwms(lines: list[str], probabilities: bool = False) -> list[Pwm]:
    """Motifs from ``>name`` lines and rows of four numbers."""
    out: list[tuple[str, list[list[float]]]] = []
    for line in lines:
        if line.startswith(">"):
            out.append((line[1:].split()[0], []))
        elif line.strip():
            out[-1][1].append([float(x) for x in line.split()[:4]])
    return [from_probabilities(n, np.array(r)) if probabilities else Pwm(n, tuple(map(tuple, r))) for n, r in out]


def read_descriptor(path: str, **overrides) -> dict:
    """A JSON descriptor; arguments that aren't None win."""
    return json.loads(Path(path).read_text()) | {k: v for k, v in overrides.items() if v is not None}


def read_gml(spark: SparkSession, text: str) -> tuple[DataFrame, DataFrame]:
    """Node and edge tables of a GML graph file: flat attributes as strings."""
    nodes: list[dict] = []
    edges: list[dict] = []
    now: dict | None = None
    for raw in text.splitlines():
        line = raw.strip()
        if line.startswith(("node", "edge")) and line.endswith("["):
            now = {}
            (nodes if line.startswith("node") else edges).append(now)
        elif line == "]":
            now = None
        elif now is not None and line:
            key, _, value = line.partition(" ")
            now[key] = value.strip().strip('"')
    return _frame(spark, nodes, ["id", "label"]), _frame(spark, edges, ["source", "target"])


def _frame(spark: SparkSession, rows: list[dict], least: list[str]) -> DataFrame:
    names = list(dict.fromkeys([*least, *[k for r in rows for k in r]]))
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], ", ".join(f"`{n}` string" for n in names))


READERS: dict[str, Callable[..., DataFrame]] = {
    "parquet": lambda spark, path, **o: spark.read.parquet(path),
    "bed": read_bed,
    "narrowpeak": read_narrow_peaks,
    "bedgraph": read_bedgraph,
    "bigwig": read_bigwig,
    "vcf": read_vcf,
    "fasta": read_fasta,
    "table": read_table,
}


def read(spark: SparkSession, data_format: str, path: str | list[str], columns: list[str] | None = None, examples: DataFrame | None = None, key: str = "example_id", **options) -> DataFrame:
    """Any of the formats; ``columns`` prunes the scan, ``examples`` (key) keeps those rows only."""
    out = READERS[data_format](spark, path, **options)
    if columns:
        out = out.select(*columns)
    return out if examples is None else out.join(examples.select(key).distinct(), key, "left_semi")
