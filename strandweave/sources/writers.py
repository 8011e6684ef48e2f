"""Sinks: tables, BED and bedGraph files, motif and graph files, run descriptors."""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.intervals import merge, parse_metadata, track_from_windows
from ..operators.motifs import Pwm
from .bigwig import write_bigwig
from .shared import stored


def write_examples(df: DataFrame, path: str, by: tuple[str, ...] = ("example_type", "chrom")) -> None:
    """Example tables, partitioned for pruning by type and chromosome where they have those columns."""
    df.write.mode("overwrite").option("compression", "zstd").partitionBy(*[c for c in by if c in df.columns]).parquet(path)


def write_tsv(df: DataFrame, path: str, header: bool = True) -> None:
    df.write.mode("overwrite").csv(path, sep="\t", header=header, compression="gzip")


def write_bed(df: DataFrame, path: str, metadata: Column, key: str = "region", merged: bool = False) -> None:
    """Intervals under ``key`` of a metadata column as BED6 (or merged BED3)."""
    rows = df.select(parse_metadata(metadata, key).alias("p"), metadata.alias("name")).where("p IS NOT NULL").select("p.*", "name")
    out = merge(rows).select("chrom", "start", "stop") if merged else rows.select("chrom", "start", "stop", "name", F.lit(1000), F.lit("."))
    write_tsv(out.sort("chrom", "start"), path, header=False)


def write_tracks(windows: DataFrame, path: str, value: str, stride: int, task: str) -> None:
    """bedGraph rows of mean values, one folder a task."""
    track_from_windows(windows, value, stride, (task,)).write.mode("overwrite").partitionBy(task).csv(path, sep="\t")


def write_track_bigwigs(windows: DataFrame, path: str, value: str, stride: int, task: str, sizes: DataFrame) -> dict[str, list[str]]:
    """Mean values as bigWig files, one folder ``task=name`` a task (tasks are a dimension); the names of the files of each."""
    tracks = stored(track_from_windows(windows, value, stride, (task,)), "tracks")
    tasks = [r[0] for r in tracks.select(task).distinct().orderBy(task).collect()]
    return {t: write_bigwig(tracks.where(F.col(task) == t).withColumnRenamed(value, "value"), f"{path}/{task}={t}", sizes) for t in tasks}


def split_by_chromosome(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("chrom").csv(path, sep="\t", compression="gzip")


def copy_rows(df: DataFrame, path: str, keys: DataFrame | None = None, key: str = "example_id", columns: list[str] | None = None) -> None:
    """Chosen rows and columns to a new table."""
    out = df if keys is None else df.join(keys.select(key).distinct(), key, "left_semi")
    (out.select(*columns) if columns else out).write.mode("overwrite").parquet(path)


def with_column_names(df: DataFrame, column: str, names: list[str]) -> DataFrame:
    """Names of an array column's elements kept as column metadata."""
    return df.withMetadata(column, {"names": names})


def write_pwms(pwms: list[Pwm], path: str, style: str = "homer") -> None:
    """Motif files of a dimension (some hundred motifs)."""
    lines = []
    for p in pwms:
        probabilities = p.probabilities()
        if style == "homer":
            lines.append(f">{p.consensus()}\t{p.name}\t0")
            lines += ["\t".join(f"{x:.4f}" for x in row) for row in probabilities]
        else:
            lines += [f"ID {p.name}", "P0 A C G T"]
            lines += [f"{i + 1:02d} " + " ".join(f"{x * 100:.2f}" for x in row) for i, row in enumerate(probabilities)] + ["XX", "//"]
    Path(path).write_text("\n".join(lines) + "\n")


def gml_text(nodes: list[dict], edges: list[dict]) -> str:
    """A small result graph as GML."""

    def block(kind: str, attributes: dict) -> str:
        inner = "\n".join(f'    {k} "{v}"' if isinstance(v, str) else f"    {k} {v}" for k, v in attributes.items())
        return f"  {kind} [\n{inner}\n  ]"

    return "graph [\n  directed 1\n" + "\n".join([block("node", n) for n in nodes] + [block("edge", e) for e in edges]) + "\n]\n"


def write_descriptor(path: str, **content) -> None:
    Path(path).write_text(json.dumps(content, indent=2, sort_keys=True, default=str))


def infer_and_save(df: DataFrame, transform: Callable[[DataFrame], DataFrame], path: str, sample_size: int | None = None) -> None:
    """Apply a stack and write; a sample size stops early."""
    transform(df if sample_size is None else df.limit(sample_size)).write.mode("overwrite").parquet(path)
