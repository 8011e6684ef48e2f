"""bigWig files as a Spark data source and sink.

The format keeps values of non-overlapping stretches of chromosomes in compressed
sections, found through an R-tree of 4-byte chromosome numbers and bases. The source
reads a file by ranges: the header, the chromosomes' B+ tree and the inner nodes of the
R-tree when it plans, so that each leaf that a wanted interval reaches becomes a
partition, and in a task that leaf and the sections that overlap. The sink sorts by
ranges; each range becomes a whole bigWig file of bounded size, so a folder of them is a
table as a folder of Parquet files is.
"""

from __future__ import annotations

import bisect
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from ..operators.intervals import merge, overlap_join

# Fixed values of the format: magic numbers, and the layout of its parts (little-endian).
MAGIC, TREE_MAGIC, INDEX_MAGIC = 0x888FFC26, 0x78CA8C91, 0x2468ACE0
HEADER = struct.Struct("<IHHQQQHHQQIQ")
SUMMARY = struct.Struct("<Qdddd")
TREE_HEADER = struct.Struct("<IIIIQQ")
INDEX_HEADER = struct.Struct("<IIQIIIIQII")
NODE = struct.Struct("<BxH")
LEAF_ITEM, INNER_ITEM = struct.Struct("<IIIIQQ"), struct.Struct("<IIIIQ")
SECTION = struct.Struct("<IIIIIBxH")
BED_GRAPH, VARIABLE_STEP, FIXED_STEP = 1, 2, 3
ITEM = np.dtype([("start", "<u4"), ("stop", "<u4"), ("value", "<f4")])
STEP_ITEM = np.dtype([("start", "<u4"), ("value", "<f4")])

SCHEMA = "chrom string, start long, stop long, value double"
ITEMS_A_SECTION, ITEMS_A_NODE = 1024, 256
#: About so many rows make a file; a task holds a file's compressed sections in memory.
ROWS_A_FILE = 4_000_000
#: Regions that a read may be narrowed to when it is planned; more are a join.
MOST_REGIONS = 10_000


@dataclass
class Ranged:
    """A file read by ranges. ``n_bytes`` counts what has been read."""

    uri: str
    n_bytes: int = 0
    source: object = field(default=None, repr=False)

    def __enter__(self) -> Ranged:
        fs, path = pyarrow.fs.FileSystem.from_uri(self.uri)
        self.source = fs.open_input_file(path)
        return self

    def __exit__(self, *_: object) -> None:
        self.source.close()

    def at(self, offset: int, size: int) -> bytes:
        self.n_bytes += size
        data = self.source.read_at(size, offset)
        if len(data) < size:
            raise ValueError(f"{self.uri} ends before {offset + size}")
        return data

    def part(self, offset: int, layout: struct.Struct) -> tuple:
        return layout.unpack(self.at(offset, layout.size))


class Wanted:
    """Stretches of chromosomes (number, start, stop), merged and in order."""

    def __init__(self, regions: Iterable[tuple[int, int, int]]):
        self.starts: list[tuple[int, int]] = []
        self.stops: list[tuple[int, int]] = []
        for c, start, stop in sorted(r for r in regions if r[1] < r[2]):
            if self.stops and (c, start) <= self.stops[-1]:
                self.stops[-1] = max(self.stops[-1], (c, stop))
            else:
                self.starts.append((c, start))
                self.stops.append((c, stop))

    def reach(self, first: tuple[int, int], last: tuple[int, int]) -> bool:
        """Whether one overlaps what lies between two places (chromosome, base)."""
        i = bisect.bisect_right(self.stops, first)
        return i < len(self.starts) and self.starts[i] < last

    def of(self, chrom: int, items: np.ndarray) -> np.ndarray:
        """The items of a chromosome that overlap one."""
        a, b = bisect.bisect_left(self.starts, (chrom, 0)), bisect.bisect_left(self.starts, (chrom + 1, 0))
        starts, stops = (np.array([p for _, p in x[a:b]], np.int64) for x in (self.starts, self.stops))
        at = np.searchsorted(stops, items["start"].astype(np.int64), "right")
        return items[(at < len(starts)) & (np.r_[starts, 1 << 62][np.minimum(at, len(starts))] < items["stop"])]


def chromosomes(file: Ranged, tree_at: int) -> dict[str, tuple[int, int]]:
    """Number and size of each chromosome, from the B+ tree."""
    magic, _, key_size, value_size, _, _ = file.part(tree_at, TREE_HEADER)
    if magic != TREE_MAGIC or value_size != 8:
        raise ValueError(f"{file.uri} has no chromosome tree")
    out, todo = {}, [tree_at + TREE_HEADER.size]
    while todo:
        at = todo.pop()
        leaf, n = file.part(at, NODE)
        items = file.at(at + NODE.size, n * (key_size + 8))
        for i in range(n):
            item = items[i * (key_size + 8) : (i + 1) * (key_size + 8)]
            if leaf:
                out[item[:key_size].rstrip(b"\0").decode()] = struct.unpack("<II", item[key_size:])
            else:
                todo.append(struct.unpack("<Q", item[key_size:])[0])
    return out


@dataclass
class Leaf(InputPartition):
    """An R-tree leaf of one file, and what is wanted of it."""

    uri: str
    at: int
    names: dict[int, str]
    wanted: Wanted | None
    compressed: bool


def planned(uri: str, wanted: list[tuple[str, int, int]] | None) -> tuple[list[Leaf], int]:
    """The leaves of a file that the wanted regions (all: None) reach, and the bytes read to find them. The inner nodes are read, the leaves aren't."""
    with Ranged(uri) as file:
        magic, _, _, tree_at, _, index_at, _, _, _, _, buffer_size, _ = file.part(0, HEADER)
        if magic != MAGIC:
            raise ValueError(f"{uri} isn't a little-endian bigWig file")
        named = chromosomes(file, tree_at)
        mine = None if wanted is None else Wanted((named[c][0], a, b) for c, a, b in wanted if c in named)
        names = {i: name for name, (i, _) in named.items()}
        magic, _, n_items, c0, b0, c1, b1, *_ = file.part(index_at, INDEX_HEADER)
        if magic != INDEX_MAGIC:
            raise ValueError(f"{uri} has no index")
        reached = n_items and (mine is None or mine.reach((c0, b0), (c1, b1)))
        out, todo = [], [index_at + INDEX_HEADER.size] if reached else []
        while todo:
            at = todo.pop()
            leaf, n = file.part(at, NODE)
            if leaf:
                out.append(Leaf(uri, at, names, mine, buffer_size > 0))
                continue
            for c0, b0, c1, b1, child in INNER_ITEM.iter_unpack(file.at(at + NODE.size, n * INNER_ITEM.size)):
                if mine is None or mine.reach((c0, b0), (c1, b1)):
                    todo.append(child)
        return sorted(out, key=lambda leaf: leaf.at), file.n_bytes


def section_items(data: bytes) -> tuple[int, np.ndarray]:
    """Chromosome number and items of a section, whatever its kind."""
    chrom, start, _, step, span, kind, n = SECTION.unpack_from(data)
    if kind == BED_GRAPH:
        return chrom, np.frombuffer(data, ITEM, n, SECTION.size)
    out = np.empty(n, ITEM)
    if kind == VARIABLE_STEP:
        items = np.frombuffer(data, STEP_ITEM, n, SECTION.size)
        out["start"], out["value"] = items["start"], items["value"]
    elif kind == FIXED_STEP:
        out["start"], out["value"] = start + step * np.arange(n, dtype=np.uint32), np.frombuffer(data, "<f4", n, SECTION.size)
    else:
        raise ValueError(f"section of kind {kind}")
    out["stop"] = out["start"] + span
    return chrom, out


def read_leaf(file: Ranged, leaf: Leaf) -> Iterator[pa.RecordBatch]:
    """The rows of a leaf's sections that overlap what is wanted, section by section."""
    is_leaf, n = file.part(leaf.at, NODE)
    if not is_leaf:
        raise ValueError(f"{leaf.uri}: no leaf at {leaf.at}")
    for c0, b0, c1, b1, at, size in LEAF_ITEM.iter_unpack(file.at(leaf.at + NODE.size, n * LEAF_ITEM.size)):
        if leaf.wanted is not None and not leaf.wanted.reach((c0, b0), (c1, b1)):
            continue
        data = file.at(at, size)
        chrom, items = section_items(zlib.decompress(data) if leaf.compressed else data)
        if leaf.wanted is not None:
            items = leaf.wanted.of(chrom, items)
        if len(items):
            yield pa.record_batch(
                {"chrom": pa.array([leaf.names[chrom]] * len(items)), "start": items["start"].astype(np.int64), "stop": items["stop"].astype(np.int64), "value": items["value"].astype(np.float64)}
            )


class BigWigSource(DataSource):
    """``spark.read.format("bigwig").option("regions", "chr1:100-200,chr2:0-50").load(path)``: rows (chrom, start, stop, value) of a file or of all files below a folder.

    ``regions`` (from 0, half-open) keeps the rows that overlap one of them and touches the leaves that hold them alone. With the option ``filters``, in sessions
    that let Python sources take filters (spark.sql.python.filterPushdown.enabled), comparisons of chrom, start and stop with values narrow the leaves too.
    """

    @classmethod
    def name(cls) -> str:
        return "bigwig"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> BigWigReader:
        kind = FilteringReader if self.options.get("filters", "false").lower() == "true" else BigWigReader
        return kind(self.options["path"], parsed_regions(self.options.get("regions")))


class BigWigReader(DataSourceReader):
    def __init__(self, path: str, regions: list[tuple[str, int, int]] | None):
        self.path, self.regions = path, regions

    def partitions(self) -> list[InputPartition]:
        return [leaf for uri in files_below(self.path) for leaf in planned(uri, self.regions)[0]] or [InputPartition(None)]

    def read(self, leaf: InputPartition) -> Iterator[pa.RecordBatch]:
        if isinstance(leaf, Leaf):
            with Ranged(leaf.uri) as file:
                yield from read_leaf(file, leaf)


class FilteringReader(BigWigReader):
    """Takes what bounds an interval; Spark checks every filter on the rows as well."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        wanted, low, high = None, 0, 1 << 32
        for f in filters:
            match f:
                case EqualTo(("chrom",), str(chrom)):
                    wanted = chrom
                case LessThan(("start",), int(v)):
                    high = min(high, v)
                case LessThanOrEqual(("start",), int(v)):
                    high = min(high, v + 1)
                case GreaterThan(("stop",), int(v)):
                    low = max(low, v)
                case GreaterThanOrEqual(("stop",), int(v)):
                    low = max(low, v - 1)
            yield f
        if wanted is not None:
            mine = [(wanted, 0, 1 << 32)] if self.regions is None else [r for r in self.regions if r[0] == wanted]
            # A region cut to nothing is left out when the leaves are planned, so it can't widen the read.
            self.regions = [(c, a, b) if self.regions is not None else (c, low, high) for c, a, b in mine if a < high and b > low]


def parsed_regions(text: str | None) -> list[tuple[str, int, int]] | None:
    if text is None:
        return None
    places = (r.rpartition(":") for r in text.split(",") if r)
    return [(chrom, *map(int, place.split("-"))) for chrom, _, place in places]


def files_below(path: str) -> list[str]:
    """A file's URI, or those of the bigWig files below a folder in order; hidden ones and unfinished ones are left out."""
    if "://" not in path:
        path = "file://" + path.removeprefix("file:")
    fs, inner = pyarrow.fs.FileSystem.from_uri(path)
    if fs.get_file_info(inner).type == pyarrow.fs.FileType.File:
        return [path]
    head = path[: len(path) - len(inner)] if path.endswith(inner) else path.partition("://")[0] + "://"
    found = fs.get_file_info(pyarrow.fs.FileSelector(inner, recursive=True))
    names = sorted(f.path for f in found if f.type == pyarrow.fs.FileType.File and f.path.endswith((".bw", ".bigwig", ".bigWig")))
    return [head + n for n in names if not any(p.startswith(("_", ".")) for p in n[len(inner) :].split("/"))]


def read_bigwig(spark: SparkSession, path: str, regions: DataFrame | None = None) -> DataFrame:
    """(chrom, start, stop, value) of a bigWig file or a folder of them; ``regions`` (chrom, start, stop) keeps rows that overlap one of them.

    Regions are merged; up to MOST_REGIONS go into the plan, so other leaves aren't read. More
    are a join over all leaves.
    """
    spark.dataSource.register(BigWigSource)
    pushes = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    reader = spark.read.format("bigwig").option("filters", pushes)
    if regions is None:
        return reader.load(path)
    merged = merge(regions.select("chrom", "start", "stop").where("start < stop")).select("chrom", "start", "stop")
    some = merged.limit(MOST_REGIONS + 1).collect()
    if len(some) > MOST_REGIONS:
        rows = reader.load(path)
        met = overlap_join(rows, merged).select(*[F.col(f"a_{c}").alias(c) for c in rows.columns])
        return met.distinct()  # a row may reach two regions; rows of a file are distinct
    reader = reader.option("regions", ",".join(f"{r.chrom}:{r.start}-{r.stop}" for r in some))
    return reader.load(path)


def _tree(sizes: dict[str, int], offset: int) -> bytes:
    """The chromosomes' B+ tree, to lie at ``offset``; numbers are places in the order of names."""
    names = sorted(sizes)
    key_size = max([1, *(len(n.encode()) for n in names)])
    leaves = [(n.encode().ljust(key_size, b"\0"), struct.pack("<II", i, sizes[n])) for i, n in enumerate(names)]
    levels = [[leaves[a : a + ITEMS_A_NODE] for a in range(0, len(leaves), ITEMS_A_NODE)] or [[]]]
    while len(levels[0]) > 1:
        firsts = [(node[0][0], None) for node in levels[0]]
        levels.insert(0, [firsts[a : a + ITEMS_A_NODE] for a in range(0, len(firsts), ITEMS_A_NODE)])
    out = [TREE_HEADER.pack(TREE_MAGIC, ITEMS_A_NODE, key_size, 8, len(names), 0)]
    at = offset + TREE_HEADER.size
    for depth, level in enumerate(levels):
        at += sum(NODE.size + len(node) * (key_size + 8) for node in level)
        child = at
        below = iter(levels[depth + 1]) if depth + 1 < len(levels) else None
        for node in level:
            out.append(NODE.pack(below is None, len(node)))
            for key, value in node:
                if below is not None:
                    value = struct.pack("<Q", child)
                    child += NODE.size + len(next(below)) * (key_size + 8)
                out.append(key + value)
    return b"".join(out)


def _index(sections: list[tuple], offset: int, data_end: int) -> bytes:
    """The R-tree over sections (chromosome, start, chromosome, stop, offset, size), to lie at ``offset``."""
    levels = [[sections[a : a + ITEMS_A_NODE] for a in range(0, len(sections), ITEMS_A_NODE)] or [[]]]
    while len(levels[0]) > 1:
        spans = [(*node[0][:2], *max(item[2:4] for item in node)) for node in levels[0]]
        levels.insert(0, [spans[a : a + ITEMS_A_NODE] for a in range(0, len(spans), ITEMS_A_NODE)])
    first, last = (sections[0][:2], max(s[2:4] for s in sections)) if sections else ((0, 0), (0, 0))
    out = [INDEX_HEADER.pack(INDEX_MAGIC, ITEMS_A_NODE, len(sections), *first, *last, data_end, ITEMS_A_SECTION, 0)]
    at = offset + INDEX_HEADER.size
    for depth, level in enumerate(levels):
        leaf = depth + 1 == len(levels)
        at += sum(NODE.size + len(node) * (LEAF_ITEM if leaf else INNER_ITEM).size for node in level)
        child = at
        below = None if leaf else iter(levels[depth + 1])
        item = LEAF_ITEM if depth + 2 >= len(levels) else INNER_ITEM
        for node in level:
            out.append(NODE.pack(leaf, len(node)))
            for entry in node:
                if leaf:
                    out.append(LEAF_ITEM.pack(*entry))
                else:
                    out.append(INNER_ITEM.pack(*entry, child))
                    child += NODE.size + len(next(below)) * item.size
    return b"".join(out)


class FileBuilder:
    """One bigWig file from sorted rows; its compressed sections are held until it is finished."""

    def __init__(self, sizes: dict[str, int]):
        self.sizes, self.numbers = sizes, {n: i for i, n in enumerate(sorted(sizes))}
        self.blocks: list[bytes] = []
        self.sections: list[tuple] = []
        self.at = self.largest = 0
        self.first = self.last = None
        self.sums = np.array([0.0, np.inf, -np.inf, 0.0, 0.0])

    def add(self, chrom: str, start: np.ndarray, stop: np.ndarray, value: np.ndarray) -> None:
        """Rows of one chromosome in order of start."""
        if chrom not in self.numbers:
            raise ValueError(f"no size for chromosome {chrom}")
        edge = self.last[1] if self.last and self.last[0] == chrom else 0
        if (start < np.r_[edge, stop[:-1]]).any() or (start >= stop).any() or stop.max() > self.sizes[chrom]:
            raise ValueError(f"intervals of {chrom} overlap, are empty or pass its end")
        number = self.numbers[chrom]
        for a in range(0, len(start), ITEMS_A_SECTION):
            part = slice(a, a + ITEMS_A_SECTION)
            items = np.empty(len(start[part]), ITEM)
            items["start"], items["stop"], items["value"] = start[part], stop[part], value[part]
            begin, end = int(start[part][0]), int(stop[part][-1])
            data = SECTION.pack(number, begin, end, 0, 0, BED_GRAPH, len(items)) + items.tobytes()
            packed = zlib.compress(data)
            self.sections.append((number, begin, number, end, self.at, len(packed)))
            self.blocks.append(packed)
            self.at, self.largest = self.at + len(packed), max(self.largest, len(data))
        length, v = (stop - start).astype(np.float64), value.astype(np.float32).astype(np.float64)
        self.sums += [length.sum(), 0, 0, length @ v, length @ v**2]
        self.sums[1], self.sums[2] = min(self.sums[1], v.min()), max(self.sums[2], v.max())
        self.first, self.last = self.first or (chrom, int(start[0])), (chrom, int(stop[-1]))

    def finished(self) -> Iterator[bytes]:
        summary_at = HEADER.size
        tree_at = summary_at + SUMMARY.size
        tree = _tree(self.sizes, tree_at)
        data_at = tree_at + len(tree)
        index_at = data_at + 8 + self.at
        yield HEADER.pack(MAGIC, 4, 0, tree_at, data_at, index_at, 0, 0, 0, summary_at, self.largest, 0)
        yield SUMMARY.pack(int(self.sums[0]), *self.sums[1:]) if self.sections else SUMMARY.pack(0, 0.0, 0.0, 0.0, 0.0)
        yield tree
        yield struct.pack("<Q", len(self.sections))
        yield from self.blocks
        yield _index([(*s[:4], data_at + 8 + s[4], s[5]) for s in self.sections], index_at, index_at)


def around_centre(regions: DataFrame, width: int) -> DataFrame:
    """Windows of ``width`` bases around the middle of each region instead of the region itself, cut at 0; other columns stay."""
    middle = F.floor((F.col("start") + F.col("stop")) / 2) - width // 2
    return regions.withColumn("stop", (middle + width).cast("long")).withColumn("start", F.greatest(F.col("stop") - width, F.lit(0)))


def write_bigwig(df: DataFrame, path: str, sizes: DataFrame, rows_a_file: int = ROWS_A_FILE) -> list[str]:
    """Write (chrom, start, stop, value) as bigWig files in a new folder, in order; their names are returned.

    Values are kept as 4-byte floats; rows without a value are left out. Intervals must
    not overlap and must lie within ``sizes`` (chrom, size; one row a chromosome, which
    all tasks get), else ValueError. Each task attempt writes a file of its own; those that
    the finished tasks name are moved into place, so a lost executor leaves no part
    behind that a reader would take. An empty table gives one file without sections.
    """
    spark = df.sparkSession
    known = {r.chrom: int(r.size) for r in sizes.select("chrom", "size").collect()}
    rows = df.where("value IS NOT NULL").select("chrom", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"), F.col("value").cast("double").alias("value"))
    n_files = max(1, -(-rows.count() // rows_a_file))
    if "://" not in path:
        path = "file://" + path.removeprefix("file:")
    attempts = f"{path.rstrip('/')}/_attempts"

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        file = FileBuilder(known)
        for pdf in batches:
            for chrom, part in pdf.groupby("chrom", sort=False):
                file.add(chrom, *(part[c].to_numpy() for c in ("start", "stop", "value")))
        fs, folder = pyarrow.fs.FileSystem.from_uri(attempts)
        fs.create_dir(folder, recursive=True)
        name = f"{uuid.uuid4().hex}.bw"
        with fs.open_output_stream(f"{folder}/{name}") as out:
            for block in file.finished():
                out.write(block)
        first, last = file.first or (None, None), file.last or (None, None)
        yield pd.DataFrame([(name, *first, *last)], columns=["name", "chrom", "start", "last_chrom", "stop"])

    order = ["chrom", "start"]
    written = rows.repartitionByRange(n_files, *order).sortWithinPartitions(*order).mapInPandas(write, "name string, chrom string, start long, last_chrom string, stop long")
    found = written.collect()  # one row a file
    files = sorted((f for f in found if f.chrom is not None), key=lambda f: (f.chrom, f.start)) or found[:1]
    for a, b in zip(files, files[1:], strict=False):
        if a.last_chrom == b.chrom and b.start < a.stop:
            raise ValueError(f"intervals of {b.chrom} overlap at {b.start}")
    fs, folder = pyarrow.fs.FileSystem.from_uri(path)
    fs.create_dir(folder, recursive=True)
    out = []
    for i, f in enumerate(files):
        out.append(f"part-{i:05d}.bw")
        fs.move(f"{folder.rstrip('/')}/_attempts/{f.name}", f"{folder.rstrip('/')}/{out[-1]}")
    if not files:  # no task had rows
        out = ["part-00000.bw"]
        with fs.open_output_stream(f"{folder.rstrip('/')}/{out[0]}") as empty:
            for block in FileBuilder(known).finished():
                empty.write(block)
    if fs.get_file_info(f"{folder.rstrip('/')}/_attempts").type == pyarrow.fs.FileType.Directory:
        fs.delete_dir(f"{folder.rstrip('/')}/_attempts")
    return out
