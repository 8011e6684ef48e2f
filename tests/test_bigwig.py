"""bigWig files: what is written is read, a region touches its leaves alone, and other writers' sections are understood."""

import random
import struct
import zlib

import numpy as np
import pytest

from strandweave.sources import bigwig


def table(rows):
    return sorted(rows)


@pytest.fixture
def small(monkeypatch):
    """Trees of several levels from few rows."""
    monkeypatch.setattr(bigwig, "ITEMS_A_SECTION", 8)
    monkeypatch.setattr(bigwig, "ITEMS_A_NODE", 4)


def made(seed, chroms, n):
    r, rows = random.Random(seed), []
    for c in chroms:
        at = 0
        for _ in range(n):
            at += r.choice([0, 0, 1, 50])
            width = r.randint(1, 30)
            rows.append((c, at, at + width, r.randint(-800, 800) / 8))
            at += width
    return rows


def build(path, rows, sizes):
    file = bigwig.FileBuilder(sizes)
    for chrom in sorted({r[0] for r in rows}):
        start, stop, value = (np.array(x) for x in list(zip(*sorted(r[1:] for r in rows if r[0] == chrom), strict=True)))
        file.add(chrom, start, stop, value)
    path.write_bytes(b"".join(file.finished()))
    return f"file://{path}"


def read(uri, wanted=None):
    leaves, n = bigwig.planned(uri, wanted)
    out = []
    with bigwig.Ranged(uri) as file:
        for leaf in leaves:
            for batch in bigwig.read_leaf(file, leaf):
                out += [tuple(r.values()) for r in batch.to_pylist()]
        return sorted(out), len(leaves), n + file.n_bytes


def test_trees_of_many_levels(tmp_path, small):
    chroms = [f"chr{i}" for i in range(70)]  # four levels of chromosomes
    rows = made(1, chroms, 60)
    uri = build(tmp_path / "a.bw", rows, {c: 10_000 for c in chroms})
    got, leaves, _ = read(uri)
    assert got == sorted(rows) and leaves == -(-70 * 8 // 4)
    with bigwig.Ranged(uri) as file:
        assert bigwig.chromosomes(file, bigwig.HEADER.size + bigwig.SUMMARY.size) == {c: (i, 10_000) for i, c in enumerate(sorted(chroms))}


def test_a_region_touches_its_leaves(tmp_path, small):
    rows = made(2, ["a", "b", "c"], 4000)
    uri = build(tmp_path / "a.bw", rows, dict.fromkeys("abc", 1 << 30))
    _, all_leaves, all_bytes = read(uri)
    r = random.Random(5)
    for _ in range(40):
        chrom, start = r.choice("abcx"), r.randrange(60_000)
        wanted = [(chrom, start, start + r.choice([1, 300])), ("b", 500, 400), (chrom, start + 2, start + 3)]
        got, leaves, n_bytes = read(uri, wanted)
        assert got == sorted(x for x in rows if any(x[0] == c and x[1] < b and x[2] > a for c, a, b in wanted if a < b))
        assert leaves <= 3 + 300 * 2 / 32 and n_bytes < all_bytes / 10 and all_leaves > 300


def test_summary_and_header(tmp_path):
    rows = [("z", 10, 20, 1.5), ("z", 20, 22, -4.0)]
    uri = build(tmp_path / "a.bw", rows, {"z": 100})
    with bigwig.Ranged(uri) as file:
        magic, version, zooms, *_, summary_at, size, _ = file.part(0, bigwig.HEADER)
        assert (magic, version, zooms, size) == (0x888FFC26, 4, 0, 24 + 2 * 12)
        assert file.part(summary_at, bigwig.SUMMARY) == (12, -4.0, 1.5, 7.0, 10 * 2.25 + 2 * 16.0)


def test_sections_of_other_writers():
    head = lambda kind, n, step, span: bigwig.SECTION.pack(3, 100, 200, step, span, kind, n)
    chrom, items = bigwig.section_items(head(2, 2, 0, 5) + struct.pack("<IfIf", 100, 1.0, 150, 2.0))
    assert chrom == 3 and items.tolist() == [(100, 105, 1.0), (150, 155, 2.0)]
    _, items = bigwig.section_items(head(3, 3, 10, 4) + struct.pack("<fff", 1, 2, 3))
    assert items.tolist() == [(100, 104, 1.0), (110, 114, 2.0), (120, 124, 3.0)]
    with pytest.raises(ValueError, match="kind"):
        bigwig.section_items(head(7, 0, 0, 0))


def test_uncompressed_files_are_read(tmp_path):
    rows = [("z", i * 3, i * 3 + 2, float(i)) for i in range(50)]
    file = bigwig.FileBuilder({"z": 1000})
    file.add("z", *(np.array(x) for x in list(zip(*rows, strict=True))[1:]))
    data = zlib.decompress(file.blocks[0])
    file.blocks, file.at, file.largest = [data], len(data), 0
    file.sections = [(*file.sections[0][:5], len(data))]
    (tmp_path / "a.bw").write_bytes(b"".join(file.finished()))
    assert read(f"file://{tmp_path}/a.bw")[0] == rows


def test_source_and_sink(spark, tmp_path, monkeypatch):
    rows = made(3, ["chr1", "chr2", "chr10"], 3000)
    df = spark.createDataFrame([*rows, ("chr1", 0, 1, None)], "chrom string, start long, stop long, value double").repartition(5)
    sizes = spark.createDataFrame([("chr1", 10**6), ("chr2", 10**6), ("chr10", 10**6), ("chrU", 7)], "chrom string, size long")
    path = str(tmp_path / "tracks")
    assert len(bigwig.write_bigwig(df, path, sizes, rows_a_file=2500)) == 4
    assert table(map(tuple, bigwig.read_bigwig(spark, path).collect())) == sorted(rows)
    regions = spark.createDataFrame([("chr2", 1000, 1300), ("chr2", 1200, 1210), ("chr10", 7, 7), (None, 1, 2), ("chrU", 0, 5)], "chrom string, start long, stop long")
    wanted = sorted(x for x in rows if x[0] == "chr2" and x[1] < 1300 and x[2] > 1000)
    assert table(map(tuple, bigwig.read_bigwig(spark, path, regions).collect())) == wanted
    monkeypatch.setattr(bigwig, "MOST_REGIONS", 1)
    more = regions.union(spark.createDataFrame([("chr1", 0, 100)], regions.schema))
    assert table(map(tuple, bigwig.read_bigwig(spark, path, more).collect())) == sorted(wanted + [x for x in rows if x[0] == "chr1" and x[1] < 100])
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        narrowed = bigwig.read_bigwig(spark, path).where("chrom = 'chr2' AND start < 1300 AND stop > 1000")
        assert table(map(tuple, narrowed.collect())) == wanted
        assert narrowed.rdd.getNumPartitions() < bigwig.read_bigwig(spark, path).rdd.getNumPartitions()
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_odd_tables(spark, tmp_path):
    schema, sizes = "chrom string, start long, stop long, value double", spark.createDataFrame([("a", 100)], "chrom string, size long")
    bigwig.write_bigwig(spark.createDataFrame([], schema), str(tmp_path / "none"), sizes)
    assert bigwig.read_bigwig(spark, str(tmp_path / "none")).collect() == []
    for k, bad in enumerate(([("a", 0, 5, 1.0), ("a", 4, 6, 1.0)], [("a", 90, 101, 1.0)], [("b", 0, 1, 1.0)], [("a", 5, 5, 1.0)])):
        with pytest.raises(Exception, match=r"overlap|no size"):
            bigwig.write_bigwig(spark.createDataFrame(bad, schema), str(tmp_path / f"bad{k}"), sizes)
    with pytest.raises(Exception, match="overlap"):  # in two files
        bigwig.write_bigwig(spark.createDataFrame([("a", i, i + 2, 1.0) for i in range(0, 40)], schema), str(tmp_path / "bad"), sizes, rows_a_file=1)


def test_around_centre(spark):
    df = spark.createDataFrame([("a", 10, 21, 1), ("a", 1000, 1001, 2)], "chrom string, start long, stop long, id int")
    assert sorted((r.id, r.start, r.stop) for r in bigwig.around_centre(df, 200).collect()) == [(1, 0, 115), (2, 900, 1100)]
