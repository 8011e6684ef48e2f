"""Hand-checked fixtures of thresholds, ranks, mutants, scans, graphs, sources and stacks."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandweave.__main__ import main
from strandweave.operators import graphs, intervals, metrics, models, motifs, mutants, ranges, scores, sequences, stats
from strandweave.plans import stacks
from strandweave.sources import readers, writers
from strandweave.streaming import metrics as streaming


def got(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_sparse_null_thresholds_count_all_cells(spark):
    nulls = spark.createDataFrame([(0, 3.0), (0, -2.0), (0, 1.0), (1, 5.0)], "g int, v double")
    assert got(scores.null_thresholds(nulls, ["g"], "v", 0.5), "g", "threshold") == [(0, 3.0), (1, 5.0)]
    cells = spark.createDataFrame([(0, 100), (1, 2), (2, 50)], "g int, cells long")
    assert got(scores.null_thresholds(nulls, ["g"], "v", 0.5, cells), "g", "threshold") == [(0, 0.0), (1, 5.0), (2, 0.0)]
    assert got(scores.null_thresholds(nulls, ["g"], "v", 0.02, cells), "g", "threshold") == [(0, 2.0), (1, 5.0), (2, 0.0)]


def test_groups_without_nulls_keep_their_scores(spark):
    rows = spark.createDataFrame([(0, 4.0), (0, 2.0), (1, 0.5), (1, -0.5), (None, 9.0)], "g int, v double")
    limits = spark.createDataFrame([(0, 3.0), (None, 10.0)], "g int, threshold double")
    assert got(scores.above_null(rows, limits, ["g"], "v"), "g", "v") == [(0, 4.0), (1, -0.5), (1, 0.5)]


@pytest.mark.parametrize("mean", [0.2, 7.0, 1000.0, 40000.0])
def test_poisson_limits_of_any_mean(spark, mean):
    df = spark.createDataFrame([(0, mean)], "g int, v double")
    k, total = 0, math.exp(-mean)
    while total < 0.95 or k == 0:
        k += 1
        total += math.exp(-mean + k * math.log(mean) - math.lgamma(k + 1))
    assert scores.poisson_limits(df, ["g"], "v", 0.05).first().limit == k


def test_random_intervals_are_as_many_as_asked(spark):
    sizes = spark.createDataFrame([("c", 1000), ("d", 300)], "chrom string, size long")
    taken = spark.createDataFrame([("c", 0, 900), ("d", 0, 290)], "chrom string, start long, stop long")
    out = intervals.random_intervals(sizes, 50, 10, "s", taken)
    assert out.count() == 50 and intervals.overlap_join(out, taken).count() == 0
    with pytest.raises(ValueError, match="fit"):
        intervals.random_intervals(sizes, 5, 200, "s", taken, most_rounds=3)


def test_ranks_of_null_keys_and_percentiles(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), (1, 2.0), (1, 2.0), (1, 8.0)], "g int, v double")
    assert sorted((r.g or 0, r.v, r.a) for r in ranges.with_ranks(df, ["g"], "v", average="a").collect()) == [(0, 1.0, 1.0), (0, 3.0, 2.0), (1, 2.0, 1.5), (1, 2.0, 1.5), (1, 8.0, 3.0)]
    assert sorted(((r.g or 0), r.p) for r in ranges.percentiles(df, ["g"], "v", [0.0, 0.5, 0.75, 1.0], "p").collect()) == [(0, [1.0, 2.0, 2.5, 3.0]), (1, [2.0, 2.0, 5.0, 8.0])]
    r = random.Random(3)
    values = [r.choice([r.random(), 0.5]) for _ in range(501)]
    one = ranges.percentiles(spark.createDataFrame([(v,) for v in values], "v double"), [], "v", [0.1, 0.333, 0.9], "p").first().p
    assert one == pytest.approx(np.quantile(values, [0.1, 0.333, 0.9]).tolist())


def test_complement_over_stretches(spark):
    r = random.Random(5)
    sizes = spark.createDataFrame([("c", 900), ("d", 40), ("e", 10)], "chrom string, size long")
    rows = [("c", s, s + r.randint(1, 40)) for s in (r.randint(0, 850) for _ in range(15))] + [("d", 0, 40)]
    covered = {(c, i) for c, s, e in rows for i in range(s, e)}
    for stretch in (1, 13, 64, 1 << 16):
        out = intervals.complement(spark.createDataFrame(rows, "chrom string, start long, stop long"), sizes, stretch=stretch).collect()
        assert sorted((r.chrom, i) for r in out for i in range(r.start, r.stop)) == sorted((c, i) for c, n in (("c", 900), ("d", 40), ("e", 10)) for i in range(n) if (c, i) not in covered)


def test_shuffled_windows_around_sites(spark):
    """Ten wide: five before the centre to four after it; nothing else changes, and the mask is fourteen wide."""
    r = random.Random(7)
    seq = "".join(r.choice("ACGT") for _ in range(1000))
    df = spark.createDataFrame([(0, seq)], "e int, seq string")
    sites = spark.createDataFrame([(0, m, p, True) for m, p in ((0, 450), (1, 475), (2, 500))] + [(0, 3, 520, False), (0, 4, 7, True)], "e int, m int, pos long, present boolean")
    out = {x.m: x.seq for x in mutants.shuffle_mutants(df, sites, "e", "m", "seq", 1000, "s").collect()}
    for m, c in ((0, 450), (1, 475), (2, 500)):
        assert out[m] != seq and out[m][: c - 5] + out[m][c + 5 :] == seq[: c - 5] + seq[c + 5 :] and sorted(out[m]) == sorted(seq)
    assert out[3] == out[4] == seq
    masks = got(mutants.blanking_masks(sites, ["e", "m"], 1000), "m", "pos")
    assert masks == [(m, p) for m, c in ((0, 450), (1, 475), (2, 500)) for p in range(c - 7, c + 7)]


def test_point_mutants_change_one_base(spark):
    seq = "A" * 1000
    df = spark.createDataFrame([(0, seq)], "e int, seq string")
    sites = spark.createDataFrame([(0, m, p, True) for m, p in ((0, 450), (1, 475), (1, 600), (2, 5))], "e int, m int, pos long, present boolean")
    put = spark.createDataFrame([(0, p, "T") for p in (450, 475, 600, 5)], "e int, pos long, base string")
    out = {x.m: x.seq for x in mutants.point_mutants(df, sites, put, "e", "m", "seq").collect()}
    assert [i for i, b in enumerate(out[0]) if b == "T"] == [450] and [i for i, b in enumerate(out[1]) if b == "T"] == [475, 600] and out[2] == seq


def test_sites_move_to_the_strongest_position(spark):
    """Twelve motifs at 500 + 20 i; peaks of importance at 515, 563 and 600."""
    sites = spark.createDataFrame([(0, i, 500 + 20 * i, True) for i in (1, 3, 5, 9)], "e int, m int, pos long, present boolean")
    importances = spark.createDataFrame([(0, 515, 2.0), (0, 563, 1.0), (0, 600, 3.0), (0, 601, 3.0), (0, 524, -9.0), (0, 523, 0.5)], "e int, pos long, value double")
    out = mutants.strongest_nearby(sites, importances, ["e", "m"], "e")
    assert got(out, "m", "pos") == [(1, 515), (3, 563), (5, 600), (9, 680)]


def test_any_significant_motif_of_either_sign(spark):
    """Eight examples of ten motifs with one hit each; hits of either sign count."""
    hits = spark.createDataFrame([(i, m, -1.0 if i % 4 == 2 else 1.0) for i, m in ((0, 1), (2, 5), (4, 1), (6, 5), (1, 0), (3, 2), (5, 9))], "e int, m int, v double")
    sig = spark.createDataFrame([(1,), (5,)], "m int")
    assert got(hits.where("v <> 0").join(sig, "m", "left_semi").select("e").distinct(), "e") == [(0,), (2,), (4,), (6,)]


def test_prepared_kernels():
    a = motifs.Pwm("a", ((3.0, 0, 0, 0), (0, 4.0, 0, 0)))
    b = motifs.Pwm("b", tuple((1.0, 0, 0, 0) for _ in range(4)))
    k = motifs.prepared([a, b], both_strands=True)
    assert k.shape == (4, 4, 4)
    assert k[0, 1].tolist() == [0.3, 0, 0, 0] and k[0, 2].tolist() == [0, 0.4, 0, 0] and not k[0, [0, 3]].any()
    assert np.linalg.norm(k[1]) == pytest.approx(1) and np.array_equal(k[2], k[0][::-1, ::-1]) and k[2, 1].tolist() == [0, 0, 0.4, 0]


def test_null_positions_fall_back_to_the_least(spark):
    seqs = spark.createDataFrame([(1, "ACG"), (2, "ACG")], "e int, seq string")
    hits = spark.createDataFrame([(1, 0, 2.0), (1, 0, -3.0), (1, 1, 1.0), (1, 2, 1.0), (2, 0, 1.0)], "e int, pos long, score double")
    assert got(motifs.null_positions(seqs, hits, "e", "seq", 5, "s"), "e", "pos") == [(1, 1), (1, 2), (2, 1), (2, 2)]


def test_normalisation_to_a_reference(spark):
    rows = [(t, i, float(v)) for t, vs in ((0, (1, 2, 2, 8)), (1, (4, 4, 6, 16))) for i, v in enumerate(vs)]
    ref = spark.createDataFrame(rows, "t int, i int, v double")
    probe = spark.createDataFrame([(0, 9, v) for v in (0.0, 1.0, 1.5, 2.0, 5.0, 8.0, 99.0)] + [(1, 9, 4.0)], "t int, i int, v double")
    out = {(r.t, r.v): r.n for r in stats.normalised_to_reference(probe, ref, "t", "v", "n").collect()}
    means = [2.5, 3.0, 4.0, 12.0]
    for v in (0.0, 1.0, 1.5, 5.0, 8.0, 99.0):
        assert out[0, v] == pytest.approx(math.log2(np.interp(v, [1, 2, 2, 8], means)))
    assert out[0, 2.0] == pytest.approx(2) and out[1, 4.0] == pytest.approx(math.log2(3))


def test_thresholds_at_recall_and_fdr(spark):
    df = spark.createDataFrame([("t", 1, 9), ("t", 1, 8), ("t", 0, 7), ("t", 1, 6), ("t", 0, 5), ("u", 0, 3), ("u", 1, 2)], "t string, y int, s int")
    out = got(metrics.recall_fdr_thresholds(df, "t", "y", "s", 0.6, 0.2), "t", "at_recall", "at_fdr")
    assert out == [("t", 8, 8), ("u", 2, 3)]


def test_matched_samples_are_as_many_as_asked(spark):
    fg = spark.createDataFrame([(i, i % 3) for i in range(30)], "k long, b long")
    bg = spark.createDataFrame([(i, i % 4) for i in range(5000)], "k long, b long")
    every = stats.matched_sample(fg, bg, "k", ["b"], 5)
    assert got(every.groupBy("seed", "b").agg(F.count_distinct("k").alias("n")), "seed", "b", "n") == [(s, b, 10) for s in range(5) for b in range(3)]
    drawn = stats.matched_with_replacement(fg, bg.where("k < 8"), "k", ["b"], 4)
    assert got(drawn.groupBy("seed", "b").agg(F.count(F.lit(1)).alias("n")), "seed", "b", "n") == [(s, b, 10) for s in range(4) for b in range(3)]


def test_empirical_p_and_median_of_medians(spark):
    nulls = spark.createDataFrame([("a", s, float(v)) for s, vs in ((0, (1, 2, 9)), (1, (4, 4)), (2, (7,))) for v in vs], "g string, s int, v double")
    assert got(stats.median_of_medians(nulls, ["g"], "s", "v"), "g", "median") == [("a", 4.0)]
    observed = spark.createDataFrame([("a", 4.0)], "g string, v double")
    assert got(stats.empirical_p(observed, nulls, ["g"], "v"), "g", "p") == [("a", pytest.approx(4 / 6))]


def test_patterns_with_triangles(spark):
    edges = [(e, i, j) for e in range(5) for i, j in (("a", "b"), ("b", "c"))] + [(e, "a", "c") for e in range(3)] + [(e, "c", "d") for e in range(5)]
    found = {(r.kind, r.a, r.b, r.c): r.support for r in graphs.patterns(spark.createDataFrame(edges, "e int, i string, j string"), "e", 2).collect()}
    assert found["triangle", "a", "b", "c"] == 3 and found["chain", "a", "b", "c"] == 5 and found["chain", "b", "c", "d"] == 5
    # The other two chains of the triangle have its own examples only.
    assert ("chain", "b", "a", "c") not in found and ("chain", "a", "c", "b") not in found and found["chain", "a", "c", "d"] == 3
    assert found["edge", "a", "c", None] == 3 and found["node", "d", None, None] == 5


@pytest.mark.parametrize("split", ["97", "1m"])
def test_fasta_in_blocks(spark, tmp_path, split):
    r = random.Random(8)
    records = {f"chr{i}": "".join(r.choice("acgtN") for _ in range(n)) for i, n in enumerate((1000, 1, 333, 60, 2500))}
    lines = [x for name, s in records.items() for x in (f">{name} note", *[s[i : i + 50] for i in range(0, len(s), 50)])]
    (tmp_path / "x.fa").write_text("\n".join(lines) + "\n")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        out = readers.read_fasta(spark, str(tmp_path / "x.fa"), 64).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    for name, s in records.items():
        chunks = sorted((x.chunk, x.seq) for x in out if x.chrom == name)
        assert "".join(c for _, c in chunks) == s.upper() and [k for k, _ in chunks] == list(range(len(chunks))) and all(len(c) <= 64 for _, c in chunks)


def test_readers_of_folders_and_statistics(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "d" / "one"))
    spark.range(9).write.parquet(str(tmp_path / "d" / "manifold"))
    for f in (tmp_path / "d" / "manifold").glob("*.parquet"):
        f.rename(f.with_name("manifold-" + f.name))
    assert readers.read_folder(spark, "parquet", str(tmp_path / "d"), "*.parquet").count() == 3
    (tmp_path / "s.tsv").write_text("SNP\tA1\tZ\nrs1\tA\t1.5\nrs2\tC\t\nrs3\tG\t-4\n")
    assert got(readers.read_summary_statistics(spark, str(tmp_path / "s.tsv"), ["SNP"]), "SNP", "Z") == [("rs1", 1.5), ("rs3", -4.0)]


def test_models_tiles_and_registry(spark, tmp_path):
    df = spark.createDataFrame([([1.0, 2.0], [3.0, -1.0])], "x array<double>, g array<double>")
    assert df.select(models.input_times_gradient("x", "g")).first()[0] == [3.0, -2.0]

    @models.register("double")
    def double(rows, by=2):
        return rows.select((F.col("id") * by).alias("id"))

    assert got(models.stack(spark.range(3), [(models.STACKS["double"], {"by": 5}), (double, {})]), "id") == [(0,), (10,), (20,)]
    train = spark.createDataFrame([([float(i % 2), 1.0], float(i % 2)) for i in range(60)], "v array<double>, y double")
    assert models.perceptron(train, train, "v", "y", [2, 4, 2]).where("prediction <> y").count() == 0
    regions = spark.createDataFrame([("c", 0, 400)], "chrom string, start long, stop long")
    writers.split_by_chromosome(regions.withColumn("name", F.lit("x")).select("chrom", "start", "stop", "name"), str(tmp_path / "by"))
    assert [p.name for p in (tmp_path / "by").glob("chrom=*")] == ["chrom=c"]
    writers.write_tsv(regions.withColumn("n", F.lit("x")), str(tmp_path / "bed"), header=False)
    assert readers.read_tiled_bed(spark, str(tmp_path / "bed"), 200, 50).count() == 6
    writers.infer_and_save(spark.range(10), lambda d: d.where("id > 3"), str(tmp_path / "inf"))
    assert spark.read.parquet(str(tmp_path / "inf")).count() == 6


def test_extractor_hooks(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", -5.0)], "k string, v double")
    out = models.extract(rows, lambda d: d.withColumn("v", F.col("v") * 2), lambda d: d.where("v > 0"), lambda d: d.withColumn("w", F.col("v") + 1), ["k"], {"v": "sum", "w": "max"})
    assert got(out, "k", "v", "w") == [("a", 8.0, 7.0)] and models.extract(rows, lambda d: d).count() == 3


def test_inference_is_not_repeated(spark, tmp_path):
    rows = spark.createDataFrame([(1, "c", 1), (2, "d", 1), (3, "c", 0)], "id int, chrom string, y int")
    path = str(tmp_path / "out")
    assert stacks.infer(rows, lambda d: d.select("id"), path, F.col("y") == 1, ["c"])
    assert not stacks.infer(rows, lambda d: d.select("id"), path)
    assert got(spark.read.parquet(path), "id") == [(1,)]


def test_motifs_sampled_and_scaled():
    p = motifs.Pwm("x", ((8.0, -8, -8, -8), (-8, -8, -8, 8.0), (0.0, 0, 0, 0)))
    assert p.sampled("s")[:2] == "AT" and p.sampled("s") == p.sampled("s") and len({p.sampled(str(i)) for i in range(30)}) > 1
    g = p.gaussian().array()
    assert g.mean() == pytest.approx(0) and g.std() == pytest.approx(1)


def test_barcodes_follow_the_order_of_keys(spark):
    codes = spark.createDataFrame([(i, f"b{i}") for i in range(10)], "rank long, barcode string")
    out = sequences.barcoded(spark.createDataFrame([(9,), (2,), (5,)], "k long"), codes, "k", 2)
    assert got(out, "k", "copy", "barcode") == [(2, 0, "b0"), (2, 1, "b1"), (5, 0, "b2"), (5, 1, "b3"), (9, 0, "b4"), (9, 1, "b5")]


def test_running_auc_of_a_stream(spark, tmp_path):
    r = random.Random(6)
    rows = [(t, int(r.random() < 0.4), round(r.random(), 3)) for t in ("x", "y") for _ in range(300)]
    table = spark.createDataFrame(rows, "task string, label int, score double")
    table.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streaming.running_table(streaming.running_score_buckets(stream), "running", str(tmp_path / "ck"))
    q.awaitTermination(120)
    found = {x.task: x.auroc for x in streaming.running_auc(spark.table("running")).collect()}
    for t in ("x", "y"):
        p = [min(99, int(s * 100)) for k, y, s in rows if k == t and y]
        n = [min(99, int(s * 100)) for k, y, s in rows if k == t and not y]
        assert found[t] == pytest.approx(sum((a > b) + (a == b) / 2 for a in p for b in n) / len(p) / len(n))


def test_windows_of_a_stream(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    streaming.to_parquet(streaming.windowed_counts(stream, "1 day", late="0 seconds"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    day = F.date_trunc("day", F.col("ts").cast("timestamp"))
    last = events.agg(F.max(day)).first()[0]
    expected = got(events.groupBy(day.alias("d"), "event_type").agg(F.count(F.lit(1)).alias("n")).where(F.col("d") < last), "d", "event_type", "n")
    out = spark.read.parquet(str(tmp_path / "out")).select(F.col("window.start").alias("d"), "event_type", "n")
    assert got(out, "d", "event_type", "n") == expected and expected


def test_commands_on_files(spark, tmp_path):
    r = random.Random(11)
    genome = "".join(r.choice("ACGT") for _ in range(6000))
    (tmp_path / "g.fa").write_text(">chr1\n" + "\n".join(genome[i : i + 60] for i in range(0, 6000, 60)) + "\n")
    (tmp_path / "sizes").write_text("chr1\t6000\nchrM\t50\n")
    (tmp_path / "peaks.bed").write_text("chr1\t1000\t1400\tp\nchr1\t3000\t3100\tq\nchr1\t0\t100\tedge\n")
    (tmp_path / "s.bedgraph").write_text("chr1\t1000\t1200\t2.0\n")
    (tmp_path / "v.vcf").write_text("".join(f"chr1\t{p}\trs{p}\t{genome[p - 1]}\t{'A' if genome[p - 1] != 'A' else 'C'}\t.\t.\t.\n" for p in range(500, 5500, 250)))
    writers_text = ">m one\n2 -1 -1 -1\n-1 2 -1 -1\n-1 -1 2 -1\n>n two\n-1 -1 -1 2\n2 -1 -1 -1\n"
    (tmp_path / "m.txt").write_text(writers_text)
    at = lambda name: str(tmp_path / name)
    main(["preprocess", "--labels", at("peaks.bed"), "--signals", "s=" + at("s.bedgraph"), "--sizes", at("sizes"), "--fasta", at("g.fa"), "--extension", "100", "--out", at("ex")])
    ex = spark.read.parquet(at("ex")).collect()
    assert ex and all(x.sequence == genome[x.start - 100 : x.stop + 100] and x.stop - x.start == 200 for x in ex) and {x.peaks for x in ex} == {1}
    main(["scanmotifs", "--examples", at("ex"), "--motifs", at("m.txt"), "--shuffles", "2", "--share", "0.05", "--out", at("hits")])
    found = spark.read.parquet(at("hits"))
    assert found.where("score <= 0").count() == 0 and {r.pwm_idx for r in found.select("pwm_idx").distinct().collect()} <= {0, 1, 2, 3} and found.count() > 0
    main(["mutatemotifs", "--examples", at("ex"), "--motifs", at("m.txt"), "--above", "3", "--out", at("mut")])
    assert spark.read.parquet(at("mut")).where("mutated = pwm_idx AND delta < 0").count() > 0
    main(["simulategrammars", "--backgrounds", at("ex"), "--motif", "ACGTAA", "GGGTCC", "--spacing", "3", "--out", at("sim")])
    assert spark.read.parquet(at("sim")).count() == 8 * len(ex)
    main(["analyzevariants", "--vcf", at("v.vcf"), "--fasta", at("g.fa"), "--motifs", at("m.txt"), "--length", "20", "--sds", "1", "--out", at("var")])
    assert spark.read.parquet(at("var")).where("diff <> 0").count() > 0
    spark.createDataFrame([("t", 1, 0.9), ("t", 0, 0.1)], "task string, label int, score double").write.parquet(at("p"))
    main(["evaluate", "--predictions", at("p"), "--out", at("met")])
    assert spark.read.parquet(at("met")).first().auroc == 1
    spark.createDataFrame([([float(i % 2)], float(i % 2)) for i in range(40)], "features array<double>, label double").write.parquet(at("tr"))
    main(["baseline", "--train", at("tr"), "--test", at("tr"), "--num_trees", "3", "--out", at("rf")])
    assert spark.read.parquet(at("rf")).where("prediction <> label").count() == 0


def test_query_list(capsys):
    main(["list"])
    assert "motif_scan" in capsys.readouterr().out
