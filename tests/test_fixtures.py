"""Hand-checked fixtures."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandweave.functions import arrays as ar
from strandweave.functions import sequences as fx
from strandweave.functions.selectors import parse_selection
from strandweave.operators import graphs, intervals, metrics, models, motifs, scores, sequences, stats
from strandweave.sources import readers, writers
from strandweave.streaming import metrics as streaming


def iv(spark, rows):
    return spark.createDataFrame(rows, "chrom string, start long, stop long")


def got(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_merge_joins_book_ended_intervals(spark):
    a = iv(spark, [("c", 0, 10), ("c", 10, 20), ("c", 30, 40), ("d", 5, 6), ("c", 7, 7)])
    assert got(intervals.merge(a), "chrom", "start", "stop", "n") == [("c", 0, 20, 2), ("c", 30, 40, 1), ("d", 5, 6, 1)]


@pytest.mark.parametrize("stretch", [1, 7, 64, 1 << 20])
@pytest.mark.parametrize("gap", [0, 3])
def test_merge_over_stretches(spark, stretch, gap):
    r = random.Random(stretch)
    rows = [("c", s, s + r.randint(1, 30)) for s in (r.randint(0, 600) for _ in range(60))] + [("c", 100, 420)]
    expected = []
    for _, s, e in sorted(rows):
        if expected and s <= expected[-1][1] + gap:
            expected[-1][1] = max(expected[-1][1], e)
        else:
            expected.append([s, e])
    assert got(intervals.merge(iv(spark, rows), gap=gap, stretch=stretch), "start", "stop") == [tuple(x) for x in expected]


def test_complement_at_the_edges(spark):
    sizes = spark.createDataFrame([("c", 50), ("d", 9)], "chrom string, size long")
    a = iv(spark, [("c", 0, 10), ("c", 40, 50), ("x", 1, 2)])
    assert got(intervals.complement(a, sizes), "chrom", "start", "stop") == [("c", 10, 40), ("d", 0, 9)]


def test_counts_keep_zeros_and_halves(spark):
    a, b = iv(spark, [("c", 0, 10), ("c", 100, 110)]), iv(spark, [("c", 5, 20), ("c", 6, 20)])
    assert got(intervals.count_overlaps(a, b), "start", "n_overlaps") == [(0, 2), (100, 0)]
    assert got(intervals.count_overlaps(a, b, min_fraction=0.5), "start", "n_overlaps") == [(0, 1), (100, 0)]


def test_bins_over_the_edge_are_dropped(spark):
    sizes = spark.createDataFrame([("c", 1000)], "chrom string, size long")
    tiles = intervals.tile(iv(spark, [("c", 0, 1000)]), 200, 50)
    assert got(intervals.context_fits(tiles, sizes, 400), "start") == [(400,)]


def test_folds():
    assert intervals.fold_of_chromosomes([("a", 9), ("b", 5), ("c", 3)], 2) == {"a": 0, "b": 1, "c": 1}


def test_random_and_combined_negatives_avoid_positives(spark):
    sizes = spark.createDataFrame([("c", 5000), ("d", 3000)], "chrom string, size long")
    positives = iv(spark, [("c", 0, 2000), ("d", 1000, 1500)])
    for out in (intervals.random_intervals(sizes, 20, 50, "s", positives), intervals.combined_negatives(positives, sizes, iv(spark, [("c", 4000, 4100)]), 5, "s", 50)):
        assert out.count() > 0
        assert intervals.overlap_join(out.select("chrom", "start", "stop"), positives).count() == 0


def test_fasta_codes(spark, tmp_path):
    text = ["N"] * 1600
    for at, bases in ((0, "aagtggggag"), (900, "GGGGtttgga"), (150, "tNcaTtcaca")):
        text[at : at + 10] = bases
    (tmp_path / "a.fa").write_text(">chr1 some words\n" + "\n".join("".join(text[i : i + 60]) for i in range(0, 1600, 60)) + "\n>chr2\nACGT\n")
    fasta = readers.read_fasta(spark, str(tmp_path / "a.fa"), 128)
    wanted = iv(spark, [("chr1", 0, 10), ("chr1", 900, 910), ("chr1", 150, 160), ("chr2", 2, 8), ("chr9", 0, 3)])
    out = sequences.lookup(wanted, fasta, 128)
    codes = {(r.chrom, r.start): r.codes for r in out.select("chrom", "start", fx.encode(F.col("sequence")).alias("codes")).collect()}
    assert codes == {("chr1", 0): "0023222202", ("chr1", 900): "2222333220", ("chr1", 150): "3410331010", ("chr2", 2): "234444", ("chr9", 0): "444"}


def test_shuffles_keep_composition(spark):
    r = random.Random(1)
    seq = "".join(r.choice("ACGT") for _ in range(1000))
    out = sequences.shuffles(spark.createDataFrame([(1, seq)], "id long, seq string"), "id", "seq", 7).orderBy("aux_idx").collect()
    assert len(out) == 8 and out[0].seq == seq and len({r.seq for r in out}) == 8
    assert all(sorted(r.seq) == sorted(seq) for r in out)


def test_null_threshold_is_strict(spark):
    nulls = spark.createDataFrame([(0, float(v)) for _ in range(7) for v in range(1000)], "g int, v double")
    limit = scores.null_thresholds(nulls, ["g"], "v", 0.01)
    assert limit.first().threshold == 990
    assert scores.above_null(nulls, limit, ["g"], "v").agg(F.min("v")).first()[0] == 991


def test_denoise_patterns(spark):
    rows = [(0, 420, 1.0), (0, 423, 1.0), (1, 420, 1.0), (1, 424, 1.0), (2, 420, -1.0), (2, 423, -1.0), (3, 420, -1.0), (3, 424, -1.0), (4, 420, 1.0), (4, 423, -1.0)]
    out = scores.denoise(spark.createDataFrame(rows, "e int, p int, v double"), ["e"], "p", "v", 1000)
    assert got(out, "e", "p") == [(0, 420), (0, 423), (2, 420), (2, 423)]


def test_importance_filter(spark):
    rows = [(e, p, 1.0) for e, n in ((0, 11), (1, 9)) for p in range(n)]
    df = spark.createDataFrame(rows, "e int, p int, v double").withColumn("t", F.lit(0))
    assert got(scores.importance_filter(df, "e", "t", "v", 10), "e") == [(0,)]


def test_dilation_window(spark):
    sites = spark.createDataFrame([(0, 450)], "e int, p int")
    assert [r.p for r in scores.dilate(sites, ["e"], "p", 10, 1000).orderBy("p").collect()] == list(range(445, 455))
    assert scores.dilate(sites, ["e"], "p", 14, 1000).count() == 14


def test_significant_motifs(spark):
    rows = [(i, i % 10, -1.0 if i % 2 else 1.0) for i in range(7)]
    hits = spark.createDataFrame(rows, "e int, m int, v double")
    required = spark.createDataFrame([(0, 1), (0, 5), (1, 5)], "cluster int, m int")
    assert got(scores.divided_by(hits, "e", "m", required, "cluster"), "e", "cluster") == [(5, 1)]


def test_normalised_to_logits(spark):
    rows = [(t, p, 1.0 if t < 2 and p < 4 else 0.0) for t in range(3) for p in range(10)]
    logits = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 3.0)], "t int, logit double")
    out = scores.normalise_to_logits(spark.createDataFrame(rows, "t int, p int, v double"), logits, ["t"], "v")
    assert got(out.groupBy("t").agg(F.sum("v").alias("s")), "t", "s") == [(0, 1.0), (1, 2.0), (2, 0.0)]


def test_point_mutants_and_epistasis(spark):
    df = spark.createDataFrame([(1, "A" * 20)], "id long, seq string")
    out = {r.combo: r.seq for r in sequences.combinations(df, [3, 9], "T", "seq").collect()}
    assert out[0] == "A" * 20 and out[3] == "AAATAAAAATAAAAAAAAAA" and out[1].count("T") == 1
    combos = spark.createDataFrame([(1, 0, 1.0), (1, 1, 2.0), (1, 2, 3.0), (1, 3, 7.0)], "id long, combo int, v double")
    assert sequences.epistasis(combos, "id", "combo", "v").first()[1:] == (3.0, 6.0, 3.0)


def test_motif_scan_forms_agree(spark):
    r = random.Random(2)
    df = spark.createDataFrame([(i, "".join(r.choice("ACGTN") for _ in range(60))) for i in range(20)] + [(99, "AC"), (98, None)], "id long, seq string")
    pwms = [motifs.Pwm("a", tuple(tuple(float(r.randint(-2, 3)) for _ in range(4)) for _ in range(5))) for _ in range(3)]
    one = got(motifs.scan(df, "id", "seq", pwms, 2.0), "id", "pwm_idx", "pos", "score")
    two = got(motifs.scan_by_join(df, "id", "seq", pwms, 2.0), "id", "pwm_idx", "pos", "score")
    assert one == two and one


def test_pwm_algebra(tmp_path):
    p = motifs.Pwm("x", ((2.0, -2, -2, -2), (-2, 2, -2, -2), (0.0, 0, 0, 0)))
    assert p.consensus()[:2] == "AC" and p.reverse_complement().consensus()[1:] == "GT"
    assert p.chomp().width == 2 and p.pad(1, 2).width == 6
    assert np.allclose(p.probabilities().sum(axis=1), 1) and np.allclose(p.information()[2], 0)
    assert motifs.best_alignment(p, p)[0] == pytest.approx(1) and motifs.best_alignment(p.pad(2, 0), p)[1] == 2
    assert [q.name for q in motifs.reduced([p, motifs.Pwm("y", p.weights)], {"y": 2.0, "x": 1.0})] == ["y"]
    assert motifs.merged(p, p, 0).consensus()[:2] == "AC"
    writers.write_pwms([p], str(tmp_path / "m"), "homer")
    back = readers.read_pwms((tmp_path / "m").read_text().splitlines(), probabilities=True)
    assert back[0].consensus()[:2] == "AC"


def test_exact_tests():
    assert stats.fisher_two_sided(8, 2, 1, 5) == pytest.approx(0.0349650, abs=1e-6)
    assert stats.hypergeometric_tail(3, 20, 5, 6) == pytest.approx(sum(math.comb(5, k) * math.comb(15, 6 - k) for k in range(3, 6)) / math.comb(20, 6))


def test_fdr_threshold(spark):
    r = random.Random(4)
    p = [r.random() for _ in range(2000)] + [r.random() * 0.001 for _ in range(1000)]
    df = spark.createDataFrame([(x,) for x in p], "p double")
    lo, hi = min(p), max(p)
    heights, width = [0] * 50, (hi - lo) / 50
    for x in p:
        heights[min(49, int((x - lo) / width))] += 1
    null, total = sum(heights[-4:-1]) / 3, 0
    for i, h in enumerate(heights):
        total += h
        if null * (i + 1) / total >= 0.2:
            break
    assert stats.fdr_threshold(df, "p", 0.2) == pytest.approx(lo + i * width)


def test_recall_at_precision_ties(spark):
    rows = [("t", 1, 0.9), ("t", 1, 0.9), ("t", 0, 0.9), ("t", 1, 0.5), ("t", 0, 0.1)]
    df = spark.createDataFrame(rows, "task string, label int, score double")
    m = metrics.ranking_metrics(df, "task", "label", "score", (0.7, 0.9)).first()
    assert m.recall_at_70 == 1 and m.recall_at_90 == 0 and m.auroc == pytest.approx(4.0 / 6)


def test_selectors(spark):
    s = parse_selection("a=0,2:b::reduce_type=min,min=2")
    assert s.targets == [("a", [0, 2]), ("b", [])] and s.options == {"reduce_type": "min", "min": "2"}
    df = spark.createDataFrame([(1, [1, 0, 0], [1]), (2, [1, 9, 0], [0])], "id int, a array<int>, b array<int>")
    assert got(df.where(s.condition()), "id") == [(1,)]


def test_array_functions(spark):
    df = spark.createDataFrame([([1.0, -2.0, 3.0], [3.0, 2.0, -1.0])], "a array<double>, b array<double>")
    a, b = F.col("a"), F.col("b")
    row = df.select(ar.dot(a, b), ar.pearson(a, b), ar.arg_max(a), ar.normalised_to(a, F.lit(12.0)), ar.z_scores(F.array(F.lit(1.0), F.lit(1.0)))).first()
    assert row[0] == -4 and row[1] == pytest.approx(np.corrcoef([1, -2, 3], [3, 2, -1])[0, 1]) and row[2] == 2 and row[3] == [2, -4, 6] and row[4] == [None, None]


def test_interpolation_is_flat_beyond_the_ends(spark):
    v = spark.createDataFrame([(0, x) for x in (-5.0, 0.0, 5.0, 10.0, 99.0)], "g int, x double")
    c = spark.createDataFrame([(0, 0.0, 1.0), (0, 10.0, 3.0)], "g int, cx double, cy double")
    assert got(stats.interpolated(v, c, ["g"], "x", "cx", "cy", "y"), "x", "y") == [(-5.0, 1.0), (0.0, 1.0), (5.0, 2.0), (10.0, 3.0), (99.0, 3.0)]


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "v.vcf").write_text("##x\n#CHROM\n1\t10\trs1\tA\tG\t.\t.\tinfo\nchr2\t5\trs2\tC\tT\t.\t.\n")
    assert got(readers.read(spark, "vcf", str(tmp_path / "v.vcf")), "chrom", "pos", "alt") == [("chr1", 10, "G"), ("chr2", 5, "T")]
    writers.write_tsv(iv(spark, [("c", 1, 2)]), str(tmp_path / "bed"), header=False)
    assert got(readers.read(spark, "bed", str(tmp_path / "bed")), "chrom", "start", "stop") == [("c", 1, 2)]
    meta = spark.createDataFrame([("region=c:5-9;active=c:6-8",), ("region=c:1-4;active=c:2-3",), ("none=1",)], "m string")
    writers.write_bed(meta, str(tmp_path / "out"), F.col("m"), "region")
    assert got(readers.read_bed(spark, str(tmp_path / "out")), "start", "stop") == [(1, 4), (5, 9)]
    nodes, edges = readers.read_gml(spark, writers.gml_text([{"id": 0, "label": "a"}], [{"source": 0, "target": 0, "edgetype": "co"}]))
    assert nodes.first().label == "a" and edges.first().edgetype == "co"
    writers.write_descriptor(str(tmp_path / "d.json"), a=1, b=2)
    assert readers.read_descriptor(str(tmp_path / "d.json"), b=3, c=None) == {"a": 1, "b": 3}
    ex = spark.createDataFrame([("x", "c", "training"), ("y", "d", "training")], "example_id string, chrom string, example_type string")
    writers.write_examples(ex, str(tmp_path / "ex"))
    chosen = readers.read(spark, "parquet", str(tmp_path / "ex"), ["example_id", "chrom"], ex.where("example_id = 'x'"))
    assert got(chosen, "example_id", "chrom") == [("x", "c")]
    named = writers.with_column_names(ex, "chrom", ["n"])
    assert named.schema["chrom"].metadata == {"names": ["n"]}


def test_splits_and_training(spark):
    rows = spark.createDataFrame([("a", "p"), ("b", "p"), ("c", "genomewide_negatives"), ("c", "p")], "chrom string, example_type string")
    parts = models.split(rows, {"a": 0, "b": 1, "c": 2}, valid=1, test=2)
    assert {k: v.count() for k, v in parts.items()} == {"train": 1, "valid": 1, "test": 2}
    losses = [3.0, 2.0, 2.5, 2.6, 2.7, 1.0]
    assert models.train_until(lambda i: losses[i]) == (1, 2.0)
    w = models.balanced(spark.createDataFrame([(1,), (0,), (0,), (0,)], "y int"), "y")
    assert got(w, "y", "weight") == [(0, pytest.approx(2 / 3))] * 3 + [(1, pytest.approx(2.0))]


def test_graph_merge_and_runs(spark):
    a = spark.createDataFrame([("x", 1, 2.0)], "node string, n long, m double")
    b = spark.createDataFrame([("x", 3, 6.0), ("y", 1, 1.0)], "node string, n long, m double")
    assert got(graphs.merge_graphs([a, b], ["node"], "n", "m"), "node", "n", "m") == [("x", 4, 5.0), ("y", 1, 1.0)]


def test_streams(spark, tmp_path):
    path = "/root/testdata/sf0.001/events.parquet"
    events = spark.read.parquet(path)
    (tmp_path / "in").mkdir()
    events.repartition(2).write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = streaming.to_parquet(streaming.windowed_counts(stream, "10 days", late="365 days"), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert not q.exception()
    scored = spark.createDataFrame([("t", 1, 0.999), ("t", 0, 0.01), ("t", 1, 1.0)], "task string, label int, score double")
    assert got(streaming.running_score_buckets(scored), "bucket", "positives", "negatives") == [(1, 0, 1), (99, 2, 0)]
    batch = streaming.session_counts(events, "6 hours").agg(F.sum("n")).first()[0]
    assert batch == events.count()
