"""Queries on tables made up to show what the given ones don't: crowded chromosomes, ties, large counts."""

import hashlib
import random
import time

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandweave import queries
from strandweave.operators import grammars, graphs, intervals, motifs, mutants, ranges, scores, sequences, stats
from strandweave.plans import stacks
from strandweave.plans.sequence_queries import PWMS


def same_as_sql(spark, d, name, tables):
    """The query's and its SQL's rows on the tables of a folder, both sorted."""
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet')")
    theirs = con.execute(queries.ORACLES[name]).df()
    ours = queries.QUERIES[name](spark, str(d)).toPandas()[list(theirs.columns)]
    return sorted(map(tuple, ours.to_numpy().tolist())), sorted(map(tuple, theirs.to_numpy().tolist()))


def test_exact_tests_of_large_counts():
    start = time.perf_counter()
    p = stats.fisher_two_sided(2_463_600, 11_551_400, 11_601_400, 54_398_600)
    assert 0.9 < p < 1 and stats.fisher_two_sided(10**6, 10**6, 10**6, 10**6) == pytest.approx(1)
    assert stats.hypergeometric_tail(10**6, 4 * 10**6, 2 * 10**6, 2 * 10**6) == pytest.approx(0.5, abs=1e-3)
    assert stats.hypergeometric_tail(0, 50, 5, 5) == pytest.approx(1) and stats.hypergeometric_tail(6, 50, 5, 5) == 0
    assert time.perf_counter() - start < 2


def test_crowded_chromosomes(spark):
    """Free stretches of 50 and 10 bases: sixty fit nowhere, fifty at one place."""
    sizes = spark.createDataFrame([("c", 1000), ("d", 300)], "chrom string, size long")
    full = spark.createDataFrame([("c", 0, 500), ("c", 550, 1000), ("d", 0, 290)], "chrom string, start long, stop long")
    assert intervals.random_intervals(sizes, 5, 60, "s", full, partial=True).count() == 0
    one = intervals.random_intervals(sizes, 5, 50, "s", full).collect()
    assert len(one) == 5 and {(r.chrom, r.start) for r in one} == {("c", 500)}
    out = intervals.combined_negatives(full, sizes, spark.createDataFrame([("c", 510, 540)], "chrom string, start long, stop long"), 5, "s", 60)
    assert sorted((r.chrom, r.start, r.stop) for r in out.collect()) == [("c", 1000, 1120), ("d", 290, 410)]  # flanks beyond the ends, nothing at random


def test_fewer_random_negatives_than_asked(spark, tmp_path):
    """Most places taken: fewer than 2,000 of the 4,000 draws are left, as in SQL."""
    pd.DataFrame({"o_custkey": [49 + 50 * (i % 3) for i in range(60000)], "o_orderkey": range(60000)}).to_parquet(tmp_path / "orders.parquet")
    ours, theirs = same_as_sql(spark, tmp_path, "random_negatives", ["orders"])
    assert ours == theirs and 0 < len(ours) < 2000


def test_greatest_thousandths_of_floats(spark, tmp_path):
    """A float just below 137 thousandths, whose product with 1,000 is 137 as a float and less as a double."""
    duckdb.execute(f"COPY (SELECT 1 AS vec_id, 0 AS label, list_value(0.137, -0.1, 0.57, 0.001, 0.9, 0.2)::FLOAT[] || [-1.0 FOR i IN range(58)]::FLOAT[] AS embedding) TO '{tmp_path}/embeddings.parquet' (FORMAT parquet)")
    ours, theirs = same_as_sql(spark, tmp_path, "k_max_in_order", ["embeddings"])
    assert ours == theirs == [(1, "137,570,900,200")]


def test_ranges_are_cut_once(spark):
    """Approximate quantiles depend on the order of merging, so both branches of a rank's plan read the same stored ones."""
    df = spark.range(1000).withColumnRenamed("id", "v")
    ranked = ranges.with_ranks(df, [], "v", ordinal="r")
    assert "percentile_approx" not in ranked._jdf.queryExecution().toString()
    assert ranked.where("r <> v + 1").count() == 0


@pytest.fixture(scope="module")
def texts(spark):
    r = random.Random(5)
    rows = [(i, "".join(r.choice("ACGTN") for _ in range(n))) for i, n in enumerate([0, 3, 4, 50, 300, 70_000])] + [(9, None), (10, "ACGT" * 20)]
    return spark.createDataFrame(rows, "id long, seq string")


def equal_rows(a, b):
    plain = lambda df: sorted([[round(v, 6) if isinstance(v, float) else v for v in r] for r in df.select(sorted(df.columns)).collect()])
    return plain(a) == plain(b) and a.count() > 0


def test_best_of_each_scan_in_one_pass(texts):
    scanned = motifs.scan(texts, "id", "seq", PWMS, 4.0)
    assert equal_rows(motifs.scan_best(texts, "id", "seq", PWMS, 4.0), motifs.best_hits(scanned, "id"))
    assert equal_rows(motifs.scan_null_positions(texts, "id", "seq", PWMS, 4.0, 5, "s"), motifs.null_positions(texts, scanned, "id", "seq", 5, "s"))


def test_weighted_scan_in_one_pass(texts):
    t = texts.where("seq IS NOT NULL").withColumn("w", F.transform(F.sequence(F.lit(0), F.length("seq")), lambda i: (i % 3).cast("double")))
    two = motifs.agreeing_hits(motifs.scan(t, "id", "seq", PWMS, 2.0), motifs.scan(t, "id", "seq", PWMS, 1.0, weights="w"), "id")
    assert equal_rows(motifs.agreeing_scan(t, "id", "seq", PWMS, 2.0, "w", 1.0), two)


def test_scan_by_join_shuffles_no_positions(texts):
    joined = motifs.scan_by_join(texts, "id", "seq", PWMS, 4.0)
    assert "hashpartitioning(id" not in joined._jdf.queryExecution().toString()
    assert equal_rows(joined, motifs.scan(texts, "id", "seq", PWMS, 4.0))


def test_scores_beyond_own_shuffles_in_one_pass(texts):
    hits = motifs.scan(sequences.shuffles(texts, "id", "seq", 3), ["id", "aux_idx"], "seq", PWMS, 0.0)
    cells = texts.select("id", F.explode(F.array(F.lit(0), F.lit(1))).alias("pwm_idx"), (F.greatest(F.length("seq") - 3, F.lit(0)) * 3).alias("cells"))
    limits = scores.null_thresholds(hits.where("aux_idx > 0"), ["id", "pwm_idx"], "score", 0.02, cells)
    assert equal_rows(motifs.scan_beyond_nulls(texts, "id", "seq", PWMS, 3, 0.02), scores.above_null(hits.where("aux_idx = 0"), limits, ["id", "pwm_idx"], "score").drop("aux_idx"))


def test_each_block_has_a_digest(texts):
    """The order of block_shuffles: by one md5 a block."""
    for r in sequences.shuffles(texts.where("length(seq) > 0 AND length(seq) < 1000"), "id", "seq", 2, digests=True).join(texts.withColumnRenamed("seq", "old"), "id").collect():
        blocks = [r.old[i : i + 2] for i in range(0, len(r.old), 2)]
        order = sorted(range(len(blocks)), key=lambda i: hashlib.md5(f"{r.id}:{r.aux_idx}:shuffle:{i}".encode()).hexdigest())
        assert r.seq == ("".join(blocks[i] for i in order) if r.aux_idx else r.old)
    assert "md5(concat(doc_id, ':', k, ':shuffle:', i))" in queries.ORACLES["block_shuffles"]


def test_importances_equal_sql_where_rounding_decides(spark):
    ours, theirs = same_as_sql(spark, "/root/testdata/sf0.01", "sequence_importances", ["documents"])
    assert ours == theirs


def test_strongest_positions_in_arrays(spark):
    r = random.Random(2)
    values = {i: [r.randint(-3, 3) for _ in range(n)] for i, n in enumerate([1, 4, 12, 40, 40, 41])}
    sites = spark.createDataFrame([(i, m, r.randrange(len(v)), True) for i, v in values.items() for m in (0, 1)], "id long, m int, pos long, present boolean")
    arrays = spark.createDataFrame(list(values.items()), "id long, v array<int>")
    sized, at = arrays.withColumn("n", F.size("v").cast("long")), lambda p: F.get("v", p.cast("int"))
    long = arrays.select("id", F.posexplode("v").alias("pos", "value")).withColumn("pos", F.col("pos").cast("long"))
    assert equal_rows(mutants.strongest_in(sites.join(sized, "id"), at, "n").drop("v", "n"), mutants.strongest_nearby(sites, long, ["id", "m"], "id"))
    far = sites.withColumn("pos", F.col("pos") + 3)
    assert equal_rows(far.join(sized, "id").withColumn("value", mutants.importance_in(at, F.col("pos"), F.col("n"))).drop("v", "n"), mutants.importance_at(far, long, "id", "pos", "value"))


def test_chains_count_without_sets_of_examples(spark):
    edges = spark.createDataFrame([(e, "a", "b") for e in (1, 1, 2, 3)] + [(e, "b", "c") for e in (1, 2, 2, 3)], "example long, i string, j string")
    found = graphs.chains(edges, "example", 3)
    assert [tuple(r) for r in found.collect()] == [("a", "b", "c", 3)]
    assert "distinct count" not in str(found._jdf.queryExecution().toString()) and "count(distinct" not in found._jdf.queryExecution().toString().lower()


def test_first_filler_stops_at_the_first_that_fits(spark):
    rows = spark.createDataFrame([(i, "TTA") for i in range(60)], "id long, f string")
    found = stacks.first_filler(rows, "id", "f", 4, ["TTAA", "TTAC", "TTAG"], 3)
    assert "lambda" not in found._jdf.queryExecution().toString()

    def least(i):
        bases = [hashlib.md5(f"{i}:fill:{k}".encode()).hexdigest()[:4].translate(str.maketrans("0123456789abcdef", "ACGTACGTACGTACGT")) for k in range(3)]
        return next((k for k in range(3) if "TTA" + bases[k][0] not in ("TTAA", "TTAC", "TTAG") and not any(s in "TTA" + bases[k] for s in ("TTAA", "TTAC", "TTAG"))), None)

    assert {r.id: r.filler for r in found.collect()} == {i: least(i) for i in range(60)}


def test_paired_effects(spark):
    rows = spark.createDataFrame([(g, i, 3 * i + g, i) for g in (1, 2) for i in range(5)], "gap int, id long, w long, b long")
    long = rows.select("gap", "id", F.col("w").alias("v"), F.lit(True).alias("e")).unionByName(rows.select("gap", "id", F.col("b").alias("v"), F.lit(False).alias("e")))
    assert equal_rows(grammars.paired_effects(rows, ["gap"], "w", "b"), grammars.simulation_effects(long, ["gap"], "id", "e", "v"))
