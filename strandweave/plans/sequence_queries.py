"""Queries on sequences, motifs and mutants."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequences as fx
from ..operators import barcodes
from ..operators import motifs as mo
from ..operators import sequences as sq
from ..operators.ranges import with_ranks
from .proxies import FRAGMENTS, SEQ_SQL, fragments, seqs, table

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = f"WITH seqs AS ({SEQ_SQL}) {oracle}"
        return f

    return add


PWMS = [
    mo.Pwm("first", ((2, -1, -1, -1), (-1, 2, -1, -1), (-1, -1, 2, -1), (-1, -1, -1, 2))),
    mo.Pwm("second", ((1, 0, 0, -2), (0, 3, -1, 0), (-2, 0, 0, 1), (1, 1, -1, -1))),
]
CELLS = ", ".join(f"({i}, {j}, '{b}', {w})" for i, p in enumerate(PWMS) for j, row in enumerate(p.weights) for b, w in zip("ACGT", row, strict=True))
SCAN = f"""SELECT doc_id, pwm, pos, sum(w)::DOUBLE AS score FROM (SELECT s.doc_id, c.pwm, s.i - c.place AS pos, c.w, s.n FROM (SELECT doc_id, length(seq) AS n, unnest(range(0, length(seq))) AS i, unnest(string_split(seq, '')) AS base FROM seqs) s
  JOIN (VALUES {CELLS}) c(pwm, place, base, w) ON s.base = c.base) WHERE pos >= 0 AND pos <= n - 4 GROUP BY doc_id, pwm, pos"""


@query("SELECT doc_id, translate(seq, 'ACGTN', '01234') AS codes, round((length(seq) - length(translate(seq, 'GC', ''))) / length(seq)::DOUBLE, 6) AS gc, translate(reverse(seq), 'ACGTN', 'TGCAN') AS rc, seq = translate(translate(seq, 'ACGTN', '01234'), '01234', 'ACGTN') AS back FROM seqs")
def encode_decode(spark, d):
    """Codes, GC share, reverse complement, decoding."""
    s = F.col("seq")
    return seqs(spark, d).select("doc_id", fx.encode(s).alias("codes"), F.round(fx.gc_fraction(s), 6).alias("gc"), fx.reverse_complement(s).alias("rc"), (fx.decode(fx.encode(s)) == s).alias("back"))


@query("SELECT kmer, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM (SELECT doc_id, substr(seq, i, 4) AS kmer FROM (SELECT doc_id, seq, unnest(range(1, length(seq) - 2)) AS i FROM seqs)) GROUP BY kmer")
def kmer_table(spark, d):
    """K-mer counts."""
    return sq.kmer_counts(seqs(spark, d), "doc_id", "seq", 4).groupBy("kmer").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_docs"))


@query("""SELECT doc_id, k AS aux_idx, CASE WHEN k = 0 THEN seq ELSE (SELECT string_agg(substr(seq, i * 2 + 1, 2), '' ORDER BY md5(concat(doc_id, ':', k, ':shuffle:', i)), substr(seq, i * 2 + 1, 2)) FROM range(0, CAST(floor((length(seq) - 1) / 2) AS BIGINT) + 1) t(i)) END AS seq FROM seqs, range(3) r(k)""")
def block_shuffles(spark, d):
    """The sequence and two shuffles of its blocks of two bases, each block with a digest of its own."""
    return sq.shuffles(seqs(spark, d), "doc_id", "seq", 2, digests=True).select("doc_id", F.col("aux_idx").cast("long").alias("aux_idx"), "seq")


@query("SELECT doc_id, k AS combo, concat(substr(seq, 1, 2), CASE WHEN k % 2 = 1 THEN 'T' ELSE substr(seq, 3, 1) END, substr(seq, 4, 4), CASE WHEN (k >> 1) % 2 = 1 THEN 'T' ELSE substr(seq, 8, 1) END, substr(seq, 9)) AS seq FROM seqs, range(4) r(k) WHERE length(seq) > 10")
def combinatorial_mutants(spark, d):
    """All mutants of two positions."""
    return sq.combinations(seqs(spark, d).where("length(seq) > 10"), [2, 7], "T", "seq").select("doc_id", F.col("combo").cast("long").alias("combo"), "seq")


@query(f"SELECT doc_id, pwm AS pwm_idx, score, pos, n_hits, total FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, pwm ORDER BY score DESC, pos) AS r, count(*) OVER (PARTITION BY doc_id, pwm) AS n_hits, sum(score) OVER (PARTITION BY doc_id, pwm) AS total FROM ({SCAN}) WHERE score > 4) WHERE r = 1")
def motif_scan(spark, d):
    """Best hit, hits and sum of each sequence and motif."""
    return mo.scan_best(seqs(spark, d), "doc_id", "seq", PWMS, above=4.0)


@query(f"SELECT pwm AS pwm_idx, sum(score) AS total, count(*) AS n FROM ({SCAN}) WHERE score > 5 GROUP BY pwm")
def motif_scan_by_join(spark, d):
    """M2 in its relational form."""
    return sq_total(mo.scan_by_join(seqs(spark, d), "doc_id", "seq", PWMS, 5.0))


def sq_total(hits):
    return hits.groupBy("pwm_idx").agg(F.sum("score").alias("total"), F.count(F.lit(1)).alias("n"))


@query(f"SELECT pwm AS pwm_idx, score > 0 AS positive, count(*) AS n FROM ({SCAN}) WHERE abs(score) > 5 GROUP BY ALL")
def motif_scan_two_tailed(spark, d):
    """Hits on both tails."""
    hits = mo.scan(seqs(spark, d), "doc_id", "seq", PWMS, above=5.0, two_tailed=True)
    return hits.groupBy("pwm_idx", (F.col("score") > 0).alias("positive")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY md5(concat(doc_id, ':', pos, ':null'))) AS r FROM (SELECT doc_id, unnest(range(length(seq))) AS pos FROM seqs) f
  WHERE NOT EXISTS (SELECT 1 FROM ({SCAN}) h WHERE h.score > 4 AND h.doc_id = f.doc_id AND h.pos = f.pos)) WHERE r <= 5""")
def null_positions(spark, d):
    """M7: five hashed positions without a motif."""
    return mo.scan_null_positions(seqs(spark, d), "doc_id", "seq", PWMS, 4.0, 5, "null")


MUTANT = "SELECT doc_id, k AS combo, (length(t) - length(replace(t, 'CG', '')))::BIGINT // 2 AS v FROM (SELECT doc_id, k, concat(substr(seq, 1, 2), CASE WHEN k % 2 = 1 THEN 'G' ELSE substr(seq, 3, 1) END, substr(seq, 4, 4), CASE WHEN (k >> 1) % 2 = 1 THEN 'G' ELSE substr(seq, 8, 1) END, substr(seq, 9)) AS t FROM seqs, range(4) r(k) WHERE length(seq) > 10)"


def _combos(spark, d):
    rows = sq.combinations(seqs(spark, d).where("length(seq) > 10"), [2, 7], "G", "seq")
    return rows.select("doc_id", "combo", fx.count_of(F.col("seq"), "CG").alias("v"))


@query(f"SELECT doc_id, (max(v) FILTER (combo = 1) - max(v) FILTER (combo = 0)) + (max(v) FILTER (combo = 2) - max(v) FILTER (combo = 0)) AS expected, max(v) FILTER (combo = 3) - max(v) FILTER (combo = 0) AS actual, max(v) FILTER (combo = 3) - max(v) FILTER (combo = 1) - max(v) FILTER (combo = 2) + max(v) FILTER (combo = 0) AS diff FROM ({MUTANT}) GROUP BY doc_id")
def epistasis(spark, d):
    """Expected and actual effect of double mutants."""
    return sq.epistasis(_combos(spark, d), "doc_id", "combo", "v")


@query(f"SELECT m.doc_id, m.combo, m.v - w.v AS delta FROM ({MUTANT}) m JOIN ({MUTANT}) w ON m.doc_id = w.doc_id AND w.combo = 0 WHERE m.combo <> 0")
def mutant_deltas(spark, d):
    """Mutant minus wild type."""
    rows = _combos(spark, d).withColumn("combo", F.col("combo").cast("long"))
    return sq.deltas(rows, "doc_id", "combo", "v", [])


@query(f"""SELECT combo, count(*) AS n, sum(CASE WHEN abs(v - m) > s THEN 1 ELSE 0 END)::BIGINT AS significant FROM (SELECT * FROM ({MUTANT}) WHERE combo > 0) x
  JOIN (SELECT doc_id % 10 AS g, avg(v) AS m, 1.645 * stddev_pop(v) AS s FROM ({MUTANT}) WHERE combo = 0 GROUP BY g) y ON x.doc_id % 10 = y.g GROUP BY combo""")
def significance_against_nulls(spark, d):
    """Values beyond their group's nulls."""
    rows = _combos(spark, d).withColumn("g", F.col("doc_id") % 10).withColumn("combo", F.col("combo").cast("long"))
    out = mo.beyond_nulls(rows, ["g"], "v", F.col("combo") == 0)
    return out.groupBy("combo").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("significant").cast("long")).alias("significant"))


@query("SELECT doc_id AS chrom, (doc_id * 37) % 900 AS start, (doc_id * 37) % 900 + 250 AS stop, rpad(substr(seq, ((doc_id * 37) % 900 + 1)::BIGINT, 250), 250, 'N') AS sequence FROM seqs")
def fasta_lookup(spark, d):
    """Bases of intervals from a chunked sequence table, N where there is none."""
    s = seqs(spark, d)
    at = (F.col("doc_id") * 37) % 900
    intervals = s.select(F.col("doc_id").alias("chrom"), at.alias("start"), (at + 250).alias("stop"))
    return sq.lookup(intervals, sq.chunked(s, "doc_id", "seq", 200), 200)


@query(f"SELECT doc_id, place, f AS fragment FROM ({FRAGMENTS}) WHERE NOT contains(f, 'CTCGAG') AND NOT contains(f, 'GCTAGC') AND NOT contains(f, 'TTAA') AND (60 - length(translate(f, 'GC', ''))) / 60.0 BETWEEN 0.2 AND 0.8")
def compatible_fragments(spark, d):
    """Fragments of whole texts, without restriction sites or N, in a GC range."""
    part = fragments(spark, d).select("doc_id", "place", F.col("f").alias("fragment"))
    return part.where(fx.compatible(F.col("fragment"), ["CTCGAG", "GCTAGC", "TTAA"], 60, (0.2, 0.8)))


CODES = "SELECT i, translate(substr(md5(concat(i, ':bc:0')), 1, 8), '0123456789abcdef', 'ACGTACGTACGTACGT') AS barcode FROM range(400) t(i)"
MANY_CODES = CODES.replace("range(400)", "range(3 * (SELECT count(*) FROM seqs))")


@query(f"SELECT doc_id, rank, copy, barcode FROM (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) * 2 + copy AS rank, copy FROM (SELECT doc_id FROM seqs), (VALUES (0), (1)) v(copy)) s JOIN (SELECT row_number() OVER (ORDER BY i) - 1 AS rank, barcode FROM ({MANY_CODES}) WHERE NOT contains(barcode, 'AAAA')) b USING (rank)".replace("(row_number() OVER (ORDER BY doc_id) - 1) * 2 + copy", "(dense_rank() OVER (ORDER BY doc_id) - 1) * 2 + copy"))
def barcoding(spark, d):
    """Each sequence gets the next two compatible barcodes."""
    picked = seqs(spark, d).select("doc_id")
    # Three candidates for two codes: about one in a hundred has the forbidden run.
    codes = spark.range(3 * picked.count()).select("id", fx.hashed_bases(F.col("id"), "bc", 8).alias("barcode")).where(~F.contains(F.col("barcode"), F.lit("AAAA")))
    ranked = with_ranks(codes, [], "id", ordinal="rank").select("barcode", (F.col("rank") - 1).cast("long").alias("rank"))
    return sq.barcoded(picked, ranked, "doc_id", 2).select("doc_id", "rank", "copy", "barcode")


#: Candidate codes, four for each of two codes a document; their length grows with the number of documents.
DISTANCE = 3
CANDIDATES = """SELECT i, translate(substr(md5(concat(i, ':far:0')), 1, 3 * greatest(3, ceil(ln(n) / ln(4))::INTEGER - 2)), '0123456789abcdef', 'ACGTACGTACGTACGT') AS barcode
  FROM (SELECT unnest(range(n)) AS i, n FROM (SELECT 4 * count(*) AS n FROM seqs))"""
NEAR = f"SELECT a.i AS a, b.i AS b FROM ({CANDIDATES}) a JOIN ({CANDIDATES}) b ON a.i < b.i WHERE hamming(a.barcode, b.barcode) < 3"


def _candidates(spark, d):
    n = 4 * seqs(spark, d).count()
    length = DISTANCE * barcodes.segment_size(n)
    return spark.range(n).select(F.col("id"), fx.hashed_bases(F.col("id"), "far", length).alias("barcode")), length


@query(NEAR)
def close_barcodes(spark, d):
    """Pairs of candidate codes for all documents that are too alike, met through the segments that they share."""
    codes, length = _candidates(spark, d)
    return barcodes.near_pairs(codes, "id", "barcode", length, DISTANCE).select(F.col("low").alias("a"), F.col("high").alias("b"))


@query(f"""SELECT doc_id, copy, barcode FROM (SELECT doc_id, copy, row_number() OVER (ORDER BY doc_id, copy) - 1 AS rank FROM seqs, (VALUES (0), (1)) v(copy)) s JOIN
  (WITH RECURSIVE highs AS MATERIALIZED (SELECT b, list(a) AS lows, row_number() OVER (ORDER BY b) AS k FROM ({NEAR}) GROUP BY b),
     run(k, rejected) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT h.k, CASE WHEN len(list_filter(h.lows, lambda x: NOT list_contains(run.rejected, x))) > 0 THEN list_append(run.rejected, h.b) ELSE run.rejected END
                          FROM run JOIN highs h ON h.k = run.k + 1),
     gone AS MATERIALIZED (SELECT unnest(rejected) AS i FROM (SELECT rejected FROM run ORDER BY k DESC LIMIT 1))
   SELECT barcode, row_number() OVER (ORDER BY i) - 1 AS rank FROM ({CANDIDATES}) WHERE i NOT IN (SELECT i FROM gone)) c USING (rank)""")
def distant_barcodes(spark, d):
    """Two codes for each document, any two of all codes at least three places apart: greedy in order of numbers, over an index of segments."""
    kept = barcodes.distant_codes(*_candidates_of(spark, d), DISTANCE)
    ranked = with_ranks(kept, [], "id", ordinal="rank").select("barcode", (F.col("rank") - 1).cast("long").alias("rank"))
    return sq.barcoded(seqs(spark, d).select("doc_id"), ranked, "doc_id", 2).select("doc_id", F.col("copy").cast("long").alias("copy"), "barcode")


def _candidates_of(spark, d):
    codes, length = _candidates(spark, d)
    return codes, "id", "barcode", length


@query("""SELECT doc_id, f.m AS first, g.m AS second, gap, o AS orientation, concat(substr(seq, 1, 20), CASE WHEN o[1] = '+' THEN f.m ELSE translate(reverse(f.m), 'ACGT', 'TGCA') END, substr(seq, 27, gap), CASE WHEN o[2] = '+' THEN g.m ELSE translate(reverse(g.m), 'ACGT', 'TGCA') END, substr(seq, 33 + gap)) AS seq
  FROM (SELECT * FROM seqs WHERE length(seq) > 100), (VALUES ('ACGTAA'), ('GGGTCC')) f(m), (VALUES ('ACGTAA'), ('GGGTCC')) g(m), (VALUES (5), (10)) s(gap), (VALUES ('++'), ('+-'), ('-+'), ('--')) v(o) WHERE f.m <> g.m""")
def grammar_simulation(spark, d):
    """Every order, orientation and spacing of two motifs in every background that has room."""
    backgrounds = seqs(spark, d).where("length(seq) > 100")
    return sq.simulate_grammars(backgrounds, ["ACGTAA", "GGGTCC"], [5, 10], "seq", 20)


@query("SELECT DISTINCT p_brand, regexp_replace(regexp_replace(concat('HCLUST-12_', p_brand, '.UNK.0.A'), '^HCLUST-\\d+_', ''), '\\.UNK\\.0\\.A', '') AS kept, regexp_replace(p_brand, '\\d+$', '') AS name FROM part")
def clean_names(spark, d):
    """Motif names without prefixes and suffixes."""
    name = F.concat(F.lit("HCLUST-12_"), F.col("p_brand"), F.lit(".UNK.0.A"))
    kept = F.regexp_replace(F.regexp_replace(name, r"^HCLUST-\d+_", ""), r"\.UNK\.0\.A", "")
    return table(spark, d, "part").select("p_brand", kept.alias("kept"), fx.clean_motif_name(name).alias("name")).distinct()


@query("SELECT p_partkey, concat(p_brand, CASE WHEN p_size % 2 = 1 THEN '+' ELSE '-' END, ',', p_type, CASE WHEN p_size % 3 = 1 THEN '+' ELSE '-' END) AS present, concat('f(seq | do(', p_brand, CASE WHEN p_size % 2 = 1 THEN '+' ELSE '-' END, '), ', p_type, CASE WHEN p_size % 3 = 1 THEN '+' ELSE '-' END, ')') AS given FROM part")
def presence_strings(spark, d):
    """Calculation strings parsed and written as states."""
    p = table(spark, d, "part")
    text = F.concat(F.when(F.col("p_size") % 2 == 1, F.lit("1")).otherwise(F.lit("x")), F.when(F.col("p_size") % 3 == 1, F.lit("1")).otherwise(F.lit("0")))
    names, flags = F.array("p_brand", "p_type"), fx.flags_of(text)
    return p.select("p_partkey", fx.presence_text(names, flags).alias("present"), fx.conditional_text(names, flags, F.array(F.lit(1), F.lit(0))).alias("given"))


@query("SELECT doc_id, substr(seq, (greatest(0, least(floor((f + l - 160) / 2), length(seq) - 160)) + 1)::BIGINT, 160) AS fragment FROM (SELECT doc_id, seq, doc_id % 500 AS f, doc_id % 500 + doc_id % 37 AS l FROM seqs WHERE length(seq) >= 160)")
def motif_fragments(spark, d):
    """Fragments around motif edges, kept inside the sequence."""
    s = seqs(spark, d).where("length(seq) >= 160")
    first = F.col("doc_id") % 500
    return s.select("doc_id", fx.fragment_around(F.col("seq"), first, first + F.col("doc_id") % 37, 160).alias("fragment"))
