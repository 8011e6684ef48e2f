"""Queries of the end-to-end stacks."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import stacks
from .proxies import CUBE, HITS, IV_A, IV_B, SEQ_SQL, SHUFFLE_SQL, SERIES, SIZES, TRACK, hits, iv_a, iv_b, seqs, series, sizes, table, track
from .sequence_queries import CELLS, PWMS

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = f"WITH a AS ({IV_A}), b AS ({IV_B}), sizes AS ({SIZES}), tr AS ({TRACK}), cube AS ({CUBE}), hits AS ({HITS}), seqs AS ({SEQ_SQL}), series AS ({SERIES}) {oracle}"
        return f

    return add


REGIONS = "SELECT chrom, min(start) AS start, max(stop) AS stop FROM (SELECT *, sum(o) OVER (PARTITION BY chrom ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, CASE WHEN start <= max(stop) OVER (PARTITION BY chrom ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS o FROM (SELECT DISTINCT chrom, start, stop FROM b))) GROUP BY chrom, g"
TILES = f"SELECT chrom, s AS start, s + 20 AS stop FROM (SELECT chrom, unnest(range(start, stop - 10, 10)) AS s FROM ({REGIONS})) WHERE s >= 400 AND s + 420 <= 1000100"


@query(f"""SELECT t.chrom, t.start, (SELECT count(*) FROM a WHERE a.chrom = t.chrom AND a.start < t.stop AND t.start < a.stop AND least(a.stop, t.stop) - greatest(a.start, t.start) >= 10) AS peaks,
  round(coalesce((SELECT sum(value * (least(tr.stop, t.stop) - greatest(tr.start, t.start))) FROM tr WHERE tr.chrom = t.chrom AND tr.start < t.stop AND t.start < tr.stop), 0) / 20, 6) AS signal FROM ({TILES}) t""")
def build_examples(spark, d):
    """Merged regions, tiled, labelled and measured."""
    b = iv_b(spark, d).select("chrom", "start", "stop").distinct()
    out = stacks.build_examples({"regions": b}, {"signal": track(spark, d)}, sizes(spark), 20, 10, 400)
    labelled = stacks.iv.count_overlaps(out.drop("regions"), iv_a(spark, d), "peaks", min_fraction=0.5)
    return labelled.select("chrom", "start", "peaks", F.round("signal", 6).alias("signal"))


@query("SELECT distance, count(*) AS n, count(DISTINCT vec_id) AS n_examples FROM (SELECT p.vec_id, p.dim - a.anchor AS distance FROM (SELECT vec_id, dim FROM hits WHERE dim % 4 = 2) p JOIN (SELECT vec_id, min(dim) AS anchor FROM hits WHERE dim % 4 = 1 GROUP BY vec_id) a USING (vec_id)) WHERE abs(distance) BETWEEN 5 AND 30 GROUP BY distance")
def spacing_profile(spark, d):
    """Distances between two motifs."""
    h = hits(spark, d).withColumn("motif", F.col("dim") % 4)
    return stacks.spacing_profile(h, "vec_id", "motif", "dim", 1, 2, 5, 30)


@query("SELECT hits, quantile_cont(label, 0.5)::DOUBLE AS median, count(*) AS n FROM (SELECT vec_id, count(*) AS hits FROM hits WHERE dim % 4 = 1 GROUP BY vec_id) JOIN embeddings USING (vec_id) GROUP BY hits HAVING count(*) > 3")
def multiplicity(spark, d):
    """Signal by number of hits."""
    h = hits(spark, d).withColumn("motif", F.col("dim") % 4)
    signal = table(spark, d, "embeddings").select("vec_id", F.col("label").cast("double").alias("label"))
    return stacks.multiplicity(h, "vec_id", "motif", 1, signal, "label", 3)


@query("""SELECT doc_id, k::INTEGER AS copies, concat(substr(seq, 1, 10), CASE WHEN k >= 1 THEN 'ACGTAA' ELSE substr(seq, 11, 6) END, substr(seq, 17, 12), CASE WHEN k >= 2 THEN 'ACGTAA' ELSE substr(seq, 29, 6) END, substr(seq, 35, 12), CASE WHEN k >= 3 THEN 'ACGTAA' ELSE substr(seq, 47, 6) END, substr(seq, 53)) AS seq
  FROM seqs, range(1, 4) r(k) WHERE 10 + (k - 1) * 18 + 6 <= length(seq)""")
def density_simulation(spark, d):
    """One to three copies of a motif at a fixed spacing."""
    return stacks.density_simulation(seqs(spark, d), "doc_id", "seq", "ACGTAA", 3, 12, 10)


@query("""SELECT user_id, pos, round(sum(w * value) / sum(w), 6) AS smooth FROM (SELECT t.user_id, t.pos, s.value, k.w FROM (SELECT *, max(pos) OVER (PARTITION BY user_id) AS hi FROM series) t, (VALUES (-1, 0.25), (0, 0.5), (1, 0.25)) k(by, w), LATERAL (SELECT value FROM series s WHERE s.user_id = t.user_id AND s.pos = CASE WHEN t.hi = 1 THEN 1 WHEN t.pos + k.by < 1 THEN 2 - t.pos - k.by WHEN t.pos + k.by > t.hi THEN 2 * t.hi - t.pos - k.by ELSE t.pos + k.by END) s) GROUP BY user_id, pos""".replace("k(by, w)", "k(d, w)").replace("k.by", "k.d"))
def kernel_smoothing(spark, d):
    """Weighted smoothing with mirrored ends."""
    out = stacks.kernel_smoothed(series(spark, d).select("user_id", "pos", "value"), ["user_id"], "pos", "value", [0.25, 0.5, 0.25])
    return out.select("user_id", F.col("pos").cast("long").alias("pos"), F.round("value", 6).alias("smooth"))


@query("SELECT user_id, event_type FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY md5(concat(user_id, ':lib'))) AS r FROM (SELECT DISTINCT user_id, event_type FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY user_id HAVING count(DISTINCT event_type) = (SELECT count(DISTINCT event_type) FROM events)))) WHERE r <= 10")
def consensus_library(spark, d):
    """Keys of all runs, sampled by group."""
    e = table(spark, d, "events").select("user_id", "event_type")
    return stacks.consensus_library(e, "user_id", "event_type", 10, "event_type", "lib")


@query("SELECT l_suppkey, l_returnflag, net FROM (SELECT l_suppkey, l_returnflag, net, row_number() OVER (PARTITION BY l_suppkey ORDER BY abs(net) DESC, l_returnflag) AS r FROM (SELECT x.l_suppkey, x.l_returnflag, x.v - coalesce(n.v, 0) AS net FROM (SELECT l_suppkey, l_returnflag, sum(l_quantity) AS v FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL) x LEFT JOIN (SELECT l_suppkey, max(v) AS v FROM (SELECT l_suppkey, l_returnflag, sum(l_quantity) AS v FROM lineitem WHERE l_linestatus = 'O' GROUP BY ALL) GROUP BY l_suppkey) n ON x.l_suppkey = n.l_suppkey)) WHERE r = 1")
def best_run(spark, d):
    """The best run of each group less its null."""
    t = table(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("v"))
    real, null = t.where("l_linestatus = 'F'").drop("l_linestatus"), t.where("l_linestatus = 'O'").drop("l_linestatus")
    return stacks.best_run(real, "l_suppkey", "l_returnflag", "v", null)


def _scan(rows: str, keys: str) -> str:
    """SQL of all window scores of ``rows`` (keys, seq)."""
    return f"""SELECT {keys}, pwm, pos, sum(w)::DOUBLE AS score FROM (SELECT s.*, c.pwm, s.i - c.place AS pos, c.w FROM (SELECT {keys}, length(seq) AS n, unnest(range(0, length(seq))) AS i, unnest(string_split(seq, '')) AS base FROM ({rows})) s
  JOIN (VALUES {CELLS}) c(pwm, place, base, w) ON s.base = c.base) WHERE pos >= 0 AND pos <= n - 4 GROUP BY {keys}, pwm, pos"""


SHUFFLED = f"""SELECT doc_id, k, {SHUFFLE_SQL.format(seq="seq", key="concat(doc_id, ':', k, ':shuffle')")} AS seq FROM seqs, range(1, 4) r(k)"""


@query(f"""SELECT h.doc_id, h.pwm AS pwm_idx, h.pos, h.score FROM ({_scan("SELECT doc_id, seq FROM seqs", "doc_id")}) h LEFT JOIN (SELECT x.doc_id, x.pwm, x.score AS t FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, pwm ORDER BY score DESC) AS r FROM ({_scan(SHUFFLED, "doc_id, k")}) WHERE score > 0) x
  JOIN seqs ON x.doc_id = seqs.doc_id WHERE r = greatest(floor(greatest(length(seq) - 3, 0) * 3 * 0.02), 1)) l ON h.doc_id = l.doc_id AND h.pwm = l.pwm WHERE h.score > 0 AND h.score > coalesce(l.t, 0)""")
def shuffled_null_scores(spark, d):
    """Hits beyond each example's shuffled null."""
    return stacks.motif_scores(seqs(spark, d), "doc_id", "seq", PWMS, 3, 0.02)


WILD = "SELECT doc_id, -1 AS mutated, seq FROM seqs"
BEST = f"SELECT doc_id, pwm AS mutated, pos FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, pwm ORDER BY score DESC, pos) AS r FROM ({_scan('SELECT doc_id, seq FROM seqs', 'doc_id')}) WHERE score > 4) WHERE r = 1"
BLANKED = f"SELECT doc_id, mutated, concat(substr(seq, 1, pos), 'NNNN', substr(seq, pos + 5)) AS seq FROM ({BEST}) JOIN seqs USING (doc_id)"


@query(f"""SELECT b.doc_id, b.mutated, w.pwm AS pwm_idx, coalesce(m.total, 0) - w.total AS delta FROM ({BEST}) b JOIN (SELECT doc_id, pwm, sum(score) AS total FROM ({_scan(WILD, "doc_id, mutated")}) WHERE score > 0 GROUP BY ALL) w USING (doc_id)
  LEFT JOIN (SELECT doc_id, mutated, pwm, sum(score) AS total FROM ({_scan(BLANKED, "doc_id, mutated")}) WHERE score > 0 GROUP BY ALL) m ON m.doc_id = b.doc_id AND m.mutated = b.mutated AND m.pwm = w.pwm""")
def mutation_effects(spark, d):
    """Effect of blanking each motif's best site."""
    s = seqs(spark, d)
    found = stacks.mo.scan_best(s, "doc_id", "seq", PWMS, 4.0)
    return stacks.mutation_effects(s, "doc_id", "seq", found, PWMS)
