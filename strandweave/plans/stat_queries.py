"""Queries of statistics and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import families
from ..operators import metrics as me
from ..operators import stats as st
from .proxies import CLF, CUBE, HITS, clf, cube, hits, table

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = f"WITH cube AS ({CUBE}), hits AS ({HITS}), clf AS ({CLF}), lab AS ({LAB}) {oracle}"
        return f

    return add


#: Labels and scores of two tasks; the score is an integer share of 1000, so ties occur and sums are exact.
LAB = "SELECT task, label, least(n_chars, 9999)::DOUBLE / 10000 AS score FROM (SELECT 'quality' AS task, quality AS label, n_chars FROM clf UNION ALL SELECT 'toxic', toxic, n_chars FROM clf)"


def _lab(spark, d):
    score = (F.least(F.col("n_chars"), F.lit(9999)) / F.lit(10000.0)).alias("score")
    return clf(spark, d).unpivot(["doc_id", "n_chars"], ["quality", "toxic"], "task", "label").select("task", "label", score)


POINTS = "SELECT task, score, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER (PARTITION BY task) AS np, sum(n) OVER (PARTITION BY task) AS nn FROM (SELECT task, score, sum(label) AS p, sum(1 - label) AS n FROM lab GROUP BY task, score) WINDOW w AS (PARTITION BY task ORDER BY score DESC ROWS UNBOUNDED PRECEDING)"
RATES = f"SELECT task, score, tp / (tp + fp) AS precision, tp / np AS recall, fp / nn AS fpr FROM ({POINTS})"


@query(f"""SELECT task, round(sum((fpr - coalesce(f0, 0)) * (recall + coalesce(r0, 0)) / 2), 6) AS auroc, round(sum((recall - coalesce(r0, 0)) * (precision + coalesce(p0, 1)) / 2), 6) AS auprc,
  round(coalesce(arg_min(recall, score) FILTER (precision >= 0.9), 0), 6) AS recall_at_90 FROM (SELECT *, lag(fpr) OVER w AS f0, lag(recall) OVER w AS r0, lag(precision) OVER w AS p0 FROM ({RATES}) WINDOW w AS (PARTITION BY task ORDER BY score DESC)) GROUP BY task""")
def ranking_metrics(spark, d):
    """Areas under ROC and PR curves, recall at a precision floor."""
    m = me.ranking_metrics(_lab(spark, d), "task", "label", "score")
    return m.select("task", *[F.round(c, 6).alias(c) for c in ("auroc", "auprc", "recall_at_90")])


@query("SELECT task, count(*) AS n, sum(label)::BIGINT AS positives, round(avg(CASE WHEN (score >= 0.15) = (label = 1) THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(avg((label - score) * (label - score)), 6) AS mse FROM lab GROUP BY ROLLUP (task)")
def classification_counts(spark, d):
    """Accuracy and error by task and over all."""
    m = me.classification_counts(_lab(spark, d), "task", "label", "score", 0.15)
    return m.select("task", "n", "positives", F.round("accuracy", 6).alias("accuracy"), F.round("mse", 6).alias("mse"))


@query("""SELECT task, round(sum((fpr - coalesce(f0, 0)) * (recall + coalesce(r0, 0)) / 2), 6) AS auroc FROM (SELECT *, lag(fpr) OVER w AS f0, lag(recall) OVER w AS r0 FROM (SELECT task, b, tp / np AS recall, fp / nn AS fpr FROM (SELECT task, b, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER (PARTITION BY task) AS np, sum(n) OVER (PARTITION BY task) AS nn
  FROM (SELECT task, least(floor(score * 100), 99) AS b, sum(label) AS p, sum(1 - label) AS n FROM lab GROUP BY ALL) WINDOW w AS (PARTITION BY task ORDER BY b DESC ROWS UNBOUNDED PRECEDING))) WINDOW w AS (PARTITION BY task ORDER BY b DESC)) GROUP BY task""")
def bucketed_auc(spark, d):
    """AUROC from a hundred buckets."""
    return me.bucketed_auc(_lab(spark, d), "task", "label", "score").withColumn("auroc", F.round("auroc", 6))


@query("SELECT l_returnflag AS task, round(avg((l_quantity - l_tax * 100) * (l_quantity - l_tax * 100)), 4) AS mse, round(corr(l_quantity, l_tax * 100), 6) AS pearson, round(1 - sum((l_quantity - l_tax * 100) * (l_quantity - l_tax * 100)) / (var_pop(l_quantity) * count(*)), 4) AS r2 FROM lineitem GROUP BY l_returnflag")
def regression_metrics(spark, d):
    """Mean squared error, correlation and R2."""
    m = me.regression_metrics(table(spark, d, "lineitem").select("l_returnflag", "l_quantity", (F.col("l_tax") * 100).alias("p")), "l_returnflag", "l_quantity", "p")
    return m.select(F.col("l_returnflag").alias("task"), F.round("mse", 4).alias("mse"), F.round("pearson", 6).alias("pearson"), F.round("r2", 4).alias("r2"))


AVG_RANK = "(rank() OVER (PARTITION BY {k} ORDER BY {v}) + (count(*) OVER (PARTITION BY {k}, {v}) - 1) / 2)"


@query(f"SELECT task, round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman FROM (SELECT l_returnflag AS task, l_quantity AS x, l_discount AS y, {AVG_RANK.format(k='l_returnflag', v='l_quantity')} AS rx, {AVG_RANK.format(k='l_returnflag', v='l_discount')} AS ry FROM lineitem) GROUP BY task")
def correlations(spark, d):
    """Pearson, and Spearman by average ranks."""
    li = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("task"), "l_quantity", "l_discount")
    return st.correlations(li, ["task"], "l_quantity", "l_discount").select("task", F.round("pearson", 6).alias("pearson"), F.round("spearman", 6).alias("spearman"))


@query("SELECT a.dim AS i, b.dim AS j, round(corr(a.value::DOUBLE, b.value::DOUBLE), 5) AS r FROM cube a JOIN cube b ON a.vec_id = b.vec_id AND a.dim < b.dim GROUP BY ALL")
def correlation_matrix(spark, d):
    """Correlations of all pairs of motifs."""
    return st.pair_correlations(cube(spark, d), "vec_id", "dim", "value").select("i", "j", F.round("r", 5).alias("r"))


#: Ward's agglomeration of the 64 columns by correlation, nearest pair by nearest pair: the pairs left after each merge, and the merges.
AGGLOMERATED = """RECURSIVE pairs AS MATERIALIZED (SELECT a.dim AS a, b.dim AS b, round(1 - corr(a.value::DOUBLE, b.value::DOUBLE), 9) AS d FROM cube a JOIN cube b ON a.vec_id = b.vec_id AND a.dim < b.dim GROUP BY ALL),
 state(it, a, b, d, na, nb) AS (SELECT 1, a, b, d, 1::BIGINT, 1::BIGINT FROM pairs UNION ALL
  SELECT any_value(it) + 1, least(x, y), greatest(x, y), CASE WHEN count(*) = 1 THEN any_value(d) ELSE (sum((nm + nk) * d) - any_value(nk * dij)) / (any_value(ni + nj) + any_value(nk)) END,
    any_value(CASE WHEN least(x, y) = i THEN ni + nj WHEN x <= y THEN na ELSE nb END), any_value(CASE WHEN greatest(x, y) = i THEN ni + nj WHEN x <= y THEN nb ELSE na END)
  FROM (SELECT *, CASE WHEN a = j THEN i ELSE a END AS x, CASE WHEN b = j THEN i ELSE b END AS y, CASE WHEN a IN (i, j) THEN na ELSE nb END AS nm, CASE WHEN a IN (i, j) THEN nb ELSE na END AS nk FROM
    (SELECT *, first_value(a) OVER w AS i, first_value(b) OVER w AS j, first_value(d) OVER w AS dij, first_value(na) OVER w AS ni, first_value(nb) OVER w AS nj FROM state WINDOW w AS (ORDER BY d, a, b)))
  WHERE NOT (a = i AND b = j) GROUP BY least(x, y), greatest(x, y)),
 merges AS MATERIALIZED (SELECT it, a, b, d, na, nb FROM (SELECT *, row_number() OVER (PARTITION BY it ORDER BY d, a, b) AS r FROM state) WHERE r = 1)"""


def _families(spark, d):
    c = cube(spark, d)
    pairs = st.pair_correlations(c, "vec_id", "dim", "value").select(F.col("i").alias("a"), F.col("j").alias("b"), F.round(1 - F.col("r"), 9).alias("d"))
    return families.agglomerated(pairs, c.select("dim").distinct(), "dim")


@query(f"SELECT a AS \"left\", b AS \"right\", round(d, 6) AS height, na AS n_left, nb AS n_right FROM (WITH {AGGLOMERATED} SELECT * FROM merges)")
def motif_families(spark, d):
    """Ward's tree of the motifs by correlation, all pairs that are nearest to each other merged in a round."""
    return _families(spark, d)[0].select("left", "right", F.round("d", 6).alias("height"), "n_left", "n_right")


@query(f"""SELECT dim, place FROM (WITH {AGGLOMERATED},
  leaves(it, dim, cluster, place) AS (SELECT 1, dim, dim, 0::BIGINT FROM (SELECT DISTINCT dim FROM cube) UNION ALL
    SELECT l.it + 1, dim, CASE WHEN cluster = m.b THEN m.a ELSE cluster END, place + CASE WHEN cluster = m.b THEN m.na ELSE 0 END FROM leaves l JOIN merges m USING (it))
  SELECT dim, place FROM leaves WHERE it = (SELECT max(it) FROM leaves))""")
def family_order(spark, d):
    """Motifs in the order of the leaves of their tree."""
    return _families(spark, d)[1].select(F.col("item").alias("dim"), "place")


@query("""SELECT event_id, round(CASE WHEN hi IS NULL THEN ylo WHEN lo IS NULL THEN yhi WHEN hi = lo THEN ylo ELSE ylo + (value - lo) / (hi - lo) * (yhi - ylo) END, 5) AS mapped FROM (
  SELECT event_id, value, (SELECT max(x) FROM (VALUES (0.0), (20.0), (50.0), (90.0)) c(x) WHERE x <= value) AS lo, (SELECT min(x) FROM (VALUES (0.0), (20.0), (50.0), (90.0)) c(x) WHERE x >= value) AS hi,
    CASE WHEN value >= 90 THEN 30 WHEN value >= 50 THEN 7 WHEN value >= 20 THEN 5 WHEN value >= 0 THEN 1 END AS ylo, CASE WHEN value <= 0 THEN 1 WHEN value <= 20 THEN 5 WHEN value <= 50 THEN 7 WHEN value <= 90 THEN 30 END AS yhi FROM events)""")
def interpolation(spark, d):
    """Values mapped through a curve by linear interpolation."""
    e = table(spark, d, "events").select("event_id", "value", (F.col("event_id") % 8).alias("shard"))
    points = spark.createDataFrame([(0.0, 1.0), (20.0, 5.0), (50.0, 7.0), (90.0, 30.0)], "x double, y double")
    curve = points.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))))
    return st.interpolated(e, curve, ["shard"], "value", "x", "y", "mapped").select("event_id", F.round("mapped", 5).alias("mapped"))


@query("SELECT vec_id, dim, round(avg(t) OVER (PARTITION BY dim, value), 6) AS norm FROM (SELECT c.vec_id, c.dim, c.value, t.t FROM (SELECT *, row_number() OVER (PARTITION BY dim ORDER BY value, vec_id) AS r FROM cube) c JOIN (SELECT r, avg(value::DOUBLE) AS t FROM (SELECT value, row_number() OVER (PARTITION BY dim ORDER BY value, vec_id) AS r FROM cube) GROUP BY r) t USING (r))")
def quantile_normalisation(spark, d):
    """Tasks brought to one distribution by rank."""
    c = cube(spark, d).select("vec_id", "dim", F.col("value").cast("double").alias("value"))
    return st.quantile_normalised(c, "vec_id", "dim", "value", "norm").select("vec_id", "dim", F.round("norm", 6).alias("norm"))


EDGES = "SELECT quantile_cont(n_chars, [i / 10.0 FOR i IN range(11)]) AS e FROM clf WHERE toxic = 1"
BINNED = f"SELECT doc_id, toxic, quality, n_chars, CASE WHEN n_chars BETWEEN e[1] AND e[11] THEN least(len(list_filter(e, lambda x: x <= n_chars)) - 1, 9) END AS bin FROM clf, ({EDGES})"


def _binned(spark, d):
    c = clf(spark, d)
    edges = st.quantile_bins(c.where("toxic = 1"), "n_chars", 10)
    return c.crossJoin(F.broadcast(edges)).withColumn("bin", st.bin_of(F.col("n_chars"), F.col("edges"))).drop("edges")


@query(f"SELECT coalesce(bin, -1) AS bin, toxic, count(*) AS n FROM ({BINNED}) GROUP BY ALL")
def quantile_bins(spark, d):
    """Equally filled bins of the foreground, and who falls into them."""
    return _binned(spark, d).groupBy(F.coalesce(F.col("bin").cast("long"), F.lit(-1)).alias("bin"), "toxic").agg(F.count(F.lit(1)).alias("n"))


SAMPLED = f"SELECT seed, doc_id, bin, quality FROM (SELECT b.*, s.seed, w.wanted, row_number() OVER (PARTITION BY s.seed, b.bin ORDER BY md5(concat(b.doc_id, ':', s.seed))) AS r FROM ({BINNED}) b JOIN (SELECT bin, count(*) AS wanted FROM ({BINNED}) WHERE toxic = 1 GROUP BY bin) w ON b.bin = w.bin, range(20) s(seed) WHERE b.toxic = 0) WHERE r <= wanted"


@query(f"SELECT seed, doc_id, bin FROM ({SAMPLED})")
def matched_background(spark, d):
    """Background rows matched by bin, twenty samples."""
    b = _binned(spark, d)
    s = st.matched_sample(b.where("toxic = 1"), b.where("toxic = 0"), "doc_id", ["bin"], 20)
    return s.select(F.col("seed").cast("long").alias("seed"), "doc_id", F.col("bin").cast("long").alias("bin"))


@query(f"SELECT 'quality' AS item, round((SELECT avg(quality) FROM clf WHERE toxic = 1), 6) AS fg, round(avg(m), 6) AS bg, round(avg(CASE WHEN (SELECT avg(quality) FROM clf WHERE toxic = 1) - m <= 0 THEN 1.0 ELSE 0.0 END), 6) AS p FROM (SELECT seed, avg(quality) AS m FROM ({SAMPLED}) GROUP BY seed)")
def bootstrap_test(spark, d):
    """Foreground mean against matched samples, empirical p."""
    b = _binned(spark, d).withColumn("item", F.lit("quality"))
    s = st.matched_sample(b.where("toxic = 1"), b.where("toxic = 0"), "doc_id", ["bin"], 20).join(b.select("doc_id", "item", "quality"), "doc_id")
    out = st.bootstrap_difference(b.where("toxic = 1"), s, "item", "quality")
    return out.select("item", *[F.round(c, 6).alias(c) for c in ("fg", "bg", "p")])


@query("""SELECT label, dim, o::BIGINT AS observed, round(avg(CASE WHEN abs(s) >= abs(o) THEN 1.0 ELSE 0.0 END), 6) AS p FROM (SELECT label, dim, seed, sum(CASE WHEN substr(md5(concat(vec_id, ':', seed)), 1, 1) < '8' THEN v ELSE -v END) AS s FROM (SELECT vec_id, label, dim, floor(value::DOUBLE * 10000)::BIGINT AS v FROM cube), range(50) t(seed) GROUP BY label, dim, seed)
  JOIN (SELECT label, dim, sum(floor(value::DOUBLE * 10000)::BIGINT) AS o FROM cube GROUP BY label, dim) USING (label, dim) GROUP BY label, dim, o""")
def sign_flip_test(spark, d):
    """Sign-flip permutations of every group and motif."""
    c = cube(spark, d).select("vec_id", "label", "dim", F.floor(F.col("value").cast("double") * 10000).alias("v"))
    return st.sign_flip(c, ["label", "dim"], "vec_id", "v", 50).select("label", "dim", "observed", F.round("p", 6).alias("p"))


@query(f"SELECT task, n, round(w, 3) AS w_plus, round((w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24), 5) AS z FROM (SELECT task, count(*) AS n, sum(CASE WHEN diff > 0 THEN r ELSE 0 END) AS w FROM (SELECT task, diff, {AVG_RANK.format(k='task', v='a')} AS r FROM (SELECT event_type AS task, floor(value)::BIGINT - 30 AS diff, abs(floor(value)::BIGINT - 30) AS a FROM events) WHERE diff <> 0) GROUP BY task)")
def signed_rank_test(spark, d):
    """Wilcoxon signed rank."""
    e = table(spark, d, "events").select(F.col("event_type").alias("task"), (F.floor("value") - 30).alias("diff"))
    return st.signed_rank(e, ["task"], "diff").select("task", "n", F.round("w_plus", 3).alias("w_plus"), F.round("z", 5).alias("z"))


@query(f"SELECT lang, n1::BIGINT AS n1, n0::BIGINT AS n0, u, round((u - n1 * n0 / 2) / nullif(sqrt(n1 * n0 * (n1 + n0 + 1) / 12), 0), 5) AS z FROM (SELECT lang, sum(p) AS n1, sum(1 - p) AS n0, sum(r * p) - sum(p) * (sum(p) + 1) / 2 AS u FROM (SELECT d.lang, l.toxic AS p, {AVG_RANK.format(k='d.lang', v='d.n_chars')} AS r FROM labels l JOIN documents d USING (doc_id)) GROUP BY lang)")
def rank_sum_test(spark, d):
    """Rank sum of two groups."""
    x = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    return st.rank_sum(x, ["lang"], "n_chars", F.col("toxic") == 1).withColumn("z", F.round("z", 5))


@query("SELECT label, round(stddev_pop(value), 5) AS sd, count(*) AS n FROM (SELECT label, value::DOUBLE AS value, quantile_cont(abs(value::DOUBLE), 0.75) OVER (PARTITION BY label) AS lim FROM cube) WHERE abs(value) <= lim AND value <> 0 GROUP BY label")
def trimmed_deviation(spark, d):
    """Deviation without outliers."""
    c = cube(spark, d).select("label", F.col("value").cast("double").alias("value"))
    return st.trimmed_deviation(c, ["label"], "value").withColumn("sd", F.round("sd", 5))


LF = "(SELECT n, sum(CASE WHEN n > 0 THEN ln(n) ELSE 0 END) OVER (ORDER BY n) AS lf FROM range(0, 2001) t(n))"


@query(f"""WITH lf AS {LF}, t AS (SELECT label, dim, max(pop) AS pop, count(*) AS draws, sum(hit) AS hits, max(succ) AS succ FROM (SELECT label, dim, (value > 0)::INTEGER AS hit, count(*) OVER (PARTITION BY dim) AS pop, sum((value > 0)::INTEGER) OVER (PARTITION BY dim) AS succ FROM cube) GROUP BY label, dim)
  SELECT label, dim, hits::BIGINT AS hits, round(sum(exp(a.lf - b.lf - c.lf + e.lf - f.lf - g.lf - h.lf + i.lf + j.lf)), 6) AS p FROM (SELECT t.*, unnest(range(hits::BIGINT, least(succ, draws)::BIGINT + 1)) AS k FROM t) x
  JOIN lf a ON a.n = succ JOIN lf b ON b.n = k JOIN lf c ON c.n = succ - k JOIN lf e ON e.n = pop - succ JOIN lf f ON f.n = draws - k JOIN lf g ON g.n = pop - succ - draws + k JOIN lf h ON h.n = pop JOIN lf i ON i.n = draws JOIN lf j ON j.n = pop - draws GROUP BY label, dim, hits""".replace("WITH lf AS", ", lf AS", 1))
def hypergeometric_test(spark, d):
    """Enrichment of every motif in each group."""
    e = cube(spark, d).select("label", "dim", (F.col("value") > 0).cast("long").alias("hit"))
    groups = e.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("draws"), F.sum("hit").alias("hits"))
    whole = groups.groupBy("dim").agg(F.sum("draws").alias("population"), F.sum("hits").alias("successes"))
    return st.add_hypergeometric(groups.join(whole, "dim"), "hits", "population", "successes", "draws").select("label", "dim", "hits", F.round("p", 6).alias("p"))
