"""Queries on labels, arrays and score tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import arrays as ar
from ..functions.selectors import parse_selection
from ..operators import scores as sc
from ..operators.ranges import percentiles
from . import proxies as px
from .proxies import CUBE, HITS, SERIES, cube, hits, series, table

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = f"WITH cube AS ({CUBE}), hits AS ({HITS}), series AS ({SERIES}) {oracle}"
        return f

    return add


E = "embeddings"


def _flags(places: str) -> str:
    return f"list_filter([embedding[i + 1] > 0 FOR i IN {places}], lambda x: x)"


for _how, _least, _test in (("any", None, ">= 1"), ("all", None, "= 4"), ("none", None, "= 0"), ("min", 3, ">= 3"), ("max", 1, "<= 1")):

    def _targets(spark, d, text=f"embedding=0,5,9,33::reduce_type={_how}" + (f",{_how}={_least}" if _least else "")):
        """Rows that a target selector keeps."""
        return table(spark, d, E).where(parse_selection(text).condition()).select("vec_id")

    QUERIES[f"target_filter_{_how}"] = _targets
    ORACLES[f"target_filter_{_how}"] = f"SELECT vec_id FROM embeddings WHERE len({_flags('[0, 5, 9, 33]')}) {_test}"


@query("SELECT vec_id, round(list_sum(list_transform(embedding[1:8], lambda x: x::DOUBLE)), 6) AS clipped_sum, list_position(embedding, list_max(embedding)) - 1 AS arg_max, round(list_max(embedding)::DOUBLE, 6) AS top FROM embeddings")
def array_reduce(spark, d):
    """Clipped sums, arg-max and maximum of array rows."""
    e = F.col("embedding")
    return table(spark, d, E).select("vec_id", F.round(ar.total(ar.clip(e, 0, 8)), 6).alias("clipped_sum"), ar.arg_max(e).cast("int").alias("arg_max"), F.round(F.array_max(e).cast("double"), 6).alias("top"))


@query("""SELECT vec_id, string_agg(p::VARCHAR, ',' ORDER BY value DESC, dim) AS top3 FROM (SELECT vec_id, dim, value, CASE WHEN value > 0 THEN dim - 1 ELSE -1 END AS p, row_number() OVER (PARTITION BY vec_id ORDER BY value DESC, dim) AS r FROM cube) WHERE r <= 3 GROUP BY vec_id""")
def top3_places(spark, d):
    """Places of the three greatest elements."""
    return table(spark, d, E).select("vec_id", F.array_join(F.transform(ar.top_places(F.col("embedding"), 3), lambda x: x.cast("string")), ",").alias("top3"))


@query("""SELECT vec_id, string_agg(round(value::DOUBLE, 4)::VARCHAR, ',' ORDER BY dim) AS kept FROM (SELECT vec_id, dim, floor(value * 1000)::BIGINT AS value, row_number() OVER (PARTITION BY vec_id ORDER BY value DESC, dim) AS r FROM cube) WHERE r <= 4 GROUP BY vec_id""".replace("round(value::DOUBLE, 4)", "value"))
def k_max_in_order(spark, d):
    """The four greatest elements in their old order (in thousandths)."""
    kept = ar.k_max_in_order(F.col("embedding"), 4)
    # A float times a whole number would be a double, which SQL's product isn't.
    thousandths = F.transform(kept, lambda x: F.floor(x * F.lit(1000).cast("float")).cast("string"))
    return table(spark, d, E).select("vec_id", F.array_join(thousandths, ",").alias("kept"))


PAIR = "SELECT a.vec_id, a.embedding AS a, b.embedding AS b FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"


@query(f"""SELECT vec_id, round(sum(x * y), 6) AS dot, round(sum(abs(x - y)), 6) AS l1, round(sqrt(sum((x - y) * (x - y))), 6) AS euclidean,
  round(coalesce(sum(least(abs(x), abs(y))) / nullif(sum(greatest(abs(x), abs(y))), 0), 0), 6) AS jaccard,
  round((sum(least(greatest(x, 0), greatest(y, 0))) + sum(least(greatest(-x, 0), greatest(-y, 0)))) / (sum(greatest(greatest(x, 0), greatest(y, 0))) + sum(greatest(greatest(-x, 0), greatest(-y, 0)))), 6) AS signed_jaccard,
  round(corr(x, y), 6) AS pearson FROM (SELECT vec_id, unnest(a)::DOUBLE AS x, unnest(b)::DOUBLE AS y FROM ({PAIR})) GROUP BY vec_id""")
def array_distances(spark, d):
    """Likeness of neighbouring rows."""
    t = table(spark, d, E)
    p = t.select("vec_id", F.col("embedding").alias("a")).join(t.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id")
    a, b = F.col("a"), F.col("b")
    size = lambda c: F.transform(c, F.abs)
    out = {"dot": ar.dot(a, b), "l1": ar.l1(a, b), "euclidean": ar.euclidean(a, b), "jaccard": ar.generalised_jaccard(size(a), size(b)), "signed_jaccard": ar.signed_jaccard(a, b), "pearson": ar.pearson(a, b)}
    return p.select("vec_id", *[F.round(c, 6).alias(n) for n, c in out.items()])


@query("SELECT vec_id, dim, round(value / max(value) OVER w, 6) AS by_max, round((value::DOUBLE - avg(value::DOUBLE) OVER w) / stddev_pop(value::DOUBLE) OVER w, 5) AS z FROM (SELECT vec_id, dim, value::DOUBLE AS value FROM cube) WINDOW w AS (PARTITION BY vec_id)")
def row_normalisation(spark, d):
    """Rows over their maximum, and as z-scores, in long form."""
    e = F.col("embedding")
    both = table(spark, d, E).select("vec_id", F.posexplode(F.arrays_zip(ar.row_max_normalised(e).alias("m"), ar.z_scores(e).alias("z"))).alias("i", "v"))
    return both.select("vec_id", (F.col("i") + 1).cast("long").alias("dim"), F.round(F.col("v").getField("m"), 6).alias("by_max"), F.round(F.col("v").getField("z"), 5).alias("z"))


@query("SELECT vec_id, dim FROM (SELECT vec_id, dim, rank() OVER (PARTITION BY vec_id ORDER BY abs(value) DESC) AS r FROM cube) WHERE r <= 10")
def top_k_ties(spark, d):
    """The ten greatest by absolute value, ties kept."""
    return sc.top_k_with_ties(cube(spark, d), ["vec_id"], F.col("value"), 10).select("vec_id", "dim")


@query("""SELECT c.vec_id, c.dim FROM cube c JOIN (SELECT label, a AS threshold FROM (SELECT label, abs(value) AS a, row_number() OVER (PARTITION BY label ORDER BY abs(value) DESC) AS r, count(*) OVER (PARTITION BY label) AS n FROM cube WHERE vec_id % 2 = 1) WHERE r = greatest(floor(n * 0.05), 1)) t ON c.label = t.label WHERE c.vec_id % 2 = 0 AND (c.value > threshold OR c.value < -threshold)""")
def null_threshold(spark, d):
    """Scores beyond the k-th greatest of their null."""
    c = cube(spark, d)
    limits = sc.null_thresholds(c.where("vec_id % 2 = 1"), ["label"], "value", 0.05)
    return sc.above_null(c.where("vec_id % 2 = 0"), limits, ["label"], "value").select("vec_id", "dim")


@query("SELECT c.vec_id, c.dim FROM cube c JOIN (SELECT vec_id, avg(value::DOUBLE) + 2 * stddev_pop(value::DOUBLE) AS t FROM cube GROUP BY vec_id) x ON c.vec_id = x.vec_id WHERE c.value::DOUBLE > t")
def gaussian_threshold(spark, d):
    """Scores above mean plus two deviations."""
    c = cube(spark, d).withColumn("value", F.col("value").cast("double"))
    return sc.above_gaussian(c, ["vec_id"], "value", 2.0).select("vec_id", "dim")


@query("""SELECT vec_id, dim FROM (SELECT *, sum(CASE WHEN value > 0 THEN 1 ELSE 0 END) OVER w * 7 >= 2 * cells AS p, sum(CASE WHEN value < 0 THEN 1 ELSE 0 END) OVER w * 7 >= 2 * cells AS m FROM (SELECT vec_id, dim - 1 AS dim, value, least(dim + 2, 63) - greatest(dim - 4, 0) + 1 AS cells FROM cube WHERE abs(value) > 0.2::FLOAT)
  WINDOW w AS (PARTITION BY vec_id ORDER BY dim RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING)) WHERE (value > 0 AND p) OR (value < 0 AND m)""")
def denoise(spark, d):
    """Scores with a neighbour of their sign in a centred window."""
    s = cube(spark, d).where(F.abs("value") > F.lit(0.2).cast("float")).withColumn("dim", F.col("dim") - 1)
    return sc.denoise(s, ["vec_id"], "dim", "value", 64).select("vec_id", "dim")


@query("SELECT DISTINCT vec_id, unnest(range(greatest(dim - 6, 0), least(dim + 3, 63) + 1)) AS dim FROM hits WHERE dim % 16 = 1")
def dilation(spark, d):
    """Masks widened to ten positions."""
    s = hits(spark, d).where("dim % 16 = 1").withColumn("dim", F.col("dim") - 1)
    return sc.dilate(s, ["vec_id"], "dim", 10, 64)


@query("SELECT user_id, event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 6) AS smooth, coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY pos), '') = event_type AS same_as_before FROM series")
def centred_mean(spark, d):
    """Centred moving average, comparison with the row before."""
    s = series(spark, d)
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("pos"))
    return s.select("user_id", "event_id", F.round(sc.moving_average(s, ["user_id"], ["pos"], "value", 3), 6).alias("smooth"), (F.coalesce(before, F.lit("")) == F.col("event_type")).alias("same_as_before"))


@query("SELECT label, vec_id, dim + 9 AS position FROM (SELECT label, vec_id, dim, row_number() OVER (PARTITION BY vec_id ORDER BY value DESC, dim) AS r FROM cube) WHERE r = 1")
def arg_max_position(spark, d):
    """Best position of each example, shifted by filter and clip."""
    return sc.arg_max_position(cube(spark, d), ["label", "vec_id"], "dim", "value", 9).select("label", "vec_id", "position")


CLUSTERS = [(0, 1), (0, 2), (1, 3), (1, 4), (2, 5)]


@query(f"SELECT h.vec_id, r.cluster FROM (SELECT DISTINCT vec_id, dim FROM hits) h JOIN (VALUES {', '.join(map(str, CLUSTERS))}) r(cluster, dim) ON h.dim = r.dim GROUP BY h.vec_id, r.cluster HAVING count(*) = (SELECT count(*) FROM (VALUES {', '.join(map(str, CLUSTERS))}) q(cluster, dim) WHERE q.cluster = r.cluster)")
def relational_division(spark, d):
    """examples with all motifs that a cluster requires."""
    required = F.broadcast(spark.createDataFrame(CLUSTERS, "cluster int, dim long"))
    return sc.divided_by(hits(spark, d), "vec_id", "dim", required, "cluster")


@query("SELECT DISTINCT vec_id FROM hits WHERE dim IN (3, 7, 11)")
def any_significant(spark, d):
    """Examples with any significant motif (semi join)."""
    sig = F.broadcast(spark.createDataFrame([(3,), (7,), (11,)], "dim long"))
    found = hits(spark, d).join(sig, "dim", "left_semi").select("vec_id").distinct()
    return found


@query("SELECT vec_id FROM hits GROUP BY vec_id HAVING count(*) > 10")
def importance_filter(spark, d):
    """more than ten non-zero positions in some task."""
    return sc.importance_filter(hits(spark, d), "vec_id", "label", "value", 10)


@query("SELECT vec_id, dim, round(CASE WHEN s <= 1e-7 THEN 0 ELSE value * logit / s END, 5) AS value FROM (SELECT vec_id, dim, value::DOUBLE AS value, (vec_id % 5 + 1)::DOUBLE AS logit, sum(abs(value::DOUBLE)) OVER (PARTITION BY vec_id) AS s FROM cube)")
def normalise_to_logits(spark, d):
    """Importances scaled to their logit."""
    c = cube(spark, d).select("vec_id", "dim", F.col("value").cast("double").alias("value"))
    logits = table(spark, d, E).select("vec_id", (F.col("vec_id") % 5 + 1).cast("double").alias("logit"))
    return sc.normalise_to_logits(c, logits, ["vec_id"], "value").select("vec_id", "dim", F.round("value", 5).alias("value"))


@query("SELECT label, dim, count(*) AS n_hits, round(sum(value::DOUBLE), 5) AS total, round(max(value)::DOUBLE, 6) AS top FROM hits GROUP BY label, dim")
def position_aggregates(spark, d):
    """Counts, sums and maxima by group and motif."""
    return hits(spark, d).groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n_hits"), F.round(F.sum(F.col("value").cast("double")), 5).alias("total"), F.round(F.max("value").cast("double"), 6).alias("top"))


@query("SELECT h.vec_id, h.dim - a.anchor AS rel FROM hits h JOIN (SELECT vec_id, min(dim) AS anchor FROM hits GROUP BY vec_id) a ON h.vec_id = a.vec_id WHERE abs(h.dim - a.anchor) <= 20")
def align_around_anchor(spark, d):
    """Positions relative to an anchor."""
    h = hits(spark, d)
    return sc.aligned(h, h.groupBy("vec_id").agg(F.min("dim").alias("anchor")), "vec_id", "dim", 20).select("vec_id", F.col("dim").alias("rel"))


@query("SELECT vec_id FROM hits GROUP BY vec_id HAVING max(dim) - min(dim) >= 40")
def distance_filter(spark, d):
    """span of positions."""
    h = hits(spark, d).groupBy("vec_id").agg(F.array_agg("dim").alias("p"))  # at most 64 positions a row
    return h.where(F.array_max("p") - F.array_min("p") >= 40).select("vec_id")


@query("SELECT dim % 32 AS pwm, vec_id, round(sum(value::DOUBLE), 5) AS total, bool_or(value > 0.3::FLOAT) AS strong FROM hits GROUP BY ALL")
def fold_strands(spark, d):
    """Forward and reverse motifs folded together."""
    return hits(spark, d).groupBy((F.col("dim") % 32).alias("pwm"), "vec_id").agg(F.round(F.sum(F.col("value").cast("double")), 5).alias("total"), F.bool_or(F.col("value") > F.lit(0.3).cast("float")).alias("strong"))


@query("SELECT vec_id FROM (SELECT vec_id, avg(CASE WHEN (label % 2 > 0) = (value >= 0) THEN 1.0 ELSE 0.0 END) AS s FROM cube GROUP BY vec_id) WHERE s >= 0.52")
def accuracy_filter(spark, d):
    """rows whose tasks are mostly predicted right."""
    t = table(spark, d, E)
    labels = F.array_repeat((F.col("label") % 2), 64)
    right = ar.share_correct(labels, F.col("embedding"), 0.0)
    return t.where(right >= 0.52).select("vec_id")


@query("SELECT vec_id, dim, round(1 / (1 + exp(-value::DOUBLE)), 6) AS p, round(CASE WHEN value::DOUBLE * 10 > 1 THEN log2(value::DOUBLE * 10) ELSE 0 END, 5) AS lg, round(greatest(value::DOUBLE, 0), 6) AS relu FROM cube")
def scalar_maths(spark, d):
    """Sigmoid, floored log2, relu."""
    c = cube(spark, d).withColumn("v", F.col("value").cast("double"))
    return c.select("vec_id", "dim", F.round(ar.sigmoid(F.col("v")), 6).alias("p"), F.round(ar.log2_floor(F.col("v") * 10), 5).alias("lg"), F.round(F.greatest("v", F.lit(0.0)), 6).alias("relu"))


@query("SELECT l.task, count(*) AS n, sum(l.v)::BIGINT AS positives, round(sum(l.v) / count(*), 6) AS share, round((count(*) - sum(l.v)) / nullif(sum(l.v), 0), 6) AS weight FROM (SELECT 'quality' AS task, quality AS v FROM labels UNION ALL SELECT 'toxic', toxic FROM labels) l GROUP BY l.task")
def class_balance(spark, d):
    """Positives, shares and class weights of each task."""
    long = table(spark, d, "labels").unpivot(["doc_id"], ["quality", "toxic"], "task", "v")
    n, p = F.count(F.lit(1)), F.sum("v")
    return long.groupBy("task").agg(n.alias("n"), p.alias("positives"), F.round(p / n, 6).alias("share"), F.round(F.try_divide(n - p, p), 6).alias("weight"))


@query("SELECT label, dim, round(avg(value::DOUBLE), 6) AS mean, round(stddev_pop(value::DOUBLE), 6) AS sd, round(avg(value::DOUBLE) - 2.576 * stddev_pop(value::DOUBLE) / sqrt(count(*)), 6) AS low, round(avg(value::DOUBLE) + 2.576 * stddev_pop(value::DOUBLE) / sqrt(count(*)), 6) AS high FROM cube GROUP BY label, dim")
def ensemble_interval(spark, d):
    """Mean over models with its confidence interval."""
    v = F.col("value").cast("double")
    half = 2.576 * F.stddev_pop(v) / F.sqrt(F.count(F.lit(1)))
    return cube(spark, d).groupBy("label", "dim").agg(F.round(F.avg(v), 6).alias("mean"), F.round(F.stddev_pop(v), 6).alias("sd"), F.round(F.avg(v) - half, 6).alias("low"), F.round(F.avg(v) + half, 6).alias("high"))


@query("SELECT h.vec_id, h.dim FROM hits h WHERE NOT EXISTS (SELECT 1 FROM hits m WHERE m.vec_id = h.vec_id AND m.dim <> h.dim AND m.dim % 8 = 0 AND abs(m.dim - h.dim) <= 2)")
def blank_sites(spark, d):
    """scores away from masked sites."""
    h = hits(spark, d)
    mask = h.where("dim % 8 = 0").select("vec_id", F.col("dim").alias("site"))
    near = mask.select("vec_id", "site", F.explode(F.sequence(F.col("site") - 2, F.col("site") + 2)).alias("dim")).where("dim <> site")
    return h.join(near.select("vec_id", "dim").distinct(), ["vec_id", "dim"], "left_anti").select("vec_id", "dim")


@query("SELECT h.vec_id FROM (SELECT a.vec_id, a.dim, max(CASE WHEN abs(a.dim - m.dim) <= 4 THEN 1 ELSE 0 END) AS near FROM hits a LEFT JOIN hits m ON a.vec_id = m.vec_id AND m.dim % 8 = 0 GROUP BY a.vec_id, a.dim) h GROUP BY h.vec_id HAVING avg(near) >= 0.6")
def solo_filter(spark, d):
    """most important positions lie near motif hits."""
    h = hits(spark, d)
    sites = h.where("dim % 8 = 0").select("vec_id", F.explode(F.sequence(F.col("dim") - 4, F.col("dim") + 4)).alias("dim")).distinct().withColumn("near", F.lit(1))
    return h.join(sites, ["vec_id", "dim"], "left").groupBy("vec_id").agg(F.avg(F.coalesce("near", F.lit(0))).alias("s")).where("s >= 0.6").select("vec_id")


@query("SELECT label, round(quantile_cont(total, 0.5), 6) AS median, count(*) AS n FROM (SELECT vec_id, label, sum(value::DOUBLE) AS total FROM hits GROUP BY ALL) GROUP BY label HAVING count(*) > 5")
def median_by_group(spark, d):
    """Median and count of groups that are large enough."""
    t = hits(spark, d).groupBy("vec_id", "label").agg(F.sum(F.col("value").cast("double")).alias("total"))
    medians = percentiles(t, ["label"], "total", [0.5], "median")
    return t.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where("n > 5").join(medians, "label").select("label", F.round(F.get("median", 0), 6).alias("median"), "n")


@query("SELECT vec_id, total FROM (SELECT vec_id, round(sum(value::DOUBLE), 6) AS total FROM cube GROUP BY vec_id) ORDER BY abs(total) DESC, vec_id LIMIT 20")
def top_absolute(spark, d):
    """The twenty greatest by absolute value."""
    t = cube(spark, d).groupBy("vec_id").agg(F.round(F.sum(F.col("value").cast("double")), 6).alias("total"))
    return t.orderBy(F.abs("total").desc(), "vec_id").limit(20)


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY md5(concat(event_id, ':s42'))) AS r FROM events) WHERE r <= 100")
def seeded_sample(spark, d):
    """A hundred rows of each group in hashed order."""
    e = table(spark, d, "events").select("event_id", "event_type")
    return e.withColumn("r", sc.hash_rank(["event_type"], "event_id", F.lit("s42"))).where("r <= 100").select("event_id")


@query("SELECT vec_id FROM cube GROUP BY vec_id HAVING sum(value::DOUBLE) > (SELECT quantile_cont(s, 0.9) FROM (SELECT sum(value::DOUBLE) AS s FROM cube GROUP BY vec_id))")
def percentile_filter(spark, d):
    """Rows above the ninth decile."""
    t = cube(spark, d).groupBy("vec_id").agg(F.sum(F.col("value").cast("double")).alias("s"))
    limit = percentiles(t, [], "s", [0.9], "limit")  # one row
    return t.crossJoin(F.broadcast(limit)).where(F.col("s") > F.get("limit", 0)).select("vec_id")


@query("""SELECT user_id, min(k)::INTEGER AS "limit" FROM (SELECT user_id, k, sum(exp(-m + k * ln(m) - lgamma(k + 1.0))) OVER (PARTITION BY user_id ORDER BY k) AS c FROM (SELECT user_id, avg(floor(value / 10)) AS m FROM events GROUP BY user_id), range(200) t(k)) WHERE c >= 0.95 GROUP BY user_id""")
def poisson_threshold(spark, d):
    """Poisson limit of each group's counts."""
    e = table(spark, d, "events").select("user_id", F.floor(F.col("value") / 10).alias("v"))
    return sc.poisson_limits(e, ["user_id"], "v", 0.05)


@query("SELECT row_number() OVER (ORDER BY doc_id) AS n, doc_id, example_type FROM (SELECT doc_id, CASE WHEN toxic = 1 THEN 'positives' WHEN quality = 1 THEN 'training_negatives' ELSE 'genomewide_negatives' END AS example_type FROM labels) WHERE example_type <> 'genomewide_negatives'".replace("row_number() OVER (ORDER BY doc_id) AS n, ", ""))
def example_type_filter(spark, d):
    """rows of wanted example types."""
    kind = F.when(F.col("toxic") == 1, "positives").when(F.col("quality") == 1, "training_negatives").otherwise("genomewide_negatives")
    return table(spark, d, "labels").select("doc_id", kind.alias("example_type")).where("example_type <> 'genomewide_negatives'")
