"""Queries of interval algebra."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import intervals as iv
from . import proxies as px
from .proxies import IV_A, IV_B, SIZES, TRACK, iv_a, iv_b, sizes, track

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = f"WITH a AS ({IV_A}), b AS ({IV_B}), sizes AS ({SIZES}), tr AS ({TRACK}) {oracle}"
        return f

    return add


TILES = "SELECT chrom, start AS region_start, stop AS region_stop, id, unnest(range(start, stop - 10, 10)) AS s FROM a"


@query(f"""SELECT chrom, count(*) AS n_tiles, sum(CASE WHEN n > 0 THEN 1 ELSE 0 END)::BIGINT AS n_positive FROM (
  SELECT t.chrom, t.s, t.id, t.region_start, t.region_stop, count(b.start) AS n FROM ({TILES}) t LEFT JOIN b ON t.chrom = b.chrom AND t.s < b.stop AND b.start < t.s + 20
    AND least(t.s + 20, b.stop) - greatest(t.s, b.start) >= 10 GROUP BY ALL) GROUP BY chrom""")
def tile_label_counts(spark: SparkSession, d: str) -> DataFrame:
    """Tile intervals, label tiles that are half covered, count positives by chromosome."""
    tiles = iv.tile(iv_a(spark, d).dropDuplicates(["chrom", "start", "id", "stop"]), 20, 10)
    labelled = iv.count_overlaps(tiles, iv_b(spark, d), min_fraction=0.5)
    return labelled.groupBy("chrom").agg(F.count(F.lit(1)).alias("n_tiles"), F.sum((F.col("n_overlaps") > 0).cast("long")).alias("n_positive"))


# Repeated (chrom, start, stop, id) rows of a are one tile row in both.
ORACLES["tile_label_counts"] = ORACLES["tile_label_counts"].replace(f"WITH a AS ({IV_A})", f"WITH a AS (SELECT DISTINCT * FROM ({IV_A}))")

MERGED = "SELECT chrom, min(start) AS start, max(stop) AS stop, count(*) AS n FROM (SELECT *, sum(o) OVER (PARTITION BY chrom ORDER BY start, stop, id ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, CASE WHEN start <= max(stop) OVER (PARTITION BY chrom ORDER BY start, stop, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {gap} THEN 0 ELSE 1 END AS o FROM {t})) GROUP BY chrom, g"


@query(MERGED.format(gap=0, t="b"))
def interval_merge(spark, d):
    """A1: union of overlapping or book-ended intervals."""
    return iv.merge(iv_b(spark, d))


@query(MERGED.format(gap=100, t="b"))
def interval_merge_gap(spark, d):
    """A1 with a gap."""
    return iv.merge(iv_b(spark, d), gap=100)


@query(f"""SELECT chrom, prev AS start, start AS stop FROM (SELECT chrom, start, coalesce(lag(stop) OVER (PARTITION BY chrom ORDER BY start, stop), 0) AS prev
  FROM (SELECT chrom, start, stop FROM ({MERGED.format(gap=0, t='b')}) UNION ALL SELECT chrom, size, size FROM sizes)) WHERE start > prev""")
def interval_complement(spark, d):
    """A2: gaps up to the chromosome sizes."""
    return iv.complement(iv_b(spark, d), sizes(spark))


@query("SELECT a.chrom, a.start, a.stop, a.id, count(b.start) AS n_overlaps FROM a LEFT JOIN b ON a.chrom = b.chrom AND a.start < b.stop AND b.start < a.stop GROUP BY a.chrom, a.start, a.stop, a.id")
def overlap_count(spark, d):
    """Number of overlapping intervals, zeros kept."""
    return iv.count_overlaps(iv_a(spark, d).dropDuplicates(), iv_b(spark, d))


ORACLES["overlap_count"] = ORACLES["overlap_count"].replace(f"WITH a AS ({IV_A})", f"WITH a AS (SELECT DISTINCT * FROM ({IV_A}))")


@query("SELECT a.id AS a_id, b.id AS b_id, a.chrom AS chrom, least(a.stop, b.stop) - greatest(a.start, b.start) AS overlap FROM a JOIN b ON a.chrom = b.chrom AND a.start < b.stop AND b.start < a.stop")
def overlap_pairs(spark, d):
    """Overlapping pairs with the number of shared bases."""
    return iv.overlap_join(iv_a(spark, d), iv_b(spark, d)).select("a_id", "b_id", F.col("a_chrom").alias("chrom"), "overlap")


@query("SELECT a.* FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE a.chrom = b.chrom AND a.start < b.stop AND b.start < a.stop)")
def overlap_anti(spark, d):
    """Intervals that touch none of the others."""
    return iv.without_overlap(iv_a(spark, d), iv_b(spark, d))


@query("SELECT a.* FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE a.chrom = b.chrom AND a.start < b.stop AND b.start < a.stop)")
def superset_negatives(spark, d):
    """B1: regions of a superset without positives."""
    return iv.superset_negatives(iv_b(spark, d), iv_a(spark, d))


@query("SELECT b.id, b.chrom, count(a.start) AS n_overlaps FROM b LEFT JOIN a ON a.chrom = b.chrom AND a.start <= b.start + b.id % 2 AND b.start + b.id % 2 < a.stop GROUP BY ALL")
def summit_overlap(spark, d):
    """Peak summits that lie in intervals."""
    peaks = iv_b(spark, d).withColumn("summit", F.col("id") % 2)
    return iv.count_overlaps(iv.summits(peaks, "summit"), iv_a(spark, d)).select("id", "chrom", "n_overlaps")


@query("SELECT b.id, count(a.start) AS n_overlaps FROM b LEFT JOIN a ON a.chrom = b.chrom AND a.start < least(b.stop + 1000, 1000100) AND greatest(b.start - 1000, 0) < a.stop GROUP BY ALL")
def slop_overlap(spark, d):
    """Intervals widened by 1000 bases, then counted."""
    return iv.count_overlaps(iv.slop(iv_b(spark, d), 1000, sizes(spark)), iv_a(spark, d)).select("id", "n_overlaps")


@query("SELECT chrom, greatest(start + k * 200, 0)::BIGINT AS start, start + k * 200 + 200 AS stop, id FROM b, (VALUES (-2), (-1)) v(k) WHERE start + k * 200 + 200 > greatest(start + k * 200, 0) UNION ALL SELECT chrom, stop + k * 200, stop + k * 200 + 200, id FROM b, (VALUES (0), (1)) v(k)")
def flank_negatives(spark, d):
    """B1: neighbouring windows on both sides."""
    return iv.flanks(iv_b(spark, d), 200, 2, 2)


@query("SELECT chrom, region_start, s AS start, concat('region=', chrom, ':', region_start, '-', region_stop, ';active=', chrom, ':', s, '-', s + 20, ';features=', chrom, ':', s - 400, '-', s + 420) AS example_metadata FROM (SELECT chrom, start AS region_start, stop AS region_stop, unnest(range(start, stop - 10, 10)) AS s FROM b) WHERE s - 400 >= 0 AND s + 420 <= 1000100")
def tiled_examples(spark, d):
    """Tiles whose context fits, with their metadata string."""
    tiles = iv.context_fits(iv.tile(iv_b(spark, d), 20, 10), sizes(spark), 400)
    return tiles.select("chrom", "region_start", "start", iv.metadata(tiles, 400).alias("example_metadata"))


@query("SELECT chrom, start, stop, count(*) AS n FROM (SELECT chrom, region_start + 0 AS start, region_start + 20 AS stop FROM (SELECT chrom, unnest(range(start, stop - 10, 10)) AS region_start FROM b)) GROUP BY ALL")
def metadata_round_trip(spark, d):
    """Intervals parsed back from metadata strings."""
    tiles = iv.tile(iv_b(spark, d), 20, 10)
    place = iv.parse_metadata(iv.metadata(tiles, 400), "active")
    return tiles.select(place.alias("p")).groupBy("p.chrom", "p.start", "p.stop").agg(F.count(F.lit(1)).alias("n"))


CHAIN = "SELECT concat('chr', i % 3) AS chrom, i * 5000 AS start, i * 5000 + 4000 AS stop, concat('new', i % 2) AS to_chrom, i * 7000 + 13 AS to_start FROM range(200) t(i)"


@query(f"SELECT c.to_chrom AS chrom, a.start + c.to_start - c.start AS start, a.stop + c.to_start - c.start AS stop, a.id FROM a JOIN ({CHAIN}) c ON a.chrom = c.chrom AND c.start <= a.start AND a.stop <= c.stop")
def liftover(spark, d):
    """Coordinates mapped through chain blocks."""
    i = F.col("id")
    chain = spark.range(200).select(F.concat(F.lit("chr"), i % 3).alias("chrom"), (i * 5000).alias("start"), (i * 5000 + 4000).alias("stop"), F.concat(F.lit("new"), i % 2).alias("to_chrom"), (i * 7000 + 13).alias("to_start"))
    return iv.liftover(iv_a(spark, d), chain)


@query("""SELECT chrom, start, stop, covered::BIGINT AS covered, s::BIGINT AS sum, round(s / (stop - start), 6) AS mean FROM (SELECT b.chrom, b.start, b.stop, coalesce(sum(o), 0) AS covered, coalesce(sum(o * value), 0) AS s
  FROM (SELECT DISTINCT chrom, start, stop FROM b) b LEFT JOIN (SELECT b.chrom, b.start, b.stop, least(b.stop, tr.stop) - greatest(b.start, tr.start) AS o, value FROM (SELECT DISTINCT chrom, start, stop FROM b) b JOIN tr ON b.chrom = tr.chrom AND b.start < tr.stop AND tr.start < b.stop) x USING (chrom, start, stop) GROUP BY ALL)""")
def signal_mean(spark, d):
    """Mean of a track over intervals."""
    return iv.mean_signal(iv_b(spark, d), track(spark, d)).withColumn("mean", F.round("mean", 6))


@query("SELECT p.id AS name, floor((tr.start - (p.start - 500)) / 100)::BIGINT AS place, sum(value)::BIGINT AS sum, count(*) AS n FROM b p JOIN tr ON p.chrom = tr.chrom AND tr.start >= p.start - 500 AND tr.start < p.start + 500 GROUP BY ALL")
def signal_matrix(spark, d):
    """Track values in steps around reference points (every tenth interval is a point of the set)."""
    points = iv_b(spark, d).select("chrom", F.col("start").alias("center"), F.col("id").alias("name"))
    return iv.signal_around(points, track(spark, d), 500, 500, 100)


@query("SELECT chrom, p AS start, p + 10 AS stop, round(avg(value), 6) AS value FROM (SELECT chrom, value, unnest(range(start, stop, 10)) AS p FROM tr) GROUP BY ALL HAVING avg(value) <> 0")
def track_average(spark, d):
    """Mean over strided windows that cover a place."""
    return iv.track_from_windows(track(spark, d), "value", 10).withColumn("value", F.round("value", 6))


DRAWS = "SELECT id, ('0x' || substr(md5(concat(id, ':neg')), 1, 14))::BIGINT % 3000300 AS p FROM range(4000) t(id)"


@query(f"""SELECT * FROM (SELECT id, concat('chr', p // 1000100) AS chrom, p % 1000100 AS start, p % 1000100 + 20 AS stop FROM ({DRAWS}) WHERE p % 1000100 + 20 <= 1000100) r
  WHERE NOT EXISTS (SELECT 1 FROM b WHERE r.chrom = b.chrom AND r.start < b.stop AND b.start < r.stop) ORDER BY id LIMIT 2000""")
def random_negatives(spark, d):
    """Hashed random intervals that avoid a set, the first 2,000 that are left of 4,000 draws."""
    return iv.placed_at_random(sizes(spark), 4000, 20, "neg", exclude=iv_b(spark, d)).orderBy("id").limit(2000)


@query("SELECT chrom, count(*) AS n, (row_number() OVER (ORDER BY count(*) DESC, chrom) - 1)::INTEGER AS fold FROM b GROUP BY chrom")
def chromosome_folds(spark, d):
    """Chromosomes to folds, largest first; with as many folds as chromosomes each has its own."""
    counts = iv_b(spark, d).groupBy("chrom").agg(F.count(F.lit(1)).alias("n"))
    folds = iv.fold_of_chromosomes([(r.chrom, r.n) for r in counts.collect()], 3)  # one row a chromosome
    return counts.join(F.broadcast(spark.createDataFrame(list(folds.items()), "chrom string, fold int")), "chrom")


@query("SELECT chrom, start, stop, id, dense_rank() OVER (ORDER BY chrom) AS chrom_no FROM b WHERE NOT contains(chrom, '_') AND chrom <> 'chrM'")
def chromosome_filter(spark, d):
    """Main chromosomes, numbered in order."""
    b = iv_b(spark, d).where(~F.col("chrom").contains("_") & (F.col("chrom") != "chrM"))
    order = b.select("chrom").distinct().select("chrom", F.expr("cast(dense_rank() OVER (ORDER BY chrom) AS bigint)").alias("chrom_no"))
    return b.join(F.broadcast(order), "chrom")


def combined_negatives(spark, d):
    """B1: merged flank, superset and random negatives (sampled by hash; no SQL twin, tested on a fixture)."""
    return iv.combined_negatives(iv_b(spark, d), sizes(spark), iv_a(spark, d), 500, "combined")


QUERIES["combined_negatives"] = combined_negatives
