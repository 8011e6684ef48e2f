"""The domain objects of the queries, made from the given tables, for Spark and (as SQL) for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequences as fx

SIZE = 1_000_100

IV_A = "SELECT concat('chr', l_suppkey % 3) AS chrom, l_partkey*500 + l_linenumber*61 AS start, l_partkey*500 + l_linenumber*61 + cast(l_quantity AS bigint) AS stop, l_orderkey AS id FROM lineitem"
IV_B = "SELECT concat('chr', o_custkey % 3) AS chrom, (o_orderkey*7919) % 1000003 AS start, (o_orderkey*7919) % 1000003 + 1 + o_custkey % 50 AS stop, o_orderkey AS id FROM orders"
TRACK = "SELECT concat('chr', l_suppkey % 3) AS chrom, l_partkey*500 + l_linenumber*61 AS start, l_partkey*500 + l_linenumber*61 + cast(l_quantity AS bigint) AS stop, cast(round(l_extendedprice) AS bigint) AS value FROM lineitem"
#: Letters to bases, in the order of the alphabet; other characters become N.
BASES = "ACGTACGTACGTACGTACGTACGTAC"
LETTERS = "abcdefghijklmnopqrstuvwxyz"
SEQ = f"SELECT doc_id, regexp_replace(translate(lower(text), '{LETTERS}', '{BASES}'), '[^ACGT]', 'N'{{flags}}) AS whole FROM documents"
SEQ_SQL = "SELECT doc_id, whole AS seq FROM (" + SEQ.format(flags=", 'g'") + ")"
CUBE = "SELECT vec_id, label, i AS dim, embedding[i] AS value FROM (SELECT vec_id, label, embedding, unnest(range(1, 65)) AS i FROM embeddings)"
HIT = 0.15
CLF = "SELECT d.doc_id, l.quality, l.toxic, d.n_chars FROM labels l JOIN documents d ON l.doc_id = d.doc_id"
SERIES = "SELECT user_id, event_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _sql(spark: SparkSession, d: str, sql: str, name: str) -> DataFrame:
    return spark.sql(sql.replace(f"FROM {name}", "FROM {t}"), t=table(spark, d, name))


def iv_a(spark: SparkSession, d: str) -> DataFrame:
    return _sql(spark, d, IV_A, "lineitem")


def iv_b(spark: SparkSession, d: str) -> DataFrame:
    return _sql(spark, d, IV_B, "orders")


def track(spark: SparkSession, d: str) -> DataFrame:
    return _sql(spark, d, TRACK, "lineitem")


def sizes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f"chr{i}", SIZE) for i in range(3)], "chrom string, size long")


SIZES = f"SELECT concat('chr', i) AS chrom, {SIZE}::BIGINT AS size FROM range(3) t(i)"


def seqs(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, seq): the whole text as bases."""
    return _sql(spark, d, SEQ.format(flags=""), "documents").select("doc_id", F.col("whole").alias("seq"))


#: The block shuffle of ``{seq}`` by ``{key}`` (with its seed), as functions.sequences.block_shuffle has it.
_H, _G = ("('0x' || substr(md5({key}), %d, 7))::BIGINT" % at for at in (1, 8))
_X = f"(({_H} + i) % {fx.PRIME})"
_Y = f"(({_X} * {_X} + {_G}) % {fx.PRIME})"
SHUFFLE_SQL = f"coalesce((SELECT string_agg(substr({{seq}}, i * 2 + 1, 2), '' ORDER BY ({_Y} * {_Y} + {_X}) % {fx.PRIME}, i) FROM range(0, CAST(floor((length({{seq}}) + 1) / 2) AS BIGINT)) t(i)), {{seq}})"
#: Bases of a fragment.
WIDTH = 60
FRAGMENTS = f"""SELECT doc_id, place, concat(doc_id, '.', place) AS fragment_id, substr(s, (least(place * {WIDTH}, length(s) - {WIDTH}) + 1)::BIGINT, {WIDTH}) AS f
  FROM (SELECT doc_id, s, unnest(range((length(s) + {WIDTH} - 1) // {WIDTH})) AS place FROM (SELECT doc_id, replace(seq, 'N', '') AS s FROM seqs) WHERE length(s) >= {WIDTH})"""


def fragments(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, place, fragment_id, f): each whole text, without N, cut into fragments of WIDTH bases as rows; the last one ends where the text does."""
    bases = seqs(spark, d).select("doc_id", F.replace("seq", F.lit("N"), F.lit("")).alias("s")).where(F.length("s") >= WIDTH)
    cut = bases.select("doc_id", F.right("s", F.lit(WIDTH)).alias("last"), F.posexplode(fx.blocks(F.col("s"), WIDTH)).alias("place", "f"))
    whole = F.when(F.length("f") < WIDTH, F.col("last")).otherwise(F.col("f"))
    return cut.select("doc_id", F.col("place").cast("long").alias("place"), F.concat_ws(".", F.col("doc_id").cast("string"), F.col("place").cast("string")).alias("fragment_id"), whole.alias("f"))


def cube(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("dim", "value")).withColumn("dim", (F.col("dim") + 1).cast("long"))


def hits(spark: SparkSession, d: str) -> DataFrame:
    return cube(spark, d).where(F.col("value") > F.lit(HIT).cast("float"))


HITS = f"SELECT vec_id, label, dim, value FROM ({CUBE}) WHERE value > {HIT}::FLOAT"


def clf(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id").select("doc_id", "quality", "toxic", "n_chars")


def series(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(SERIES.replace("FROM events", "FROM {t}"), t=table(spark, d, "events"))
