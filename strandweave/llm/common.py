"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is ``spark.checkpoint.dir`` of the session. Only where that is unset and driver and
    executors are one process (local mode) a fresh temporary folder is taken and
    remembered; on a cluster that is an error.
    """
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that nothing has used before."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: What ``stored`` has written in this process, in order.
_written: list[str] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_so_far() -> int:
    return len(_written)


def drop_stored(spark: SparkSession, since: int, keep_last: bool = True) -> None:
    """Remove the tables that ``stored`` has written since it had written so many, but for the last one: what a finished step needed."""
    gone = _written[since : len(_written) - keep_last]
    for path in gone:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _written[since:] = _written[len(_written) - keep_last :]


def join_spread(rows: DataFrame, keyed: DataFrame, key: str, counts: DataFrame | None = None, n_rows: int | None = None) -> DataFrame:
    """Inner join of ``rows`` with a table that has one row a key. Keys with more than a thousandth of all rows (a thousand keys at most) are broadcast, so none crowds a task.

    ``counts`` (key, _n) and ``n_rows`` are the rows of each key and of all, where they are known.
    """
    if counts is None:
        counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    limit = max(1000, (rows.count() if n_rows is None else n_rows) // 1000)
    hot = stored(counts.where(F.col("_n") > limit).select(key), "hot-keys")
    if not hot.head(1):
        return rows.join(keyed, key)
    hot = F.broadcast(hot)
    few = F.broadcast(keyed.join(hot, key, "left_semi"))
    return rows.join(few, key).unionByName(rows.join(hot, key, "left_anti").join(keyed, key))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def whole_text(column: str | Column = "text") -> Column:
    """The text with null read as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def fold(doc_id: str, parts: int) -> Column:
    """crc32 of the identifier as text, modulo ``parts``."""
    return F.crc32(F.col(doc_id).cast("string")) % parts


#: CRC-32 in SQL: a table by the rule, a step for each byte. ``{text}`` is the text, the table's ``t`` must be in scope.
SQL_CRC_TABLE = """crc_table AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY i) AS t FROM range(256) x(i))"""
SQL_CRC = (
    "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, octet_length(encode({text})) + 1), "
    "lambda i: ('0x' || substr(hex(encode({text})), 2 * i - 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295)"
)


class BoundedCache:
    """Two dicts of at most ``limit`` entries each, with keys of at most LONGEST characters; when the newer is full, the older goes. Memory stays bounded, results don't change."""

    #: Longer words aren't kept.
    LONGEST = 64

    def __init__(self, limit: int = 100_000):
        self.limit, self.newer, self.older = limit, {}, {}

    def get(self, key):
        value = self.newer.get(key)
        if value is None and (value := self.older.get(key)) is not None:
            self.keep(key, value)
        return value

    def keep(self, key: str, value) -> None:
        if len(key) > self.LONGEST:
            return
        if len(self.newer) >= self.limit:
            self.older, self.newer = self.newer, {}
        self.newer[key] = value
