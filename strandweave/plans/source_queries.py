"""Queries that write tables in the domain's formats to the shared folder and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals as iv
from ..sources import readers, writers
from ..sources.bigwig import around_centre
from ..sources.shared import fresh_path, spread
from .proxies import IV_B, SEQ_SQL, TRACK, iv_b, seqs, table, track
from .table_queries import VCF, vcf

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = f"WITH b AS ({IV_B}), tr AS ({TRACK}), seqs AS ({SEQ_SQL}), vcf AS ({VCF}) {oracle}"
        return f

    return add


@query("SELECT chrom, start, stop, concat('peak_', id) AS name FROM b")
def bed_files(spark, d):
    """Intervals split by chromosome into compressed BED files and read back together."""
    path = fresh_path(spark, "bed")
    rows = iv_b(spark, d).select("chrom", "start", "stop", F.concat(F.lit("peak_"), F.col("id").cast("string")).alias("name"))
    writers.write_tsv(rows.where("chrom = 'chr0'"), f"{path}/a", header=False)
    writers.write_tsv(rows.where("chrom <> 'chr0'"), f"{path}/b", header=False)
    return readers.read(spark, "bed", [f"{path}/a", f"{path}/b"])


@query("SELECT chrom, start, stop, id % 7 AS summit FROM b")
def narrow_peak_files(spark, d):
    """narrowPeak rows with their summits."""
    path = fresh_path(spark, "peaks")
    cells = ["chrom", "start", "stop", F.lit("p"), F.lit(0), F.lit("."), F.lit(1.5), F.lit(2.5), F.lit(3.5), (F.col("id") % 7).alias("summit")]
    writers.write_tsv(iv_b(spark, d).select(*cells), path, header=False)
    return readers.read(spark, "narrowpeak", path).select("chrom", "start", "stop", "summit")


@query("SELECT chrom, p AS start, p + 10 AS stop, round(avg(value), 4) AS value FROM (SELECT chrom, value, unnest(range(start, stop, 10)) AS p FROM tr) GROUP BY ALL HAVING avg(value) <> 0")
def track_files(spark, d):
    """Averaged windows written as bedGraph, one folder a task, and read back."""
    path = fresh_path(spark, "tracks")
    writers.write_tracks(track(spark, d).withColumn("task", F.lit("t0")), path, "value", 10, "task")
    return readers.read(spark, "bedgraph", f"{path}/task=t0").withColumn("value", F.round("value", 4))


def _track_files(spark, d):
    """Averaged windows of the track as a folder of bigWig files: its path."""
    path = fresh_path(spark, "bigwig")
    t = track(spark, d)
    sizes = t.groupBy("chrom").agg((F.max("stop") + 10).alias("size"))
    writers.write_track_bigwigs(t.withColumn("task", F.lit("t0")), path, "value", 10, "task", sizes)
    return f"{path}/task=t0"


AVERAGED = "SELECT chrom, p AS start, p + 10 AS stop, avg(value)::FLOAT::DOUBLE AS value FROM (SELECT chrom, value, unnest(range(start, stop, 10)) AS p FROM tr) GROUP BY ALL HAVING avg(value) <> 0"


@query(AVERAGED)
def bigwig_files(spark, d):
    """Averaged windows written as bigWig files (R-tree of compressed sections) and read back, leaf by leaf."""
    return readers.read(spark, "bigwig", _track_files(spark, d))


@query(f"""SELECT w.id, coalesce(sum(o), 0)::BIGINT AS covered, coalesce(sum(o * value), 0) / (w.stop - w.start) AS mean FROM (SELECT w.*, t.value, CASE WHEN t.start IS NOT NULL THEN least(w.stop, t.stop) - greatest(w.start, t.start) END AS o
  FROM (SELECT id, chrom, (start + stop) // 2 - 100 + 200 AS stop, greatest((start + stop) // 2 - 100, 0) AS start FROM b) w
  LEFT JOIN ({AVERAGED}) t ON w.chrom = t.chrom AND w.start < t.stop AND t.start < w.stop) w GROUP BY w.id, w.start, w.stop""")
def bigwig_means(spark, d):
    """Mean signal in 200 bases around the middle of each interval, from the bigWig leaves that these windows reach."""
    windows = around_centre(iv_b(spark, d), 200)
    signal = readers.read(spark, "bigwig", _track_files(spark, d), regions=windows)
    means = iv.mean_signal(windows, signal).select("chrom", "start", "stop", F.col("covered").cast("long").alias("covered"), "mean")
    return windows.join(means, ["chrom", "start", "stop"]).select("id", "covered", "mean")


@query("SELECT concat('chr', chrom) AS chrom, pos, id, ref, alt FROM vcf")
def vcf_files(spark, d):
    """Variants written as VCF lines and read back."""
    path = fresh_path(spark, "vcf")
    v = vcf(spark, d)
    v.select(F.concat_ws("\t", F.col("chrom").cast("string"), F.col("pos").cast("string"), "id", "ref", "alt", F.lit("."), F.lit("."), F.lit("x=1")).alias("value")).write.text(path)
    return readers.read(spark, "vcf", path).select("chrom", "pos", "id", "ref", "alt")


@query("SELECT concat('s', doc_id) AS chrom, length(seq) AS n, md5(seq) AS digest FROM seqs WHERE length(seq) > 0")
def fasta_files(spark, d):
    """Sequences written as FASTA lines of sixty bases and read back in chunks, whole again."""
    path = fresh_path(spark, "fasta")
    s = seqs(spark, d).where("length(seq) > 0")
    lines = F.array_join(F.regexp_extract_all("seq", F.lit("(.{1,60})"), F.lit(1)), "\n")
    s.select(F.concat(F.lit(">s"), F.col("doc_id").cast("string"), F.lit(" words\n"), lines).alias("value")).write.text(path)
    chunks = readers.read(spark, "fasta", path, size=500)
    whole = spread(chunks, "chrom").groupBy("chrom").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "seq"))), lambda c: c["seq"]), "").alias("seq"))
    return whole.select("chrom", F.length("seq").cast("long").alias("n"), F.md5("seq").alias("digest"))


@query("SELECT c_custkey AS id, c_name AS name, c_nationkey::BIGINT AS nation FROM customer WHERE c_nationkey < 12")
def table_files(spark, d):
    """A TSV with header, with inferred types."""
    path = fresh_path(spark, "table")
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"))
    writers.write_tsv(c, path)
    return readers.read(spark, "table", path).where("nation < 12")


@query("SELECT event_id, event_type, user_id FROM events WHERE user_id % 3 = 0")
def example_tables(spark, d):
    """Example tables partitioned by type, copied for chosen keys and columns."""
    path = fresh_path(spark, "examples")
    e = table(spark, d, "events").select("event_id", "event_type", "user_id", F.col("event_type").alias("example_type"))
    writers.write_examples(e, f"{path}/all")
    keys = e.where("user_id % 3 = 0").select("event_id")
    writers.copy_rows(readers.read(spark, "parquet", f"{path}/all"), f"{path}/some", keys, "event_id", ["event_id", "event_type", "user_id"])
    return readers.read_folder(spark, "parquet", f"{path}/some", "*.parquet")
