"""Queries of joins, sets, graphs, variants and reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graphs as gr
from ..operators import variants as va
from ..sources.shared import spread
from .proxies import CUBE, HITS, SEQ_SQL, hits, seqs, table

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = f"WITH cube AS ({CUBE}), hits AS ({HITS}), seqs AS ({SEQ_SQL}), baskets AS ({BASKETS}), vcf AS ({VCF}) {oracle}"
        return f

    return add


BASKETS = "SELECT DISTINCT l_orderkey AS example, p_brand AS item FROM lineitem JOIN part ON l_partkey = p_partkey"
VCF = "SELECT doc_id AS chrom, 150 + doc_id % 300 AS pos, concat('rs', doc_id) AS id, substr('ACGT', (doc_id % 4 + 1)::BIGINT, 1) AS ref, substr('GTAC', (doc_id % 4 + 1)::BIGINT, 2) AS alt FROM documents"


def baskets(spark, d):
    li, part = table(spark, d, "lineitem"), table(spark, d, "part")
    rows = li.join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("example"), F.col("p_brand").alias("item"))
    return spread(rows, "example").distinct()


def vcf(spark, d):
    i = F.col("doc_id")
    return table(spark, d, "documents").select(i.alias("chrom"), (150 + i % 300).alias("pos"), F.concat(F.lit("rs"), i).alias("id"), F.substring(F.lit("ACGT"), (i % 4 + 1).cast("int"), F.lit(1)).alias("ref"), F.substring(F.lit("GTAC"), (i % 4 + 1).cast("int"), F.lit(2)).alias("alt"))


@query("SELECT item, count(*) AS n_examples FROM baskets GROUP BY item")
def graph_nodes(spark, d):
    """G1: items with their support."""
    return gr.nodes(baskets(spark, d), "example", "item")


@query("SELECT a.item AS i, b.item AS j, count(*) AS both, round((SELECT count(*) FROM baskets x WHERE x.item = a.item) * (SELECT count(*) FROM baskets y WHERE y.item = b.item) / (SELECT count(DISTINCT example) FROM baskets), 5) AS expected FROM baskets a JOIN baskets b ON a.example = b.example AND a.item < b.item GROUP BY a.item, b.item HAVING count(*) > 5")
def graph_edges(spark, d):
    """Co-occurrence of items against independence."""
    return gr.cooccurrence(baskets(spark, d), "example", "item", 5).select("i", "j", "both", F.round("expected", 5).alias("expected"))


def cooccurrence_tests(spark, d):
    """Odds ratio and exact p of every pair (tested against a direct sum)."""
    return gr.cooccurrence(baskets(spark, d), "example", "item", 5)


QUERIES["cooccurrence_tests"] = cooccurrence_tests


@query("""SELECT a, b, c, count(DISTINCT example) AS support FROM (SELECT x.example, x.a, x.b, y.a AS c FROM both_ways x JOIN both_ways y ON x.example = y.example AND x.b = y.b AND x.a < y.a) GROUP BY a, b, c HAVING count(DISTINCT example) >= 3""")
def graph_chains(spark, d):
    """Connected patterns of three items with support."""
    edges = gr.pairs(baskets(spark, d), "example", "item")
    return gr.chains(edges, "example", 3)


_EDGES = "SELECT a.example, a.item AS i, b.item AS j FROM baskets a JOIN baskets b ON a.example = b.example AND a.item < b.item"
ORACLES["graph_chains"] = ORACLES["graph_chains"].replace(" SELECT a, b, c,", f", e AS ({_EDGES}), kept AS (SELECT i, j FROM e GROUP BY i, j HAVING count(DISTINCT example) >= 3), f AS (SELECT e.* FROM e JOIN kept USING (i, j)), both_ways AS (SELECT example, i AS a, j AS b FROM f UNION ALL SELECT example, j, i FROM f) SELECT a, b, c,", 1)


@query("SELECT item, sum(n)::BIGINT AS n, round(sum(n * m) / sum(n), 6) AS m, count(*) AS n_graphs FROM (SELECT p_brand AS item, l_returnflag, count(*) AS n, avg(l_quantity) AS m FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL) GROUP BY item")
def graph_merge(spark, d):
    """Graphs of three runs merged, means weighed by counts."""
    li = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    whole = li.groupBy(F.col("p_brand").alias("item"), "l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.avg("l_quantity").alias("m"))
    graphs = [whole.where(F.col("l_returnflag") == f).drop("l_returnflag") for f in ("A", "N", "R")]
    return gr.merge_graphs(graphs, ["item"], "n", "m").withColumn("m", F.round("m", 6))


@query("SELECT a, b, sum(n)::BIGINT AS n FROM (SELECT a.item AS a, b.item AS b, count(*) AS n FROM baskets a JOIN baskets b ON a.example = b.example AND a.item < b.item GROUP BY ALL UNION ALL SELECT b.item, a.item, count(*) FROM baskets a JOIN baskets b ON a.example = b.example AND a.item < b.item GROUP BY ALL) GROUP BY a, b")
def adjacency(spark, d):
    """Symmetric pair totals."""
    edges = gr.pairs(baskets(spark, d), "example", "item").groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"))
    return gr.adjacency(edges, "i", "j", "n")


@query("SELECT user_id FROM events GROUP BY user_id HAVING count(DISTINCT event_type) = (SELECT count(DISTINCT event_type) FROM events)")
def in_every_run(spark, d):
    """Keys that occur in all runs."""
    return gr.in_every_run(table(spark, d, "events"), "user_id", "event_type")


@query("(SELECT DISTINCT c_nationkey AS k, 'and' AS op FROM customer INTERSECT SELECT s_nationkey, 'and' FROM supplier) UNION ALL (SELECT c_nationkey, 'minus' FROM customer EXCEPT SELECT s_nationkey, 'minus' FROM supplier) UNION ALL (SELECT c_nationkey, 'or' FROM customer UNION SELECT s_nationkey, 'or' FROM supplier)")
def set_operations(spark, d):
    """Intersection, difference and union."""
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("k"))
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))
    out = [(c.intersect(s), "and"), (c.subtract(s), "minus"), (c.union(s).distinct(), "or")]
    parts = [f.withColumn("op", F.lit(op)) for f, op in out]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT b.example AS example FROM baskets b GROUP BY b.example HAVING count(*) FILTER (b.item IN ('Brand#11', 'Brand#12')) = count(*)")
def subset_test(spark, d):
    """Examples whose items all lie in a set."""
    sets = baskets(spark, d).groupBy("example").agg(F.collect_set("item").alias("s"))
    return sets.where(F.size(F.array_except("s", F.array(F.lit("Brand#11"), F.lit("Brand#12")))) == 0).select("example")


@query("SELECT n.n_name, count(DISTINCT c.c_custkey) AS n_customers, count(DISTINCT s.s_suppkey) AS n_suppliers FROM nation n LEFT JOIN customer c ON c.c_nationkey = n.n_nationkey LEFT JOIN supplier s ON s.s_nationkey = n.n_nationkey GROUP BY n.n_name")
def left_joins(spark, d):
    """Lookups with missing partners counted as zero."""
    n = table(spark, d, "nation")
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count_distinct("c_custkey").alias("n_customers"))
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count_distinct("s_suppkey").alias("n_suppliers"))
    return n.join(c, "n_nationkey", "left").join(s, "n_nationkey", "left").fillna(0, ["n_customers", "n_suppliers"]).groupBy("n_name").agg(F.sum("n_customers").alias("n_customers"), F.sum("n_suppliers").alias("n_suppliers"))


@query("SELECT user_id, coalesce(max(n) FILTER (event_type = 'click'), 0)::BIGINT AS click, coalesce(max(n) FILTER (event_type = 'view'), 0)::BIGINT AS view FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id")
def outer_join_pivot(spark, d):
    """Series side by side, gaps filled with zero."""
    e = table(spark, d, "events").groupBy("user_id").pivot("event_type", ["click", "view"]).count()
    return e.fillna(0)


@query("SELECT region.r_name, sum(l_extendedprice * 100)::BIGINT AS cents FROM (SELECT l_orderkey, round(l_extendedprice)::BIGINT AS l_extendedprice FROM lineitem) JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def star_join(spark, d):
    """Equi joins along keys."""
    li = table(spark, d, "lineitem").select("l_orderkey", F.round("l_extendedprice").cast("long").alias("v"))
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    small = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    joined = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(small, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("r_name").agg(F.sum(F.col("v") * 100).alias("cents"))


@query("SELECT event_id, k, v FROM (SELECT event_id, unnest(string_split(event_type, 'i')) AS k, unnest(string_split(concat(event_type, '-', user_id), 'i')) AS v FROM events) WHERE k IS NOT NULL AND v IS NOT NULL")
def lock_step_explode(spark, d):
    """Several lists exploded side by side."""
    e = table(spark, d, "events")
    both = F.arrays_zip(F.split("event_type", "i").alias("k"), F.split(F.concat_ws("-", "event_type", F.col("user_id").cast("string")), "i").alias("v"))
    return e.select("event_id", F.explode(both).alias("z")).select("event_id", "z.k", "z.v").where("k IS NOT NULL AND v IS NOT NULL")


@query("SELECT event_id, json_extract_string(props, '$.k') IS NULL AS no_k, length(props) AS size FROM events")
def json_rows(spark, d):
    """JSON read and written."""
    e = table(spark, d, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").isNull().alias("no_k"), F.length("props").cast("long").alias("size"))


@query("SELECT v.id, v.pos, s.seq[v.pos - 0 : v.pos - 0] AS old, concat(substr(s.seq, 1, v.pos - 1), substr(v.alt, 1, 1), substr(s.seq, v.pos + 1)) AS mutated FROM vcf v JOIN seqs s ON v.chrom = s.doc_id WHERE length(s.seq) > 460".replace("s.seq[v.pos - 0 : v.pos - 0]", "substr(s.seq, v.pos, 1)"))
def variant_alleles(spark, d):
    """The alternative allele written into its sequence (position from 1)."""
    s = seqs(spark, d).where("length(seq) > 460").withColumnRenamed("doc_id", "chrom")
    rows = vcf(spark, d).join(s, "chrom").withColumn("offset", F.col("pos") - 1).withColumn("old", F.substring(F.col("seq"), F.col("pos").cast("int"), F.lit(1)))
    return va.alleles(rows, "seq", "offset").where("allele = 'alt'").select("id", "pos", "old", F.col("seq").alias("mutated"))


@query("SELECT id, k * 10 AS shift, pos - 1 - 50 + k * 10 AS start, (50 - k * 10)::BIGINT AS \"offset\" FROM vcf, (VALUES (-1), (0), (1)) t(k)")
def variant_windows(spark, d):
    """Strided windows around variants."""
    return va.windows(vcf(spark, d), 100, 10, 3).select("id", F.col("shift").cast("int").alias("shift"), "start", "offset")


SCORED = "SELECT id, ref_n, alt_n, alt_n - ref_n AS diff FROM (SELECT id, (length(r) - length(replace(r, 'CG', '')))::BIGINT AS ref_n, (length(a) - length(replace(a, 'CG', '')))::BIGINT AS alt_n FROM (SELECT v.id, concat(substr(s.seq, 1, v.pos - 1), v.ref, substr(s.seq, v.pos + 1)) AS r, concat(substr(s.seq, 1, v.pos - 1), substr(v.alt, 1, 1), substr(s.seq, v.pos + 1)) AS a FROM vcf v JOIN seqs s ON v.chrom = s.doc_id WHERE length(s.seq) > 460))"


@query(f"SELECT id, diff FROM ({SCORED}) WHERE abs(diff) > 2 * (SELECT stddev_pop(diff) FROM ({SCORED}))")
def variant_effects(spark, d):
    """Score difference of alleles beyond two deviations."""
    s = seqs(spark, d).where("length(seq) > 460").withColumnRenamed("doc_id", "chrom")
    rows = va.alleles(vcf(spark, d).join(s, "chrom").withColumn("offset", F.col("pos") - 1), "seq", "offset")
    scored = rows.withColumn("n", (F.length("seq") - F.length(F.replace("seq", F.lit("CG"), F.lit("")))).cast("long"))
    return va.significant(va.paired(scored, ["id"], "allele", "n"), "diff").select("id", "diff")


@query("SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1")
def best_of_group(spark, d):
    """The best row of each group."""
    o = table(spark, d, "orders")
    return o.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey"))).alias("o_orderkey"))


@query("SELECT p_brand, p_type, count(*) AS n, sum(p_size)::BIGINT AS size FROM part GROUP BY CUBE (p_brand, p_type)")
def cube_totals(spark, d):
    """Totals over all groupings."""
    return table(spark, d, "part").cube("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"), F.sum("p_size").alias("size"))


@query("SELECT window_start AS w, event_type, count(*) AS n FROM (SELECT floor(epoch(ts) / 600)::BIGINT * 600 AS window_start, event_type FROM events) GROUP BY ALL")
def tumbling_counts(spark, d):
    """2.16: event counts in windows of ten minutes."""
    e = table(spark, d, "events")
    return e.groupBy((F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 600) * 600).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, count(*) AS n_sessions, max(n) AS longest FROM (SELECT user_id, g, count(*) AS n FROM (SELECT user_id, sum(o) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS o FROM events)) GROUP BY ALL) GROUP BY user_id")
def sessions(spark, d):
    """2.16: sessions with gaps under six hours."""
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    s = e.groupBy("user_id", F.session_window("ts", "6 hours")).agg(F.count(F.lit(1)).alias("n"))
    return s.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_sessions"), F.max("n").alias("longest"))
