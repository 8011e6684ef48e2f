"""Prefix trie of conversations, family first.

Conversations are brought together by their base (the last multiple of FAMILY at or
before them), rebuilt on the base's first turns, and each family's small trie is built
where the family is read. Only combined family nodes are shuffled: equal prefixes have
equal keys, a hash chained over their turns, by which the families' nodes are merged.

What a subtree adds up to is found without walking it level by level. The nodes whose
smallest member is the same conversation form one chain, so (conv_id, depth) names a node; a
chain hangs from a node of another chain. The sums of whole chains are gathered
upwards in rounds that double the distance, those along a chain by one window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SQL_CRC, SQL_CRC_TABLE, join_spread, shuffle_partitions, stored

FAMILY, LONGEST_SHARED = 5, 8
ROOT = bytes(16)
#: A family's trie is handed on in parts of about so many nodes, and identifiers are joined by so many at once; neither changes a result.
NODES_AT_ONCE, IDS_AT_ONCE = 20_000, 4_096

_NODE_ROWS = "node binary, parent binary, depth long, conv_id long, n_convs long, n_bytes long, ends boolean"


def _base(conv_id: Column) -> Column:
    """As SQL and Java reckon: the remainder has the sign of the identifier."""
    return conv_id - conv_id % FAMILY


def turns_by_family(conversations: DataFrame) -> DataFrame:
    """(base, conv_id, shared, digest, n_bytes), each family in one partition: its base first, each conversation in order of turn.

    ``shared`` is how many of the base's first turns replace a conversation's own; the digest
    stands for role and text, so whole texts aren't shuffled. A null turn comes first, rows of
    one turn are in order of their digests. Rows without a conv_id are left out.
    """
    conv = F.col("conv_id").cast("long")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where(conv.isNotNull()).select(
        _base(conv).alias("base"), conv.alias("conv_id"), (F.crc32(conv.cast("string")) % (LONGEST_SHARED + 1)).cast("int").alias("shared"),
        F.col("turn").alias("turn"), F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"),
    )
    order = ["base", F.col("conv_id") != F.col("base"), "conv_id", F.col("turn").asc_nulls_first(), "digest"]
    return rows.repartition(shuffle_partitions(conversations.sparkSession), "base").sortWithinPartitions(*order).drop("turn")


class FamilyTrie:
    """The nodes of one family, and where its conversations end. A very long conversation is handed on in parts, so memory is bounded."""

    def __init__(self):
        self.nodes: dict[bytes, list] = {}
        self.ended: list[tuple[bytes, int]] = []
        self.base = self.conv = None

    def begin(self, base: int, conv: int, shared: int) -> None:
        if base != self.base:
            self.base, self.first_turns = base, []
        self.conv, self.shared, self.own, self.node, self.depth = conv, shared, 0, ROOT, 0
        self.visit(ROOT, 0)
        if conv != base:
            for digest, n_bytes in self.first_turns[:shared]:
                self.append(digest, n_bytes)

    def turn(self, digest: bytes, n_bytes: int) -> None:
        """The next original turn of the conversation."""
        if self.conv == self.base:
            if len(self.first_turns) < LONGEST_SHARED:
                self.first_turns.append((digest, n_bytes))
            self.append(digest, n_bytes)
        elif self.own >= self.shared:
            self.append(digest, n_bytes)
        self.own += 1

    def append(self, digest: bytes, n_bytes: int) -> None:
        parent, self.depth = self.node, self.depth + 1
        self.node = hashlib.blake2b(parent + digest, digest_size=16).digest()
        self.visit(parent, n_bytes)

    def visit(self, parent: bytes, n_bytes: int) -> None:
        known = self.nodes.get(self.node)
        if known is None:
            self.nodes[self.node] = [parent, self.depth, self.conv, 1, n_bytes]
        else:
            known[2], known[3] = min(known[2], self.conv), known[3] + 1

    def end(self) -> None:
        if self.conv is not None:
            self.ended.append((self.node, self.conv))
            self.conv = None

    def taken(self) -> pd.DataFrame:
        """What has been gathered, which is forgotten here."""
        rows = [(k, *v, False) for k, v in self.nodes.items()] + [(k, ROOT, 0, c, 0, 0, True) for k, c in self.ended]
        self.nodes, self.ended = {}, []
        return pd.DataFrame(rows, columns=["node", "parent", "depth", "conv_id", "n_convs", "n_bytes", "ends"])


def family_nodes(turns: DataFrame) -> DataFrame:
    """(node, parent, depth, conv_id, n_convs, n_bytes, ends) of each family's trie: its nodes, and with ``ends`` a row for the last node of each conversation."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie = FamilyTrie()
        for pdf in batches:
            for base, conv, shared, digest, n_bytes in zip(*(pdf[c].tolist() for c in ("base", "conv_id", "shared", "digest", "n_bytes")), strict=True):
                if conv != trie.conv:
                    trie.end()
                    if len(trie.ended) + len(trie.nodes) >= NODES_AT_ONCE:
                        yield trie.taken()
                    trie.begin(base, conv, shared)
                elif len(trie.nodes) >= 2 * NODES_AT_ONCE:
                    yield trie.taken()
                trie.turn(digest, n_bytes)
        trie.end()
        yield trie.taken()

    return turns.mapInPandas(build, _NODE_ROWS)


def ends_digests(ended: DataFrame) -> DataFrame:
    """(node, ends_sha256) from (node, conv_id): the hash of each node's identifiers in order, joined by commas.

    Identifiers are sorted and joined in ranges that a node with very many of them spreads over; its
    hash then runs over the pieces one after the other, in constant memory.
    """
    parts = shuffle_partitions(ended.sparkSession)

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a in range(0, len(pdf), IDS_AT_ONCE):
                part = pdf.iloc[a : a + IDS_AT_ONCE]
                yield part.groupby("node", sort=False)["conv_id"].agg(first="min", ids=lambda ids: ",".join(map(str, ids))).reset_index()

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, running = None, None
        for pdf in batches:
            done = []
            for at, ids in zip(pdf["node"], pdf["ids"], strict=True):
                if at != node:
                    if node is not None:
                        done.append((node, running.hexdigest()))
                    node, running = at, hashlib.sha256(ids.encode())
                else:
                    running.update(b"," + ids.encode())
            yield pd.DataFrame(done, columns=["node", "ends_sha256"])
        if node is not None:
            yield pd.DataFrame([(node, running.hexdigest())], columns=["node", "ends_sha256"])

    pieces = ended.repartitionByRange(parts, "node", "conv_id").sortWithinPartitions("node", "conv_id").mapInPandas(join, "node binary, first long, ids string")
    return pieces.repartition(parts, "node").sortWithinPartitions("node", "first").mapInPandas(digest, "node binary, ends_sha256 string")


def merged_nodes(families: DataFrame) -> DataFrame:
    """One row a node of the whole trie: node, parent, depth, conv_id (its smallest member), n_convs, n_bytes, ends_sha256."""
    nodes = families.where("NOT ends").groupBy("node").agg(
        F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.first("n_bytes").alias("n_bytes")
    )
    ends = ends_digests(families.where("ends").select("node", "conv_id"))
    return nodes.join(ends, "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())))


def chain_parents(nodes: DataFrame) -> DataFrame:
    """(chain, above, at): for each chain but the root's the chain that it hangs from, and the depth there."""
    tops = nodes.groupBy("conv_id").agg(F.min_by(F.struct("parent", "depth"), "depth").alias("top")).where("top.depth > 0")
    tops = tops.select(F.col("top.parent").alias("node"), F.col("conv_id").alias("chain"), (F.col("top.depth") - 1).alias("at"))
    return join_spread(tops, nodes.select("node", F.col("conv_id").alias("above")), "node").select("chain", "above", "at")


def chain_totals(chains: DataFrame) -> DataFrame:
    """(chain, leaves, saved): what each chain and all that hang from it add up to; from (chain, above, leaves, saved), ``above`` null at the root.

    Round k adds what lies 2^k chains below and doubles the distance to the chain above, so
    the rounds are as many as the depth of nested chains has binary digits.
    """
    now = stored(chains, "chains")
    while now.where("above IS NOT NULL").head(1):
        below = now.where("above IS NOT NULL").groupBy(F.col("above").alias("chain")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        grown = now.join(below, "chain", "left").select(
            "chain", "above", (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved")
        )
        higher = now.select(F.col("chain").alias("above"), F.col("above").alias("higher")).where("higher IS NOT NULL")
        moved = join_spread(now.where("above IS NOT NULL").select("chain", "above"), higher, "above").select("chain", "higher")
        now = stored(grown.drop("above").join(moved, "chain", "left").withColumnRenamed("higher", "above"), "chains")
    return now.select("chain", "leaves", "saved")


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Each conversation is rebuilt from the first h turns of its base conv_id - conv_id % 5 (all
    if there are fewer, none if the base is absent) and its own turns after its first h; h is
    crc32(conv_id as text) % 9. A node is a distinct sequence of first turns (role, text);
    the root has none. Null roles and texts are empty, a null turn comes first, rows of one
    turn are in an order fixed by role and text, repeated rows are turns of their own, rows without
    a conv_id are left out. A conversation of any length is read row by row; one with very many
    turns passes through one task in bounded memory. An empty table has no nodes, not even a root.
    """
    families = stored(family_nodes(turns_by_family(conversations)), "family-nodes")
    nodes = stored(merged_nodes(families), "trie-nodes")
    hung = stored(chain_parents(nodes), "chain-parents")
    places = hung.groupBy(F.col("above").alias("conv_id"), F.col("at").alias("depth")).agg(F.count(F.lit(1)).alias("n_hung"))
    saved = (F.col("n_convs") - 1) * F.col("n_bytes")
    # The last node of a chain is a leaf unless another chain hangs from it; no other node of a chain is one.
    own = nodes.groupBy("conv_id").agg(F.max("depth").alias("depth"), F.sum(saved).alias("saved"))
    own = own.join(places, ["conv_id", "depth"], "left").select(F.col("conv_id").alias("chain"), F.col("n_hung").isNull().cast("long").alias("leaves"), "saved")
    totals = chain_totals(own.join(hung, "chain", "left").select("chain", "above", "leaves", "saved"))
    at_node = hung.join(totals, "chain").groupBy(F.col("above").alias("conv_id"), F.col("at").alias("depth")).agg(
        F.count(F.lit(1)).alias("n_hung"), F.sum("leaves").alias("hung_leaves"), F.sum("saved").alias("hung_saved")
    )
    rows = nodes.join(at_node, ["conv_id", "depth"], "left").join(hung.select(F.col("chain").alias("conv_id"), (F.col("at") + 1).alias("depth"), "above"), ["conv_id", "depth"], "left")
    chain = Window.partitionBy("conv_id").orderBy(F.col("depth").desc())
    last = F.lag("depth").over(chain).isNull()
    zero = F.lit(0)
    leaves = F.coalesce("hung_leaves", zero) + (last & F.col("n_hung").isNull()).cast("long")
    rows = rows.withColumn("_last", last).withColumn("_leaves", leaves).withColumn("_saved", F.coalesce("hung_saved", zero) + saved)
    return rows.select(
        "conv_id", "depth", F.when(F.col("depth") > 0, F.coalesce("above", "conv_id")).alias("parent_conv_id"), "n_convs",
        (F.coalesce("n_hung", zero) + (~F.col("_last")).cast("long")).alias("n_children"),
        F.sum("_leaves").over(chain).alias("n_leaves"), F.sum("_saved").over(chain).alias("saved_tokens"), "ends_sha256",
    )


def _sql() -> str:
    crc = SQL_CRC.format(text="cast(conv_id AS VARCHAR)")
    return f"""
WITH {SQL_CRC_TABLE},
turns AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS i FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {crc} % 9 AS h FROM (SELECT DISTINCT conv_id FROM turns), crc_table),
rebuilt AS (SELECT c.conv_id, t.i, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.base AND t.i < c.h
            UNION ALL SELECT c.conv_id, t.i, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.i >= c.h),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY i) AS d FROM rebuilt),
paths AS (SELECT conv_id, d, octet_length(encode(text)) AS n_bytes,
            list({{'role': role, 'text': text}}) OVER (PARTITION BY conv_id ORDER BY d ROWS UNBOUNDED PRECEDING) AS path FROM numbered
          UNION ALL SELECT conv_id, 0, 0, [] FROM convs),
members AS (SELECT conv_id, d, n_bytes, dense_rank() OVER (ORDER BY d, path) AS node FROM paths),
lengths AS (SELECT conv_id, max(d) AS length FROM members GROUP BY conv_id),
nodes AS (SELECT node, any_value(d) AS d, min(m.conv_id) AS first, count(*) AS n_convs, any_value(n_bytes) AS n_bytes,
            sha256(coalesce(string_agg(m.conv_id::VARCHAR, ',' ORDER BY m.conv_id) FILTER (WHERE l.length = m.d), '')) AS ends_sha256
          FROM members m JOIN lengths l USING (conv_id) GROUP BY node),
edges AS (SELECT DISTINCT a.node AS parent, b.node AS child FROM members a JOIN members b ON a.conv_id = b.conv_id AND b.d = a.d + 1),
children AS (SELECT parent AS node, count(*) AS n FROM edges GROUP BY parent),
below AS (SELECT DISTINCT a.node AS top, b.node FROM members a JOIN members b ON a.conv_id = b.conv_id AND b.d >= a.d),
sums AS (SELECT top AS node, sum(CASE WHEN c.n IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((x.n_convs - 1) * x.n_bytes) AS saved
         FROM below b JOIN nodes x ON x.node = b.node LEFT JOIN children c ON c.node = b.node GROUP BY top)
SELECT n.first AS conv_id, n.d::BIGINT AS depth, p.first AS parent_conv_id, n.n_convs, coalesce(c.n, 0)::BIGINT AS n_children, s.n_leaves::BIGINT AS n_leaves,
  s.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN sums s USING (node) LEFT JOIN children c USING (node) LEFT JOIN edges e ON e.child = n.node LEFT JOIN nodes p ON p.node = e.parent
"""


ORACLE_SQL = _sql()
