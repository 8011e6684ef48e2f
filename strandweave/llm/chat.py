"""Chat formatting: sorted turn structs, adjacent turns of one role merged, text concatenated; Spark expressions only.

The template of a merged message is ``<s>role[INST]text[SEP]text[/INST]`` for every
role but the assistant, whose text is what a model is to learn:
``<s>assistant[OUT]text[SEP]text</s>``. A formatted conversation is its messages
one after the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The control strings of the template.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[OUT]", "[SEP]")
ASSISTANT = "assistant"
#: One backslash more goes behind the first character of each control string inside a text, those that have backslashes there included.
#: The bracket kinds needn't be told apart: "<INST]" is escaped as well, which does no harm and keeps the rule simple.
ESCAPE = r"([<\[])(\\*(?:/?s>|(?:/?INST|OUT|SEP)\]))"
UNESCAPE = r"([<\[])\\(\\*(?:/?s>|(?:/?INST|OUT|SEP)\]))"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(ESCAPE), F.lit(r"$1\\$2"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(UNESCAPE), F.lit("$1$2"))


def _messages(turns: Column) -> Column:
    """From sorted turns (role, text) to merged messages (role, texts)."""
    places = F.sequence(F.lit(1), F.size(turns))
    starts = F.filter(places, lambda i: (i == 1) | ~F.element_at(turns, i)["role"].eqNullSafe(F.try_element_at(turns, F.greatest(i - 1, F.lit(1)))["role"]))
    ends = F.concat(F.transform(F.slice(starts, F.lit(2), F.greatest(F.size(starts) - 1, F.lit(0))), lambda s: s - 1), F.array(F.size(turns)))
    return F.zip_with(
        starts,
        ends,
        lambda a, b: F.struct(
            F.element_at(turns, a)["role"].alias("role"),
            F.transform(F.slice(turns, a, b - a + 1), lambda t: t["text"]).alias("texts"),
        ),
    )


def _rendered(message: Column) -> Column:
    """A message as text, with its loss mask: start (code points into the message) and length of each assistant text."""
    mine = message["role"] == ASSISTANT
    texts = F.transform(message["texts"], escaped)
    head = F.concat(F.lit("<s>"), escaped(message["role"]), F.when(mine, F.lit("[OUT]")).otherwise(F.lit("[INST]")))
    body = F.array_join(texts, "[SEP]")
    text = F.concat(head, body, F.when(mine, F.lit("</s>")).otherwise(F.lit("[/INST]")))
    lengths = F.transform(texts, lambda t: F.char_length(t))
    spans = F.aggregate(
        lengths,
        F.struct(F.char_length(head).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda acc, n: F.struct(
            (acc["at"] + n + len("[SEP]")).alias("at"),
            F.concat(acc["spans"], F.array(F.struct(acc["at"].alias("start"), n.alias("length")))).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    nothing = F.array().cast("array<struct<start:int,length:int>>")
    return F.struct(text.alias("text"), F.when(mine, spans).otherwise(nothing).alias("loss"))


def format_chats(turns: DataFrame, chunk: int = 512) -> DataFrame:
    """One row a conversation: ``conv_id``, ``formatted`` and ``messages`` (text and loss mask of each merged message).

    Rows are ordered by turn; equal turns by role, then text, so repeated rows stay
    and ties don't depend on partitions. Null texts and roles count as empty, null
    turns come first, a null conv_id is a conversation of its own, other columns are
    dropped. An empty table gives no rows. Turns are first gathered ``chunk`` at a
    time, so a hot conversation is sorted in parts on many tasks; only its finished
    text, which is one value of the result, meets in one row.
    """
    turn = F.struct(
        F.col("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    parts = (
        turns.select("conv_id", F.floor(F.col("turn") / chunk).alias("part"), turn.alias("t"))
        .groupBy("conv_id", "part")
        .agg(F.sort_array(F.collect_list("t")).alias("turns"))
    )
    whole = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "turns"))).alias("parts"))
    merged = whole.select("conv_id", F.flatten(F.col("parts.turns")).alias("turns")).select("conv_id", _messages(F.col("turns")).alias("m"))
    rendered = merged.select("conv_id", F.transform("m", _rendered).alias("messages"))
    return rendered.select("conv_id", F.array_join("messages.text", "").alias("formatted"), "messages")


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    parts = F.filter(F.split(formatted, r"\[/INST\]|</s>"), lambda x: x != "")
    split = F.transform(parts, lambda p: F.split(p, r"\[INST\]|\[OUT\]", 2))
    return F.flatten(
        F.transform(
            split,
            lambda p: F.transform(
                F.split(p[1], r"\[SEP\]"),
                lambda t: F.struct(unescaped(F.substring(p[0], len("<s>") + 1, 2**31 - 1)).alias("role"), unescaped(t).alias("text")),
            ),
        )
    )


def read_loss(messages: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(
        F.flatten(F.transform(messages, lambda m: F.transform(m["loss"], lambda s: unescaped(F.substr(m["text"], s["start"] + 1, s["length"]))))),
        "",
    )


def chat_digests(formatted: DataFrame) -> DataFrame:
    """What reading a formatted conversation back gives."""
    back = formatted.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("messages")).alias("loss"))
    listed = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(listed, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def with_probe(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """The table plus conversation -7, whose texts look like the template."""
    text = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, ASSISTANT, text)], "conv_id long, turn long, role string, text string")
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(probe)


_ESC = r"([<\[])(\\*(?:/?s>|(?:/?INST|OUT|SEP)\]))"
ORACLE_SQL = rf"""
WITH turns AS (
  SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
marked AS (
  SELECT *, regexp_replace(text, '{_ESC}', '\1\\\2', 'g') AS esc, regexp_replace(role, '{_ESC}', '\1\\\2', 'g') AS esc_role,
         CASE WHEN lag(role) OVER w IS NOT DISTINCT FROM role THEN 0 ELSE 1 END AS opens
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (sum(length(esc)) + 5 * sum(1 - opens) + sum(opens * (3 + length(esc_role) + CASE WHEN role = 'assistant' THEN 9 ELSE 13 END)))::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id
"""
