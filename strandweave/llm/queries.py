"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import chat, imatch, importance, jaccard, media, minhash, mixing, pieces, pii, quality, sstable, toxicity, trie
from .common import documents

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
WORD_MODEL = public_tokenizers.path("word_bpe_49k.json")
END_ID = 2


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(documents(spark, sf_dir), labels(spark, sf_dir))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.edit_digests(documents(spark, sf_dir))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat.with_probe(spark, spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return chat.chat_digests(chat.format_chats(turns))


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(documents(spark, sf_dir))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(documents(spark, sf_dir))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.piece_digests(documents(spark, sf_dir), PIECE_MODEL)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digests(documents(spark, sf_dir))


def op8_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.read_shards(sstable.write_shards(documents(spark, sf_dir), WORD_MODEL, END_ID))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(documents(spark, sf_dir), labels(spark, sf_dir))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.importance_digests(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_copies(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_fingerprints": op2_fingerprints,
    "op3_chat_format": op3_chat_format,
    "op4_media_columns": op4_media_columns,
    "op5_ngram_jaccard": op5_ngram_jaccard,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_pii": op7_pii,
    "op8_sstable": op8_sstable,
    "op9_mixing": op9_mixing,
    "op10_quality": op10_quality,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_importance": op12_importance,
    "op13_minhash": op13_minhash,
}

ORACLES: dict[str, str] = {
    "op3_chat_format": chat.ORACLE_SQL,
    "op9_mixing": mixing.ORACLE_SQL,
    "op11_prefix_trie": trie.ORACLE_SQL,
    "op12_importance": importance.ORACLE_SQL,
    "op13_minhash": minhash.ORACLE_SQL,
}
