"""From raw documents to token ids: five stages, each a Spark job over all that its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from strandweave.llm import jaccard, mixing, pieces, pii, quality
from strandweave.llm.common import documents, drop_stored, stored, stored_so_far

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on these documents and their labels, doesn't reject. Null texts count as empty; an empty table stays empty."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, of repeated rows one; texts without words are one class."""
    return jaccard.one_of_each(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; null texts and those without any stay as they are."""
    return pii.mask_pii(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight asks for, in a global random order. A null source is a source of its own."""
    return mixing.mix(docs).select(*docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document instead of its text; null and empty texts have none."""
    return pieces.encode_documents(docs, PIECE_MODEL)


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("PII", mask_personal_data),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode_pieces),
]

#: SQL can't express the classifier's vectors, the shingle classes or the merges; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; what each returns is written to the shared folder and read again, what it needed on the way is removed.

    Nulls in any column, empty and very long texts, repeated rows and further columns
    pass as each stage says; the last stage's columns are those of documents without the
    text, with ids, n_tokens and decoded_sha256. An empty table gives no rows.
    """
    docs, before = documents(spark, sf_dir), stored_so_far()
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, f"stage-{k}")
            drop_stored(spark, before)
    return docs
