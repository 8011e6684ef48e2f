"""Queries on sequences read each document to its end, in Spark and in SQL; test_queries.py compares the two."""

from pyspark.sql import functions as F

from strandweave.plans import proxies

DATA = "/root/testdata/sf0.001"


def test_sequences_are_whole(spark):
    got = proxies.seqs(spark, DATA).agg(F.sum(F.length("seq")).alias("n")).first().n
    assert got == spark.read.parquet(f"{DATA}/documents.parquet").agg(F.sum(F.length("text")).alias("n")).first().n


def test_sql_has_no_cut():
    assert "1000" not in proxies.SEQ_SQL
