"""Bounded samples of labelled rows, for fitting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, whole_text


def usable_labels(labels: DataFrame, target: str, parts: int, held_out: int) -> DataFrame:
    """(doc_id, label) of all labels that may be fitted on, none of them from the held-out fold.

    Rows with a null doc_id or label are left out; of repeated ids one is kept.
    """
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col(target).isNotNull() & (fold("doc_id", parts) != held_out))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max(F.col(target).cast("int")).alias("label"))
    )


def labelled_sample(labels: DataFrame, target: str, parts: int, held_out: int, a_class: int) -> DataFrame:
    """(doc_id, label): at most ``a_class`` usable rows of each class, the first by hash of doc_id."""
    usable = usable_labels(labels, target, parts, held_out)
    order = F.xxhash64("doc_id")
    picked = [usable.where(F.col("label") == y).orderBy(order, "doc_id").limit(a_class) for y in (0, 1)]
    return picked[0].unionByName(picked[1])


def texts_of(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """(doc_id, label, text) of a bounded sample: it is broadcast, so texts aren't shuffled. Of repeated ids one text is kept."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).join(F.broadcast(sample), "doc_id")
    return rows.groupBy("doc_id", "label").agg(F.min("text").alias("text"))
