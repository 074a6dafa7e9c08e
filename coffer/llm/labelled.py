"""Bounded samples of labelled documents for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coffer.llm.common import fold


def sample_labels(labels: DataFrame, column: str, per_class: int, modulus: int, held_out: int) -> DataFrame:
    """(doc_id, label) of at most ``per_class`` rows of each class, in hash order of their ids.

    Only rows outside the held-out fold count; null ids and null labels do not;
    an id labelled more than once takes its largest label.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (fold(F.col("doc_id"), modulus) != held_out))
    rows = rows.groupBy("doc_id").agg(F.max("label").alias("label"))
    parts = [rows.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    return parts[0].unionByName(parts[1])


def with_labels(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """(doc_id, text, label), one document of each sampled id; the sample is bounded, so it is broadcast.

    Where rows of ``docs`` share an id, the one with the least hash of its text stands for it.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = rows.join(F.broadcast(sample), "doc_id")
    return found.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("doc_id", "text", "label")
