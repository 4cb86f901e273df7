"""Bounded samples of labelled documents for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(folds: int) -> Column:
    """Remainder of the document id's checksum; null ids count as 0."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)), F.lit(0))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, limit: int) -> DataFrame:
    """``text`` and ``y`` of at most ``limit`` labelled documents outside the held-out fold.

    They are those of the smallest id hashes, so the sample is the same on every run;
    its ids are few enough to broadcast, and no text is shuffled. A document with
    several label rows counts with the smallest.
    """
    known = (labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).where(fold(folds) != held)
             .groupBy("doc_id").agg(F.min(label).cast("int").alias("y")))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return rows.select(F.coalesce("text", F.lit("")).alias("text"), "y")
