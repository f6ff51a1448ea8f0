"""Bounded training samples of labelled documents.

A classifier is fitted on at most ``max_rows`` labelled rows: those with the
smallest hash of doc_id, so the sample is the same in every run and does not
depend on file order. Everything else covers all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of doc_id as text, modulo ``modulus`` (null for a null id)."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, keep: Column, max_rows: int) -> DataFrame:
    """(doc_id, text, y) of at most ``max_rows`` labelled rows for which ``keep`` holds.

    Rows with a null id or label are left out; an id labelled twice counts once
    (its largest label); an id that several documents carry gives each of them.
    """
    ids = (labels.select(F.col("doc_id").cast("long"), F.col(label).cast("int").alias("y"))
           .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1)).where(keep)
           .groupBy("doc_id").agg(F.max("y").alias("y"))
           .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))
    # broadcast: at most max_rows rows of two numbers
    return (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
            .join(F.broadcast(ids), "doc_id")
            .select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "y"))
