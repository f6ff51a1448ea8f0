"""The corpus pipeline: documents to packed training sequences.

Each stage works on all that the one before kept; all but the last return the
columns of documents. ``run`` writes each stage's result to the shared folder
and reads it again for the next one. Stages fill in the session settings that are
not set (``session.configure``), so that they can be run one by one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bourse.llm import decontam, lines, minhash, packing, quality
from bourse.llm.sampling import remainder
from bourse.session import configure

MIN_QUALITY = 0.3


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    configure(spark)
    model = quality.fit_quality(docs, _table(spark, sf_dir, "labels"), remainder("doc_id", 5) != 0)
    scored = quality.score_quality(docs, model, "__quality")
    return scored.where(F.col("__quality") >= MIN_QUALITY).drop("__quality")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier line has; one that loses its last word goes."""
    configure(spark)
    out = lines.dedup_lines(docs, count="__gone")
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    out = out.where(worded | (F.col("__gone") == 0)).drop("__gone")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    configure(spark)
    return minhash.keep_first(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item contaminates."""
    configure(spark)
    return decontam.decontaminate(docs, _table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequences and offsets."""
    configure(spark)
    return packing.pack_documents(docs).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("decontamination", benchmark_stage),
    ("packing", packing_stage),
]

# A trained network and a genetic algorithm cannot be told in SQL. The tests hold
# the operators of the stages against brute force or held-out labels, and the
# pipeline's rows against their stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = lines.saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
