"""Exact ranks, splits and samples without an unpartitioned window.

``row_number() OVER (ORDER BY k)`` without PARTITION BY moves every row into
one task. The helpers here give the same numbers distributed:

1. range-partition and sort by (group, key)  -> many tasks, each a key range;
2. tag each row with its partition id and ``monotonically_increasing_id``
   (consecutive inside a partition) and checkpoint, so the tags are fixed;
3. count rows per (partition, group): a table of at most
   partitions + groups rows; prefix sums over it give each partition's offset;
4. rank = offset + position inside the partition.

A hot group is spread over many range partitions, so no task holds it whole.
Random choices use ``md5(concat(key, seed))`` (the same in any SQL engine).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def md5_key(key: Column | str, seed: int | str) -> Column:
    """Deterministic pseudo-random order key."""
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(k.cast("string"), F.lit(str(seed))))


def ordered_rank(df: DataFrame, order: list[Column | str], by: list[str] | None = None,
                 name: str = "rank", partitions: int | None = None,
                 size_name: str | None = None) -> DataFrame:
    """Add ``name`` = 1-based position of each row by ``order`` within ``by``.

    ``order`` must be a total order (unique tie-breaker) for exact results.
    Without ``by`` the offset table has one row per partition and is broadcast;
    with ``by`` Spark decides by its size.
    ``size_name`` also attaches the group's row count (no extra pass).
    """
    by = list(by or [])
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ocols = [F.col(c) if isinstance(c, str) else c for c in order]
    keyed = (df.repartitionByRange(n, *[F.col(b) for b in by], *ocols)
             .sortWithinPartitions(*[F.col(b) for b in by], *ocols)
             .withColumn("_pid", F.spark_partition_id())
             .withColumn("_mid", F.monotonically_increasing_id()))
    # Fix the tags (and cut lineage) in the shared checkpoint folder.
    keyed = keyed.checkpoint(eager=True)
    counts = keyed.groupBy("_pid", *by).agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
    w = Window.partitionBy(*by).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0))) \
        .withColumn("_gsize", F.sum("_n").over(Window.partitionBy(*by))).drop("_n")
    if not by:
        offsets = F.broadcast(offsets)
    out = keyed.join(offsets, ["_pid", *by])
    out = out.withColumn(name, F.col("_before") + F.col("_mid") - F.col("_first") + 1)
    if size_name:
        out = out.withColumnRenamed("_gsize", size_name)
    return out.drop("_pid", "_mid", "_first", "_before", "_gsize")


def exact_split(df: DataFrame, key: str, seed: int, fraction: float, by: list[str] | None = None,
                name: str = "split") -> DataFrame:
    """PRE-1 / PRE-2: the first ``int(n * fraction)`` rows (per ``by`` group) in
    md5 order are 'train', the rest 'test'."""
    ranked = ordered_rank(df, [md5_key(key, seed), F.col(key)], by, "_r", size_name="_size")
    cut = F.floor(F.col("_size") * F.lit(fraction))
    return ranked.withColumn(name, F.when(F.col("_r") <= cut, "train").otherwise("test")).drop("_r", "_size")


def head_split(df: DataFrame, order: list[Column | str], fraction: float, name: str = "split") -> DataFrame:
    """PRE-3: first ``int(n * fraction)`` rows by position (an explicit order) are 'train'."""
    ranked = ordered_rank(df, order, None, "_r", size_name="_size")
    cut = F.floor(F.col("_size") * F.lit(fraction))
    return ranked.withColumn(name, F.when(F.col("_r") <= cut, "train").otherwise("test")).drop("_r", "_size")


def deterministic_sample(df: DataFrame, key: str, seed: int, n: int) -> DataFrame:
    """PRE-4: ``n`` rows in md5 order. ``orderBy().limit()`` plans as
    TakeOrderedAndProject: each task keeps its best ``n``, the driver merges."""
    return df.orderBy(md5_key(key, seed), F.col(key)).limit(n)
