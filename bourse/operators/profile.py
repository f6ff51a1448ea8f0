"""Profiling of a table: describe, value counts, histograms, box stats, correlation.

Exact quantiles (linear interpolation, as pandas/numpy) are computed from
counts per distinct value, not with ``percentile`` (which buffers every value
of a group in one task) nor ``percentile_approx`` (approximate). Columns are
unpivoted to (column, value), so one aggregate serves all numeric columns and
a value that a third of the rows hold is one row with its count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

QUARTILES = (0.25, 0.5, 0.75)


def long_values(df: DataFrame, columns: list[str], keys: list[str] | None = None,
                cast: str = "double") -> DataFrame:
    """(keys..., column, value) for the listed columns, NULL values dropped."""
    keys = list(keys or [])
    long = df.select(*keys, *[F.col(c).cast(cast).alias(c) for c in columns]) \
        .unpivot(keys, columns, "column", "value")
    return long.where(F.col("value").isNotNull())


def exact_quantiles(long: DataFrame, probs: tuple[float, ...] = QUARTILES,
                    by: list[str] | None = None) -> DataFrame:
    """Exact interpolated quantiles of ``value`` per (by..., column).

    position p = (n - 1) * q; result = v[floor p] + (p - floor p) * (v[ceil p] - v[floor p]).

    1. Count the rows of each distinct value (partial aggregation first).
    2. Range-partition the distinct values; the sums per partition and group
       (one row each) give the ranks at which a partition starts.
    3. Only partitions that hold a wanted rank are summed up value by value.
    """
    groups = [*(by or []), "column"]
    n = int(long.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = long.groupBy(*groups, "value").agg(F.count(F.lit(1)).alias("_c"))
    # the partition tags are fixed in the shared checkpoint folder
    keyed = counts.repartitionByRange(n, *groups, "value").withColumn("_pid", F.spark_partition_id()).checkpoint()
    sums = keyed.groupBy("_pid", *groups).agg(F.sum("_c").alias("_s"))
    earlier = Window.partitionBy(*groups).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("_before", F.coalesce(F.sum("_s").over(earlier), F.lit(0))) \
        .withColumn("_n", F.sum("_s").over(Window.partitionBy(*groups)))
    wanted = starts.withColumn("q", F.explode(F.array(*[F.lit(q) for q in probs])))
    pos = (F.col("_n") - 1) * F.col("q")
    wanted = wanted.withColumn("_lo", F.floor(pos) + 1).withColumn("_hi", F.ceil(pos) + 1) \
        .withColumn("_f", pos - F.floor(pos))
    wanted = wanted.where(((F.col("_lo") > F.col("_before")) & (F.col("_lo") <= F.col("_before") + F.col("_s")))
                          | ((F.col("_hi") > F.col("_before")) & (F.col("_hi") <= F.col("_before") + F.col("_s"))))
    found = keyed.join(wanted, ["_pid", *groups])
    upto = Window.partitionBy("_pid", *groups, "q").orderBy("value")
    found = found.withColumn("_to", F.col("_before") + F.sum("_c").over(upto))

    def at(rank: str):
        return F.max(F.when((F.col(rank) <= F.col("_to")) & (F.col(rank) > F.col("_to") - F.col("_c")), F.col("value")))

    agg = found.groupBy(*groups, "q").agg(at("_lo").alias("_a"), at("_hi").alias("_b"), F.max("_f").alias("_f"))
    return agg.select(*groups, "q", (F.col("_a") + F.col("_f") * (F.col("_b") - F.col("_a"))).alias("quantile"))


def describe_numeric(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    """AGG-7: count, mean, sample std, min, 25/50/75 % (exact), max per column."""
    long = long_values(df, columns)
    stats = long.groupBy("column").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    qs = exact_quantiles(long).groupBy("column").pivot("q", list(QUARTILES)).agg(F.first("quantile"))
    qs = qs.withColumnsRenamed({str(q): f"q{int(q * 100)}" for q in QUARTILES})
    out = stats.join(qs, "column")
    return out.select("column", "count", *[F.round(c, digits).alias(c) for c in
                                           ("mean", "std", "min", "q25", "q50", "q75", "max")])


def describe_category(df: DataFrame, columns: list[str]) -> DataFrame:
    """AGG-8: count, distinct values, most frequent value (ties: smallest) and its count."""
    long = long_values(df, columns, cast="string")
    per_value = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    return per_value.groupBy("column").agg(
        F.sum("n").alias("count"), F.count(F.lit(1)).alias("unique"),
        F.min_by("value", F.struct((-F.col("n")).alias("a"), F.col("value").alias("b"))).alias("top"),
        F.max("n").alias("freq"))


def column_info(df: DataFrame) -> DataFrame:
    """AGG-9: non-null count and type of every column (one aggregate pass)."""
    counts = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns])
    long = counts.unpivot([], df.columns, "column", "non_null")
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    tmap = F.create_map(*[x for k, v in types.items() for x in (F.lit(k), F.lit(v))])
    return long.select("column", "non_null", tmap[F.col("column")].alias("dtype"))


def with_share(counts: DataFrame, count_col: str = "count", name: str = "share") -> DataFrame:
    """Add count / total via a scalar subquery (aggregate first, no unpartitioned window)."""
    spark = counts.sparkSession
    return spark.sql(f"SELECT *, `{count_col}` / (SELECT sum(`{count_col}`) FROM {{c}}) AS `{name}` FROM {{c}}",
                     c=counts)


def value_counts(df: DataFrame, column: str, digits: int = 6) -> DataFrame:
    """AGG-10: count per value and its share of all rows."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("count"))
    return with_share(counts).withColumn("share", F.round("share", digits))


def histogram_by_class(df: DataFrame, columns: list[str], label: str, bins: int = 10) -> DataFrame:
    """AGG-11 (numeric): counts per equal-width bin between the column's min and
    max (max goes to the last bin) and class."""
    long = long_values(df, columns, [label])
    rng = long.groupBy("column").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    j = long.join(F.broadcast(rng), "column")  # one row per column: fixed size
    width = F.col("_hi") - F.col("_lo")
    b = F.when(width == 0, F.lit(1)).otherwise(
        F.least(F.floor((F.col("value") - F.col("_lo")) / width * bins) + 1, F.lit(bins)))
    return j.groupBy("column", b.cast("int").alias("bin"), F.col(label).alias("label")) \
        .agg(F.count(F.lit(1)).alias("count"))


def category_counts_by_class(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """AGG-11 (category): counts per value and class."""
    long = long_values(df, columns, [label], cast="string")
    return long.groupBy("column", "value", F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("count"))


def box_stats(df: DataFrame, columns: list[str], label: str, digits: int = 6) -> DataFrame:
    """AGG-12: quartiles, 1.5 IQR whiskers and the outlier count per column and class."""
    long = long_values(df, columns, [label])
    q = exact_quantiles(long, (0.25, 0.5, 0.75), [label])
    qs = q.groupBy(label, "column").pivot("q", [0.25, 0.5, 0.75]).agg(F.first("quantile")) \
        .withColumnsRenamed({"0.25": "q1", "0.5": "median", "0.75": "q3"})
    qs = qs.withColumn("iqr", F.col("q3") - F.col("q1")) \
        .withColumn("lower", F.col("q1") - 1.5 * F.col("iqr")) \
        .withColumn("upper", F.col("q3") + 1.5 * F.col("iqr"))
    j = long.join(qs, [label, "column"])  # a row per class and column: broadcast under Spark's own limit
    out = j.groupBy(label, "column").agg(
        F.first("q1").alias("q1"), F.first("median").alias("median"), F.first("q3").alias("q3"),
        F.first("lower").alias("lower"), F.first("upper").alias("upper"),
        F.sum(((F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper"))).cast("int")).alias("outliers"))
    return out.select(F.col(label).alias("label"), "column",
                      *[F.round(c, digits).alias(c) for c in ("q1", "median", "q3", "lower", "upper")], "outliers")


def abs_correlation(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    """AGG-13: |Pearson r| for every ordered pair, from pairwise complete rows.

    Tasks multiply blocks of rows as matrices (values, squares and presence, around
    the column means, so sums do not cancel) and send one row of sums a column; these are
    merged by column. A missing value (null or NaN) leaves out its own pairs
    only. Without variation, or without a common row, r is NULL.
    """
    d = len(columns)
    means = df.agg(*[F.avg(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))).alias(f"m{i}")
                     for i, c in enumerate(columns)]).first()
    centre = np.array([m or 0.0 for m in means])
    names = list(columns)

    def products(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((6, d, d))
        for batch in it:
            x = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(d)]) - centre
            v = (~np.isnan(x)).astype(float)
            x = np.where(v > 0, x, 0.0)
            xv, qv = x.T @ v, (x * x).T @ v
            total += np.stack([v.T @ v, xv, xv.T, qv, qv.T, x.T @ x])
        for i in range(d):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([total[:, i].tobytes()], pa.binary())],
                                             names=["i", "sums"])

    def merged(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in it:
            for i, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got = np.frombuffer(s).reshape(6, d)
                sums[i] = sums[i] + got if i in sums else got
        for i, (n, sx, sy, qx, qy, xy) in sums.items():
            with np.errstate(divide="ignore", invalid="ignore"):
                r = np.abs((xy - sx * sy / n) / np.sqrt((qx - sx * sx / n) * (qy - sy * sy / n)))
            yield pa.RecordBatch.from_arrays([pa.array([names[i]] * d), pa.array(names), pa.array(r, mask=~np.isfinite(r))],
                                             names=["a", "b", "abs_r"])

    cols = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    out = cols.mapInArrow(products, "i int, sums binary").repartition("i").mapInArrow(merged, "a string, b string, abs_r double")
    return out.select("a", "b", F.round("abs_r", digits).alias("abs_r"))
