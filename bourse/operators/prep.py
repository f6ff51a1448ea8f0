"""Data preparation for the tabular study: imputers, scaling, encoders, resampling.

Pattern: ``fit_*`` runs aggregates on the training rows and brings back the
fitted parameters (medians, modes, means, category lists: one value per
column or category, a fixed small size); ``apply`` turns them into literal
column expressions, so applying a fit is a narrow projection (no join, no
shuffle) on any number of rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bourse.operators.ordering import md5_key, ordered_rank
from bourse.operators.profile import exact_quantiles, long_values


MAX_CATEGORIES = 1000  # of a column that becomes literal expressions


def safe_name(v: str) -> str:
    return re.sub(r"[^0-9A-Za-z]+", "_", v)


def fit_medians(train: DataFrame, columns: list[str]) -> dict[str, float]:
    """PRE-5: exact median (interpolated) of each column over the training rows."""
    q = exact_quantiles(long_values(train, columns), (0.5,)).collect()
    return {r["column"]: r["quantile"] for r in q}


def modes(train: DataFrame, columns: list[str]) -> DataFrame:
    """PRE-6: most frequent value per column (ties: smallest)."""
    long = long_values(train, columns, cast="string")
    per = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("column").agg(
        F.min_by("value", F.struct((-F.col("n")).alias("a"), F.col("value").alias("b"))).alias("mode"))


def fit_modes(train: DataFrame, columns: list[str]) -> dict[str, str]:
    return {r["column"]: r["mode"] for r in modes(train, columns).collect()}


def impute(df: DataFrame, values: dict) -> DataFrame:
    """PRE-5/6/7 apply: NULL -> fitted or constant value."""
    return df.fillna(values)


def fit_scaler(train: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """PRE-8: mean and *population* std per column (std 0 -> scale 1)."""
    row = train.agg(*[x for c in columns for x in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))]).first()
    return {c: (row[f"m_{c}"], row[f"s_{c}"] if row[f"s_{c}"] else 1.0) for c in columns}


def scale(df: DataFrame, params: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in params.items()})


def fit_categories(train: DataFrame, column: str, most: int = MAX_CATEGORIES) -> list[str]:
    """Sorted distinct training values; more than ``most`` of them are an error."""
    return fit_category_columns(train, [column], most)[1][column]


def fit_category_columns(train: DataFrame, columns: list[str], most: int = MAX_CATEGORIES
                         ) -> tuple[dict[str, str], dict[str, list[str]]]:
    """Mode and sorted values of every category column, from one table of counts."""
    long = long_values(train, columns, cast="string")
    per = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    rows = per.limit(len(columns) * most + 1).collect()
    values: dict[str, list] = {c: [] for c in columns}
    for r in rows:
        values[r["column"]].append((-r["n"], r["value"]))
    over = [c for c, v in values.items() if len(v) > most]
    if over or len(rows) > len(columns) * most:
        raise ValueError(f"more than {most} categories in {over or columns}; encode such columns another way")
    modes = {c: min(v)[1] for c, v in values.items() if v}
    return modes, {c: sorted(x for _, x in v) for c, v in values.items()}


def one_hot(df: DataFrame, column: str, categories: list[str], drop_first: bool = True) -> DataFrame:
    """PRE-9: one 0/1 column per category after the first; unknown -> all zeros."""
    keep = categories[1:] if drop_first else categories
    return df.withColumns({f"{column}_{safe_name(c)}": F.when(F.col(column) == c, 1.0).otherwise(0.0) for c in keep}) \
        .drop(column)


def ordinal(c: Column, categories: list[str]) -> Column:
    """PRE-10: index in the given order as double; unknown -> NULL
    (the scikit encoder raises; NULL keeps the job alive and is checkable)."""
    pos = F.array_position(F.array(*[F.lit(x) for x in categories]), c)
    return F.when(pos > 0, pos - 1).cast("double")


@dataclass
class TabularSpec:
    """Column roles of the prepared table."""
    numeric: list[str]
    one_hot: list[str]
    auto_ordinal: list[str]
    given_ordinal: dict[str, tuple[list[str], str]] = field(default_factory=dict)  # col -> (order, fill)


@dataclass
class TabularFit:
    medians: dict
    scaler: dict
    modes: dict
    categories: dict


def fit_transformer(train: DataFrame, spec: TabularSpec) -> TabularFit:
    """PRE-11 fit: every parameter from the training rows only."""
    medians = fit_medians(train, spec.numeric)
    imputed = impute(train, medians)
    scaler = fit_scaler(imputed, spec.numeric)
    # filling in the mode adds no category
    modes, cats = fit_category_columns(train, spec.one_hot + spec.auto_ordinal)
    return TabularFit(medians, scaler, modes, cats)


def apply_transformer(df: DataFrame, spec: TabularSpec, fit: TabularFit) -> DataFrame:
    """PRE-11 apply: impute, scale, encode - one projection."""
    out = impute(df, fit.medians)
    out = scale(out, fit.scaler)
    out = impute(out, fit.modes)
    out = impute(out, {c: fill for c, (_order, fill) in spec.given_ordinal.items()})
    for c in spec.auto_ordinal:
        out = out.withColumn(c, ordinal(F.col(c), fit.categories[c]))
    for c, (order, _fill) in spec.given_ordinal.items():
        out = out.withColumn(c, ordinal(F.col(c), order))
    for c in spec.one_hot:
        out = one_hot(out, c, fit.categories[c])
    return out


def feature_names(spec: TabularSpec, fit: TabularFit) -> list[str]:
    oh = [f"{c}_{safe_name(v)}" for c in spec.one_hot for v in fit.categories[c][1:]]
    return [*spec.numeric, *oh, *spec.auto_ordinal, *spec.given_ordinal]


# ---------------------------------------------------------------- resampling
def stratified_folds(df: DataFrame, key: str, label: str, seed: int, k: int = 5) -> DataFrame:
    """WIN-5: fold = (rank within class in md5 order - 1) mod k."""
    r = ordered_rank(df, [md5_key(key, seed), F.col(key)], [label], "_r")
    return r.withColumn("fold", ((F.col("_r") - 1) % k).cast("int")).drop("_r")


def random_undersample(df: DataFrame, key: str, label: str, seed: int) -> DataFrame:
    """PRE-12: keep, per class, the first (smallest class size) rows in md5 order."""
    r = ordered_rank(df, [md5_key(key, seed), F.col(key)], [label], "_r", size_name="_n")
    smallest = r.groupBy(label).agg(F.max("_n").alias("_n")).agg(F.min("_n")).first()[0]
    return r.where(F.col("_r") <= F.lit(smallest)).drop("_r", "_n")
