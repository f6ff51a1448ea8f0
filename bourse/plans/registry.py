"""Query registry: name -> (Spark builder, oracle SQL or None).

Every builder takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the
driver tables (or fixtures Spark derives from them). The oracle SQL is an
independent DuckDB statement over the same parquet views; its column names
equal the Spark column names. ``None`` marks operators without an SQL
counterpart (fitted models, iterative jobs): the driver checks rows only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]

REGISTRY: dict[str, tuple[Builder, str | None]] = {}


def register(name: str, sql: str | None = None) -> Callable[[Builder], Builder]:
    def deco(fn: Builder) -> Builder:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = (fn, sql)
        return fn

    return deco


def load_all() -> dict[str, tuple[Builder, str | None]]:
    # Importing the plan modules fills REGISTRY.
    from bourse.plans import (  # noqa: F401
        market_plans, news_plans, forecast_plans, profile_plans, text_plans, model_plans,
        stream_plans, neighbour_plans,
    )

    return REGISTRY
