"""Price forecast: lag features, models, recursive multi-day forecast, R².

All symbols are handled in one job. Per-symbol windows are bounded by the
trading calendar (one bar per symbol and day), so a window partition never
grows with the number of symbols or with history beyond that bound.

The forecast recursion is sequential in days and parallel in symbols: the
state is one row per symbol, each step is a projection (lags move by one
day, the prediction becomes lag 0) followed by ``model.transform``. The
state is checkpointed to the shared checkpoint folder every few steps so
the plan does not grow and a lost executor recomputes one step only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bourse.functions.dates import next_business_day
from bourse.operators import boosting as B

# Target order and window length of the price model.
TARGETS = ["Open", "Close", "High", "Low", "Volume"]
WINDOW_DAYS = 20
HORIZON = 10
MISSING_LAG = -1.0


def lag_name(t: str, k: int) -> str:
    return f"{t}_{k}"


def lag_columns(day: int = WINDOW_DAYS) -> list[str]:
    """Day-major order: Open_0, Close_0, High_0, Low_0, Volume_0, Open_1, ..."""
    return [lag_name(t, k) for k in range(day) for t in TARGETS]


def feature_columns(day: int = WINDOW_DAYS) -> list[str]:
    return ["Year", "Month", "Day", *lag_columns(day)]


def _date_parts(d: Column) -> list[Column]:
    return [F.year(d).alias("Year"), F.month(d).alias("Month"), F.dayofmonth(d).alias("Day")]


def lag_features(ohlcv: DataFrame, day: int = WINDOW_DAYS) -> DataFrame:
    """WIN-1 + FLT-6 + FLT-5: training rows.

    ``T_k`` of row r is T of row r-(k+1). All 100 lags share one window spec:
    one exchange by symbol, one sort, one Window node. The first ``day``
    rows of each symbol are dropped, then rows with a missing target.
    """
    w = Window.partitionBy("symbol").orderBy("trade_date")
    lags = [F.lag(t, k + 1).over(w).alias(lag_name(t, k)) for k in range(day) for t in TARGETS]
    df = ohlcv.select("symbol", "trade_date", *_date_parts(F.col("trade_date")), *lags, *TARGETS,
                      F.row_number().over(w).alias("_rn"))
    return complete_targets(skip_warmup(df, day)).drop("_rn")


def skip_warmup(df: DataFrame, day: int = WINDOW_DAYS) -> DataFrame:
    """FLT-6: drop the first ``day`` rows of each series (needs ``_rn``)."""
    return df.where(F.col("_rn") > day)


def complete_targets(df: DataFrame) -> DataFrame:
    """FLT-5: drop rows with any missing target."""
    return df.na.drop(subset=TARGETS)


def last_lag_row(ohlcv: DataFrame, day: int = WINDOW_DAYS) -> DataFrame:
    """WIN-2: scoring form - lags 0..day-1 of the newest row of each symbol.

    ``row_number(desc) <= day`` is planned as WindowGroupLimit, so only the
    newest ``day`` bars per symbol pass the shuffle.
    """
    wd = Window.partitionBy("symbol").orderBy(F.col("trade_date").desc())
    recent = ohlcv.withColumn("_rd", F.row_number().over(wd)).where(F.col("_rd") <= day)
    w = Window.partitionBy("symbol").orderBy("trade_date")
    lags = [(F.col(t) if k == 0 else F.lag(t, k).over(w)).alias(lag_name(t, k))
            for k in range(day) for t in TARGETS]
    out = recent.select("symbol", "trade_date", "_rd", *_date_parts(F.col("trade_date")), *lags)
    return out.where(F.col("_rd") == 1).drop("_rd")


# ---------------------------------------------------------------- models
class LagMeanModel:
    """MOD-2: prediction of T = mean of its non-missing lags T_0..T_{day-1}.

    A transparent stand-in with the interface of a fitted model
    (``transform`` adds ``Pred_<T>``); its forecast is checkable in SQL.
    """

    def __init__(self, day: int = WINDOW_DAYS):
        self.day = day

    def predict_column(self, t: str) -> Column:
        # One SQL expression (parsed once on the JVM) instead of ~100 Column calls.
        num = " + ".join(f"coalesce(`{lag_name(t, k)}`, 0.0D)" for k in range(self.day))
        cnt = " + ".join(f"CAST(`{lag_name(t, k)}` IS NOT NULL AS INT)" for k in range(self.day))
        return F.expr(f"try_divide({num}, CAST(nullif({cnt}, 0) AS DOUBLE))")

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({f"Pred_{t}": self.predict_column(t) for t in TARGETS})


class BoostedModel:
    """MOD-1 / MOD-3: one boosted ensemble per target over the same binned features."""

    def __init__(self, features: list[str], edges: list, grown: dict[str, B.Ensemble]):
        self.features, self.edges, self.grown = features, edges, grown

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``Pred_<T>``; missing lags become the sentinel, as in training."""
        present = [c for c in lag_columns(WINDOW_DAYS) if c in df.columns]
        return B.add_scores(df.fillna(MISSING_LAG, subset=present), self.features, self.edges,
                            {f"Pred_{t}": e for t, e in self.grown.items()})

    def save(self, spark, path: str) -> None:
        """SNK-2: edges and trees as one table."""
        B.save_ensembles(spark, path, [self.grown[t] for t in TARGETS], self.edges)

    @classmethod
    def load(cls, spark, path: str, day: int = WINDOW_DAYS) -> "BoostedModel":
        grown, edges = B.load_ensembles(spark, path)
        return cls(feature_columns(day), edges, dict(zip(TARGETS, grown, strict=True)))


def train_price_model(features: DataFrame, trees: int = 250, depth: int = 5, rate: float = 0.1,
                      row_share: float = 0.7, column_share: float = 0.8, seed: int = 11,
                      day: int = WINDOW_DAYS) -> BoostedModel:
    """MOD-1: boosted trees per target over all symbols pooled.

    Features are binned once and the five targets grow side by side, so a fit
    is trees x depth jobs over one byte a feature. A missing lag is the
    sentinel -1: below any price or volume, so it has a bin of its own where it
    occurs often, as a missing-value branch would.
    """
    names = feature_columns(day)
    # read three times while it is binned
    given = features.select(*names, *TARGETS).fillna(MISSING_LAG, subset=lag_columns(day)).checkpoint(eager=True)
    rows = B.bin_rows(given, names, TARGETS)
    specs = [B.Spec("squared", target=i, trees=trees, depth=depth, rate=rate, rows=row_share, columns=column_share, seed=seed)
             for i in range(len(TARGETS))]
    return BoostedModel(names, rows.edges, dict(zip(TARGETS, B.fit_ensembles(rows, specs), strict=True)))


# ---------------------------------------------------------------- forecast
def score_prices(model, features: DataFrame) -> DataFrame:
    """MOD-3 / JOI-4: predictions next to the true values of every feature row."""
    return model.transform(features)


def recursive_forecast(model, insample: DataFrame, days: int = HORIZON, day: int = WINDOW_DAYS,
                       checkpoint_every: int = 1) -> DataFrame:
    """WIN-6: ``days`` business days ahead for every symbol.

    Starts from the newest in-sample row of each symbol with its *predicted*
    values (Q5); each step: date = next business day, lag 0 = last
    prediction, lag k = old lag k-1, predict. Emits (symbol, step, trade_date, Pred_*).

    The state (one row per symbol) is checkpointed after every step: without
    that barrier Catalyst inlines each step's projection into the next and the
    prediction expression grows ~20x per step.
    """
    lagc = lag_columns(day)
    preds = [f"Pred_{t}" for t in TARGETS]
    last = insample.groupBy("symbol").agg(
        F.max_by(F.struct("trade_date", *lagc, *preds), "trade_date").alias("s")).select("symbol", "s.*")
    state = last.checkpoint(eager=True) if checkpoint_every else last
    spark = insample.sparkSession
    # lag 0 = the last prediction, lag k = old lag k-1 (day-major order); one SQL
    # statement per step keeps the driver-side plan building to a few calls.
    moved = ", ".join([f"`Pred_{t}` AS `{lag_name(t, 0)}`" for t in TARGETS]
                      + [f"`{lag_name(t, k - 1)}` AS `{lag_name(t, k)}`" for k in range(1, day) for t in TARGETS])
    step_sql = ("SELECT symbol, nd AS trade_date, year(nd) AS Year, month(nd) AS Month, dayofmonth(nd) AS Day, "
                f"{moved} FROM (SELECT *, date_add(trade_date, CASE weekday(date_add(trade_date, 1)) "
                "WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END) AS nd FROM {state})")
    out = []
    for step in range(1, days + 1):
        nxt = spark.sql(step_sql, state=state)
        state = model.transform(nxt)
        if checkpoint_every and step % checkpoint_every == 0:
            state = state.checkpoint(eager=True)
        out.append(state.select("symbol", F.lit(step).alias("step"), "trade_date", *preds))
    res = out[0]
    for o in out[1:]:
        res = res.unionByName(o)
    return res


def append_forecast(insample: DataFrame, future: DataFrame) -> DataFrame:
    """SET-2 + PRJ-4: in-sample rows then forecast rows; True_* is NULL on forecast rows (Q4)."""
    inside = insample.select("symbol", F.col("trade_date").alias("Date"),
                             *[F.col(t).cast("double").alias(f"True_{t}") for t in TARGETS],
                             *[F.col(f"Pred_{t}") for t in TARGETS], F.lit(False).alias("is_forecast"))
    ahead = future.select("symbol", F.col("trade_date").alias("Date"),
                          *[F.lit(None).cast("double").alias(f"True_{t}") for t in TARGETS],
                          *[F.col(f"Pred_{t}") for t in TARGETS], F.lit(True).alias("is_forecast"))
    return inside.unionByName(ahead)


def chart_series(forecast: DataFrame) -> DataFrame:
    """SNK-6: long series (metric, kind, Date, value) of the prices (no volume);
    True values without forecast rows."""
    cols = [f"{k}_{t}" for t in TARGETS if t != "Volume" for k in ("True", "Pred")]
    long = forecast.unpivot(["symbol", "Date", "is_forecast"], cols, "series", "value")
    parts = F.split(F.col("series"), "_")
    out = long.select("symbol", "Date", "is_forecast", parts[1].alias("metric"), parts[0].alias("kind"), "value")
    return out.where(~((F.col("kind") == "True") & F.col("is_forecast"))).drop("is_forecast")


# ---------------------------------------------------------------- metrics
def r2_columns(y: str, yhat: str) -> list[Column]:
    """SS_res and SS_tot of one target. ``var_pop * n`` is SS_tot computed with
    Spark's numerically stable (mergeable) central-moment aggregate."""
    return [F.sum((F.col(y) - F.col(yhat)) * (F.col(y) - F.col(yhat))).alias(f"_res_{y}"),
            (F.var_pop(y) * F.count(y)).alias(f"_tot_{y}")]


def r2_value(res: Column, tot: Column) -> Column:
    return F.when(tot == 0, F.when(res == 0, F.lit(1.0)).otherwise(F.lit(0.0))).otherwise(1 - res / tot)


def multi_target_r2(scored: DataFrame, by: list[str] | None = None, targets: list[str] = TARGETS,
                    digits: int = 6) -> DataFrame:
    """AGG-3: 1 - SS_res/SS_tot per target, uniform mean over targets.

    A constant target scores 1 if predicted exactly, else 0. One aggregate
    (partial aggregation before the shuffle) per group; ``by=None`` pools.
    """
    by = list(by or [])
    cols = [c for t in targets for c in r2_columns(t, f"Pred_{t}")]
    agg = scored.groupBy(*by).agg(*cols) if by else scored.agg(*cols)
    per = {f"r2_{t}": r2_value(F.col(f"_res_{t}"), F.col(f"_tot_{t}")) for t in targets}
    mean = sum(per.values(), F.lit(0.0)) / len(targets)
    return agg.select(*by, F.round(mean, digits).alias("r2"),
                      *[F.round(v, digits).alias(k) for k, v in per.items()])
