"""Registered forecast queries (WIN-1/2/6, FLT-5/6, MOD-2/3/4, AGG-3, SET-2, SNK-6, JOI-1/4, PRE-1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bourse.operators import forecast as FC
from bourse.operators.ordering import exact_split
from bourse.plans.registry import register
from bourse.sources import fixtures as X
from bourse.sources.fixtures import oracle_with as W

T = FC.TARGETS
DAY = FC.WINDOW_DAYS
SPLIT_SEED = 11
LAGC = FC.lag_columns(DAY)
PREDS = [f"Pred_{t}" for t in T]


# ---------------------------------------------------------------- SQL text
def _lag_sql() -> str:
    w = "OVER (PARTITION BY symbol ORDER BY trade_date)"
    return ", ".join(f"lag({t}, {k + 1}) {w} AS {t}_{k}" for k in range(DAY) for t in T)


_FEAT_SQL = (
    "feat AS (SELECT symbol, trade_date, Year, Month, Day, " + ", ".join(LAGC) + ", " + ", ".join(T)
    + " FROM (SELECT symbol, trade_date, CAST(year(trade_date) AS INTEGER) AS Year, "
    "CAST(month(trade_date) AS INTEGER) AS Month, CAST(day(trade_date) AS INTEGER) AS Day, "
    + _lag_sql() + ", " + ", ".join(T)
    + ", row_number() OVER (PARTITION BY symbol ORDER BY trade_date) AS _rn FROM training_bars) "
    f"WHERE _rn > {DAY} AND " + " AND ".join(f"{t} IS NOT NULL" for t in T) + ")")


def _pred_sql(t: str) -> str:
    num = " + ".join(f"coalesce({t}_{k}, 0.0)" for k in range(DAY))
    cnt = " + ".join(f"CAST({t}_{k} IS NOT NULL AS INTEGER)" for k in range(DAY))
    return f"(({num}) / CAST(nullif({cnt}, 0) AS DOUBLE))"


_PREDS_SQL = ", ".join(f"{_pred_sql(t)} AS Pred_{t}" for t in T)
_INS_SQL = f"ins AS (SELECT *, {_PREDS_SQL} FROM feat)"
_ROUND_PREDS = ", ".join(f"round(Pred_{t}, 6) AS Pred_{t}" for t in T)


def _next_bd_sql(d: str) -> str:
    return (f"CAST({d} + INTERVAL (CASE isodow({d} + 1) WHEN 6 THEN 3 WHEN 7 THEN 2 ELSE 1 END) DAY AS DATE)")


_MOVED = ", ".join([f"Pred_{t} AS {t}_0" for t in T] + [f"{t}_{k - 1} AS {t}_{k}" for k in range(1, DAY) for t in T])
_STEPS_SQL = (
    "last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) AS _rd "
    "FROM ins) WHERE _rd = 1), "
    "steps AS (SELECT symbol, 0 AS step, trade_date, " + ", ".join(LAGC) + ", " + ", ".join(PREDS) + " FROM last "
    "UNION ALL SELECT symbol, step, trade_date, " + ", ".join(LAGC) + ", " + _PREDS_SQL
    + " FROM (SELECT symbol, step + 1 AS step, " + _next_bd_sql("trade_date") + " AS trade_date, " + _MOVED
    + f" FROM steps WHERE step < {FC.HORIZON}) s)")
_FORECAST_SQL = (
    "fc AS (SELECT symbol, trade_date AS Date, " + ", ".join(f"CAST({t} AS DOUBLE) AS True_{t}" for t in T) + ", "
    + ", ".join(PREDS) + ", false AS is_forecast FROM ins UNION ALL SELECT symbol, trade_date, "
    + ", ".join(f"CAST(NULL AS DOUBLE) AS True_{t}" for t in T) + ", " + ", ".join(PREDS)
    + ", true FROM steps WHERE step > 0)")


def _r2_sql(source: str, by: str) -> str:
    inner = ", ".join(f"sum(({t} - Pred_{t}) * ({t} - Pred_{t})) AS res_{t}, var_pop({t}) * count({t}) AS tot_{t}"
                      for t in T)
    per = ", ".join(f"CASE WHEN tot_{t} = 0 THEN (CASE WHEN res_{t} = 0 THEN 1.0 ELSE 0.0 END) "
                    f"ELSE 1 - res_{t} / tot_{t} END AS r2_{t}" for t in T)
    mean = "(0.0 + " + " + ".join(f"r2_{t}" for t in T) + f") / {len(T)}"
    sel_by = f"{by}, " if by else ""
    grp = f" GROUP BY {by}" if by else ""
    return (f"SELECT {sel_by}round({mean}, 6) AS r2, " + ", ".join(f"round(r2_{t}, 6) AS r2_{t}" for t in T)
            + f" FROM (SELECT {sel_by}{per} FROM (SELECT {sel_by}{inner} FROM {source}{grp}))")


# ---------------------------------------------------------------- Spark pieces
def _features(spark: SparkSession, sf: str) -> DataFrame:
    return FC.lag_features(X.training_bars(spark, sf), DAY)


def _insample(spark: SparkSession, sf: str) -> DataFrame:
    return FC.score_prices(FC.LagMeanModel(DAY), _features(spark, sf))


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({p: F.round(p, 6) for p in PREDS if p in df.columns})


def _forecast(spark: SparkSession, sf: str) -> DataFrame:
    ins = _insample(spark, sf)
    fut = FC.recursive_forecast(FC.LagMeanModel(DAY), ins, FC.HORIZON, DAY)
    return FC.append_forecast(ins, fut)


@register("lag_features", W(f"WITH {_FEAT_SQL} SELECT * FROM feat", "training_bars"))
def q_lag_features(spark: SparkSession, sf: str) -> DataFrame:
    """WIN-1 + FLT-6 + FLT-5: 100 lag features + date parts + targets, all symbols."""
    return _features(spark, sf)


@register("skip_warmup", W(
    "SELECT symbol, trade_date FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY trade_date) AS rn "
    f"FROM training_bars) WHERE rn > {DAY}", "training_bars"))
def q_skip_warmup(spark: SparkSession, sf: str) -> DataFrame:
    """FLT-6: drop the first 20 bars of every series."""
    w = Window.partitionBy("symbol").orderBy("trade_date")
    b = X.training_bars(spark, sf).withColumn("_rn", F.row_number().over(w))
    return FC.skip_warmup(b, DAY).select("symbol", "trade_date")


@register("complete_targets", W(
    "SELECT symbol, trade_date FROM training_bars WHERE " + " AND ".join(f"{t} IS NOT NULL" for t in T),
    "training_bars"))
def q_complete_targets(spark: SparkSession, sf: str) -> DataFrame:
    """FLT-5: rows with every target present."""
    return FC.complete_targets(X.training_bars(spark, sf)).select("symbol", "trade_date")


_LAST_LAG_SQL = W(
    "WITH r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) AS _rd FROM training_bars), "
    "l AS (SELECT symbol, trade_date, _rd, CAST(year(trade_date) AS INTEGER) AS Year, "
    "CAST(month(trade_date) AS INTEGER) AS Month, CAST(day(trade_date) AS INTEGER) AS Day, "
    + ", ".join((f"{t} AS {t}_0" if k == 0 else
                 f"lag({t}, {k}) OVER (PARTITION BY symbol ORDER BY trade_date) AS {t}_{k}")
                for k in range(DAY) for t in T)
    + f" FROM r WHERE _rd <= {DAY}) SELECT symbol, trade_date, Year, Month, Day, " + ", ".join(LAGC)
    + " FROM l WHERE _rd = 1", "training_bars")


@register("last_lag_row", _LAST_LAG_SQL)
def q_last_lag_row(spark: SparkSession, sf: str) -> DataFrame:
    """WIN-2: scoring-form lags of every symbol's newest bar."""
    return FC.last_lag_row(X.training_bars(spark, sf), DAY)


@register("score_prices", W(
    f"WITH {_FEAT_SQL}, {_INS_SQL} SELECT symbol, trade_date, {_ROUND_PREDS} FROM ins", "training_bars"))
def q_score_prices(spark: SparkSession, sf: str) -> DataFrame:
    """MOD-2 + MOD-3: lag-mean model applied to every feature row."""
    return _rounded(_insample(spark, sf).select("symbol", "trade_date", *PREDS))


@register("pair_truth_prediction", W(
    f"WITH {_FEAT_SQL}, {_INS_SQL} SELECT symbol, trade_date, "
    + ", ".join(f"{t} AS True_{t}" for t in T) + f", {_ROUND_PREDS} FROM ins", "training_bars"))
def q_pair_truth_prediction(spark: SparkSession, sf: str) -> DataFrame:
    """JOI-4: truth and prediction of the same row side by side."""
    ins = _insample(spark, sf)
    return _rounded(ins.select("symbol", "trade_date", *[F.col(t).alias(f"True_{t}") for t in T], *PREDS))


@register("multi_target_r2", W(
    f"WITH {_FEAT_SQL}, {_INS_SQL} {_r2_sql('ins', 'symbol')} UNION ALL "
    f"SELECT '*' AS symbol, * FROM ({_r2_sql('ins', '')})", "training_bars"))
def q_multi_target_r2(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-3: in-sample R² per symbol and pooled (symbol '*')."""
    ins = _insample(spark, sf)
    per = FC.multi_target_r2(ins, ["symbol"])
    pooled = FC.multi_target_r2(ins).select(F.lit("*").alias("symbol"), "*")
    return per.unionByName(pooled)


@register("recursive_forecast", W(
    f"WITH RECURSIVE {_FEAT_SQL}, {_INS_SQL}, {_STEPS_SQL} SELECT symbol, step, trade_date, {_ROUND_PREDS} "
    "FROM steps WHERE step > 0", "training_bars"))
def q_recursive_forecast(spark: SparkSession, sf: str) -> DataFrame:
    """WIN-6: 10 business days ahead for every symbol, lag-mean model."""
    ins = _insample(spark, sf)
    return _rounded(FC.recursive_forecast(FC.LagMeanModel(DAY), ins, FC.HORIZON, DAY))


_FC_COLS = "symbol, Date, " + ", ".join(f"True_{t}" for t in T) + f", {_ROUND_PREDS}, is_forecast"


@register("append_forecast", W(
    f"WITH RECURSIVE {_FEAT_SQL}, {_INS_SQL}, {_STEPS_SQL}, {_FORECAST_SQL} SELECT {_FC_COLS} FROM fc",
    "training_bars"))
def q_append_forecast(spark: SparkSession, sf: str) -> DataFrame:
    """SET-2 + PRJ-4: in-sample rows then forecast rows (True_* NULL ahead)."""
    return _rounded(_forecast(spark, sf))


_CHART_SQL = W(
    f"WITH RECURSIVE {_FEAT_SQL}, {_INS_SQL}, {_STEPS_SQL}, {_FORECAST_SQL} "
    + " UNION ALL ".join(
        f"SELECT symbol, Date, '{t}' AS metric, '{k}' AS kind, round({k}_{t}, 6) AS value FROM fc"
        + (" WHERE NOT is_forecast" if k == "True" else "")
        for t in T if t != "Volume" for k in ("True", "Pred")), "training_bars")


@register("chart_series", _CHART_SQL)
def q_chart_series(spark: SparkSession, sf: str) -> DataFrame:
    """SNK-6: forecast as a long (metric, kind, Date, value) series."""
    out = FC.chart_series(_forecast(spark, sf))
    return out.withColumn("value", F.round("value", 6))


REPLY_DAYS = 100
_WINDOW_SQL = ("win AS (SELECT b.* FROM training_bars b JOIN (SELECT symbol, max(trade_date) AS last_date FROM training_bars "
               f"GROUP BY symbol) e ON b.symbol = e.symbol WHERE b.trade_date > e.last_date - INTERVAL {REPLY_DAYS} DAY)")


@register("projection_reply", W(
    f"WITH RECURSIVE {_WINDOW_SQL}, {_FEAT_SQL.replace('FROM training_bars', 'FROM win')}, {_INS_SQL}, {_STEPS_SQL}, "
    f"{_FORECAST_SQL}, score AS ({_r2_sql('ins', 'symbol')}), chart AS ("
    + " UNION ALL ".join(
        f"SELECT symbol, Date, '{t}' AS metric, '{k}' AS kind, round({k}_{t}, 6) AS value FROM fc"
        + (" WHERE NOT is_forecast" if k == "True" else "")
        for t in T if t != "Volume" for k in ("True", "Pred"))
    + ") SELECT c.symbol, s.r2 AS score, c.metric, c.kind, c.Date, c.value FROM chart c JOIN score s ON s.symbol = c.symbol",
    "training_bars"))
def q_projection_reply(spark: SparkSession, sf: str) -> DataFrame:
    """FLT-2 + WIN-1 + WIN-6 + AGG-3 + SNK-6: the last 100 calendar days of every
    symbol, their lag features, the forecast, and the chart series beside the score."""
    return projection(spark, sf, FC.LagMeanModel(DAY))


def projection(spark: SparkSession, sf: str, model) -> DataFrame:
    """The projection reply by any price model."""
    b = X.training_bars(spark, sf)
    last = b.groupBy("symbol").agg(F.max("trade_date").alias("last_date"))
    recent = b.join(last, "symbol").where(F.col("trade_date") > F.date_sub("last_date", REPLY_DAYS)).drop("last_date")
    ins = FC.score_prices(model, FC.lag_features(recent, DAY)).checkpoint()
    chart = FC.chart_series(FC.append_forecast(ins, FC.recursive_forecast(model, ins, FC.HORIZON, DAY)))
    score = FC.multi_target_r2(ins, ["symbol"]).select("symbol", F.col("r2").alias("score"))
    return chart.join(score, "symbol").select("symbol", "score", "metric", "kind", "Date", F.round("value", 6).alias("value"))


@register("align_by_position", W(
    f"WITH RECURSIVE {_FEAT_SQL}, {_INS_SQL}, {_STEPS_SQL}, {_FORECAST_SQL}, "
    "t AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY Date) AS pos, "
    + ", ".join(f"True_{t}" for t in T) + " FROM fc WHERE NOT is_forecast), "
    "p AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY Date) AS pos, Date, "
    + ", ".join(PREDS) + " FROM fc) "
    "SELECT coalesce(t.symbol, p.symbol) AS symbol, coalesce(t.pos, p.pos) AS pos, p.Date, "
    + ", ".join(f"t.True_{t}" for t in T) + ", " + ", ".join(f"round(p.Pred_{t}, 6) AS Pred_{t}" for t in T)
    + " FROM t FULL OUTER JOIN p ON t.symbol = p.symbol AND t.pos = p.pos", "training_bars"))
def q_align_by_position(spark: SparkSession, sf: str) -> DataFrame:
    """JOI-1: truth and (in-sample + forecast) predictions matched by row position, full outer."""
    fc = _forecast(spark, sf)
    w = Window.partitionBy("symbol").orderBy("Date")
    t = fc.where(~F.col("is_forecast")).select("symbol", F.row_number().over(w).alias("pos"),
                                               *[f"True_{x}" for x in T])
    p = fc.select("symbol", F.row_number().over(w).alias("pos"), "Date", *PREDS)
    j = t.join(p, ["symbol", "pos"], "full")
    return _rounded(j.select("symbol", "pos", "Date", *[f"True_{x}" for x in T], *PREDS))


_SPLIT_SQL = ("SELECT symbol, CASE WHEN rn <= floor(n * 0.8) THEN 'train' ELSE 'test' END AS split FROM ("
              f"SELECT symbol, row_number() OVER (ORDER BY md5(concat(symbol, '{SPLIT_SEED}')), symbol) AS rn, "
              "count(*) OVER () AS n FROM (SELECT DISTINCT symbol FROM bars))")


@register("group_split", W(_SPLIT_SQL, "bars"))
def q_group_split(spark: SparkSession, sf: str) -> DataFrame:
    """PRE-1: exact 80/20 split of the symbols (md5 order, seed 11)."""
    return exact_split(X.bars(spark, sf).select("symbol").distinct(), "symbol", SPLIT_SEED, 0.8)


@register("evaluate_prices", W(
    f"WITH {_FEAT_SQL}, {_INS_SQL}, sp AS ({_SPLIT_SQL}), "
    f"te AS (SELECT ins.* FROM ins JOIN sp ON sp.symbol = ins.symbol WHERE sp.split = 'test'), "
    f"r AS ({_r2_sql('te', 'symbol')}) "
    "SELECT sp.symbol, coalesce(r.r2, 1.0) AS r2 FROM sp LEFT JOIN r ON r.symbol = sp.symbol "
    "WHERE sp.split = 'test'", "training_bars"))
def q_evaluate_prices(spark: SparkSession, sf: str) -> DataFrame:
    """MOD-4: R² on every held-out symbol; 1 when a symbol has no scorable rows (Q10)."""
    split = exact_split(X.bars(spark, sf).select("symbol").distinct(), "symbol", SPLIT_SEED, 0.8)
    test = split.where(F.col("split") == "test").select("symbol")
    ins = _insample(spark, sf).join(test, "symbol")
    r = FC.multi_target_r2(ins, ["symbol"]).select("symbol", "r2")
    return test.join(r, "symbol", "left").select("symbol", F.coalesce("r2", F.lit(1.0)).alias("r2"))
