"""Registered fitted-model jobs (MOD-1/3, MOD-5/6, MOD-8/9, MOD-12..17, SNK-2, SNK-4).

Fitted models have no SQL counterpart (but for ``save_load_model``): the driver
checks rows only; ``tests/test_models.py`` checks counts, ranges, reload
equality and known losses on small tables.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bourse.operators import classify as C
from bourse.operators import forecast as FC
from bourse.operators import linear as L
from bourse.operators import market as M
from bourse.operators import neighbours as NB
from bourse.operators import news as N
from bourse.operators import prep as PR
from bourse.operators import text as TX
from bourse.operators.evaluate import accuracy, confusion_counts
from bourse.operators.ordering import exact_split
from bourse.plans import forecast_plans as FP
from bourse.plans import news_plans as NP
from bourse.plans import profile_plans as PP
from bourse.plans.registry import register
from bourse.session import checkpoint_dir, scratch_path
from bourse.sources import fixtures as X
from bourse.sources.fixtures import oracle_with as W

SEED = 11


def _tabular(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, list[str]]:
    prep, feats = PP._prepared(spark, sf)
    data = C.assemble(prep, feats)
    return data.where(F.col("split") == "train"), data, feats


def _report(pred: DataFrame, model: str, params: str) -> DataFrame:
    c = confusion_counts(pred, ["split"])
    return c.select(F.lit(model).alias("model"), F.lit(params).alias("params"), "*")


# ---------------------------------------------------------------- prices
_price_models: dict[tuple[str, str], str] = {}


def fitted_prices(spark: SparkSession, sf: str) -> FC.BoostedModel:
    """The price model fitted on the 80 % training symbols; fitted and saved once a session, then loaded."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _price_models:
        train = FP.q_group_split(spark, sf).where("split = 'train'").select("symbol")
        path = scratch_path(spark, "price-model")
        FC.train_price_model(FP._features(spark, sf).join(train, "symbol")).save(spark, path)
        _price_models[key] = path
    return FC.BoostedModel.load(spark, _price_models[key])


@register("train_price_model")
def q_train_price_model(spark: SparkSession, sf: str) -> DataFrame:
    """MOD-1 + MOD-3 + MOD-4 + SNK-2: 250 boosted trees per target on the training
    symbols, saved, reloaded; R² of the reloaded model per held-out symbol."""
    test = FP.q_group_split(spark, sf).where("split = 'test'").select("symbol")
    return FC.multi_target_r2(FC.score_prices(fitted_prices(spark, sf), FP._features(spark, sf).join(test, "symbol")), ["symbol"])


@register("forecast_gbt")
def q_forecast_gbt(spark: SparkSession, sf: str) -> DataFrame:
    """WIN-6 with the boosted-tree model: 10 business days for every symbol."""
    model = fitted_prices(spark, sf)
    return FC.recursive_forecast(model, FC.score_prices(model, FP._features(spark, sf)))


@register("projection_trained")
def q_projection_trained(spark: SparkSession, sf: str) -> DataFrame:
    """The projection reply with the trained price model instead of the lag mean."""
    return FP.projection(spark, sf, fitted_prices(spark, sf))


# ---------------------------------------------------------------- sentiment
def _sentiment_split(spark: SparkSession, sf: str) -> DataFrame:
    return exact_split(X.sentences(spark, sf), "doc_id", SEED, 0.8)


@register("train_sentiment")
def q_train_sentiment(spark: SparkSession, sf: str) -> DataFrame:
    """MOD-5 + AGG-4: fit on 80 %, accuracy on the held-out 20 %."""
    s = _sentiment_split(spark, sf)
    model = C.train_sentiment(s.where(F.col("split") == "train"))
    pred = C.predict_sentiment(model, s.where(F.col("split") == "test"))
    return accuracy(pred, "label", "predicted")


@register("predict_sentiment")
def q_predict_sentiment(spark: SparkSession, sf: str) -> DataFrame:
    """MOD-6 / UDF-1 with a trained model: every headline gets a label."""
    s = _sentiment_split(spark, sf)
    model = C.train_sentiment(s.where(F.col("split") == "train"))
    return C.predict_sentiment(model, X.news(spark, sf).select("doc_id", F.col("title").alias("text"))) \
        .select("doc_id", "predicted")


@register("news_reply_trained")
def q_news_reply_trained(spark: SparkSession, sf: str) -> DataFrame:
    """UDF-1 + JOI-3 + AGG-2 + SNK-3: request -> company -> its headlines, labelled by the trained model
    first, the mood over these labels, one reply per request; an unknown one gets the placeholder."""
    s = _sentiment_split(spark, sf)
    model = C.train_sentiment(s.where(F.col("split") == "train"))
    labelled = C.predict_sentiment(model, NP._ranked(spark, sf).withColumn("text", F.coalesce("title", F.lit(""))))
    resolved = M.company_lookup(NP._requests(spark, sf), X.companies(spark, sf))
    items = N.company_news(resolved, N.clean_headlines(labelled.drop("text"), predictor=lambda _t: F.col("predicted")))
    names = resolved.select(F.col("request").alias("symbol"), F.when(F.col("company_name") == "na", F.col("request"))
                            .otherwise(F.col("company_name")).alias("name"))
    return N.news_reply(items, names)


@register("save_load_model", W("SELECT count(*) AS n, count(*) AS n_equal FROM sentences", "sentences"))
def q_save_load_model(spark: SparkSession, sf: str) -> DataFrame:
    """SNK-2: a saved and reloaded pipeline predicts exactly as the original."""
    s = _sentiment_split(spark, sf)
    model = C.train_sentiment(s.where(F.col("split") == "train"))
    path = scratch_path(spark, "sentiment-model")
    model.write().overwrite().save(path)
    again = PipelineModel.load(path)
    a = C.predict_sentiment(model, s).select("doc_id", F.col("predicted").alias("a"))
    b = C.predict_sentiment(again, s).select("doc_id", F.col("predicted").alias("b"))
    j = a.join(b, "doc_id")
    return j.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("a") == F.col("b")).cast("long")).alias("n_equal"))


# ---------------------------------------------------------------- tabular classifiers
def _plane_reports(data: DataFrame, feats: list[str], model: str, planes: dict[str, list[float]]) -> DataFrame:
    """Confusion counts per split of several planes, in one pass over the rows."""
    found = F.array(*[F.struct(F.lit(name).alias("params"), L.side(feats, w).alias("pred")) for name, w in planes.items()])
    pred = data.select("split", "label", F.explode(found).alias("p")).select("split", "label", "p.params", "p.pred")
    return confusion_counts(pred, ["params", "split"]).select(F.lit(model).alias("model"), "params", "split", "tn", "fp", "fn", "tp")


@register("logistic_regression")
def q_logistic_regression(spark: SparkSession, sf: str) -> DataFrame:
    """MOD-8: iterations x solver, the study's grid; confusion counts per split."""
    train, data, feats = _tabular(spark, sf)
    return _plane_reports(data, feats, "logistic_regression", C.logistic_grid(L.training_rows(train, feats), feats))


@register("sgd_linear")
def q_sgd_linear(spark: SparkSession, sf: str) -> DataFrame:
    """MOD-9: five linear losses by minibatch descent, stopped early on held-out rows."""
    train, data, feats = _tabular(spark, sf)
    fitted = L.sgd_linear(L.training_rows(train, feats), feats, list(L.SGD_LOSSES))
    return _plane_reports(data, feats, "sgd_linear", {f"loss={x}": w for x, (w, _) in fitted.items()})


@register("decision_tree")
def q_decision_tree(spark: SparkSession, sf: str) -> DataFrame:
    """MOD-12: criterion x depth x least gain, the study's grid."""
    train, data, _ = _tabular(spark, sf)
    train = train.checkpoint()
    out = None
    for p in C.grid_points("decision_tree"):
        r = _report(C.fit_predict(C.estimators("decision_tree", **p), train, data), "decision_tree",
                    ",".join(f"{k}={v}" for k, v in p.items()))
        out = r if out is None else out.unionByName(r)
    return out


@register("random_forest")
def q_random_forest(spark: SparkSession, sf: str) -> DataFrame:
    """MOD-13: trees x depth x least gain, the study's grid, from one forest."""
    prep, feats = PP._prepared(spark, sf)
    return C.tree_grid(prep, feats, "random_forest", SEED)


@register("ada_boost")
def q_ada_boost(spark: SparkSession, sf: str) -> DataFrame:
    """MOD-14: SAMME with stumps, rounds x rate, the study's grid, from three fits."""
    prep, feats = PP._prepared(spark, sf)
    return C.tree_grid(prep, feats, "ada_boost", SEED)


@register("gradient_boost")
def q_gradient_boost(spark: SparkSession, sf: str) -> DataFrame:
    """MOD-15: trees x rate x depth, the study's grid, from six fits."""
    prep, feats = PP._prepared(spark, sf)
    return C.tree_grid(prep, feats, "gradient_boost", SEED)


@register("grid_search_recall")
def q_grid_search_recall(spark: SparkSession, sf: str) -> DataFrame:
    """MOD-16: all points of all eight families x 5 folds, undersampling inside the
    training folds only, best mean recall of class 1; each family's best point is
    refitted on all training rows and reported on train, test and all rows."""
    prep, feats = PP._prepared(spark, sf)
    return C.grid_search(prep, feats, lambda rows: PR.random_undersample(rows, "row_id", "label", SEED), SEED)


@register("compare_sampling")
def q_compare_sampling(spark: SparkSession, sf: str) -> DataFrame:
    """MOD-17: the same boosted trees with undersampling, SMOTE oversampling
    and no resampling; error counts on every split and on all rows (Q13)."""
    train, data, feats = _tabular(spark, sf)
    # every fit passes over its rows several times, and every report over ``data``: the search and the joins run once
    data = data.select("row_id", "split", "label", *feats, "features").checkpoint(eager=True)
    train = data.where(F.col("split") == "train")
    synthetic = NB.smote(train.select("row_id", "label", *feats), "row_id", "label", feats, SEED)
    over = C.assemble(train.select("row_id", "label", *feats).unionByName(
        synthetic.select((-F.col("i")).alias("row_id"), "label", *feats)), feats).checkpoint(eager=True)
    est = C.estimators("gradient_boost", trees=20, depth=5, rate=0.1)
    out = None
    for name, rows in (("under", PR.random_undersample(train, "row_id", "label", SEED).checkpoint(eager=True)), ("over", over),
                       ("none", train)):
        per = confusion_counts(C.fit_predict(est, rows, data), ["split"]).checkpoint(eager=True)   # one row a split
        cells = [c for c in per.columns if c != "split"]
        per = per.unionByName(per.agg(*[F.sum(c).alias(c) for c in cells]).select(F.lit("all").alias("split"), *cells))
        r = per.select(F.lit(name).alias("sampling"), "*")
        out = r if out is None else out.unionByName(r)
    return out


# ---------------------------------------------------------------- quality metrics
@register("quality_metrics")
def q_quality_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """SNK-4: R² of the trained price model (held-out symbols), accuracy of the trained sentiment
    model (held-out texts) and precision of the summaries, appended to a metrics table; returns this run's rows."""
    r2 = q_train_price_model(spark, sf).agg(F.avg("r2").alias("value")).select(F.lit("forecast_r2").alias("name"), "value")
    acc = q_train_sentiment(spark, sf).select(F.lit("sentiment_accuracy").alias("name"), F.col("accuracy").alias("value"))
    # The reference scores (prediction, summary) in swapped order, so its
    # "precision" is overlap / reference length, i.e. our recall (Q9). The text to
    # sum up is a turn, the true summary its answer.
    pairs = X.pairs(spark, sf).withColumn("pair", F.concat_ws("-", "conv_id", "turn"))
    made = TX.extractive_summary(pairs, "pair", "reference_text").select("pair", F.col("summary").alias("made"))
    scored = pairs.join(made, "pair").select("conv_id", "turn", F.col("candidate_text").alias("reference_text"),
                                             F.col("made").alias("candidate_text"))
    rouge = TX.rouge_n(scored, ["conv_id", "turn"], 1) \
        .agg(F.avg("recall").alias("value")).select(F.lit("summary_precision").alias("name"), "value")
    m = r2.unionByName(acc).unionByName(rouge).withColumn("as_of", F.current_timestamp())
    # one table for all runs: a later run's rows are added to it
    path = f"{checkpoint_dir(spark).rstrip('/')}/bourse-metrics"
    m = m.checkpoint()
    m.write.mode("append").parquet(path)
    now = m.select("as_of").limit(1)
    return spark.read.schema(m.schema).parquet(path).join(now, "as_of", "left_semi")
