"""Registered tabular-study queries: profiling (AGG-7..13), preparation (PRE-2..12, WIN-5),
Gaussian NB (MOD-11) and evaluation (AGG-4, AGG-14..18, UDF-4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bourse.operators import evaluate as EV
from bourse.operators import prep as PR
from bourse.operators import profile as PF
from bourse.operators.ordering import deterministic_sample, exact_split, head_split
from bourse.plans.registry import register
from bourse.sources import fixtures as X
from bourse.sources.fixtures import oracle_with as W

SEED = 11
NUMERIC = ["total_price", "acct_bal", "order_month"]
CATEGORY = ["region", "age_like", "health_like", "checkup_like", "target"]
# Given category orders and fill values of the two ordinal columns.
HEALTH_ORDER = ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT"]
CHECKUP_ORDER = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
SPEC = PR.TabularSpec(numeric=NUMERIC, one_hot=["region"], auto_ordinal=["age_like"],
                      given_ordinal={"health_like": (HEALTH_ORDER, "3-MEDIUM"),
                                     "checkup_like": (CHECKUP_ORDER, "FURNITURE")})
# The five TPC-H region names (the one-hot columns of the oracle; Spark derives them).
REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


def M_drop_target(df: DataFrame) -> DataFrame:
    """PRJ-5: the feature table X = every column but the target."""
    return df.drop("target")


def _r6(x: str) -> str:
    return f"round({x}, 6)"


# ---------------------------------------------------------------- profiling
def _tab(spark: SparkSession, sf: str) -> DataFrame:
    return X.tab(spark, sf)


_DESC_NUM_SQL = W(" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS count, {_r6(f'avg({c})')} AS mean, {_r6(f'stddev_samp({c})')} AS std, "
    f"{_r6(f'min({c})')} AS min, {_r6(f'quantile_cont({c}, 0.25)')} AS q25, {_r6(f'quantile_cont({c}, 0.5)')} AS q50, "
    f"{_r6(f'quantile_cont({c}, 0.75)')} AS q75, {_r6(f'max({c})')} AS max FROM tab" for c in NUMERIC), "tab")


@register("describe_numeric", _DESC_NUM_SQL)
def q_describe_numeric(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-7 with exact interpolated quartiles."""
    return PF.describe_numeric(_tab(spark, sf), NUMERIC)


_DESC_CAT_SQL = W(" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", sum(n) AS count, count(*) AS \"unique\", "
    f"arg_min(v, (-n, v)) AS top, max(n) AS freq FROM (SELECT CAST({c} AS VARCHAR) AS v, count(*) AS n FROM tab "
    f"WHERE {c} IS NOT NULL GROUP BY 1)" for c in CATEGORY), "tab")


@register("describe_category", _DESC_CAT_SQL)
def q_describe_category(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-8."""
    return PF.describe_category(_tab(spark, sf), CATEGORY)


_TAB_TYPES = {"row_id": "bigint", "total_price": "double", "acct_bal": "double", "order_month": "double",
              "region": "string", "age_like": "string", "health_like": "string", "checkup_like": "string",
              "target": "string"}


@register("column_info", W(" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS non_null, '{t}' AS dtype FROM tab" for c, t in _TAB_TYPES.items()),
    "tab"))
def q_column_info(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-9: non-null count and type per column."""
    return PF.column_info(_tab(spark, sf))


@register("value_counts", W(
    "SELECT target AS value, count(*) AS count, round(count(*) / (SELECT count(*) FROM tab), 6) AS share "
    "FROM tab GROUP BY target", "tab"))
def q_value_counts(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-10: class counts and shares."""
    return PF.value_counts(_tab(spark, sf), "target")


@register("histogram_by_class", W(
    "WITH l AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", target, CAST({c} AS DOUBLE) AS value FROM tab "
                                       f"WHERE {c} IS NOT NULL" for c in NUMERIC)
    + "), r AS (SELECT \"column\", min(value) AS lo, max(value) AS hi FROM l GROUP BY 1) "
    "SELECT l.\"column\", CAST(CASE WHEN hi - lo = 0 THEN 1 ELSE least(floor((value - lo) / (hi - lo) * 10) + 1, 10) "
    "END AS INTEGER) AS bin, target AS label, count(*) AS count FROM l JOIN r ON l.\"column\" = r.\"column\" "
    "GROUP BY 1, 2, 3", "tab"))
def q_histogram_by_class(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-11 (numeric): 10 equal-width bins per column and class."""
    return PF.histogram_by_class(_tab(spark, sf), NUMERIC, "target", 10)


_CATS = [c for c in CATEGORY if c != "target"]


@register("category_counts_by_class", W(" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value, target AS label, count(*) AS count FROM tab "
    f"WHERE {c} IS NOT NULL GROUP BY 2, 3" for c in _CATS), "tab"))
def q_category_counts_by_class(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-11 (category): counts per value and class."""
    return PF.category_counts_by_class(_tab(spark, sf), _CATS, "target")


@register("box_stats", W(
    "WITH l AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", target, CAST({c} AS DOUBLE) AS value FROM tab "
                                       f"WHERE {c} IS NOT NULL" for c in NUMERIC)
    + "), q AS (SELECT target, \"column\", quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, "
    "quantile_cont(value, 0.75) AS q3 FROM l GROUP BY 1, 2), "
    "w AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper FROM q) "
    "SELECT w.target AS label, w.\"column\", round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, "
    "round(lower, 6) AS lower, round(upper, 6) AS upper, "
    "sum(CASE WHEN value < lower OR value > upper THEN 1 ELSE 0 END) AS outliers "
    "FROM l JOIN w ON l.target = w.target AND l.\"column\" = w.\"column\" "
    "GROUP BY w.target, w.\"column\", q1, median, q3, lower, upper", "tab"))
def q_box_stats(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-12: quartiles, whiskers and outliers per class."""
    return PF.box_stats(_tab(spark, sf), NUMERIC, "target")


@register("abs_correlation", W(" UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(abs(corr({a}, {b})), 6) AS abs_r FROM tab"
    for a in NUMERIC for b in NUMERIC), "tab"))
def q_abs_correlation(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-13 / SCA-14: |Pearson r| for every pair of numeric columns."""
    return PF.abs_correlation(_tab(spark, sf), NUMERIC)


# ---------------------------------------------------------------- splits
_SPLIT_SQL = ("sp AS (SELECT *, CASE target WHEN 'Yes' THEN 1 ELSE 0 END AS label, "
              "CASE WHEN rn <= floor(n * 0.75) THEN 'train' ELSE 'test' END AS split FROM (SELECT *, "
              f"row_number() OVER (ORDER BY md5(concat(CAST(row_id AS VARCHAR), '{SEED}')), row_id) AS rn, "
              "count(*) OVER () AS n FROM tab))")


def _split(spark: SparkSession, sf: str) -> DataFrame:
    t = _tab(spark, sf).withColumn("label", F.when(F.col("target") == "Yes", 1).otherwise(0))
    return exact_split(t, "row_id", SEED, 0.75)


@register("row_split", W(f"WITH {_SPLIT_SQL} SELECT row_id, label, split FROM sp", "tab"))
def q_row_split(spark: SparkSession, sf: str) -> DataFrame:
    """PRE-2 + JOI-2: exact 75/25 split in md5 order; Yes/No -> 1/0."""
    return _split(spark, sf).select("row_id", "label", "split")


@register("split_shapes", W(
    f"WITH {_SPLIT_SQL} SELECT split, count(*) AS rows, 8 AS columns FROM sp GROUP BY split", "tab"))
def q_split_shapes(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-18: rows and feature columns of each part."""
    s = _split(spark, sf)
    n_features = len(M_drop_target(_tab(spark, sf)).columns)
    return s.groupBy("split").agg(F.count(F.lit(1)).alias("rows")).withColumn("columns", F.lit(n_features))


@register("head_split", W(
    "SELECT row_id, CASE WHEN row_number() OVER (ORDER BY row_id) <= floor(count(*) OVER () * 0.8) "
    "THEN 'train' ELSE 'test' END AS split FROM tab", "tab"))
def q_head_split(spark: SparkSession, sf: str) -> DataFrame:
    """PRE-3: first 80 % by position (row_id order)."""
    return head_split(_tab(spark, sf).select("row_id"), ["row_id"], 0.8)


@register("deterministic_sample", W(
    f"SELECT row_id, total_price, target FROM tab ORDER BY md5(concat(CAST(row_id AS VARCHAR), '{SEED}')), row_id "
    "LIMIT 5", "tab"))
def q_deterministic_sample(spark: SparkSession, sf: str) -> DataFrame:
    """PRE-4: 5 rows in md5 order (top-k per task, merged)."""
    return deterministic_sample(_tab(spark, sf), "row_id", SEED, 5).select("row_id", "total_price", "target")


@register("stratified_folds", W(
    f"WITH {_SPLIT_SQL} SELECT row_id, label, CAST((row_number() OVER (PARTITION BY label ORDER BY "
    f"md5(concat(CAST(row_id AS VARCHAR), '{SEED}')), row_id) - 1) % 5 AS INTEGER) AS fold FROM sp", "tab"))
def q_stratified_folds(spark: SparkSession, sf: str) -> DataFrame:
    """WIN-5: 5 folds with equal class shares."""
    return PR.stratified_folds(_split(spark, sf).select("row_id", "label"), "row_id", "label", SEED)


@register("random_undersample", W(
    f"WITH {_SPLIT_SQL}, tr AS (SELECT * FROM sp WHERE split = 'train'), "
    f"r AS (SELECT row_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(concat(CAST(row_id AS VARCHAR), "
    f"'{SEED}')), row_id) AS rk FROM tr) "
    "SELECT row_id, label FROM r WHERE rk <= (SELECT min(c) FROM (SELECT count(*) AS c FROM tr GROUP BY label))",
    "tab"))
def q_random_undersample(spark: SparkSession, sf: str) -> DataFrame:
    """PRE-12: majority class cut to the minority size (training rows)."""
    tr = _split(spark, sf).where(F.col("split") == "train").select("row_id", "label")
    return PR.random_undersample(tr, "row_id", "label", SEED)


# ---------------------------------------------------------------- preparation
_MED = ", ".join(f"quantile_cont({c}, 0.5) AS {c}" for c in NUMERIC)
_PREP_SQL = (
    f"{_SPLIT_SQL}, tr AS (SELECT * FROM sp WHERE split = 'train'), med AS (SELECT {_MED} FROM tr), "
    "imp AS (SELECT sp.row_id, sp.split, sp.label, "
    + ", ".join(f"coalesce(sp.{c}, med.{c}) AS {c}" for c in NUMERIC)
    + ", sp.region, sp.age_like, sp.health_like, sp.checkup_like FROM sp, med), "
    "sc AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}, coalesce(nullif(stddev_pop({c}), 0), 1.0) AS s_{c}"
                                 for c in NUMERIC) + " FROM imp WHERE split = 'train'), "
    "mo AS (SELECT (SELECT arg_min(v, (-n, v)) FROM (SELECT region AS v, count(*) AS n FROM tr WHERE region IS NOT NULL "
    "GROUP BY 1)) AS region, (SELECT arg_min(v, (-n, v)) FROM (SELECT age_like AS v, count(*) AS n FROM tr "
    "WHERE age_like IS NOT NULL GROUP BY 1)) AS age_like), "
    "agec AS (SELECT list(v ORDER BY v) AS cats FROM (SELECT DISTINCT coalesce(tr.age_like, mo.age_like) AS v "
    "FROM tr, mo)), "
    "prep AS (SELECT imp.row_id, imp.split, imp.label, "
    + ", ".join(f"(imp.{c} - sc.m_{c}) / sc.s_{c} AS {c}" for c in NUMERIC) + ", "
    + ", ".join(f"CAST(CASE WHEN coalesce(imp.region, mo.region) = '{r}' THEN 1 ELSE 0 END AS DOUBLE) "
                f"AS region_{PR.safe_name(r)}"
                for r in REGIONS[1:]) + ", "
    "CAST(list_position(agec.cats, coalesce(imp.age_like, mo.age_like)) - 1 AS DOUBLE) AS age_like, "
    f"CAST(list_position({HEALTH_ORDER!r}, coalesce(imp.health_like, '3-MEDIUM')) - 1 AS DOUBLE) AS health_like, "
    f"CAST(list_position({CHECKUP_ORDER!r}, coalesce(imp.checkup_like, 'FURNITURE')) - 1 AS DOUBLE) AS checkup_like "
    "FROM imp, sc, mo, agec)")
_FEATURES = [*NUMERIC, *[f"region_{PR.safe_name(r)}" for r in REGIONS[1:]], "age_like", "health_like", "checkup_like"]


def _prepared(spark: SparkSession, sf: str) -> tuple[DataFrame, list[str]]:
    s = _split(spark, sf)
    train = s.where(F.col("split") == "train")
    fit = PR.fit_transformer(train, SPEC)
    out = PR.apply_transformer(s, SPEC, fit)
    return out, PR.feature_names(SPEC, fit)


@register("impute_median", W(f"WITH {_SPLIT_SQL}, tr AS (SELECT * FROM sp WHERE split = 'train') " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", round(quantile_cont({c}, 0.5), 6) AS median FROM tr" for c in NUMERIC), "tab"))
def q_impute_median(spark: SparkSession, sf: str) -> DataFrame:
    """PRE-5: exact training medians (the fill values)."""
    tr = _split(spark, sf).where(F.col("split") == "train")
    q = PF.exact_quantiles(PF.long_values(tr, NUMERIC), (0.5,))
    return q.select("column", F.round("quantile", 6).alias("median"))


@register("impute_mode", W(f"WITH {_SPLIT_SQL}, tr AS (SELECT * FROM sp WHERE split = 'train') " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", arg_min(v, (-n, v)) AS mode FROM (SELECT {c} AS v, count(*) AS n FROM tr "
    f"WHERE {c} IS NOT NULL GROUP BY 1)" for c in ["region", "age_like"]), "tab"))
def q_impute_mode(spark: SparkSession, sf: str) -> DataFrame:
    """PRE-6: most frequent training value (ties: smallest)."""
    tr = _split(spark, sf).where(F.col("split") == "train")
    return PR.modes(tr, ["region", "age_like"])


@register("impute_constant", W(
    "SELECT row_id, coalesce(health_like, '3-MEDIUM') AS health_like, "
    "coalesce(checkup_like, 'FURNITURE') AS checkup_like FROM tab", "tab"))
def q_impute_constant(spark: SparkSession, sf: str) -> DataFrame:
    """PRE-7: constant fill values."""
    return PR.impute(_tab(spark, sf).select("row_id", "health_like", "checkup_like"),
                     {"health_like": "3-MEDIUM", "checkup_like": "FURNITURE"})


@register("column_transformer", W(
    f"WITH {_PREP_SQL} SELECT row_id, split, label, " + ", ".join(f"round({c}, 6) AS {c}" for c in _FEATURES)
    + " FROM prep", "tab"))
def q_column_transformer(spark: SparkSession, sf: str) -> DataFrame:
    """PRE-11 (+ PRE-5..10): all features, fitted on the training rows only."""
    out, feats = _prepared(spark, sf)
    return out.select("row_id", "split", "label", *[F.round(c, 6).alias(c) for c in feats])


@register("standard_scale", W(
    f"WITH {_PREP_SQL} SELECT row_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in NUMERIC) + " FROM prep", "tab"))
def q_standard_scale(spark: SparkSession, sf: str) -> DataFrame:
    """PRE-8: (x - mean) / population std of the imputed training values."""
    out, _ = _prepared(spark, sf)
    return out.select("row_id", *[F.round(c, 6).alias(c) for c in NUMERIC])


_OH = [f"region_{PR.safe_name(r)}" for r in REGIONS[1:]]


@register("one_hot", W(f"WITH {_PREP_SQL} SELECT row_id, {', '.join(_OH)} FROM prep", "tab"))
def q_one_hot(spark: SparkSession, sf: str) -> DataFrame:
    """PRE-9: sorted categories, first dropped."""
    out, _ = _prepared(spark, sf)
    return out.select("row_id", *_OH)


@register("ordinal_encode", W("WITH " + _PREP_SQL + " SELECT row_id, age_like, health_like, checkup_like FROM prep",
                              "tab"))
def q_ordinal_encode(spark: SparkSession, sf: str) -> DataFrame:
    """PRE-10: sorted (age_like) and given (health_like, checkup_like) orders."""
    out, _ = _prepared(spark, sf)
    return out.select("row_id", "age_like", "health_like", "checkup_like")


# ---------------------------------------------------------------- Gaussian NB + evaluation
def _gnb_sql(smoothing: float, name: str) -> str:
    f = _FEATURES
    return (
        f"gp_{name} AS (SELECT label AS cls, count(*) AS n_c, "
        + ", ".join(f"avg({c}) AS m_{c}, var_pop({c}) AS v_{c}" for c in f)
        + " FROM prep WHERE split = 'train' GROUP BY label), "
        f"ge_{name} AS (SELECT {smoothing!r} * greatest(" + ", ".join(f"var_pop({c})" for c in f)
        + ") AS eps, count(*) AS n FROM prep WHERE split = 'train'), "
        f"g_{name} AS (SELECT cls, ln(n_c / n) AS lp, " + ", ".join(f"m_{c}, v_{c} + eps AS v_{c}" for c in f)
        + f" FROM gp_{name}, ge_{name}), "
        f"j_{name} AS (SELECT p.row_id, g.cls, g.lp - 0.5 * ("
        + " + ".join(f"ln(2 * pi() * g.v_{c})" for c in f) + ") - 0.5 * ("
        + " + ".join(f"(p.{c} - g.m_{c}) * (p.{c} - g.m_{c}) / g.v_{c}" for c in f)
        + f") AS jll FROM prep p, g_{name} g), "
        f"pr_{name} AS (SELECT p.row_id, p.split, p.label, j.cls AS pred FROM prep p JOIN (SELECT row_id, cls, "
        f"row_number() OVER (PARTITION BY row_id ORDER BY jll DESC, cls) AS k FROM j_{name}) j "
        f"ON j.row_id = p.row_id AND j.k = 1)")


_GNB_SQL = f"WITH {_PREP_SQL}, {_gnb_sql(1e-9, 'a')}"


def _gnb(spark: SparkSession, sf: str, smoothing: float = 1e-9) -> DataFrame:
    prep, feats = _prepared(spark, sf)
    train = prep.where(F.col("split") == "train")
    model = EV.GaussianNB(feats, "label", smoothing).fit(train)
    return model.transform(prep)


@register("gaussian_nb", W(f"{_GNB_SQL} SELECT row_id, split, label, pred FROM pr_a", "tab"))
def q_gaussian_nb(spark: SparkSession, sf: str) -> DataFrame:
    """MOD-11: Gaussian naive Bayes with variance smoothing, closed form."""
    return _gnb(spark, sf).select("row_id", "split", "label", "pred")


_CONF = ("sum(CASE WHEN label = 0 AND pred = 0 THEN 1 ELSE 0 END) AS tn, "
         "sum(CASE WHEN label = 0 AND pred = 1 THEN 1 ELSE 0 END) AS fp, "
         "sum(CASE WHEN label = 1 AND pred = 0 THEN 1 ELSE 0 END) AS fn, "
         "sum(CASE WHEN label = 1 AND pred = 1 THEN 1 ELSE 0 END) AS tp")


@register("confusion_counts", W(
    f"{_GNB_SQL} SELECT split, {_CONF} FROM pr_a GROUP BY split UNION ALL SELECT 'all', {_CONF} FROM pr_a", "tab"))
def q_confusion_counts(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-14: per split and over all rows (Q13)."""
    p = _gnb(spark, sf)
    per = EV.confusion_counts(p, ["split"])
    return per.unionByName(EV.confusion_counts(p).select(F.lit("all").alias("split"), "*"))


def _div(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) = 0 THEN 0.0 ELSE CAST({a} AS DOUBLE) / ({b}) END"


def _f1(p: str, r: str) -> str:
    return f"CASE WHEN ({p}) + ({r}) = 0 THEN 0.0 ELSE 2 * ({p}) * ({r}) / (({p}) + ({r})) END"


_REPORT_SQL = W(
    f"{_GNB_SQL}, c AS (SELECT split, {_CONF} FROM pr_a GROUP BY split), "
    f"b AS (SELECT split, {_div('tn', 'tn + fn')} AS p0, {_div('tn', 'tn + fp')} AS r0, "
    f"{_div('tp', 'tp + fp')} AS p1, {_div('tp', 'tp + fn')} AS r1, tn + fp AS s0, tp + fn AS s1, "
    f"{_div('tp + tn', 'tn + fp + fn + tp')} AS acc, tn + fp + fn + tp AS n FROM c), "
    f"b2 AS (SELECT *, {_f1('p0', 'r0')} AS f0, {_f1('p1', 'r1')} AS f1 FROM b) "
    "SELECT split, '0' AS class, round(p0, 6) AS precision, round(r0, 6) AS recall, round(f0, 6) AS f1, s0 AS support FROM b2 "
    "UNION ALL SELECT split, '1', round(p1, 6), round(r1, 6), round(f1, 6), s1 FROM b2 "
    "UNION ALL SELECT split, 'accuracy', NULL, NULL, round(acc, 6), n FROM b2 "
    "UNION ALL SELECT split, 'macro avg', round((p0 + p1) / 2, 6), round((r0 + r1) / 2, 6), round((f0 + f1) / 2, 6), n FROM b2 "
    f"UNION ALL SELECT split, 'weighted avg', round({_div('p0 * s0 + p1 * s1', 'n')}, 6), "
    f"round({_div('r0 * s0 + r1 * s1', 'n')}, 6), round({_div('f0 * s0 + f1 * s1', 'n')}, 6), n FROM b2", "tab")


@register("classification_report", _REPORT_SQL)
def q_classification_report(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-15: per class, accuracy, macro and weighted means, per split."""
    return EV.classification_report(EV.confusion_counts(_gnb(spark, sf), ["split"]), ["split"])


_ERR_SQL = W(
    f"{_GNB_SQL}, c AS (SELECT split, {_CONF} FROM pr_a GROUP BY split), "
    f"r AS (SELECT split, {_div('tn', 'tn + fp')} AS tn_rate, {_div('fp', 'tn + fp')} AS fp_rate, "
    f"{_div('fn', 'fn + tp')} AS fn_rate, {_div('tp', 'fn + tp')} AS tp_rate, "
    f"{_div('fn * 100', 'tn + fp + fn + tp')} AS fn_pct, {_div('fp * 100', 'tn + fp + fn + tp')} AS fp_pct FROM c) "
    "SELECT split, round(tn_rate, 6) AS tn_rate, round(fp_rate, 6) AS fp_rate, round(fn_rate, 6) AS fn_rate, "
    f"round(tp_rate, 6) AS tp_rate, round(fn_pct, 6) AS fn_pct, round(fp_pct, 6) AS fp_pct, "
    f"round({_div('tn_rate', 'fn_rate + tn_rate')}, 6) AS conf_false, "
    f"round({_div('tp_rate', 'fp_rate + tp_rate')}, 6) AS conf_true FROM r", "tab")


@register("error_rates", _ERR_SQL)
def q_error_rates(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-16: class-normalised rates and confidences per split."""
    return EV.error_rates(EV.confusion_counts(_gnb(spark, sf), ["split"]), ["split"])


@register("model_error_ranking", W(
    f"WITH {_PREP_SQL}, {_gnb_sql(1e-9, 'a')}, {_gnb_sql(0.01, 'b')}, "
    "allp AS (SELECT 'gaussian_nb' AS model, * FROM pr_a UNION ALL SELECT 'gaussian_nb_smooth', * FROM pr_b "
    "UNION ALL SELECT 'majority', row_id, split, label, 0 FROM prep) "
    "SELECT model, sum(CASE WHEN label = 1 AND pred = 0 THEN 1 ELSE 0 END) AS fn, "
    "sum(CASE WHEN label <> pred THEN 1 ELSE 0 END) AS fn_fp FROM allp WHERE split = 'test' GROUP BY model", "tab"))
def q_model_error_ranking(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-17: FN and FN+FP of each model on the test rows."""
    prep, feats = _prepared(spark, sf)
    train = prep.where(F.col("split") == "train")
    parts = [EV.GaussianNB(feats, "label", 1e-9).fit(train).transform(prep).withColumn("model", F.lit("gaussian_nb")),
             EV.GaussianNB(feats, "label", 0.01).fit(train).transform(prep)
             .withColumn("model", F.lit("gaussian_nb_smooth")),
             prep.withColumn("pred", F.lit(0)).withColumn("model", F.lit("majority"))]
    u = parts[0].select("model", "split", "label", "pred")
    for p in parts[1:]:
        u = u.unionByName(p.select("model", "split", "label", "pred"))
    t = u.where(F.col("split") == "test")
    return t.groupBy("model").agg(
        F.sum(((F.col("label") == 1) & (F.col("pred") == 0)).cast("long")).alias("fn"),
        F.sum((F.col("label") != F.col("pred")).cast("long")).alias("fn_fp")).orderBy("fn", "fn_fp")


@register("sample_accuracy", W(
    f"{_GNB_SQL}, s AS (SELECT * FROM pr_a WHERE split = 'test' ORDER BY "
    f"md5(concat(CAST(row_id AS VARCHAR), '{SEED}')), row_id LIMIT 5) "
    "SELECT round(avg(CASE WHEN label = pred THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS n FROM s", "tab"))
def q_sample_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-4: accuracy on 5 md5-sampled test rows."""
    test = _gnb(spark, sf).where(F.col("split") == "test")
    return EV.accuracy(deterministic_sample(test, "row_id", SEED, 5))


@register("metric_callback", W(
    f"{_GNB_SQL} SELECT split, round(avg(CASE WHEN label = pred THEN 1.0 ELSE 0.0 END), 6) AS accuracy, "
    "count(*) AS n FROM pr_a GROUP BY split", "tab"))
def q_metric_callback(spark: SparkSession, sf: str) -> DataFrame:
    """UDF-4: argmax over the per-class score array, then accuracy per split."""
    p = _gnb(spark, sf).withColumn("pred_idx", EV.argmax_index(F.col("scores")))
    return EV.accuracy(p, "label", "pred_idx", ["split"])


@register("scan_survey", W("SELECT * FROM tab", "tab"))
def q_scan_survey(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-8: the mixed numeric/category table landed as CSV, read with its schema."""
    from bourse.session import scratch_path
    from bourse.sources import files as S

    path = S.write_csv(_tab(spark, sf), scratch_path(spark, "survey-csv"))
    return S.scan_survey(spark, path)
