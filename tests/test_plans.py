"""Physical-plan checks: the plan shapes the scale notes rely on."""

from bourse.operators import forecast as FC
from bourse.operators import market as M
from bourse.sources import fixtures as X
from tests.conftest import SF


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lag_features_single_window(spark):
    p = FC.lag_features(X.training_bars(spark, SF))._jdf.queryExecution().optimizedPlan().toString()
    assert p.count("Window [") == 1


def test_top_k_is_take_ordered(spark):
    q = M.select_quote_columns(X.quotes(spark, SF))
    assert "TakeOrderedAndProject" in plan(q.orderBy("p_change").limit(5))


def test_latest_quotes_group_limit(spark):
    assert "WindowGroupLimit" in plan(X.quotes(spark, SF))


def test_bars_aggregate_is_partial(spark):
    p = plan(X.bars(spark, SF))
    assert "partial_max" in p or "partial_min_by" in p


def test_scan_prunes_columns_and_pushes_filter(spark):
    from pyspark.sql import functions as F

    from bourse.sources.tables import table

    df = table(spark, SF, "lineitem").where(F.col("l_quantity") > 10).select("l_orderkey")
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,10.0)]" in p
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in p


def test_news_cuts_titles_out_below_the_joins(spark):
    p = X.news(spark, SF)._jdf.queryExecution().optimizedPlan().toString().lower()
    assert p.index("join") < p.rindex("split")
