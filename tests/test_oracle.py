"""Spark query vs independent DuckDB SQL on the driver tables (order-insensitive)."""

import os

import pytest

from tests.conftest import SF
from tools.check import digest

import __spark_entry__ as E

FAST = ["highlights", "top_losers", "select_bar_columns", "company_lookup", "ticker_suggest", "ticker_map_json",
        "bars_in_range", "missing_date_ranges", "date_windows", "keep_last_per_key", "upsert_bars",
        "next_business_day", "split_join_date", "scan_json_records", "scan_all_bars",
        "headline_rank", "label_headlines", "news_mood", "news_reply_json", "company_news", "scan_news",
        "lag_features", "last_lag_row", "multi_target_r2", "recursive_forecast", "chart_series", "group_split",
        "describe_numeric", "describe_category", "box_stats", "abs_correlation", "row_split", "stratified_folds",
        "random_undersample", "column_transformer", "gaussian_nb", "classification_report", "error_rates",
        "rouge_n", "extractive_summary", "map_batches", "stream_upsert_bars", "stream_first_seen_news",
        "knn_candidates", "knn_classifier", "smote_oversample", "projection_reply", "news_reply_predicted",
        "truncate_targets", "stream_news_mood"]
NAMES = sorted(E.oracle_sql()) if os.environ.get("BOURSE_ALL_ORACLE") else FAST


def test_every_query_has_a_builder():
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(qs) >= 100


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    res = duck.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    orows = res.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(rows) == len(orows)
    assert digest(df.columns, rows)[0] == digest(ocols, orows)[0]


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns[:3] == ["category", "title", "rank"]
