"""Registered market-data queries (SRC, SNK-1/5, PRJ, FLT, TOP, SRT, SET, SCA dates)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bourse.functions.dates import join_date, next_business_day, split_date
from bourse.operators import forecast as FC
from bourse.operators import market as M
from bourse.plans.registry import register
from bourse.session import scratch_path
from bourse.sources import files as S
from bourse.sources import fixtures as X
from bourse.sources.fixtures import oracle_with as W

# DuckDB has no initcap: title-case each blank-separated word.
_TITLE_SQL = ("array_to_string(list_transform(string_split(replace(category, '_', ' '), ' '), "
              "lambda x: upper(substr(x, 1, 1)) || lower(substr(x, 2))), ' ')")
_QCOLS = ", ".join(M.QUOTE_COLUMNS)

# Fixed request parameters of the registered market queries.
RANGE_END = "2001-11-04"
RANGE_DAYS = 100
SUGGEST_TEXT = "s1"


def _topk_sql(category: str, column: str, asc: bool, k: int = 5) -> str:
    order = f"{column} {'ASC' if asc else 'DESC'} NULLS LAST, symbol ASC"
    return (f"SELECT * FROM (SELECT '{category}' AS category, {_QCOLS}, "
            f"row_number() OVER (ORDER BY {order}) AS rank FROM quotes) WHERE rank <= {k}")


_HIGHLIGHTS_SQL = W(
    "SELECT category, " + _TITLE_SQL + " AS title, rank, " + _QCOLS + " FROM ("
    + " UNION ALL ".join(_topk_sql(c, col, asc) for c, col, asc in M.HIGHLIGHT_LISTS) + ")",
    "quotes")


@register("highlights", _HIGHLIGHTS_SQL)
def q_highlights(spark: SparkSession, sf: str) -> DataFrame:
    """TOP-5 (flagship): four top-5 lists of the latest quotes."""
    return M.highlights(X.quotes(spark, sf))


def _register_topk(category: str, column: str, asc: bool) -> None:
    @register(category, W(f"SELECT {_QCOLS}, rank FROM ({_topk_sql(category, column, asc)})", "quotes"))
    def q(spark: SparkSession, sf: str) -> DataFrame:
        return M.top_k(M.select_quote_columns(X.quotes(spark, sf)), column, asc, 5)


for _c, _col, _asc in M.HIGHLIGHT_LISTS:  # TOP-1..4
    _register_topk(_c, _col, _asc)


@register("select_quote_columns", W(f"SELECT {_QCOLS} FROM quotes", "quotes"))
def q_quotes(spark: SparkSession, sf: str) -> DataFrame:
    """PRJ-3 over the latest quote of every symbol."""
    return M.select_quote_columns(X.quotes(spark, sf))


@register("select_bar_columns", W(
    "SELECT trade_date AS CH_TIMESTAMP, symbol AS CH_SYMBOL, 'EQ' AS CH_SERIES, "
    "high AS CH_TRADE_HIGH_PRICE, low AS CH_TRADE_LOW_PRICE, open AS CH_OPENING_PRICE, "
    "close AS CH_CLOSING_PRICE, volume AS CH_TOT_TRADED_QTY, value AS CH_TOT_TRADED_VAL FROM bars",
    "bars"))
def q_select_bar_columns(spark: SparkSession, sf: str) -> DataFrame:
    """PRJ-1."""
    return M.select_bar_columns(X.bars(spark, sf))


@register("rename_ohlcv", W(
    "SELECT symbol, trade_date AS Date, high AS High, low AS Low, open AS Open, close AS Close, "
    "CAST(volume AS DOUBLE) AS Volume FROM bars", "bars"))
def q_rename_ohlcv(spark: SparkSession, sf: str) -> DataFrame:
    """PRJ-2."""
    return M.rename_ohlcv(X.bars(spark, sf))


@register("prefix_columns", W(
    "SELECT symbol, trade_date, high AS True_High, low AS True_Low, open AS True_Open, "
    "close AS True_Close, CAST(volume AS DOUBLE) AS True_Volume FROM bars", "bars"))
def q_prefix_columns(spark: SparkSession, sf: str) -> DataFrame:
    """PRJ-4: target columns get the ``True_`` prefix."""
    o = M.rename_ohlcv(X.bars(spark, sf)).withColumnRenamed("Date", "trade_date")
    return M.prefix_columns(o, "True_", FC.TARGETS)


@register("drop_columns", W("SELECT symbol, trade_date, open, close FROM bars", "bars"))
def q_drop_columns(spark: SparkSession, sf: str) -> DataFrame:
    """PRJ-5: all columns but some."""
    return M.drop_columns(X.bars(spark, sf), ["high", "low", "volume", "value"])


@register("tickers", W("SELECT DISTINCT symbol FROM companies", "companies"))
def q_tickers(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-1."""
    return M.tickers(X.companies(spark, sf))


_REQUESTS_SQL = ("SELECT DISTINCT lower(symbol) AS request FROM bars "
                 "UNION SELECT DISTINCT symbol AS request FROM companies "
                 "UNION SELECT DISTINCT symbol AS request FROM news")


def _requests(spark: SparkSession, sf: str) -> DataFrame:
    """Lookup requests derived from the data: lower-cased bar symbols, listed
    symbols and the news sources (unknown to the company list)."""
    b = X.bars(spark, sf).select(F.lower("symbol").alias("request"))
    c = X.companies(spark, sf).select(F.col("symbol").alias("request"))
    n = X.news(spark, sf).select(F.col("symbol").alias("request"))
    return b.union(c).union(n).distinct()


@register("company_lookup", W(
    f"WITH r AS ({_REQUESTS_SQL}), k AS (SELECT lower(symbol) AS k, count(*) AS n, "
    "min(company_name) AS name FROM companies GROUP BY lower(symbol)) "
    "SELECT r.request, CASE WHEN k.n = 1 THEN k.name ELSE 'na' END AS company_name "
    "FROM r LEFT JOIN k ON lower(r.request) = k.k", "bars", "companies", "news"))
def q_company_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """FLT-1 / SCA-8: case-insensitive, exactly one match, else 'na' (Q12)."""
    return M.company_lookup(_requests(spark, sf), X.companies(spark, sf))


@register("ticker_suggest", W(
    f"WITH h AS (SELECT symbol, instr(lower(symbol), '{SUGGEST_TEXT}') - 1 AS match_pos "
    f"FROM (SELECT DISTINCT symbol FROM companies) WHERE instr(lower(symbol), '{SUGGEST_TEXT}') > 0 "
    "ORDER BY symbol LIMIT 5) SELECT symbol, match_pos FROM h", "companies"))
def q_ticker_suggest(spark: SparkSession, sf: str) -> DataFrame:
    """FLT-8: first 5 alphabetical matches, then by match position (Q19)."""
    return M.ticker_suggest(X.companies(spark, sf), SUGGEST_TEXT)


@register("ticker_map_json", W(
    "SELECT '{' || string_agg('\"' || symbol || '\":null', ',' ORDER BY symbol) || '}' AS tickers_json "
    "FROM (SELECT DISTINCT symbol FROM companies)", "companies"))
def q_ticker_map_json(spark: SparkSession, sf: str) -> DataFrame:
    """SNK-5."""
    return M.ticker_map_json(X.companies(spark, sf))


@register("bars_in_range", W(
    f"SELECT * FROM bars WHERE trade_date > DATE '{RANGE_END}' - INTERVAL {RANGE_DAYS} DAY "
    f"AND trade_date <= DATE '{RANGE_END}' AND symbol NOT LIKE '%7'", "bars"))
def q_bars_in_range(spark: SparkSession, sf: str) -> DataFrame:
    """FLT-2: half-open date range (Q11) of one series over all symbols."""
    series = F.when(F.col("symbol").endswith("7"), "BE").otherwise("EQ")
    return M.bars_in_range(X.bars(spark, sf).withColumn("series", series), RANGE_END, RANGE_DAYS, "EQ").drop("series")


@register("missing_date_ranges", W(
    f"WITH cal AS (SELECT s.symbol, CAST(d AS DATE) AS trade_date FROM (SELECT DISTINCT symbol FROM bars) s, "
    f"generate_series(DATE '{RANGE_END}' - INTERVAL {RANGE_DAYS - 1} DAY, DATE '{RANGE_END}', INTERVAL 1 DAY) g(d)), "
    "m AS (SELECT * FROM cal WHERE NOT EXISTS (SELECT 1 FROM bars b WHERE b.symbol = cal.symbol "
    "AND b.trade_date = cal.trade_date)), "
    "r AS (SELECT symbol, trade_date, trade_date - CAST(row_number() OVER (PARTITION BY symbol ORDER BY trade_date) "
    "AS INTEGER) AS grp FROM m) "
    "SELECT symbol, min(trade_date) AS gap_start, max(trade_date) AS gap_end, count(*) AS gap_days "
    "FROM r GROUP BY symbol, grp", "bars"))
def q_missing_date_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-9: missing day runs in the requested window, per symbol."""
    b = X.bars(spark, sf)
    return M.missing_date_ranges(b, b.select("symbol").distinct(), RANGE_END, RANGE_DAYS)


@register("date_windows", W(
    "WITH q AS (SELECT symbol, max(trade_date) AS end_date, 100 AS days FROM bars GROUP BY symbol), "
    "e AS (SELECT q.*, w AS window_no, CASE WHEN w < days // 30 THEN 30 ELSE days % 30 END AS span "
    "FROM q, range(0, days // 30 + 1) t(w)) "
    "SELECT symbol, end_date, days, window_no, "
    "strftime(CAST(end_date - INTERVAL (window_no * 30) DAY - INTERVAL (span) DAY AS DATE), '%d-%m-%Y') AS from_text, "
    "strftime(CAST(end_date - INTERVAL (window_no * 30) DAY AS DATE), '%d-%m-%Y') AS to_text FROM e", "bars"))
def q_date_windows(spark: SparkSession, sf: str) -> DataFrame:
    """SCA-4: 100 days before each symbol's last bar, cut into 30-day windows."""
    req = X.bars(spark, sf).groupBy("symbol").agg(F.max("trade_date").alias("end_date")) \
        .withColumn("days", F.lit(100))
    return M.date_windows(req)


_UPSERT_SQL = W(
    "SELECT symbol, trade_date, high, low, open, close, volume, value, batch FROM ("
    "SELECT *, row_number() OVER (PARTITION BY symbol, trade_date ORDER BY batch DESC) AS rn "
    "FROM (SELECT * FROM bars_base UNION ALL SELECT * FROM bars_delta)) WHERE rn = 1",
    "bars_base", "bars_delta")


@register("keep_last_per_key", _UPSERT_SQL)
def q_keep_last(spark: SparkSession, sf: str) -> DataFrame:
    """WIN-3: the later batch wins on overlapping days."""
    return M.keep_last_per_key(X.bars_base(spark, sf).unionByName(X.bars_delta(spark, sf)),
                               ["symbol", "trade_date"])


@register("upsert_bars", W(
    "SELECT symbol, trade_date, high, low, open, close, volume, value FROM ("
    "SELECT *, row_number() OVER (PARTITION BY symbol, trade_date ORDER BY batch DESC) AS rn "
    "FROM (SELECT * FROM bars_base UNION ALL SELECT * FROM bars_delta)) WHERE rn = 1",
    "bars_base", "bars_delta"))
def q_upsert_bars(spark: SparkSession, sf: str) -> DataFrame:
    """SNK-1: write the base store, upsert the delta into the folders it touches, read it back."""
    store = S.write_yearly_store(X.bars_base(spark, sf).drop("batch"), scratch_path(spark, "bars-store"))
    S.upsert_yearly_store(spark, store, X.bars_delta(spark, sf))
    return S.read_yearly_store(spark, store).select(
        "symbol", "trade_date", "high", "low", "open", "close", "volume", "value")


@register("stack_bars", W("SELECT * FROM bars_base UNION ALL SELECT * FROM bars_delta",
                          "bars_base", "bars_delta"))
def q_stack_bars(spark: SparkSession, sf: str) -> DataFrame:
    """SET-1: union all of batches."""
    return M.stack([X.bars_base(spark, sf), X.bars_delta(spark, sf)])


@register("bars_newest_first", W("SELECT * FROM bars ORDER BY trade_date DESC, symbol", "bars"))
def q_bars_newest_first(spark: SparkSession, sf: str) -> DataFrame:
    """SRT-1."""
    return M.bars_newest_first(X.bars(spark, sf))


@register("last_rows", W(
    "SELECT symbol, trade_date, high, low, open, close, volume, value FROM (SELECT *, row_number() OVER "
    "(PARTITION BY symbol ORDER BY trade_date DESC) AS rn FROM bars) WHERE rn <= 20", "bars"))
def q_last_rows(spark: SparkSession, sf: str) -> DataFrame:
    """FLT-7: last 20 bars per symbol."""
    return M.last_rows(X.bars(spark, sf), 20)


@register("next_business_day", W(
    "SELECT symbol, max(trade_date) AS last_date, CAST(max(trade_date) + INTERVAL (CASE isodow(max(trade_date) + 1) "
    "WHEN 6 THEN 3 WHEN 7 THEN 2 ELSE 1 END) DAY AS DATE) AS next_date FROM bars GROUP BY symbol", "bars"))
def q_next_business_day(spark: SparkSession, sf: str) -> DataFrame:
    """SCA-3 on every symbol's last bar."""
    return M.next_trading_dates(X.bars(spark, sf))


@register("split_join_date", W(
    "SELECT symbol, trade_date, year(trade_date) AS Year, month(trade_date) AS Month, "
    "day(trade_date) AS Day, concat_ws('-', CAST(year(trade_date) AS VARCHAR), "
    "CAST(month(trade_date) AS VARCHAR), CAST(day(trade_date) AS VARCHAR)) AS date_text, "
    "CAST(CAST(year(trade_date) AS VARCHAR) AS INTEGER) AS year_again FROM bars", "bars"))
def q_split_join_date(spark: SparkSession, sf: str) -> DataFrame:
    """SCA-1 / SCA-2 / SCA-17: date -> ints -> unpadded text -> int."""
    b = X.bars(spark, sf)
    y, m, d = split_date(F.col("trade_date"))
    return b.select("symbol", "trade_date", y, m, d).select(
        "*", join_date(F.col("Year"), F.col("Month"), F.col("Day")).alias("date_text"),
        F.col("Year").cast("string").try_cast("int").alias("year_again"))


@register("preview", W("SELECT * FROM bars ORDER BY symbol, trade_date LIMIT 5", "bars"))
def q_preview(spark: SparkSession, sf: str) -> DataFrame:
    """TOP-6: first rows under an explicit order."""
    return M.preview(X.bars(spark, sf), ["symbol", "trade_date"], 5)


# ---------------------------------------------------------------- sources
@register("scan_companies", W("SELECT symbol, company_name FROM companies", "companies"))
def q_scan_companies(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-1: land the company list as header CSV, read it back with its schema."""
    path = S.write_csv(X.companies(spark, sf), scratch_path(spark, "companies-csv"))
    return S.scan_companies(spark, path)


@register("scan_symbol_bars", W("SELECT trade_date, high, low, open, close, volume, value, symbol "
                                "FROM bars WHERE symbol = 'S03'", "bars"))
def q_scan_symbol_bars(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-2: one symbol's bars from the partitioned store (partition pruning)."""
    path = S.write_bar_store(X.bars(spark, sf), scratch_path(spark, "bars-store"))
    return S.scan_symbol_bars(spark, path, "S03")


@register("scan_all_bars", W("SELECT trade_date, high, low, open, close, volume, value, symbol FROM bars",
                             "bars"))
def q_scan_all_bars(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-3: per-symbol CSV files, read and stacked in one scan."""
    b = X.bars(spark, sf).select(*[f.name for f in S.BAR_SCHEMA.fields])
    named = b.withColumn("file", F.concat("symbol", F.lit("_price.csv"))).drop("symbol")
    path = S.write_csv(named.repartitionByRange("file", "trade_date"), scratch_path(spark, "bars-csv"),
                       partition_by=["file"])
    return S.scan_all_bars(spark, path)


@register("scan_json_records", W(f"SELECT {_QCOLS} FROM quotes", "quotes"))
def q_scan_json_records(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-4: quotes landed as ``{"data": [...]}`` envelopes, exploded back to rows."""
    q = M.select_quote_columns(X.quotes(spark, sf))
    path = S.write_json_envelopes(q, scratch_path(spark, "quotes-json"), "symbol")
    return S.scan_json_records(spark, path)
