"""Market data: bars, quotes, top movers, company lookup, date ranges, upsert.

Scale notes
-----------
* ``bars`` has one row per (symbol, trade_date). The rows of one symbol are
  bounded by the trading calendar (about 250 a year), not by data volume, so
  windows partitioned by symbol stay small even for the busiest symbol.
* Top-k lists use ``orderBy().limit()`` -> TakeOrderedAndProject: each task
  keeps its k best rows, the driver merges k x tasks rows.
* Per-key "last row wins" uses ``max_by`` aggregates (partial aggregation
  before the shuffle) instead of ``dropDuplicates`` (which row survives is
  unspecified) or a window (ships every duplicate).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bourse.functions.dates import next_business_day

QUOTE_COLUMNS = ["symbol", "open", "day_high", "day_low", "last_price", "total_traded_volume",
                 "total_traded_value", "p_change", "year_high", "year_low"]


# ---------------------------------------------------------------- projections
def select_bar_columns(bars: DataFrame, series: str = "EQ") -> DataFrame:
    """PRJ-1: the nine exchange bar columns, in the exchange's order."""
    # The exchange's column names.
    return bars.select(
        F.col("trade_date").alias("CH_TIMESTAMP"),
        F.col("symbol").alias("CH_SYMBOL"),
        F.lit(series).alias("CH_SERIES"),
        F.col("high").alias("CH_TRADE_HIGH_PRICE"),
        F.col("low").alias("CH_TRADE_LOW_PRICE"),
        F.col("open").alias("CH_OPENING_PRICE"),
        F.col("close").alias("CH_CLOSING_PRICE"),
        F.col("volume").alias("CH_TOT_TRADED_QTY"),
        F.col("value").alias("CH_TOT_TRADED_VAL"),
    )


def rename_ohlcv(bars: DataFrame) -> DataFrame:
    """PRJ-2: Date/High/Low/Open/Close/Volume (symbol kept as key)."""
    return bars.select(
        "symbol",
        F.col("trade_date").alias("Date"),
        F.col("high").alias("High"),
        F.col("low").alias("Low"),
        F.col("open").alias("Open"),
        F.col("close").alias("Close"),
        F.col("volume").cast("double").alias("Volume"),
    )


def select_quote_columns(quotes: DataFrame) -> DataFrame:
    """PRJ-3: the ten quote columns."""
    return quotes.select(*QUOTE_COLUMNS)


def prefix_columns(df: DataFrame, prefix: str, columns: list[str]) -> DataFrame:
    """PRJ-4: rename ``columns`` to ``prefix + name``."""
    return df.withColumnsRenamed({c: prefix + c for c in columns})


def drop_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """PRJ-5: every column but ``columns``."""
    return df.drop(*columns)


def columns_by_type(df: DataFrame) -> dict[str, list[str]]:
    """PRJ-6: numeric (double) and text column names, from the schema only."""
    out: dict[str, list[str]] = {"numeric": [], "text": []}
    for f in df.schema.fields:
        t = f.dataType.typeName()
        if t in ("double", "float"):
            out["numeric"].append(f.name)
        elif t == "string":
            out["text"].append(f.name)
    return out


# ---------------------------------------------------------------- quotes / top-k
def latest_quotes(bars: DataFrame, year_bars: int = 250) -> DataFrame:
    """Last bar per symbol, % change vs the previous close, 250-bar high/low.

    ``row_number() <= year_bars`` is planned as WindowGroupLimit: each task
    keeps only the newest ``year_bars`` rows per symbol before the shuffle.
    The aggregate then reuses the window's partitioning (no 2nd exchange).
    """
    w = Window.partitionBy("symbol").orderBy(F.col("trade_date").desc())
    recent = bars.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= year_bars)
    agg = recent.groupBy("symbol").agg(
        F.min_by(F.struct("open", "high", "low", "close", "volume", "value"), "rn").alias("last"),
        F.max(F.when(F.col("rn") == 2, F.col("close"))).alias("prev_close"),
        F.max("high").alias("year_high"),
        F.min("low").alias("year_low"),
    )
    return agg.select(
        "symbol",
        F.col("last.open").alias("open"),
        F.col("last.high").alias("day_high"),
        F.col("last.low").alias("day_low"),
        F.col("last.close").alias("last_price"),
        F.col("last.volume").alias("total_traded_volume"),
        F.col("last.value").alias("total_traded_value"),
        (F.try_divide(F.col("last.close") - F.col("prev_close"), F.col("prev_close")) * 100).alias("p_change"),
        "year_high",
        "year_low",
    )


# The four highlight lists (category key, sort column, ascending).
HIGHLIGHT_LISTS = [
    ("top_losers", "p_change", True),
    ("top_gainers", "p_change", False),
    ("most_active_by_value", "total_traded_value", False),
    ("most_active_by_volume", "total_traded_volume", False),
]


def top_k(df: DataFrame, column: str, ascending: bool, k: int, tie: str = "symbol") -> DataFrame:
    """TOP-1..4: k rows by ``column`` (NULLs last), ties by ``tie``; adds ``rank``.

    ``orderBy().limit()`` plans as TakeOrderedAndProject (per-task top-k).
    The rank is numbered on those k rows only.
    """
    order = F.col(column).asc_nulls_last() if ascending else F.col(column).desc_nulls_last()
    best = df.orderBy(order, F.col(tie).asc()).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(order, F.col(tie).asc())))


def category_title(c: Column) -> Column:
    """SCA-13: ``most_active_by_value`` -> ``Most Active By Value``."""
    return F.initcap(F.regexp_replace(c, "_", " "))


def highlights(quotes: DataFrame, k: int = 5) -> DataFrame:
    """TOP-5: the four top-k lists in one long table (category, title, rank, quote)."""
    q = select_quote_columns(quotes)
    parts = [top_k(q, col, asc, k).withColumn("category", F.lit(cat))
             for cat, col, asc in HIGHLIGHT_LISTS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("category", category_title(F.col("category")).alias("title"), "rank",
                      *QUOTE_COLUMNS)


def preview(df: DataFrame, order: list[str], n: int = 5) -> DataFrame:
    """TOP-6: first ``n`` rows under an explicit order."""
    return df.orderBy(*order).limit(n)


# ---------------------------------------------------------------- companies
def tickers(companies: DataFrame) -> DataFrame:
    """AGG-1: distinct symbols."""
    return companies.select("symbol").distinct()


def company_lookup(requests: DataFrame, companies: DataFrame, request_col: str = "request") -> DataFrame:
    """FLT-1: symbol -> company name, case-insensitive; exactly one match else 'na'.

    Companies are reduced to one row per lower-cased symbol first (partial
    aggregation), then joined to the requests on that key.
    """
    by_key = companies.groupBy(F.lower("symbol").alias("_k")).agg(
        F.count(F.lit(1)).alias("_n"), F.min("company_name").alias("_name"))
    j = requests.join(by_key, F.lower(requests[request_col]) == by_key["_k"], "left")
    return j.select(*[requests[c] for c in requests.columns],
                    F.when(F.col("_n") == 1, F.col("_name")).otherwise(F.lit("na")).alias("company_name"))


def ticker_suggest(companies: DataFrame, typed: str, k: int = 5, min_chars: int = 2) -> DataFrame:
    """FLT-8: first ``k`` symbols (alphabetical) containing the typed text
    (case-insensitive), then ordered by match position; nothing under 2 chars."""
    q = typed.lower()
    t = tickers(companies)
    if len(typed) < min_chars:
        return t.where(F.lit(False)).select("symbol", F.lit(0).alias("match_pos"))
    hits = t.select("symbol", (F.instr(F.lower("symbol"), q) - 1).alias("match_pos")) \
        .where(F.col("match_pos") >= 0)
    first = hits.orderBy("symbol").limit(k)
    return first.orderBy("match_pos", "symbol")


def ticker_map_json(companies: DataFrame) -> DataFrame:
    """SNK-5: ``{"SYM": null, ...}`` over the distinct tickers, one row.

    The distinct step runs distributed; only the distinct ticker list (the
    size of an exchange's listing, a dimension table) is folded into one map.
    """
    t = tickers(companies)
    return t.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(
        F.struct(F.col("symbol"), F.lit(None).cast("string"))))),
        {"ignoreNullFields": "false"}).alias("tickers_json"))


# ---------------------------------------------------------------- date ranges
def bars_in_range(bars: DataFrame, end: str | Column, days: int, series: str | None = None) -> DataFrame:
    """FLT-2: ``trade_date > end - days and trade_date <= end`` (half open)."""
    end_c = F.lit(end).cast("date") if isinstance(end, str) else end
    cond = (F.col("trade_date") > F.date_sub(end_c, days)) & (F.col("trade_date") <= end_c)
    if series is not None and "series" in bars.columns:
        cond = cond & (F.col("series") == series)
    return bars.where(cond)


def missing_date_ranges(bars: DataFrame, symbols: DataFrame, end: str, days: int) -> DataFrame:
    """SRC-9: runs of calendar days in ``(end - days, end]`` absent from the store.

    Calendar per symbol via ``sequence`` + ``explode`` (bounded by ``days``),
    ``left_anti`` join to the stored days, then gaps-and-islands: a run is
    constant ``date - row_number`` within a symbol.
    """
    end_c = F.lit(end).cast("date")
    cal = symbols.select("symbol", F.explode(F.sequence(F.date_sub(end_c, days - 1), end_c)).alias("trade_date"))
    # only the asked range of the store is read (the filter reaches the scan)
    have = bars.where((F.col("trade_date") > F.date_sub(end_c, days)) & (F.col("trade_date") <= end_c)) \
        .select("symbol", "trade_date")
    missing = cal.join(have, ["symbol", "trade_date"], "left_anti")
    w = Window.partitionBy("symbol").orderBy("trade_date")
    runs = missing.withColumn("grp", F.date_sub(F.col("trade_date"), F.row_number().over(w)))
    return runs.groupBy("symbol", "grp").agg(
        F.min("trade_date").alias("gap_start"), F.max("trade_date").alias("gap_end"),
        F.count(F.lit(1)).alias("gap_days")).drop("grp")


def date_windows(requests: DataFrame, end_col: str = "end_date", days_col: str = "days",
                 width: int = 30) -> DataFrame:
    """SCA-4: cut the last ``days`` before ``end`` into 30-day windows plus the rest,
    newest first; window i+1 ends where window i starts; ``dd-MM-yyyy`` text."""
    n = (F.col(days_col) / width).cast("int")
    idx = F.sequence(F.lit(0), n)
    e = requests.select("*", F.posexplode(idx).alias("window_no", "_i"))
    to_ = F.date_sub(F.col(end_col), F.col("window_no") * width)
    span = F.when(F.col("window_no") < n, F.lit(width)).otherwise(F.col(days_col) % width)
    from_ = F.date_sub(to_, span)
    return e.select(*requests.columns, "window_no",
                    F.date_format(from_, "dd-MM-yyyy").alias("from_text"),
                    F.date_format(to_, "dd-MM-yyyy").alias("to_text"))


# ---------------------------------------------------------------- upsert
def keep_last_per_key(df: DataFrame, keys: list[str], order_col: str = "batch") -> DataFrame:
    """WIN-3: of several rows per key keep the one with the highest ``order_col``.

    ``max_by`` over a struct of the remaining columns: partial aggregation
    before the shuffle, so a key repeated in many batches ships one row per task.
    """
    rest = [c for c in df.columns if c not in keys]
    agg = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order_col)).alias("_last"))
    return agg.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest])


def upsert_bars(store: DataFrame, delta: DataFrame, keys: tuple[str, ...] = ("symbol", "trade_date"),
                order_col: str = "batch") -> DataFrame:
    """SNK-1 (logical part): union the batch into the store, last arrival wins.

    An empty delta leaves the store unchanged (Q2); duplicates are always
    removed (Q3). ``bourse.sources.files.upsert_bar_store`` writes it.
    """
    both = store.unionByName(delta.select(*store.columns))
    return keep_last_per_key(both, list(keys), order_col)


def stack(frames: list[DataFrame]) -> DataFrame:
    """SET-1: union all by name."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def bars_newest_first(bars: DataFrame) -> DataFrame:
    """SRT-1: order by date descending (symbol for ties)."""
    return bars.orderBy(F.col("trade_date").desc(), F.col("symbol"))


def last_rows(bars: DataFrame, n: int) -> DataFrame:
    """FLT-7: last ``n`` bars per symbol (WindowGroupLimit: partial top-n before the shuffle)."""
    w = Window.partitionBy("symbol").orderBy(F.col("trade_date").desc())
    return bars.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def next_trading_dates(bars: DataFrame) -> DataFrame:
    """SCA-3 on the last known date of every symbol."""
    last = bars.groupBy("symbol").agg(F.max("trade_date").alias("last_date"))
    return last.select("symbol", "last_date", next_business_day(F.col("last_date")).alias("next_date"))
