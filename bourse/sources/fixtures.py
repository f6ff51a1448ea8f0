"""Stand-in inputs derived from the driver tables (FIXTURES.md §C).

Each fixture exists twice: a Spark builder (DataFrame code, written for
the plan we want at scale) and a SQL text for the independent oracle. SQL
templates name base tables as ``{lineitem}``; Spark binds DataFrames to
them through ``spark.sql(text, lineitem=df)``, the oracle binds plain names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bourse.sources.tables import TABLES, table

# --------------------------------------------------------------------------
# Oracle / template SQL (FIXTURES.md §C). Runs unchanged in DuckDB.
# --------------------------------------------------------------------------
BARS_SQL = """
WITH t AS (
  SELECT concat('S', lpad(CAST(l_suppkey % 20 AS STRING), 2, '0')) AS symbol,
         CAST(l_shipdate AS DATE) AS trade_date, l_extendedprice / l_quantity AS px,
         l_quantity AS q, l_extendedprice AS v, l_orderkey, l_linenumber, l_partkey
  FROM {lineitem}),
r AS (
  SELECT *,
    row_number() OVER (PARTITION BY symbol, trade_date
      ORDER BY l_orderkey, l_linenumber, l_partkey, v, q) AS rn,
    row_number() OVER (PARTITION BY symbol, trade_date
      ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, v DESC, q DESC) AS rd
  FROM t)
SELECT symbol, trade_date, max(px) AS high, min(px) AS low,
       max(CASE WHEN rn = 1 THEN px END) AS open, max(CASE WHEN rd = 1 THEN px END) AS close,
       CAST(sum(q) AS BIGINT) AS volume,
       CAST(sum(CAST(v AS DECIMAL(18, 2))) AS DOUBLE) AS value
FROM r GROUP BY symbol, trade_date
"""

BARS_BASE_SQL = "SELECT *, 0 AS batch FROM bars WHERE trade_date < DATE '1998-01-10'"

BARS_DELTA_SQL = """
SELECT symbol, trade_date, high, low, open, close * 1.01 AS close, volume, value, 1 AS batch
FROM bars WHERE trade_date >= DATE '1998-01-01'
"""

QUOTES_SQL = """
WITH w AS (
  SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY trade_date) AS prev_close,
    row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) AS rn,
    max(high) OVER (PARTITION BY symbol ORDER BY trade_date
      ROWS BETWEEN 249 PRECEDING AND CURRENT ROW) AS year_high,
    min(low) OVER (PARTITION BY symbol ORDER BY trade_date
      ROWS BETWEEN 249 PRECEDING AND CURRENT ROW) AS year_low
  FROM bars)
SELECT symbol, open, high AS day_high, low AS day_low, close AS last_price,
       volume AS total_traded_volume, value AS total_traded_value,
       (close - prev_close) / prev_close * 100 AS p_change, year_high, year_low
FROM w WHERE rn = 1
"""

COMPANIES_SQL = """
SELECT concat('S', lpad(CAST(CASE WHEN s_suppkey < 25 THEN s_suppkey ELSE 20 + s_suppkey % 5 END AS STRING), 2, '0')) AS symbol,
       s_name AS company_name
FROM {supplier}
"""

NEWS_SQL = """
SELECT d.doc_id, d.source AS symbol, split_part(d.text, chr(10), 1) AS title,
  CASE WHEN d.doc_id % 7 = 0 THEN NULL
       WHEN d.doc_id % 7 = 1 THEN replace(replace(p.url, 'https://', ''), 'http://', '')
       ELSE p.url END AS link,
  CASE WHEN d.doc_id % 11 = 0 THEN '' ELSE d.source END AS media,
  CASE WHEN d.doc_id % 13 = 0 THEN NULL ELSE e.ts END AS published_at,
  CASE WHEN l.doc_id IS NULL THEN 'n/a' WHEN l.toxic = 1 THEN 'Negative'
       WHEN l.quality = 1 THEN 'Positive' ELSE 'Neutral' END AS label
FROM {documents} d
LEFT JOIN {labels} l ON l.doc_id = d.doc_id
LEFT JOIN {events} e ON e.event_id = d.doc_id
LEFT JOIN {pages} p ON p.page_id = d.doc_id % (SELECT count(*) FROM {pages})
"""

SENTENCES_SQL = "SELECT doc_id, title AS text, label FROM news WHERE label <> 'n/a'"

PAIRS_SQL = """
SELECT u.conv_id, u.turn, u.text AS reference_text, a.text AS candidate_text
FROM {conversations} u
JOIN {conversations} a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
WHERE u.role = 'user' AND a.role = 'assistant'
"""

TAB_SQL = """
SELECT o.o_orderkey AS row_id,
  CASE WHEN o.o_orderkey % 17 = 0 THEN NULL ELSE o.o_totalprice END AS total_price,
  CASE WHEN o.o_orderkey % 19 = 0 THEN NULL ELSE c.c_acctbal END AS acct_bal,
  CAST(month(o.o_orderdate) AS DOUBLE) AS order_month,
  CASE WHEN o.o_orderkey % 23 = 0 THEN NULL ELSE r.r_name END AS region,
  CASE WHEN o.o_orderkey % 29 = 0 THEN NULL ELSE o.o_orderstatus END AS age_like,
  CASE WHEN o.o_orderkey % 31 = 0 THEN NULL ELSE o.o_orderpriority END AS health_like,
  CASE WHEN o.o_orderkey % 37 = 0 THEN NULL ELSE c.c_mktsegment END AS checkup_like,
  CASE WHEN o.o_totalprice > 300000 AND (o.o_orderpriority = '1-URGENT' OR c.c_acctbal < 0)
       THEN 'Yes' ELSE 'No' END AS target
FROM {orders} o
JOIN {customer} c ON c.c_custkey = o.o_custkey
JOIN {nation} n ON n.n_nationkey = c.c_nationkey
JOIN {region} r ON r.r_regionkey = n.n_regionkey
"""

TRAINING_BARS_SQL = """
SELECT symbol, trade_date, CASE WHEN dayofmonth(trade_date) = 13 THEN NULL ELSE open END AS Open,
       close AS Close, high AS High, low AS Low, CAST(volume AS DOUBLE) AS Volume
FROM bars
"""

# name -> (sql template, fixtures it reads)
FIXTURE_SQL = {
    "bars": (BARS_SQL, ()),
    "bars_base": (BARS_BASE_SQL, ("bars",)),
    "bars_delta": (BARS_DELTA_SQL, ("bars",)),
    "quotes": (QUOTES_SQL, ("bars",)),
    "companies": (COMPANIES_SQL, ()),
    "news": (NEWS_SQL, ()),
    "sentences": (SENTENCES_SQL, ("news",)),
    "pairs": (PAIRS_SQL, ()),
    "tab": (TAB_SQL, ()),
    "training_bars": (TRAINING_BARS_SQL, ("bars",)),
}

_PLAIN = {t: t for t in TABLES}


def oracle_with(body: str, *names: str) -> str:
    """``WITH`` clause holding the named fixtures (and what they read) + body."""
    order: list[str] = []

    def visit(n: str) -> None:
        for dep in FIXTURE_SQL[n][1]:
            visit(dep)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    if not order:
        return body
    ctes = ",\n".join(f"{n} AS ({FIXTURE_SQL[n][0].format(**_PLAIN).strip()})" for n in order)
    stripped = body.lstrip()
    if stripped[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {ctes},\n{stripped[15:]}"
    if stripped[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{stripped[5:]}"
    return f"WITH {ctes}\n{body}"


# --------------------------------------------------------------------------
# Spark builders
# --------------------------------------------------------------------------
def _sql(spark: SparkSession, sf_dir: str, text: str, **extra: DataFrame) -> DataFrame:
    args = {n: table(spark, sf_dir, n) for n in TABLES if "{" + n + "}" in text}
    args.update(extra)
    return spark.sql(text, **args)


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily OHLCV bars per symbol.

    One aggregate on (symbol, trade_date) with partial aggregation before the
    shuffle: open/close are ``min_by``/``max_by`` over the tie-broken arrival
    order (a window per (symbol, day) would ship every row of a hot symbol).
    The order is a struct, so Spark sorts each task's rows for it
    (SortAggregate): (orderkey, linenumber) alone is not unique here.
    """
    li = table(spark, sf_dir, "lineitem")
    t = li.select(
        F.concat(F.lit("S"), F.lpad((F.col("l_suppkey") % 20).cast("string"), 2, "0")).alias("symbol"),
        F.col("l_shipdate").cast("date").alias("trade_date"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("px"),
        F.col("l_quantity").alias("q"),
        F.col("l_extendedprice").alias("v"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity").alias("arrival"),
    )
    return t.groupBy("symbol", "trade_date").agg(
        F.max("px").alias("high"),
        F.min("px").alias("low"),
        F.min_by("px", "arrival").alias("open"),
        F.max_by("px", "arrival").alias("close"),
        F.sum("q").cast("bigint").alias("volume"),
        F.sum(F.col("v").cast("decimal(18,2)")).cast("double").alias("value"),
    )


def bars_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(spark, sf_dir).where(F.col("trade_date") < F.lit("1998-01-10").cast("date")) \
        .withColumn("batch", F.lit(0))


def bars_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars(spark, sf_dir).where(F.col("trade_date") >= F.lit("1998-01-01").cast("date"))
    return b.select("symbol", "trade_date", "high", "low", "open",
                    (F.col("close") * 1.01).alias("close"), "volume", "value",
                    F.lit(1).alias("batch"))


def quotes(spark: SparkSession, sf_dir: str, bars_df: DataFrame | None = None) -> DataFrame:
    """Last bar per symbol, change against the previous close, 250-bar range."""
    from bourse.operators.market import latest_quotes

    return latest_quotes(bars_df if bars_df is not None else bars(spark, sf_dir))


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, COMPANIES_SQL)


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles are cut out before the joins, so no whole text is shuffled (the first line of a first line is itself)."""
    title = F.split_part(F.col("text"), F.lit("\n"), F.lit(1)).alias("text")
    return _sql(spark, sf_dir, NEWS_SQL, documents=table(spark, sf_dir, "documents").select("doc_id", "source", title))


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return news(spark, sf_dir).where(F.col("label") != "n/a") \
        .select("doc_id", F.col("title").alias("text"), "label")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, PAIRS_SQL)


def tab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, TAB_SQL)


def training_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OHLCV training input; Open is missing on the 13th of each month (FLT-5 cases)."""
    b = bars(spark, sf_dir)
    return b.select("symbol", "trade_date",
                    F.when(F.dayofmonth("trade_date") == 13, F.lit(None)).otherwise(F.col("open")).alias("Open"),
                    F.col("close").alias("Close"), F.col("high").alias("High"), F.col("low").alias("Low"),
                    F.col("volume").cast("double").alias("Volume"))
