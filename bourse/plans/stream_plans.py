"""Registered streaming jobs (STR-1..3): land files, drain with availableNow, read the sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bourse.plans.registry import register
from bourse.session import scratch_path
from bourse.sources import files as S
from bourse.sources import fixtures as X
from bourse.sources.fixtures import oracle_with as W
from bourse.streaming import streams as ST

# Two lists that overlap in a third of the items, whatever their dates.
_NEWS_AB = ("u AS (SELECT * FROM news WHERE doc_id % 3 <> 0 UNION ALL SELECT * FROM news WHERE doc_id % 3 <> 1)")
FILES_PER_BATCH = 1


def _land_news(spark: SparkSession, sf: str) -> str:
    """Two overlapping result lists landed as JSON files in one folder."""
    n = X.news(spark, sf)
    landing = scratch_path(spark, "news-landing")
    for left_out in (0, 1):
        (n.where(F.col("doc_id") % 3 != left_out).write.mode("append").option("timestampNTZFormat", S.TS_FORMAT)
         .option("timestampFormat", S.TS_FORMAT).json(landing))
    return landing


@register("stream_upsert_bars", W(
    "SELECT symbol, trade_date, high, low, open, close, volume, value, batch FROM ("
    "SELECT *, row_number() OVER (PARTITION BY symbol, trade_date ORDER BY batch DESC) AS rn "
    "FROM (SELECT * FROM bars_base UNION ALL SELECT * FROM bars_delta)) WHERE rn = 1",
    "bars_base", "bars_delta"))
def q_stream_upsert_bars(spark: SparkSession, sf: str) -> DataFrame:
    """STR-1: two landings of bar files, upserted micro-batch by micro-batch, each compacted in its level."""
    landing, out = scratch_path(spark, "bars-landing"), scratch_path(spark, "bars-stream-out")
    progress, compacted = scratch_path(spark, "bars-stream-ckpt"), scratch_path(spark, "bars-compacted")
    for part in (X.bars_base(spark, sf), X.bars_delta(spark, sf)):
        part.withColumn("batch", F.col("batch").cast("int")).write.mode("append").parquet(landing)
        ST.stream_upsert_bars(spark, landing, out, progress, files_per_batch=FILES_PER_BATCH)
        ST.compact_upserted_bars(spark, out, compacted)
    return ST.read_upserted_bars(spark, out, compacted)


@register("stream_news_mood", W(
    f"WITH {_NEWS_AB} SELECT symbol, CAST(published_at AS DATE) AS day, "
    "round(coalesce(avg(CASE label WHEN 'Positive' THEN 1 WHEN 'Neutral' THEN 0 WHEN 'Negative' THEN -1 END), 0), 6) "
    "AS mood, count(*) AS items FROM u GROUP BY 1, 2", "news"))
def q_stream_news_mood(spark: SparkSession, sf: str) -> DataFrame:
    """STR-2: daily mood per symbol from a news file stream, undated items included."""
    return ST.stream_news_mood(spark, _land_news(spark, sf), scratch_path(spark, "mood-stream-out"),
                               scratch_path(spark, "mood-stream-ckpt"), FILES_PER_BATCH)


@register("stream_first_seen_news", W(
    f"WITH {_NEWS_AB}, r AS (SELECT *, row_number() OVER (PARTITION BY link ORDER BY published_at IS NULL, "
    "published_at, doc_id) AS rn FROM u) SELECT link, doc_id, symbol, title, published_at FROM r WHERE rn = 1", "news"))
def q_stream_first_seen_news(spark: SparkSession, sf: str) -> DataFrame:
    """STR-3: every link once, with the item that is kept."""
    return ST.stream_first_seen_news(spark, _land_news(spark, sf), scratch_path(spark, "seen-stream-out"),
                                     scratch_path(spark, "seen-stream-ckpt"), FILES_PER_BATCH).select(
        "link", "doc_id", "symbol", "title", "published_at")
