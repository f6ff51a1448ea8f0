"""Registered news queries (FLT-3/4/9/11, WIN-4, SCA-5/6/7/12/16, JOI-2/3, AGG-2, UDF-1, SNK-3, SRC-7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bourse.operators import market as M
from bourse.operators import news as N
from bourse.plans.registry import register
from bourse.session import scratch_path
from bourse.sources import files as S
from bourse.sources import fixtures as X
from bourse.sources.fixtures import oracle_with as W

TOPIC = "that"

_RANKED = ("ranked AS (SELECT *, CAST(rank AS VARCHAR) AS srno FROM (SELECT *, row_number() OVER "
           "(PARTITION BY symbol ORDER BY published_at DESC NULLS LAST, doc_id) AS rank FROM news "
           "WHERE length(title) > 30) WHERE rank <= 9)")


def _sql_list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_WORDS = "string_split_regex(lower(title), '[^a-z]+')"
_KEYWORD_LABEL = (
    f"CASE WHEN len(list_intersect({_WORDS}, {_sql_list(N.POSITIVE_WORDS)})) > "
    f"len(list_intersect({_WORDS}, {_sql_list(N.NEGATIVE_WORDS)})) THEN 'Positive' "
    f"WHEN len(list_intersect({_WORDS}, {_sql_list(N.NEGATIVE_WORDS)})) > "
    f"len(list_intersect({_WORDS}, {_sql_list(N.POSITIVE_WORDS)})) THEN 'Negative' ELSE 'Neutral' END")


def _clean_sql(label: str) -> str:
    return ("SELECT symbol, doc_id, srno, rank, title, "
            "CASE WHEN coalesce(link, '') = '' THEN '#' WHEN starts_with(link, 'https://') THEN link "
            "ELSE 'https://' || link END AS link, "
            f"'{N.MISSING_IMAGE}' AS img, "
            f"coalesce(nullif(strftime(published_at, '%Y-%m-%d %H:%M:%S'), ''), '{N.MISSING_DATE}') AS date, "
            f"coalesce(nullif(media, ''), '{N.MISSING_MEDIA}') AS media, {label} AS label FROM ranked")


def _ranked(spark: SparkSession, sf: str) -> DataFrame:
    return N.headline_rank(X.news(spark, sf))


@register("long_headlines", W("SELECT doc_id, symbol, title FROM news WHERE length(title) > 30", "news"))
def q_long_headlines(spark: SparkSession, sf: str) -> DataFrame:
    """FLT-3."""
    return N.long_headlines(X.news(spark, sf)).select("doc_id", "symbol", "title")


@register("headline_rank", W(f"WITH {_RANKED} SELECT symbol, doc_id, rank, srno FROM ranked", "news"))
def q_headline_rank(spark: SparkSession, sf: str) -> DataFrame:
    """WIN-4: newest 9 long titles per symbol."""
    return _ranked(spark, sf).select("symbol", "doc_id", "rank", "srno")


@register("clean_headlines", W(f"WITH {_RANKED} {_clean_sql('label')}", "news"))
def q_clean_headlines(spark: SparkSession, sf: str) -> DataFrame:
    """SCA-5 / SCA-6 / SCA-7: reply fields with defaults; labels kept from the input."""
    r = _ranked(spark, sf)
    return N.clean_headlines(r, predictor=lambda _t: F.col("label"))


@register("label_headlines", W(f"WITH {_RANKED} {_clean_sql(_KEYWORD_LABEL)}", "news"))
def q_label_headlines(spark: SparkSession, sf: str) -> DataFrame:
    """UDF-1: each kept title labelled by the predictor (keyword rule, JVM-side)."""
    return N.clean_headlines(_ranked(spark, sf), predictor=N.keyword_label)


@register("countable_labels", W(
    "SELECT doc_id, symbol, label FROM news WHERE label IN ('Positive', 'Neutral', 'Negative')", "news"))
def q_countable_labels(spark: SparkSession, sf: str) -> DataFrame:
    """FLT-4."""
    return N.countable_labels(X.news(spark, sf)).select("doc_id", "symbol", "label")


@register("map_labels", W(
    "SELECT doc_id, label, CASE label WHEN 'Positive' THEN 1 WHEN 'Neutral' THEN 0 "
    "WHEN 'Negative' THEN -1 END AS score FROM news", "news"))
def q_map_labels(spark: SparkSession, sf: str) -> DataFrame:
    """JOI-2: label -> code through a literal map (unmapped -> NULL)."""
    return X.news(spark, sf).select("doc_id", "label", N.label_score(F.col("label")).alias("score"))


_MOOD_SQL = ("SELECT symbol, round(coalesce(avg(CASE label WHEN 'Positive' THEN 1 WHEN 'Neutral' THEN 0 "
             "WHEN 'Negative' THEN -1 END), 0), 6) AS mood FROM ranked GROUP BY symbol")


@register("news_mood", W(f"WITH {_RANKED} {_MOOD_SQL}", "news"))
def q_news_mood(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-2: mood of the kept headlines per symbol (0 when nothing is countable)."""
    m = N.news_mood(_ranked(spark, sf))
    return m.select("symbol", F.round("mood", 6).alias("mood"))


@register("mood_gauge", W(
    f"WITH {_RANKED}, m AS ({_MOOD_SQL}) SELECT symbol, mood, CASE WHEN mood * 100 < -33.3 THEN 'red' "
    "WHEN mood * 100 > 33.3 THEN 'green' ELSE 'gray' END AS band FROM m", "news"))
def q_mood_gauge(spark: SparkSession, sf: str) -> DataFrame:
    """SCA-12."""
    m = N.news_mood(_ranked(spark, sf)).select("symbol", F.round("mood", 6).alias("mood"))
    return m.withColumn("band", N.mood_gauge(F.col("mood")))


@register("badge_colour", W(
    f"WITH {_RANKED} SELECT doc_id, label, CASE WHEN label = 'Positive' THEN 'green' "
    "WHEN label = 'Negative' THEN 'red' ELSE 'grey' END AS colour FROM ranked", "news"))
def q_badge_colour(spark: SparkSession, sf: str) -> DataFrame:
    """SCA-16."""
    return _ranked(spark, sf).select("doc_id", "label", N.badge_colour(F.col("label")).alias("colour"))


_LOOKUP_SQL = ("req AS (SELECT DISTINCT symbol AS request FROM news UNION SELECT DISTINCT symbol FROM companies), "
               "k AS (SELECT lower(symbol) AS k, count(*) AS n, min(company_name) AS name FROM companies "
               "GROUP BY lower(symbol)), "
               "res AS (SELECT req.request, CASE WHEN k.n = 1 THEN k.name ELSE 'na' END AS company_name "
               "FROM req LEFT JOIN k ON lower(req.request) = k.k)")
_ITEMS_SQL = (f"items AS (SELECT res.request AS symbol, c.doc_id, c.srno, c.rank, c.title, c.link, c.img, "
              f"c.date, c.media, c.label FROM res JOIN ({_clean_sql('label')}) c "
              f"ON lower(res.request) = lower(c.symbol) WHERE res.company_name <> 'na' "
              f"UNION ALL SELECT request, -1, '1', 1, '{N.NOT_FOUND_TITLE}', '{N.NOT_FOUND_LINK}', NULL, "
              f"'{N.NOT_FOUND_DATE}', '{N.NOT_FOUND_MEDIA}', '{N.NOT_FOUND_LABEL}' FROM res "
              f"WHERE res.company_name = 'na')")


def _requests(spark: SparkSession, sf: str) -> DataFrame:
    n = X.news(spark, sf).select(F.col("symbol").alias("request"))
    c = X.companies(spark, sf).select(F.col("symbol").alias("request"))
    return n.union(c).distinct()


def _company_items(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    resolved = M.company_lookup(_requests(spark, sf), X.companies(spark, sf))
    items = N.clean_headlines(_ranked(spark, sf), predictor=lambda _t: F.col("label"))
    return resolved, N.company_news(resolved, items)


@register("company_news", W(
    f"WITH {_RANKED}, {_LOOKUP_SQL}, {_ITEMS_SQL} SELECT symbol, doc_id, srno, title, link, date, media, "
    "label FROM items", "news", "companies"))
def q_company_news(spark: SparkSession, sf: str) -> DataFrame:
    """JOI-3 + FLT-9: request -> company -> its items; unknown request -> placeholder."""
    _res, items = _company_items(spark, sf)
    return items.select("symbol", "doc_id", "srno", "title", "link", "date", "media", "label")


@register("news_reply_json", W(
    f"WITH {_RANKED}, {_LOOKUP_SQL}, {_ITEMS_SQL}, "
    "mood AS (SELECT symbol, coalesce(avg(CASE label WHEN 'Positive' THEN 1 WHEN 'Neutral' THEN 0 "
    "WHEN 'Negative' THEN -1 END), 0) AS mood FROM items GROUP BY symbol), "
    "packed AS (SELECT symbol, list(struct_pack(srno := srno, title := title, date := date, media := media, "
    "link := link, label := label) ORDER BY rank) AS news FROM items GROUP BY symbol) "
    "SELECT p.symbol, CAST(to_json(struct_pack(name := CASE WHEN r.company_name = 'na' THEN p.symbol "
    "ELSE r.company_name END, mood := round(m.mood, 6), news := p.news)) AS VARCHAR) AS reply "
    "FROM packed p JOIN mood m ON m.symbol = p.symbol JOIN res r ON r.request = p.symbol",
    "news", "companies"))
def q_news_reply_json(spark: SparkSession, sf: str) -> DataFrame:
    """SNK-3: nested reply {name, mood, news[]} per requested symbol, as JSON text."""
    resolved, items = _company_items(spark, sf)
    names = resolved.select(F.col("request").alias("symbol"),
                            F.when(F.col("company_name") == "na", F.col("request"))
                            .otherwise(F.col("company_name")).alias("name"))
    return N.news_reply(items, names)


@register("news_reply_predicted", W(
    f"WITH {_RANKED}, items AS ({_clean_sql(_KEYWORD_LABEL)}), "
    "mood AS (SELECT symbol, coalesce(avg(CASE label WHEN 'Positive' THEN 1 WHEN 'Neutral' THEN 0 "
    "WHEN 'Negative' THEN -1 END), 0) AS mood FROM items GROUP BY symbol), "
    "packed AS (SELECT symbol, list(struct_pack(srno := srno, title := title, date := date, media := media, "
    "link := link, label := label) ORDER BY rank) AS news FROM items GROUP BY symbol) "
    "SELECT p.symbol, CAST(to_json(struct_pack(name := p.symbol, mood := round(m.mood, 6), news := p.news)) AS VARCHAR) "
    "AS reply FROM packed p JOIN mood m ON m.symbol = p.symbol", "news"))
def q_news_reply_predicted(spark: SparkSession, sf: str) -> DataFrame:
    """UDF-1 + AGG-2 + SNK-3: the kept headlines labelled first, the mood over these labels, one reply per symbol."""
    items = N.clean_headlines(_ranked(spark, sf), predictor=N.keyword_label)
    return N.news_reply(items, items.select("symbol", F.col("symbol").alias("name")).distinct())


@register("topic_news", W(
    f"SELECT doc_id, symbol, title, published_at FROM news WHERE length(title) > 30 "
    f"AND contains(lower(title), '{TOPIC}') ORDER BY published_at DESC NULLS LAST, doc_id LIMIT 9", "news"))
def q_topic_news(spark: SparkSession, sf: str) -> DataFrame:
    """FLT-11: headline list for a free-text topic (top-9 newest long titles mentioning it)."""
    n = N.long_headlines(X.news(spark, sf)).where(F.lower("title").contains(TOPIC.lower()))
    return N.news_newest_first(n).limit(9).select("doc_id", "symbol", "title", "published_at")


@register("news_newest_first", W(
    "SELECT doc_id, symbol, published_at FROM news ORDER BY published_at DESC NULLS LAST, doc_id", "news"))
def q_news_newest_first(spark: SparkSession, sf: str) -> DataFrame:
    """SRT-2."""
    return N.news_newest_first(X.news(spark, sf)).select("doc_id", "symbol", "published_at")


SCAN_DAYS = 30  # the study's period


@register("scan_news", W(
    "WITH u AS (SELECT * FROM news WHERE coalesce(doc_id % 3, 2) <> 0 UNION ALL "
    "SELECT * FROM news WHERE coalesce(doc_id % 3, 2) <> 1), "
    "e AS (SELECT max(published_at) AS as_of FROM news) "
    "SELECT doc_id, symbol, title, link, media, published_at, label FROM u, e WHERE published_at IS NULL OR "
    f"(published_at > as_of - INTERVAL {SCAN_DAYS} DAY AND published_at <= as_of)", "news"))
def q_scan_news(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-7: two overlapping landed result lists, which hold every item together, unioned, the 30 days
    before the newest item, newest first."""
    n = X.news(spark, sf)
    third = F.coalesce(F.col("doc_id") % 3, F.lit(2))          # an item without id is in both lists
    paths = [S.write_json(n.where(third != left_out), scratch_path(spark, f"news-{left_out}"))
             for left_out in (0, 1)]
    as_of = n.agg(F.max("published_at").cast("string")).first()[0]
    return S.scan_news(spark, paths, as_of, SCAN_DAYS)
