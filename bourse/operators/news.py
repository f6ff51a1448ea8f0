"""Headlines: clean-up, ranking, labelling, mood and the nested reply.

Everything is a per-row expression or a per-symbol aggregate:
* ranking keeps 9 items per symbol with ``row_number() <= 9``, planned as
  WindowGroupLimit (each task ships at most 9 rows per symbol, so a symbol
  with a third of all items does not land whole in one task);
* mood is ``avg`` (partial aggregation before the shuffle);
* the nested reply collects at most 9 items per symbol.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the reply format.
MAX_HEADLINES = 9
MIN_TITLE_CHARS = 30
LINK_SCHEME = "https://"
MISSING_LINK = "#"
MISSING_IMAGE = "/static/sample_img.jpeg"
MISSING_DATE = "Date Not Specified"
MISSING_MEDIA = "Unknown source"  # the reference shows its own app name here
LABEL_SCORE = {"Positive": 1, "Neutral": 0, "Negative": -1}
NOT_FOUND_TITLE = ("Unable to find news related requested symbol. "
                   "Please verify if this symbol is listed in NSE.")
NOT_FOUND_DATE = "No News Found."
NOT_FOUND_MEDIA = "NSE"
NOT_FOUND_LINK = "https://www.nseindia.com/"
NOT_FOUND_LABEL = "na"
DATE_FORMAT = "yyyy-MM-dd HH:mm:ss"

# Keyword rule standing in for a trained sentiment model (UDF-1 default).
POSITIVE_WORDS = ["gain", "gains", "growth", "profit", "rise", "rises", "strong", "good", "best", "up"]
NEGATIVE_WORDS = ["loss", "losses", "fall", "falls", "weak", "bad", "worst", "drop", "down", "risk"]


def clean_link(c: Column, missing: str = MISSING_LINK) -> Column:
    """SCA-5: empty -> default; prefix ``https://`` unless already there (Q8)."""
    return (F.when(F.coalesce(c, F.lit("")) == "", F.lit(missing))
            .when(c.startswith(LINK_SCHEME), c)
            .otherwise(F.concat(F.lit(LINK_SCHEME), c)))


def text_default(c: Column, default: str) -> Column:
    """SCA-6: NULL or empty -> default text."""
    return F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit(default))


def long_headlines(news: DataFrame, min_chars: int = MIN_TITLE_CHARS) -> DataFrame:
    """FLT-3: title longer than 30 characters."""
    return news.where(F.length("title") > min_chars)


def news_newest_first(news: DataFrame) -> DataFrame:
    """SRT-2: newest first, undated last, id as tie-breaker."""
    return news.orderBy(F.col("published_at").desc_nulls_last(), F.col("doc_id"))


def headline_rank(news: DataFrame, k: int = MAX_HEADLINES, group: str = "symbol") -> DataFrame:
    """WIN-4: keep the newest ``k`` long titles per group; ``srno`` = rank as text."""
    w = Window.partitionBy(group).orderBy(F.col("published_at").desc_nulls_last(), F.col("doc_id"))
    ranked = long_headlines(news).withColumn("rank", F.row_number().over(w))
    return ranked.where(F.col("rank") <= k).withColumn("srno", F.col("rank").cast("string"))


def keyword_label(title: Column) -> Column:
    """UDF-1 default predictor: a word rule (JVM-side, no Python per row)."""
    words = F.split(F.lower(title), "[^a-z]+")
    pos = F.size(F.array_intersect(words, F.array(*[F.lit(w) for w in POSITIVE_WORDS])))
    neg = F.size(F.array_intersect(words, F.array(*[F.lit(w) for w in NEGATIVE_WORDS])))
    return F.when(pos > neg, "Positive").when(neg > pos, "Negative").otherwise("Neutral")


def clean_headlines(ranked: DataFrame, predictor=None) -> DataFrame:
    """SCA-5/6/7 + UDF-1: the reply fields of each kept item.

    ``predictor`` maps a title Column to a label Column (built-in expression
    or a pandas UDF); ``None`` keeps the label 'n/a' as the reference does.
    """
    label = predictor(F.col("title")) if predictor is not None else F.lit("n/a")
    return ranked.select(
        "symbol", "doc_id", "srno", "rank", "title",
        clean_link(F.col("link")).alias("link"),
        clean_link(F.lit(None).cast("string"), MISSING_IMAGE).alias("img"),
        text_default(F.date_format("published_at", DATE_FORMAT), MISSING_DATE).alias("date"),
        text_default(F.col("media"), MISSING_MEDIA).alias("media"),
        label.alias("label"),
    )


def label_score(label: Column) -> Column:
    """JOI-2: label -> +1/0/-1 through a literal map; unknown -> NULL."""
    m = F.create_map(*[x for k, v in LABEL_SCORE.items() for x in (F.lit(k), F.lit(v))])
    return m[label]


def countable_labels(news: DataFrame) -> DataFrame:
    """FLT-4: items whose label is in the label map (Q7)."""
    return news.where(F.col("label").isin(list(LABEL_SCORE)))


def news_mood(items: DataFrame, group: str = "symbol") -> DataFrame:
    """AGG-2: mean label score over countable items, 0 when none (avg skips NULL)."""
    return items.groupBy(group).agg(F.coalesce(F.avg(label_score(F.col("label"))), F.lit(0.0)).alias("mood"))


def mood_gauge(mood: Column) -> Column:
    """SCA-12: mood x 100 into red / gray / green bands at -33.3 and 33.3."""
    v = mood * 100
    return F.when(v < -33.3, "red").when(v > 33.3, "green").otherwise("gray")


def badge_colour(label: Column) -> Column:
    """SCA-16: label -> badge colour."""
    return F.when(label == "Positive", "green").when(label == "Negative", "red").otherwise("grey")


def placeholder_items(requests: DataFrame, key: str = "request") -> DataFrame:
    """The one fixed 'not found' item for each unknown request (FLT-9)."""
    return requests.select(
        F.col(key).alias("symbol"), F.lit(-1).cast("bigint").alias("doc_id"), F.lit("1").alias("srno"),
        F.lit(1).alias("rank"), F.lit(NOT_FOUND_TITLE).alias("title"), F.lit(NOT_FOUND_LINK).alias("link"),
        F.lit(None).cast("string").alias("img"), F.lit(NOT_FOUND_DATE).alias("date"),
        F.lit(NOT_FOUND_MEDIA).alias("media"), F.lit(NOT_FOUND_LABEL).alias("label"))


def company_news(resolved: DataFrame, items: DataFrame, key: str = "request") -> DataFrame:
    """JOI-3 + FLT-9: known requests get their items; unknown ('na') get the placeholder.

    ``resolved`` has (request, company_name) from :func:`company_lookup`.
    Items are joined on the lower-cased request (equi join, both sides
    reduced to <= 9 items per key first).
    """
    known = resolved.where(F.col("company_name") != "na")
    unknown = resolved.where(F.col("company_name") == "na")
    found = known.join(items, F.lower(known[key]) == F.lower(items["symbol"]), "inner") \
        .select(known[key].alias("symbol"), *[items[c] for c in items.columns if c != "symbol"])
    return found.unionByName(placeholder_items(unknown, key))


def news_reply(items: DataFrame, names: DataFrame) -> DataFrame:
    """SNK-3: one JSON document per symbol: {name, mood, news:[...] by srno}.

    ``names`` maps symbol -> display name. Items are at most 9 per symbol,
    so the collected array is bounded.
    """
    mood = news_mood(items)
    packed = items.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct(
        F.col("rank"), F.col("srno"), F.col("title"), F.col("date"), F.col("media"),
        F.col("link"), F.col("label")))).alias("news"))
    j = packed.join(mood, "symbol").join(names, "symbol", "left")
    news = F.transform("news", lambda x: x.dropFields("rank"))
    return j.select("symbol", F.to_json(F.struct(
        F.coalesce(F.col("name"), F.col("symbol")).alias("name"),
        F.round("mood", 6).alias("mood"), news.alias("news"))).alias("reply"))
