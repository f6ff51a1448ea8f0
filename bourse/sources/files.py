"""File sources and sinks (SRC-1..8, SNK-1 writing part).

Every reader declares its schema (no inference pass, no drift). Writers of the
bar store never overwrite a path that is being read: a version goes to new
folders, and readers are pointed at it in one step afterwards (``versions``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bourse.operators.market import keep_last_per_key
from bourse.sources.versions import publish, published, remove

COMPANY_SCHEMA = T.StructType([
    T.StructField("symbol", T.StringType()),
    T.StructField("company_name", T.StringType()),
])

BAR_SCHEMA = T.StructType([
    T.StructField("trade_date", T.DateType()),
    T.StructField("high", T.DoubleType()),
    T.StructField("low", T.DoubleType()),
    T.StructField("open", T.DoubleType()),
    T.StructField("close", T.DoubleType()),
    T.StructField("volume", T.LongType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("symbol", T.StringType()),
])

QUOTE_SCHEMA = T.StructType([
    T.StructField("symbol", T.StringType()),
    T.StructField("open", T.DoubleType()),
    T.StructField("day_high", T.DoubleType()),
    T.StructField("day_low", T.DoubleType()),
    T.StructField("last_price", T.DoubleType()),
    T.StructField("total_traded_volume", T.LongType()),
    T.StructField("total_traded_value", T.DoubleType()),
    T.StructField("p_change", T.DoubleType()),
    T.StructField("year_high", T.DoubleType()),
    T.StructField("year_low", T.DoubleType()),
])

ENVELOPE_SCHEMA = T.StructType([T.StructField("data", T.ArrayType(QUOTE_SCHEMA))])

LABELLED_TEXT_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("label", T.StringType()),
])

NEWS_ITEM_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("symbol", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("link", T.StringType()),
    T.StructField("media", T.StringType()),
    T.StructField("published_at", T.TimestampNTZType()),
    T.StructField("label", T.StringType()),
])

SURVEY_SCHEMA = T.StructType([
    T.StructField("row_id", T.LongType()),
    T.StructField("total_price", T.DoubleType()),
    T.StructField("acct_bal", T.DoubleType()),
    T.StructField("order_month", T.DoubleType()),
    T.StructField("region", T.StringType()),
    T.StructField("age_like", T.StringType()),
    T.StructField("health_like", T.StringType()),
    T.StructField("checkup_like", T.StringType()),
    T.StructField("target", T.StringType()),
])


# ---------------------------------------------------------------- CSV
def write_csv(df: DataFrame, path: str, partition_by: list[str] | None = None) -> str:
    w = df.write.mode("overwrite").option("header", True).option("escape", '"')
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.csv(path)
    return path


def scan_csv(spark: SparkSession, path: str, schema: T.StructType, multiline: bool = False) -> DataFrame:
    """Header CSV with a declared schema; quoted fields may hold commas/quotes/newlines."""
    return (spark.read.schema(schema).option("header", True).option("escape", '"')
            .option("multiLine", multiline).option("mode", "PERMISSIVE").csv(path))


def scan_companies(spark: SparkSession, path: str) -> DataFrame:
    """SRC-1: company list with header."""
    return scan_csv(spark, path, COMPANY_SCHEMA)


def scan_labelled_text(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """SRC-5: ``doc_id,text,label`` CSV.

    ``multiline`` allows line ends inside quoted text, but makes each file one
    task; without it files are split.
    """
    return scan_csv(spark, path, LABELLED_TEXT_SCHEMA, multiline=multiline)


def scan_survey(spark: SparkSession, path: str) -> DataFrame:
    """SRC-8: the mixed numeric / category table."""
    return scan_csv(spark, path, SURVEY_SCHEMA)


def scan_text_pairs(df_or_path, spark: SparkSession | None = None,
                    columns: tuple[str, str] = ("reference_text", "candidate_text")) -> DataFrame:
    """SRC-6: keep the two text columns (plus keys) of a text/summary table."""
    df = spark.read.parquet(df_or_path) if isinstance(df_or_path, str) else df_or_path
    keys = [c for c in df.columns if c not in columns and not c.endswith("_text")]
    return df.select(*keys, *columns)


# ---------------------------------------------------------------- bar store
def write_bar_store(bars: DataFrame, path: str, files_per_symbol_hint: int | None = None) -> str:
    """Write bars partitioned by symbol (SNK-1 write, SRC-2 layout).

    ``repartitionByRange(symbol, trade_date)`` splits a busy symbol over
    several tasks (no single writer for a hot key) and keeps each file's
    dates contiguous, so min/max statistics prune date filters.
    """
    n = files_per_symbol_hint or bars.sparkSession.sparkContext.defaultParallelism
    (bars.select(*[f.name for f in BAR_SCHEMA.fields])
     .repartitionByRange(n, "symbol", "trade_date")
     .sortWithinPartitions("symbol", "trade_date")
     .write.mode("overwrite").partitionBy("symbol").parquet(path))
    return path


def _yearly(bars: DataFrame) -> DataFrame:
    return bars.withColumn("year", F.year("trade_date"))


def _write_version(bars: DataFrame, path: str, version: int) -> None:
    """Folders of one version: newest first inside a file. An unpublished try of the same number is replaced."""
    n = bars.sparkSession.sparkContext.defaultParallelism
    (bars.repartitionByRange(n, "symbol", "year").sortWithinPartitions("symbol", "year", F.desc("trade_date"))
     .write.mode("overwrite").partitionBy("symbol", "year").parquet(f"{path}/data/version={version}"))


def _publish_folders(folders: DataFrame, path: str, version: int, after: int) -> None:
    """One row a folder and the version that holds it; then the one step that readers see."""
    folders.select("symbol", "year", "version").write.mode("overwrite").parquet(f"{path}/folders/version={version}")
    publish(folders.sparkSession, path, {"version": version}, after)


def write_yearly_store(bars: DataFrame, path: str) -> str:
    """SNK-1 store: bars by symbol and year, as a new version that replaces whatever was there."""
    after, _ = published(bars.sparkSession, path)
    version, rows = after + 1, _yearly(bars)
    _write_version(rows, path, version)
    _publish_folders(rows.select("symbol", "year").distinct().withColumn("version", F.lit(version)), path, version, after)
    return path


def _folders(spark: SparkSession, path: str) -> tuple[int, DataFrame]:
    after, state = published(spark, path)
    if state is None:
        raise ValueError(f"no store at {path}")
    return after, spark.read.schema("symbol string, year int, version int").parquet(f"{path}/folders/version={state['version']}")


def read_yearly_store(spark: SparkSession, path: str) -> DataFrame:
    """The published store: of every (symbol, year) the folder of the version that holds it."""
    kinds = T.StructType([*BAR_SCHEMA.fields, T.StructField("year", T.IntegerType()), T.StructField("version", T.IntegerType())])
    _, folders = _folders(spark, path)
    return spark.read.schema(kinds).parquet(f"{path}/data").join(folders, ["symbol", "year", "version"]).select(
        *[f.name for f in BAR_SCHEMA.fields], "year")


def upsert_yearly_store(spark: SparkSession, path: str, delta: DataFrame) -> None:
    """SNK-1: rewrite only the (symbol, year) folders that ``delta`` touches.

    ``delta`` has a ``batch`` column above 0; the stored rows of the touched
    folders are read and merged (the last arrival wins) into folders of a new
    version, beside the old ones. Readers see them all at once, when the version is
    published; a job that fails before leaves the store as it was.
    """
    after, folders = _folders(spark, path)
    version, new = after + 1, _yearly(delta)
    touched = new.select("symbol", "year").distinct().checkpoint()
    old = read_yearly_store(spark, path).join(touched, ["symbol", "year"], "left_semi").withColumn("batch", F.lit(0))
    merged = keep_last_per_key(old.unionByName(new.select(*old.columns)), ["symbol", "trade_date"]).drop("batch")
    _write_version(merged, path, version)
    kept = folders.join(touched, ["symbol", "year"], "left_anti")
    _publish_folders(kept.unionByName(touched.withColumn("version", F.lit(version))), path, version, after)


def compact_yearly_store(spark: SparkSession, path: str) -> None:
    """All folders as one new version; the versions before the published one are removed."""
    after, _ = published(spark, path)
    write_yearly_store(read_yearly_store(spark, path).drop("year"), path)
    remove(spark, [f"{path}/{kind}/version={v}" for v in range(1, after + 1) for kind in ("data", "folders")])


def read_bar_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BAR_SCHEMA).parquet(path)


def scan_symbol_bars(spark: SparkSession, path: str, symbol: str) -> DataFrame:
    """SRC-2: bars of one symbol; partition pruning reads only that folder.
    A symbol without a folder gives an empty table with the same schema."""
    return read_bar_store(spark, path).where(F.col("symbol") == symbol)


def scan_all_bars(spark: SparkSession, path: str) -> DataFrame:
    """SRC-3: every ``<symbol>_price.csv`` below ``path``, stacked.

    The symbol comes from that name, be it a file's or (as Spark writes them)
    a folder's of part files.
    """
    own = T.StructType([f for f in BAR_SCHEMA.fields if f.name != "symbol"])
    rows = (spark.read.schema(own).option("header", True).option("pathGlobFilter", "*.csv")
            .option("recursiveFileLookup", True).csv(path))
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/=]+)_price\.csv(?:/|$)", 1)
    return rows.select("*", name.alias("symbol")).where(F.col("symbol") != "")


# ---------------------------------------------------------------- JSON
def write_json_envelopes(records: DataFrame, path: str, group_col: str) -> str:
    """Land records as ``{"data": [...]}`` documents, one per ``group_col`` value."""
    cols = [c for c in records.columns]
    env = records.groupBy(group_col).agg(
        F.to_json(F.struct(F.sort_array(F.collect_list(F.struct(*cols))).alias("data"))).alias("value"))
    env.select("value").write.mode("overwrite").text(path)
    return path


def scan_json_records(spark: SparkSession, path: str, schema: T.StructType = ENVELOPE_SCHEMA,
                      multiline: bool = False) -> DataFrame:
    """SRC-4: ``{"data": [...]}`` documents -> one row per record.

    A broken document yields no rows (DROPMALFORMED); an empty ``data``
    array yields none either. JSON-lines input stays splittable.
    """
    env = (spark.read.schema(schema).option("mode", "DROPMALFORMED")
           .option("multiLine", multiline).json(path))
    return env.select(F.explode("data").alias("r")).select("r.*")


TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def write_json(df: DataFrame, path: str) -> str:
    """JSON lines with full microsecond timestamps (the default format drops them)."""
    (df.write.mode("overwrite").option("timestampNTZFormat", TS_FORMAT)
     .option("timestampFormat", TS_FORMAT).json(path))
    return path


def scan_news(spark: SparkSession, paths: list[str], as_of: str, period_days: int = 30) -> DataFrame:
    """SRC-7: union of result files, items of the last ``period_days`` up to
    ``as_of``, newest first (undated items last, then by id)."""
    frames = [spark.read.schema(NEWS_ITEM_SCHEMA).option("timestampNTZFormat", TS_FORMAT)
              .option("timestampFormat", TS_FORMAT).json(p) for p in paths]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    end = F.lit(as_of).cast("timestamp_ntz")
    keep = F.col("published_at").isNull() | (
        (F.col("published_at") > end - F.expr(f"INTERVAL {period_days} DAYS")) & (F.col("published_at") <= end))
    return out.where(keep).orderBy(F.col("published_at").desc_nulls_last(), F.col("doc_id"))
