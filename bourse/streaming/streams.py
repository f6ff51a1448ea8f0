"""Structured Streaming versions of the three polls (STR-1..3).

All three read a folder of landed files, run with ``availableNow`` (drain
what is there, then stop) and keep their progress and state in a checkpoint folder
below the shared ``spark.checkpoint.dir``, so a restarted job continues
where it stopped. Sinks are idempotent per micro-batch: a batch writes to
its own ``batch_id=N`` folder with overwrite, so a replayed batch replaces
its earlier output instead of adding to it.

* STR-1 is compacted in levels: a compaction reads the micro-batches since the
  last one, and a level's runs are merged when there are ``FAN_IN`` of them, so a
  row is rewritten once a level.
* STR-2 keeps the open days in Spark's state store under a watermark; items that
  come later than that, and undated ones, are summed in a side table.
* STR-3 keeps each link's earliest item in the state store.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bourse.operators.market import keep_last_per_key
from bourse.operators.news import label_score
from bourse.sources.files import NEWS_ITEM_SCHEMA, TS_FORMAT
from bourse.sources.versions import publish, published, remove

FAN_IN = 4               # runs of a level that become one of the next
_PLACE = ["published_at", "doc_id"]

BAR_BATCH_SCHEMA = T.StructType([
    T.StructField("symbol", T.StringType()),
    T.StructField("trade_date", T.DateType()),
    T.StructField("high", T.DoubleType()),
    T.StructField("low", T.DoubleType()),
    T.StructField("open", T.DoubleType()),
    T.StructField("close", T.DoubleType()),
    T.StructField("volume", T.LongType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("batch", T.IntegerType()),
])


def _run(query) -> None:
    query.awaitTermination()
    if query.exception() is not None:  # pragma: no cover - surfaced to the caller
        raise query.exception()


def stream_upsert_bars(spark: SparkSession, landing: str, out: str, checkpoint: str,
                       files_per_batch: int | None = None) -> DataFrame:
    """STR-1: every landed batch of bars is upserted; the later ``batch`` wins.

    Each micro-batch writes its rows (with the micro-batch id) to
    ``out/batch_id=N``; the store is the last row per (symbol, trade_date) by
    (batch, micro-batch id) - computed on read, so a replay never duplicates.
    """
    reader = spark.readStream.schema(BAR_BATCH_SCHEMA)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    src = reader.parquet(landing)

    def sink(df: DataFrame, batch_id: int) -> None:
        # reduce inside the batch first (partial aggregation), then land it
        last = keep_last_per_key(df.withColumn("micro_batch", F.lit(batch_id)), ["symbol", "trade_date"], "batch")
        last.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    _run(src.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    return read_upserted_bars(spark, out)


def _last_bars(rows: DataFrame) -> DataFrame:
    """Last row per (symbol, trade_date) by (batch, micro-batch)."""
    rest = [c for c in rows.columns if c not in ("symbol", "trade_date")]
    agg = rows.groupBy("symbol", "trade_date").agg(F.max_by(F.struct(*rest), F.struct("batch", "micro_batch")).alias("_l"))
    return agg.select("symbol", "trade_date", *[F.col(f"_l.{c}").alias(c) for c in rest])


def _landed_since(spark: SparkSession, out: str, upto: int) -> DataFrame:
    """Rows of the micro-batches after ``upto``; earlier folders are pruned by their partition value."""
    kinds = T.StructType([*BAR_BATCH_SCHEMA.fields, T.StructField("micro_batch", T.LongType()), T.StructField("batch_id", T.LongType())])
    return spark.read.schema(kinds).parquet(out).where(F.col("batch_id") > upto).drop("batch_id")


def _run_rows(spark: SparkSession, paths: list[str]) -> DataFrame:
    kinds = T.StructType([*BAR_BATCH_SCHEMA.fields, T.StructField("micro_batch", T.LongType())])
    return spark.read.schema(kinds).parquet(*paths)


def read_upserted_bars(spark: SparkSession, out: str, compacted: str | None = None) -> DataFrame:
    """Last row per (symbol, trade_date): the compacted runs, if any, and the later micro-batches."""
    _, state = published(spark, compacted) if compacted else (0, None)
    rows = _landed_since(spark, out, state["upto"] if state else -1)
    if state and state["runs"]:
        rows = rows.unionByName(_run_rows(spark, [r["path"] for r in state["runs"]]))
    return _last_bars(rows).drop("micro_batch")


def compact_upserted_bars(spark: SparkSession, out: str, compacted: str) -> int:
    """Take the micro-batches since the last compaction into a new run; returns the last one in it.

    While a level has ``FAN_IN`` runs they are merged into one of the next level.
    The runs to read are published in one step; those that a step has replaced
    are removed by the compaction after it, so readers of the moment finish.
    """
    after, state = published(spark, compacted)
    state = state or {"upto": -1, "runs": [], "replaced": []}
    newer = _landed_since(spark, out, state["upto"])
    # folder names tell the last micro-batch: a metadata read of one column
    upto = spark.read.schema("batch_id long").parquet(out).where(F.col("batch_id") > state["upto"]).agg(F.max("batch_id")).first()[0]
    if upto is None:
        return state["upto"]
    remove(spark, state["replaced"])
    runs, replaced = list(state["runs"]), []

    def written(rows: DataFrame, level: int) -> dict:
        path = f"{compacted.rstrip('/')}/run-{uuid.uuid4().hex}"
        _last_bars(rows).write.parquet(path)
        return {"level": level, "path": path}

    runs.append(written(newer, 0))
    level = 0
    while len(full := [r for r in runs if r["level"] == level]) >= FAN_IN:
        paths = [r["path"] for r in full]
        runs = [r for r in runs if r["level"] != level] + [written(_run_rows(spark, paths), level + 1)]
        replaced += paths
        level += 1
    publish(spark, compacted, {"upto": upto, "runs": runs, "replaced": replaced}, after)
    return upto


def _news_stream(spark: SparkSession, landing: str, files_per_batch: int | None) -> DataFrame:
    reader = (spark.readStream.schema(NEWS_ITEM_SCHEMA).option("timestampNTZFormat", TS_FORMAT)
              .option("timestampFormat", TS_FORMAT))
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(landing)


def _log(spark: SparkSession, folder: str) -> dict[int, list[str]]:
    """Lines of a streaming log by batch; compacted entries hold those of all batches before."""
    rows = spark.read.text(folder, wholetext=True).select("value", F.regexp_extract(
        F.col("_metadata.file_path"), r"/(\d+)(?:\.compact)?$", 1).alias("batch")).where(F.col("batch") != "").collect()
    return {int(r["batch"]): r["value"].split("\n")[1:] for r in rows}


def _lateness(spark: SparkSession, progress: str, done: int) -> dict[str, tuple[int, int]]:
    """Of a query with a watermark: landed file -> (its number in the source's log, the watermark in ms
    below which the query dropped its rows), for files after number ``done``.

    A micro-batch drops by the watermark that the batch before it has logged. Its
    entry in the log also says up to which number of the source it has read.
    """
    ends, mark = [], 0                                     # (last source number, watermark it was filtered by)
    for _, lines in sorted(_log(spark, f"{progress}/offsets").items()):
        if len(lines) > 1 and lines[1].startswith("{"):
            ends.append((json.loads(lines[1])["logOffset"], mark))
        mark = json.loads(lines[0])["batchWatermarkMs"]
    files: dict[str, int] = {}
    for lines in _log(spark, f"{progress}/sources/0").values():
        for line in lines:
            if line.strip():
                entry = json.loads(line)
                files[entry["path"]] = entry["batchId"]
    return {p: (n, next((m for end, m in ends if end >= n), mark)) for p, n in files.items() if n > done}


def stream_news_mood(spark: SparkSession, landing: str, out: str, checkpoint: str,
                     files_per_batch: int | None = None, delay: str = "7 days") -> DataFrame:
    """STR-2: mood per symbol and calendar day of publication (day NULL: undated items).

    The stream sums items by symbol and day window in the state store. Under a
    watermark of ``delay`` behind the newest item, days that it has passed leave the
    state; their last totals stay in what was landed. Items of such days that
    still come, and undated ones, are summed from the files that the run has
    taken, by the watermark that the query's own log has for each, into a side
    table. So nothing is lost, and each file is read twice at most.
    """
    score = label_score(F.col("label"))
    sums = [F.sum(score).alias("total"), F.count(score).alias("scored"), F.count(F.lit(1)).alias("items")]
    when = F.col("published_at").cast("timestamp")
    dated = (_news_stream(spark, landing, files_per_batch).withColumn("at", when).where(F.col("at").isNotNull())
             .withWatermark("at", delay).groupBy("symbol", F.window("at", "1 day").alias("w")).agg(*sums))

    def sink(df: DataFrame, batch_id: int) -> None:
        df.select("symbol", F.col("w.start").cast("date").alias("day"), "total", "scored", "items") \
            .write.mode("overwrite").parquet(f"{out}/open/batch_id={batch_id}")

    progress = f"{checkpoint}/days"
    _run(dated.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", progress)
         .trigger(availableNow=True).start())

    after, state = published(spark, f"{out}/side")
    done = state["done"] if state else -1
    files = _lateness(spark, progress, done)
    runs = list(state["runs"]) if state else []
    if files:
        # one row per landed file of this run
        taken = spark.createDataFrame([(p, mark) for p, (_, mark) in files.items()], "path string, mark long")
        rows = (spark.read.schema(NEWS_ITEM_SCHEMA).option("timestampNTZFormat", TS_FORMAT).option("timestampFormat", TS_FORMAT)
                .json(list(files)).withColumn("path", F.col("_metadata.file_path")))
        late = F.unix_millis(F.date_trunc("day", when)) + 86_400_000 <= F.col("mark")
        plain = F.regexp_replace("path", "^file:/+", "/")          # logs and readers spell local paths differently
        kept = rows.withColumn("path", plain).join(taken.withColumn("path", plain), "path").where(when.isNull() | late)
        path = f"{out}/side/run-{uuid.uuid4().hex}"
        kept.groupBy("symbol", F.col("published_at").cast("date").alias("day")).agg(*sums).write.parquet(path)
        runs.append(path)
        publish(spark, f"{out}/side", {"done": max(n for n, _ in files.values()), "runs": runs}, after)
    return read_news_mood(spark, out)


def read_news_mood(spark: SparkSession, out: str) -> DataFrame:
    """Last totals of every day and what came too late for it."""
    kinds = "symbol string, day date, total long, scored long, items long"
    totals = ["total", "scored", "items"]
    opened = spark.read.schema(f"{kinds}, batch_id long").parquet(f"{out}/open").groupBy("symbol", "day").agg(
        F.max_by(F.struct(*totals), "batch_id").alias("_l")).select("symbol", "day", "_l.*")
    _, state = published(spark, f"{out}/side")
    if state:
        opened = opened.unionByName(spark.read.schema(kinds).parquet(*state["runs"]))
    every = opened.groupBy("symbol", "day").agg(*[F.sum(c).alias(c) for c in totals])
    mood = F.coalesce(F.try_divide(F.col("total"), F.col("scored")), F.lit(0.0))
    return every.select("symbol", "day", F.round(mood, 6).alias("mood"), "items")


def stream_first_seen_news(spark: SparkSession, landing: str, out: str, checkpoint: str,
                           files_per_batch: int | None = None) -> DataFrame:
    """STR-3: each link once, with its earliest item (undated last, then doc_id).

    The state store holds each link's earliest item so far and the micro-batch that brought it; a micro-batch
    lands only links that it has not seen, or an earlier item of one. No
    earlier output is read. Items without a link count as one link.
    """
    src = _news_stream(spark, landing, files_per_batch).where(F.col("doc_id").isNotNull())
    # one time for all rows of a micro-batch, logged with it: of equal items the one that came first stays
    rest = [c for c in NEWS_ITEM_SCHEMA.names if c not in ("link", *_PLACE)]
    item = F.struct(F.col("published_at").isNull().alias("undated"), *_PLACE, F.current_timestamp().alias("came"), *rest)
    first = src.select("link", item.alias("item")).groupBy("link").agg(F.min("item").alias("f"))
    found = first.where(F.col("f.came") == F.current_timestamp()).select(
        *[F.col(c if c == "link" else f"f.{c}").alias(c) for c in NEWS_ITEM_SCHEMA.names])

    def sink(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    _run(found.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    return read_first_seen_news(spark, out)


def read_first_seen_news(spark: SparkSession, out: str) -> DataFrame:
    """The last item that was landed for each link: each is earlier than those before it."""
    rest = [c for c in NEWS_ITEM_SCHEMA.names if c != "link"]
    kinds = T.StructType([*NEWS_ITEM_SCHEMA.fields, T.StructField("batch_id", T.LongType())])
    rows = spark.read.schema(kinds).parquet(out)
    return rows.groupBy("link").agg(F.max_by(F.struct(*rest), "batch_id").alias("_f")).select(
        "link", *[F.col(f"_f.{c}").alias(c) for c in rest])
