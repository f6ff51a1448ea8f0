"""Line deduplication by a deletion-neighbourhood join.

A line is its words, A-Z in lower case. Two lines are linked when they are equal
and have ``exact_words`` words (one), or are one word edit apart (one word put in,
left out or replaced) and have ``min_words`` words; other lines always stay. A line goes when an earlier
line, by (doc_id, line number), is linked with it; the earliest stays.

1. One Arrow pass writes every line's 128-bit hash and place, and four half
   keys. Equal lines meet in one partially aggregated group.
2. Half keys: with one edit, either the first or the last half of the words is
   untouched. Only lines that share a half key with another line go on; this
   loses no link and keeps the variants from all lines being written out.
3. Every candidate emits its deletion neighbourhood, one key per left-out word
   of the half that may differ, and one for itself. Lines that leave out the same place with an equal rest
   differ in that word; a line equal to a variant lacks one word. Per key only
   the earliest line is joined back, so a key shared by a third of all lines
   makes as many rows as it has lines, never pairs.
4. Each (later, earlier) pair is verified on its words.

Edge cases: a null text stays null and has no lines; a document that loses
every line keeps an empty text; a null doc_id sorts last; repeated rows have
the same places, so their lines count once and stay or go together; other
columns stay as they are; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bourse.llm import bitmap
from bourse.llm import textcols as T
from bourse.session import scratch_path

_Q = np.uint64(0xD6E8FEB86659FD93)
LINE_DDL = "doc_id long, text_key long, line_no int, la long, lb long, halves array<bigint>"


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def discard(df: DataFrame) -> None:
    """Remove the folder of a ``saved`` table that no plan reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.saved_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class BlockLines:
    """Lines of a block with at least ``min_words`` words, as word-hash ranges."""

    def __init__(self, d: np.ndarray, o: np.ndarray, min_words: int) -> None:
        self.low = T.LOWER[d]
        self.s, self.e = T.spans(T.NOT_SPACE[self.low], o)
        self.h = T.span_hash(T.prefix_hash(self.low), self.s, self.e)
        ls, le = T.line_spans(d, o)
        a, b = np.searchsorted(self.s, ls), np.searchsorted(self.s, le)
        # every text has one line more than line feeds, an empty one too
        n_lines = np.bincount(T.owners(o, np.flatnonzero(d == 10)), minlength=len(o) - 1) + 1
        self.n_lines = n_lines
        doc = np.repeat(np.arange(len(o) - 1), n_lines)
        number = np.arange(len(doc)) - np.repeat(np.cumsum(n_lines) - n_lines, n_lines)
        keep = b - a >= min_words
        self.doc, self.number, self.first, self.last = doc[keep], number[keep], a[keep], b[keep]
        n = self.last - self.first
        # word j of a block weighs base^j: sums of a range, shifted back by its start
        self.sums = [T.weighted_sums(self.h), T.weighted_sums(T.mix(self.h ^ _Q), 1)]
        self.n = n

    def raw(self, a: np.ndarray, b: np.ndarray, which: int = 0) -> np.ndarray:
        return T.raw_span(self.sums[which], a, b, which)

    def line_hash(self) -> tuple[np.ndarray, np.ndarray]:
        n = self.n.astype(np.uint64) * T._M2
        return T.mix(self.raw(self.first, self.last) + n), T.mix(self.raw(self.first, self.last, 1) ^ n)

    def halves(self) -> np.ndarray:
        """Four keys a line: first and last half as the shorter, then as the longer of two lines."""
        out = np.empty((len(self.n), 4), np.uint64)
        for k, m in enumerate((self.n, self.n - 1)):
            a = m // 2
            size = m.astype(np.uint64) * _Q
            out[:, 2 * k] = T.mix(self.raw(self.first, self.first + a) + size)
            out[:, 2 * k + 1] = T.mix((self.raw(self.last - (m - a), self.last) ^ T._M1) + size)
        return out


def _line_batches(min_words: int, exact_words: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            data, off = T.column(batch, "text")
            ids, keys = T.keep_columns(batch, ["doc_id", "text_key"])
            for i, _, d, o in T.blocks(data, off):
                x = BlockLines(d, o, min(min_words, exact_words))
                if not len(x.n):
                    continue
                la, lb = x.line_hash()
                at = pa.array(x.doc + i)
                long = x.n >= min_words                      # others have no half keys, so no variants
                yield pa.RecordBatch.from_arrays(
                    [ids.take(at), keys.take(at), pa.array(x.number, pa.int32()), pa.array(la.view(np.int64)),
                     pa.array(lb.view(np.int64)),
                     T.ragged(x.halves()[long].view(np.int64).reshape(-1), 4 * long, pa.int64())],
                    names=["doc_id", "text_key", "line_no", "la", "lb", "halves"])
    return run


def _text_batches(min_words: int, bits):
    """Words of the lines whose hash may be a candidate's."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            data, off = T.column(batch, "text")
            for _, _, d, o in T.blocks(data, off):
                x = BlockLines(d, o, min_words)
                if not len(x.n):
                    continue
                la, lb = (v.view(np.int64) for v in x.line_hash())
                pick = np.flatnonzero(bitmap.test(bits.value, la))
                if not len(pick):
                    continue
                raw = x.low.tobytes()
                words = [b" ".join(raw[p:q] for p, q in zip(
                    x.s[a:b].tolist(), x.e[a:b].tolist(), strict=True)).decode()
                    for a, b in zip(x.first[pick].tolist(), x.last[pick].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(la[pick]), pa.array(lb[pick]), pa.array(words, pa.string())],
                                                 names=["la", "lb", "words"])
    return run


def _variant_batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Deletion neighbourhoods: key of the rest and its place (0), key of the rest (1), the line's own key (2)."""
    for batch in it:
        data, off = T.column(batch, "words")
        line = T.keep_columns(batch, ["line"])[0].to_numpy()
        lo, hi = (c.to_numpy(zero_copy_only=False) for c in T.keep_columns(batch, ["lo", "hi"]))
        for i, j, d, o in T.blocks(data, off, 1 << 18):
            x = BlockLines(d, o, 0)
            n = x.n
            row = np.repeat(np.arange(j - i), n)
            place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)          # the word left out
            keep = (hi[i:j][row] & (place >= (n[row] - 1) // 2)) | (lo[i:j][row] & (place <= n[row] // 2))
            row, place = row[keep], place[keep]
            first, last = x.first[row], x.last[row]
            w = first + place
            rest = T.joined(x.raw(first, w), x.raw(w + 1, last), place)
            size = (last - first - 1).astype(np.uint64) * T._M2
            gone = T.mix(rest + size)                                             # as ``line_hash`` of the rest
            placed = T.mix((gone ^ _Q) + place.astype(np.uint64) * T._M1)
            own = T.mix(x.raw(x.first, x.last) + n.astype(np.uint64) * T._M2)
            key = np.concatenate([placed, gone, own]).view(np.int64)
            kind = np.repeat(np.array([0, 1, 2], np.int32), [len(row), len(row), j - i])
            of = line[i:j][np.concatenate([row, row, np.arange(j - i)])]
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(kind), pa.array(of)], names=["key", "kind", "line"])


def _one_edit(a: pd.Series, b: pd.Series) -> pd.Series:
    def near(x: str, y: str) -> bool:
        x, y = (x.split(" "), y.split(" ")) if len(x.split(" ")) <= len(y.split(" ")) else (y.split(" "), x.split(" "))
        if len(y) - len(x) > 1:
            return False
        k = next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), len(x))
        return x[k + (len(x) == len(y)):] == y[k + 1:]
    return pd.Series([near(x, y) for x, y in zip(a, b, strict=True)])


def _line_table(docs: DataFrame, min_words: int, exact_words: int) -> DataFrame:
    """Eligible lines of every document row, with place and hashes."""
    cols = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn(
        "text_key", F.xxhash64("text"))
    return saved(cols.mapInArrow(T.released(_line_batches(min_words, exact_words)), LINE_DDL), "lines")


def _place() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "line_no")


def near_lines(docs: DataFrame, distinct: DataFrame, min_words: int) -> DataFrame:
    """(la, lb, earlier_la, earlier_lb): verified pairs of a line and an earlier one an edit apart."""
    keys = distinct.select("node", F.posexplode("halves").alias("side", "half"))
    shared = keys.groupBy("half").agg(F.count("*").alias("n")).where("n > 1").select("half")
    # an equal first half leaves the edit to the last one, and the other way round
    sides = keys.join(shared, "half").groupBy("node").agg(
        F.bool_or(F.col("side") % 2 == 1).alias("lo"), F.bool_or(F.col("side") % 2 == 0).alias("hi"))
    chosen = saved(sides.join(distinct.select("node", "la", "lb", "first"), "node").drop("node"), "line-candidates")
    bits = docs.sparkSession.sparkContext.broadcast(bitmap.build(chosen, F.col("la")))   # 2 MB at any size
    words = docs.select(F.col("text").cast("string")).mapInArrow(
        T.released(_text_batches(min_words, bits)), "la long, lb long, words string").dropDuplicates(["la", "lb"])
    # numbered in the order of their places, so a smaller number is an earlier line
    texts = saved(words.join(chosen, ["la", "lb"]).orderBy("first", "la", "lb")
                  .withColumn("line", F.monotonically_increasing_id()), "line-words")
    posts = saved(texts.select("words", "line", "lo", "hi").repartition("line").mapInArrow(
        T.released(_variant_batches), "key long, kind int, line long"), "line-variants")
    placed = posts.where("kind = 0").select("key", "line")
    heads = placed.groupBy("key").agg(F.min("line").alias("head"), F.count("*").alias("n")).where("n > 1").drop("n")
    replaced = placed.join(heads, "key").select(F.col("line").alias("x"), F.col("head").alias("y"))
    # a line, and the lines that a word more makes of it
    shorter = posts.where("kind = 2").select("key", F.col("line").alias("x"))
    longer = posts.where("kind = 1").select("key", F.col("line").alias("y"))
    pairs = replaced.union(shorter.join(longer, "key").select("x", "y")).where("x != y").select(
        F.greatest("x", "y").alias("late"), F.least("x", "y").alias("early")).distinct()
    for side in ("late", "early"):
        own = texts.select(F.col("line").alias(side), F.col("la").alias(f"{side}_la"), F.col("lb").alias(f"{side}_lb"),
                           F.col("words").alias(f"{side}_words"))
        pairs = pairs.join(own, side)
    one_edit = F.pandas_udf(_one_edit, "boolean")
    return pairs.where(one_edit("late_words", "early_words")).select(
        F.col("late_la").alias("la"), F.col("late_lb").alias("lb"), F.col("early_la").alias("earlier_la"),
        F.col("early_lb").alias("earlier_lb"))


def dropped_lines(docs: DataFrame, *, min_words: int = 6, exact_words: int = 1) -> DataFrame:
    """(doc_id, text_key, gone): line numbers to take out, for rows that lose any."""
    lines = _line_table(docs, min_words, exact_words)
    distinct = saved(lines.groupBy("la", "lb").agg(F.min(_place()).alias("first"), F.max(_place()).alias("last"),
                                                   F.first("halves").alias("halves"))
                     .withColumn("node", F.monotonically_increasing_id()), "line-classes")
    late = near_lines(docs, distinct, min_words).select("la", "lb").distinct().withColumn("late", F.lit(True))
    marks = (distinct.select("la", "lb", "first", (F.col("first") != F.col("last")).alias("again"))
             .join(late, ["la", "lb"], "left").where("again OR late").select("la", "lb", "first", "late"))
    gone = lines.select("doc_id", "text_key", "line_no", "la", "lb").join(marks, ["la", "lb"]).where(
        F.coalesce("late", F.lit(False)) | (_place() != F.col("first")))
    return gone.groupBy("doc_id", "text_key").agg(F.collect_set("line_no").alias("gone"))


def _without(text: pd.Series, gone: pd.Series) -> pd.Series:
    def cut(t, g):
        if t is None or g is None:
            return t
        g = set(g)
        return "\n".join(x for i, x in enumerate(t.split("\n")) if i not in g)
    out = pd.Series([cut(t, g) for t, g in zip(text, gone, strict=True)], dtype=object)
    T.release()
    return out


def dedup_lines(docs: DataFrame, *, min_words: int = 6, exact_words: int = 1,
                count: str | None = None) -> DataFrame:
    """``docs`` with the repeated lines taken out of ``text``.

    ``exact_words`` is the least number of words of lines that go as exact
    copies (1: every line that holds a word), ``min_words`` that of lines one edit apart.
    ``count`` names a column to add with the number of lines taken out.
    """
    gone = dropped_lines(docs, min_words=min_words, exact_words=exact_words).select(
        F.col("doc_id").alias("__of"), F.col("text_key").alias("__key"), F.col("gone").alias("__gone"))
    own = F.col("doc_id").cast("long").eqNullSafe(F.col("__of")) & (F.xxhash64(F.col("text").cast("string")) == F.col("__key"))
    joined = docs.join(gone, own, "left")
    # else a filter or a length of the new text would cut it again, in a Python worker of its own
    text = F.pandas_udf(_without, "string").asNondeterministic()
    cols = [F.when(F.col("__gone").isNull(), F.col("text").cast("string")).otherwise(text("text", "__gone")).alias("text")
            if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    if count:
        cols.append(F.coalesce(F.array_size("__gone"), F.lit(0)).alias(count))
    return joined.select(*cols)
