"""Quality rules by distribution divergence.

Each document's character-class and common-word histograms are compared with
references of its language by Jensen-Shannon distance. The references are the
mean histograms of all documents of the language that pass the base rules,
computed by one Spark aggregate. A language with fewer than ``min_docs`` such
documents (or a null one) has no reference: its distances are to the mean over
all languages, which tells other scripts and words rather than junk, so they
are given but the base rules alone decide. Each distance counts only above a
minimum length (``min_chars``, ``min_words``), since a short text's histogram
says little.

One Arrow pass makes a fixed number of counts per document; that narrow table
is checkpointed, summed up by language and joined with the references (a row
per language; Spark broadcasts it only under its size threshold, else AQE
splits the hot language). No text is shuffled.

Edge cases: a null or empty text has no words, so it fails the base rule; null
language: base rules only; repeated rows stay repeated; other columns of the
input are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bourse.llm import textcols as T

# Frequent function words of four languages.
COMMON = {
    "en": "the of and to a in is that for it was on are as with be by this at from or an not have".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más".split(),
}
# The base rules' symbol characters.
SYMBOLS = b"#*$%&|<>"
WORDS = sorted({w for ws in COMMON.values() for w in ws})
N_CLASSES = 9

_CLASS = np.full(256, 7, np.uint8)            # other ASCII
_CLASS[97:123] = 0
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[32] = 3
_CLASS[10] = 4
_CLASS[list(b".,;:!?'\"()-")] = 5
_CLASS[list(SYMBOLS)] = 6
_CLASS[192:] = 8                              # first byte of a non-ASCII character
_CLASS[128:192] = 9                           # its other bytes: not counted
_SYMBOL = T.byte_table(SYMBOLS)
_CHAR = np.ones(256, bool)
_CHAR[128:192] = False

_ORDER = np.argsort(T.word_hash(WORDS))
_SORTED = T.word_hash(WORDS)[_ORDER]

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SCHEMA = pa.schema([("doc_id", pa.int64()), ("lang", pa.string())] + [(c, pa.int64()) for c in COUNTS]
                   + [("n_chars_", pa.int64()), ("classes", pa.list_(pa.int64())), ("common", pa.list_(pa.int64()))])
DDL = ("doc_id long, lang string, " + ", ".join(f"{c} long" for c in COUNTS)
       + ", n_chars_ long, classes array<bigint>, common array<bigint>")


def _repeats(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """True where a value occurs twice or more; true where it occurred before."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    same = np.zeros(len(k), bool)
    same[1:] = k[1:] == k[:-1]
    again = np.zeros(len(k), bool)
    again[order] = same
    twice = same.copy()
    twice[:-1] |= same[1:]
    many = np.zeros(len(k), bool)
    many[order] = twice
    return many, again


def block_counts(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of every document of one block."""
    n = len(off) - 1
    s, e = T.spans(T.NOT_SPACE[data], off)
    doc = T.owners(off, s)
    c = T.prefix_hash(data)
    h = T.span_hash(c, s, e)
    out = {"n_words": np.bincount(doc, minlength=n)}
    chars = np.concatenate([[0], np.cumsum(_CHAR[data], dtype=np.int64)])
    out["word_chars"] = T.sums(chars[e] - chars[s], doc, n)
    cum = np.concatenate([[0], np.cumsum(_SYMBOL[data], dtype=np.int64)])
    out["n_symbols"] = cum[off[1:]] - cum[off[:-1]]
    out["n_chars_"] = chars[off[1:]] - chars[off[:-1]]
    # lines that hold a word and equal an earlier line of the document
    ls, le = T.line_spans(data, off)
    first = np.searchsorted(s, ls)
    worded = (first < len(s)) & (s[np.minimum(first, max(len(s) - 1, 0))] < le) if len(s) else np.zeros(len(ls), bool)
    ls, le = ls[worded], le[worded]
    ldoc = T.owners(off, ls)
    again = _repeats(T.mix(T.span_hash(c, ls, le) + ldoc.astype(np.uint64) * T._M1))[1]
    out["n_dup_lines"] = np.bincount(ldoc[again], minlength=n)
    # words inside 3-word windows found twice or more
    g, at = T.gram_hash(h, doc, 3)
    many = _repeats(T.mix(g + doc[at].astype(np.uint64) * T._M1))[0]
    hit = np.zeros(len(s) + 2, bool)
    for j in range(3):
        hit[at[many] + j] = True
    out["n_repeat_words"] = np.bincount(doc[hit[:len(s)]], minlength=n)
    # histograms
    cls = _CLASS[data]
    byte_doc = np.repeat(np.arange(n), np.diff(off))
    out["classes"] = np.bincount(byte_doc * 10 + cls, minlength=n * 10).reshape(n, 10)[:, :N_CLASSES]
    at = np.minimum(np.searchsorted(_SORTED, h), len(_SORTED) - 1)
    bin_ = np.where(_SORTED[at] == h, _ORDER[at], len(WORDS))
    out["common"] = np.bincount(doc * (len(WORDS) + 1) + bin_, minlength=n * (len(WORDS) + 1)).reshape(n, -1)
    return out


def _count_batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        data, off = T.column(batch, "text")
        ids, lang = T.keep_columns(batch, ["doc_id", "lang"])
        for i, j, d, o in T.blocks(data, off):
            r = block_counts(d, o)
            rows = [ids.slice(i, j - i), lang.slice(i, j - i)]
            rows += [pa.array(r[c], pa.int64()) for c in (*COUNTS, "n_chars_")]
            for c in ("classes", "common"):
                rows.append(T.ragged(r[c].reshape(-1), np.full(j - i, r[c].shape[1]), pa.int64()))
            yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(rows, SCHEMA, strict=True)], schema=SCHEMA)


def document_counts(docs: DataFrame) -> DataFrame:
    """A row of counts and histograms for each row of ``docs``."""
    cols = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    return cols.mapInArrow(_count_batches, DDL)


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of two arrays of shares."""
    def part(x: Column, y: Column) -> Column:
        m = (x + y) / 2
        return (F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
                + F.when(y > 0, y * F.log2(y / m)).otherwise(F.lit(0.0))) / 2
    total = F.aggregate(F.zip_with(p, q, part), F.lit(0.0), lambda a, x: a + x)
    return F.sqrt(F.greatest(total, F.lit(0.0)))


def _shares(counts: str) -> Column:
    total = F.aggregate(F.col(counts), F.lit(0).cast("long"), lambda a, x: a + x)
    return F.transform(F.col(counts), lambda x: x / F.greatest(total, F.lit(1)).cast("double"))


def _means(rows: DataFrame, *by: str) -> DataFrame:
    cols = []
    for name, n in (("class_share", N_CLASSES), ("word_share", len(WORDS) + 1)):
        cols.append(F.array(*[F.avg(F.col(name)[i]) for i in range(n)]).alias(f"{name}_{'lang' if by else 'all'}"))
    return rows.groupBy(*by).agg(*cols, F.count("*").alias("n_ref")) if by else rows.agg(*cols)


def quality_rules(docs: DataFrame, *, max_class_distance: float = 0.22, max_word_distance: float = 0.43,
                  min_chars: int = 100, min_words: int = 50, min_docs: int = 20) -> DataFrame:
    """Counts, base verdict, distances and the verdict ``kept`` per document."""
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = (document_counts(docs).withColumn("base_failed", base_failed)
            .withColumn("class_share", _shares("classes")).withColumn("word_share", _shares("common"))
            .drop("classes", "common").checkpoint())
    good = rows.where(~F.col("base_failed"))
    by_lang = _means(good.where(F.col("lang").isNotNull()), "lang").where(F.col("n_ref") >= min_docs).drop("n_ref")
    overall = _means(good).first()  # one row of fixed size
    joined = rows.join(by_lang, "lang", "left")
    for name in ("class_share", "word_share"):
        joined = joined.withColumn(f"{name}_all", F.array(*[F.lit(x).cast("double") for x in overall[f"{name}_all"]]))
    out = joined.withColumns({
        "class_distance": F.when(F.col("n_chars_") >= min_chars, js_distance(
            F.col("class_share"), F.coalesce("class_share_lang", "class_share_all"))),
        "word_distance": F.when(F.col("n_words") >= min_words, js_distance(
            F.col("word_share"), F.coalesce("word_share_lang", "word_share_all"))),
    })
    far = F.col("class_share_lang").isNotNull() & (
        (F.coalesce("class_distance", F.lit(0.0)) > max_class_distance)
        | (F.coalesce("word_distance", F.lit(0.0)) > max_word_distance))
    return out.select("doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & ~far).alias("kept"),
                      "class_distance", "word_distance")
