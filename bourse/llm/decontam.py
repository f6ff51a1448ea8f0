"""Benchmark decontamination by template windows.

Words (letters and digits, A-Z in lower case) are canonicalised: numbers,
number words, units and capitalised words inside a sentence become typed
placeholders (``<num>``, ``<unit>``, ``<name>``). Every window of ``window``
words, plain and template, of every text is hashed and joined with the windows of the
benchmark items. Windows that match on one diagonal (document position minus
item position) belong together. In a window each placeholder value of the item
must stand for one value of the document (two item values may become equal).
Equal values are a verbatim copy, consistently replaced ones a re-parameterised
question; inconsistent windows do not count, and leave the others of their
diagonal alone. A document is contaminated by an item when at least
``min_coverage`` of the item's windows are matched, or when windows that follow each other on one diagonal cover
``run_words`` words, whatever their share of the item.

An item shorter than a window is one window of its own length. Every window of
every item is looked for word for word; templates of items under ``min_words``
words, and of windows with fewer than half literal words, are too common to
tell anything, so these match word for word only.

Scale: texts are read once. A 2 MB bitmap of the item windows' hashes, the same
size for any benchmark, lets tasks drop other windows before the exact join;
what is shuffled are hits. Their join is on the window hash, so AQE splits a
passage that a third of all documents share.

Edge cases: null and empty texts or items have no windows; repeated rows are
reported each; a null doc_id or item_id stays null; other columns are ignored;
empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bourse.llm import bitmap
from bourse.llm import textcols as T
from bourse.llm.lines import saved

WORD = T.byte_table([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)])
_DIGIT = T.byte_table(range(48, 58))
_BREAK = T.byte_table(b".!?:;\n\"()")
# Number words and units of measure.
NUMBERS = ("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen "
           "eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen "
           "half").split()
UNITS = ("mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms pound pounds ounce "
         "ounces ml l liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks "
         "month months year years dollar dollars cent cents euro euros percent degree degrees meter meters metre metres "
         "kilometer kilometers kilometre kilometres mph kmh watt watts volt volts").split()
_NUMBERS, _UNITS = np.sort(T.word_hash(NUMBERS)), np.sort(T.word_hash(UNITS))
_MARKS = T.word_hash(["<num>", "<unit>", "<name>"])


def _member(sorted_: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(sorted_, h), len(sorted_) - 1)
    return sorted_[at] == h


class Template:
    """Template words of a block of texts."""

    def __init__(self, d: np.ndarray, o: np.ndarray) -> None:
        low = T.LOWER[d]
        s, e = T.spans(WORD[low], o)
        self.doc = T.owners(o, s)
        self.value = T.span_hash(T.prefix_hash(low), s, e)
        self.count = np.bincount(self.doc, minlength=len(o) - 1)
        digits = np.concatenate([[0], np.cumsum(_DIGIT[d])])
        breaks = np.concatenate([[0], np.cumsum(_BREAK[d])])
        number = (digits[e] - digits[s] == e - s) | _member(_NUMBERS, self.value)
        unit = _member(_UNITS, self.value)
        inside = np.zeros(len(s), bool)                    # follows a word of the same sentence
        inside[1:] = (self.doc[1:] == self.doc[:-1]) & (breaks[s[1:]] == breaks[e[:-1]])
        upper = (d >= 65) & (d <= 90)
        second = np.append(upper, False)[np.minimum(s + 1, len(d))] & (e - s > 1)
        name = inside & upper[s] & ~second if len(s) else inside
        self.slot = number | unit | name
        self.word = np.where(number, _MARKS[0], np.where(unit, _MARKS[1], np.where(name, _MARKS[2], self.value)))

    def windows(self, k: int, plain: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the windows of ``k`` template or plain words and their first words.

        A template window without a placeholder is the plain one, so it is left out.
        """
        g, at = T.gram_hash(self.value if plain else self.word, self.doc, k)
        if not plain:
            slots = np.concatenate([[0], np.cumsum(self.slot)])
            typed = slots[at + k] > slots[at]
            g, at = g[typed], at[typed]
        return T.mix(g + np.uint64(k)).view(np.int64), at

    def slots(self, at: np.ndarray, k: int) -> np.ndarray:
        """Placeholder values of windows, 0 at literal words."""
        x = at[:, None] + np.arange(k)
        return np.where(self.slot[x], self.value[x].view(np.int64), 0)

    def slot_lists(self, at: np.ndarray, k: int, plain: bool) -> pa.Array:
        """``slots`` as lists; plain windows need no placeholder values."""
        if plain:
            return T.ragged(np.zeros(0, np.int64), np.zeros(len(at), np.int64), pa.int64())
        return T.ragged(self.slots(at, k).reshape(-1), np.full(len(at), k), pa.int64())


def _item_batches(window: int, min_words: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            data, off = T.column(batch, "text")
            item_row, item = T.keep_columns(batch, ["item_row", "item_id"])
            for i, j, d, o in T.blocks(data, off):
                t = Template(d, o)
                first = np.cumsum(t.count) - t.count
                for k, plain in product(range(1, window + 1), (True, False)):
                    g, at = t.windows(k, plain)
                    doc = t.doc[at]
                    fits = t.count[doc] >= window if k == window else t.count[doc] == k
                    # templates of few literal words are too common; such windows match word for word only
                    literal = (2 * (t.slots(at, k) == 0).sum(1) >= k) & (k >= min_words)
                    if not plain:
                        fits &= literal
                    g, at, doc, literal = g[fits], at[fits], doc[fits], literal[fits]
                    rows = pa.array(doc + i)
                    yield pa.RecordBatch.from_arrays(
                        [item_row.take(rows), item.take(rows), pa.array(at - first[doc], pa.int32()), pa.array(g),
                         pa.array(np.full(len(g), k), pa.int32()), pa.array(literal), t.slot_lists(at, k, plain)],
                        names=["item_row", "item_id", "item_pos", "hash", "size", "literal", "item_slots"])
    return run


def _hit_batches(sizes: list[int], bits):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            data, off = T.column(batch, "text")
            own = T.keep_columns(batch, ["row_id", "doc_id", "text_key"])
            for i, _, d, o in T.blocks(data, off):
                t = Template(d, o)
                first = np.cumsum(t.count) - t.count
                for k, plain in product(sizes, (True, False)):
                    g, at = t.windows(k, plain)
                    hit = bitmap.test(bits.value, g)
                    g, at = g[hit], at[hit]
                    if len(g):
                        doc = t.doc[at]
                        rows = pa.array(doc + i)
                        yield pa.RecordBatch.from_arrays(
                            [*[c.take(rows) for c in own], pa.array(at - first[doc], pa.int32()), pa.array(g),
                             t.slot_lists(at, k, plain)],
                            names=["row_id", "doc_id", "text_key", "pos", "hash", "slots"])
    return run


def _longer(last: Column, n: Column, best: Column) -> Column:
    return F.struct(last.alias("last"), n.alias("n"), F.greatest(best, n).alias("best"))


def contamination(docs: DataFrame, benchmark: DataFrame, *, window: int = 8, min_words: int = 5,
                  min_coverage: float = 0.3, run_words: int = 30) -> DataFrame:
    """One row per contaminated document row and item.

    Columns doc_id, text_key (hash of the text), item_id, matched and
    n_windows (windows), coverage, and kind (verbatim or reparameterised).
    """
    spark = docs.sparkSession
    items = (benchmark.select(F.monotonically_increasing_id().alias("item_row"), F.col("item_id").cast("long"),
                              F.col("text").cast("string"))
             .mapInArrow(_item_batches(window, min_words),
                         "item_row long, item_id long, item_pos int, hash long, size int, literal boolean, "
                         "item_slots array<bigint>")
             .checkpoint())
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect())   # at most window
    bits = spark.sparkContext.broadcast(bitmap.build(items, F.col("hash")))          # 2 MB at any size
    hits = (docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long"),
                        F.col("text").cast("string"))
            .withColumn("text_key", F.xxhash64("text"))
            .mapInArrow(T.released(_hit_batches(sizes, bits)),
                        "row_id long, doc_id long, text_key long, pos int, hash long, slots array<bigint>"))
    literal_pos = F.when(F.col("literal"), F.col("item_pos"))
    total = items.groupBy("item_row").agg(F.countDistinct("item_pos").alias("n"), F.countDistinct(literal_pos).alias("n_literal"))
    # (item value, document value) of every placeholder of the item
    both = F.zip_with("item_slots", "slots", lambda i, d: F.struct(i.alias("i"), d.alias("d")))

    def consistent(values: str) -> Column:
        return F.size(F.array_distinct(F.col(f"{values}.i"))) == F.size(values)

    matched = (hits.join(items, "hash").withColumn("diagonal", F.col("pos") - F.col("item_pos"))
               .withColumn("pairs", F.array_distinct(F.filter(both, lambda x: x["i"] != 0))))
    by = ["row_id", "doc_id", "text_key", "item_row", "item_id", "diagonal"]
    at = [F.collect_set("item_pos").alias("at"), F.collect_set(F.when(F.col("literal"), F.col("item_pos"))).alias("literal_at")]
    changed = F.exists("pairs", lambda x: x["i"] != x["d"])
    found = matched.where(consistent("pairs")).groupBy(*by).agg(*at, F.max(changed).alias("changed"))
    # the longest run of positions that follow each other
    longest = F.aggregate(
        F.array_sort("at"), F.struct(F.lit(-2).alias("last"), F.lit(0).alias("n"), F.lit(0).alias("best")),
        lambda r, x: _longer(x, F.when(r["last"] + 1 == x, r["n"] + 1).otherwise(1), r["best"]), lambda r: r["best"])
    per_item = (found.withColumn("run", longest).groupBy("row_id", "doc_id", "text_key", "item_row", "item_id")
                .agg(*[F.size(F.array_distinct(F.flatten(F.collect_list(c)))).alias(f"n_{c}") for c in ("at", "literal_at")],
                     F.max("changed").alias("changed"), F.max("run").alias("run")))
    # of all windows, or of those that a template can match, whichever is the larger share
    by_template = F.col("n_literal_at") * F.col("n") > F.col("n_at") * F.col("n_literal")
    shares = (per_item.join(total, "item_row")
              .withColumn("matched", F.when(by_template, F.col("n_literal_at")).otherwise(F.col("n_at")))
              .withColumn("n_windows", F.when(by_template, F.col("n_literal")).otherwise(F.col("n"))))
    coverage = F.col("matched") / F.col("n_windows")
    return (shares.where((coverage >= min_coverage) | (F.col("run") >= max(run_words - window + 1, 2)))
            .select("doc_id", "text_key", "item_id", F.col("matched").cast("long"), "n_windows",
                    coverage.alias("coverage"),
                    F.when(F.col("changed"), "reparameterised").otherwise("verbatim").alias("kind")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows that an item contaminates; columns stay."""
    found = contamination(docs, benchmark, **options).select(
        F.col("doc_id").alias("__of"), F.col("text_key").alias("__key")).distinct()
    found = saved(found, "contaminated")           # its size is known then: a small one goes to the texts, not they to it
    own = F.col("doc_id").cast("long").eqNullSafe(F.col("__of")) & (F.xxhash64(F.col("text").cast("string")) == F.col("__key"))
    return docs.join(found, own, "left_anti")
