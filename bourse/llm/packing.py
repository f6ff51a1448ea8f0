"""Best-fit packing of documents into sequences by a grouping genetic algorithm.

A document's tokens end with one separator id; only documents longer than a
sequence are cut, into full pieces and a rest. Full pieces are sequences of
their own. The other pieces are dealt at random into shards of about
``shard_items`` pieces and at least ``shard_bins`` sequences' worth of tokens.
Each shard is solved by ``islands`` populations: a solution is a set of bins;
crossover injects the best-filled bins of one parent whole into the other,
drops the bins that hold an injected document, and puts their displaced
documents back by best fit, largest first; mutation does so with a few poorly
filled bins. After each of the ``epochs`` an island's elite migrates to the
next island. An island stops at the lower bound (tokens / capacity).

Islands are rows of a Spark table (lengths and assignments, a few kilobytes),
evolved in ``mapInPandas`` and checkpointed per epoch. At the end the worst bin
of each shard is opened and these documents are packed again in groups of
``merge_shards`` shards, so a shard's unavoidable last bin is shared.

Edge cases: null and empty texts are one separator id; repeated rows are
packed as often as they occur; a null doc_id stays null; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import random
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bourse.llm import textcols as T
from bourse.llm.tokens import RunTokenizer, default_tokenizer, tokenizer

PIECE_DDL = "row_id long, doc_id long, piece int, start long, length long, ids_crc32 long"


def _piece_batches(path: str, capacity: int, separator: int, keep_ids: bool):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tokenizer(path) as tok:
            yield from pieces(it, tok)

    def pieces(it: Iterator[pa.RecordBatch], tok: RunTokenizer) -> Iterator[pa.RecordBatch]:
        end = np.array([separator], np.uint32)
        names = ["row_id", "doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
        for batch in it:
            data, off = T.column(batch, "text")
            row_id, doc_id = T.keep_columns(batch, ["row_id", "doc_id"])
            for i, j, d, o in T.blocks(data, off, 1 << 18):
                texts = [np.concatenate([x, end]) for x in tok.block(d, o)]
                n = np.array([-(-len(x) // capacity) for x in texts])
                of = np.repeat(np.arange(j - i), n)
                piece = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                parts = [texts[k][a:a + capacity] for k, a in zip(of.tolist(), start.tolist(), strict=True)]
                cols = [row_id.take(pa.array(of + i)), doc_id.take(pa.array(of + i)), pa.array(piece, pa.int32()),
                        pa.array(start, pa.int64()), pa.array([len(p) for p in parts], pa.int64()),
                        pa.array([zlib.crc32(p.astype("<u4").tobytes()) for p in parts], pa.int64())]
                if keep_ids:
                    cols.append(T.ragged(np.concatenate(parts).astype(np.int32), np.array([len(p) for p in parts]),
                                         pa.int32()))
                yield pa.RecordBatch.from_arrays(cols, names=names)
    return run


def token_pieces(docs: DataFrame, *, path: str | None = None, capacity: int = 4096, separator: int = 1,
                 keep_ids: bool = False) -> DataFrame:
    """Pieces of every row of ``docs``; ``keep_ids`` adds the ids themselves."""
    return (docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long"),
                        F.col("text").cast("string"))
            .mapInArrow(T.released(_piece_batches(path or default_tokenizer(), capacity, separator, keep_ids)),
                        PIECE_DDL + ", ids array<int>" * keep_ids))


class Packing:
    """Bins of one solution: item lists and their fill."""

    def __init__(self, lengths: list[int], capacity: int) -> None:
        self.lengths, self.capacity = lengths, capacity
        self.bins: list[list[int]] = []
        self.fill: list[int] = []

    def best_fit(self, items: list[int]) -> None:
        """Put every item into the fullest bin that takes it."""
        free = sorted((self.capacity - f, b) for b, f in enumerate(self.fill) if f < self.capacity)
        for i in items:
            n = self.lengths[i]
            at = bisect_left(free, (n, -1))
            if at < len(free):
                room, b = free.pop(at)
                self.bins[b].append(i)
                self.fill[b] += n
            else:
                room, b = self.capacity, len(self.bins)
                self.bins.append([i])
                self.fill.append(n)
            if room > n:
                insort(free, (room - n, b))

    def add(self, bin_: list[int], fill: int) -> None:
        self.bins.append(bin_)
        self.fill.append(fill)

    @property
    def fitness(self) -> tuple[int, float]:
        """Fewer bins first, then fuller ones."""
        return -len(self.bins), sum((f / self.capacity) ** 2 for f in self.fill)


def offspring(a: Packing, b: Packing, rng: random.Random) -> Packing:
    """Bins of ``b`` injected whole into ``a``."""
    order = sorted(range(len(b.bins)), key=lambda k: (-b.fill[k], rng.random()))
    take = order[:max(1, int(len(order) * rng.uniform(0.2, 0.6)))]
    child = Packing(a.lengths, a.capacity)
    inside: set[int] = set()
    for k in take:
        child.add(list(b.bins[k]), b.fill[k])
        inside.update(b.bins[k])
    out: list[int] = []
    for bin_, fill in zip(a.bins, a.fill, strict=True):
        if inside.isdisjoint(bin_):
            child.add(list(bin_), fill)
        else:
            out += [i for i in bin_ if i not in inside]
    child.best_fit(sorted(out, key=lambda i: (-a.lengths[i], i)))
    return child


def mutated(a: Packing, rng: random.Random) -> Packing:
    """A few bins, poorly filled ones rather, opened and packed anew."""
    n = len(a.bins)
    order = sorted(range(n), key=lambda k: a.fill[k] * rng.uniform(0.8, 1.2))
    opened = set(order[:max(2, min(n, 4 + n // 20))])
    child = Packing(a.lengths, a.capacity)
    out: list[int] = []
    for k in range(n):
        if k in opened:
            out += a.bins[k]
        else:
            child.add(list(a.bins[k]), a.fill[k])
    child.best_fit(sorted(out, key=lambda i: (-a.lengths[i] * rng.uniform(0.9, 1.1), i)))
    return child


def evolve(lengths: list[int], seeds: list[list[int]], capacity: int, seed: int, population: int = 4,
           generations: int = 6) -> tuple[list[int], int]:
    """Best assignment (bin of each item) of one island and its number of bins."""
    rng = random.Random(seed)
    bound = -(-sum(lengths) // capacity)
    pool: list[Packing] = []
    for assign in seeds:
        p = Packing(lengths, capacity)
        p.bins = [[] for _ in range(max(assign) + 1)]
        for i, b in enumerate(assign):
            p.bins[b].append(i)
        p.fill = [sum(lengths[i] for i in b) for b in p.bins]
        pool.append(p)
    while len(pool) < population:
        spread = 0.0 if not pool else 0.1 * len(pool)      # the first one is best-fit decreasing
        p = Packing(lengths, capacity)
        p.best_fit(sorted(range(len(lengths)), key=lambda i: (-lengths[i] * rng.uniform(1 - spread, 1), i)))
        pool.append(p)
        if len(p.bins) <= bound:
            break
    pool.sort(key=lambda p: p.fitness, reverse=True)
    for _ in range(generations):
        if len(pool[0].bins) <= bound or len(pool) < 2:
            break
        a, b = pool[0], pool[rng.randrange(1, len(pool))]
        children = [offspring(a, b, rng), mutated(offspring(b, a, rng), rng)]
        pool = sorted([*pool, *children], key=lambda p: p.fitness, reverse=True)[:population]
    assign = [0] * len(lengths)
    for k, bin_ in enumerate(pool[0].bins):
        for i in bin_:
            assign[i] = k
    return assign, len(pool[0].bins)


ISLAND_DDL = "shard long, island int, lengths array<int>, assign array<int>, bins int, score double"


def _evolve_rows(capacity: int, epoch: int):
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for r in pdf.itertuples(index=False):
                lengths = [int(x) for x in r.lengths]
                seeds = [[int(x) for x in s] for s in r.seeds]
                assign, bins = evolve(lengths, seeds, capacity, hash((r.shard, r.island, epoch)))
                fill = np.bincount(assign, weights=lengths, minlength=bins) / capacity
                rows.append((r.shard, r.island, lengths, assign, bins, float((fill ** 2).sum())))
            yield pd.DataFrame(rows, columns=["shard", "island", "lengths", "assign", "bins", "score"])
    return run


def solve(items: DataFrame, capacity: int, islands: int, epochs: int) -> DataFrame:
    """(shard, items, assign): the best island's solution of each row (shard, items).

    ``items`` holds an array of structs with a ``length``.
    """
    state = items.select("shard", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"),
                         F.transform("items", lambda x: x["length"].cast("int")).alias("lengths"),
                         F.array().cast("array<array<int>>").alias("seeds"))
    for epoch in range(epochs):
        # a row is a whole island's work: dealt by a hash, so rows spread over all tasks
        grown = (state.repartition("shard", "island").mapInPandas(_evolve_rows(capacity, epoch), ISLAND_DDL).checkpoint())
        came = grown.select("shard", ((F.col("island") + 1) % islands).alias("island"), F.col("assign").alias("elite"))
        state = grown.join(came, ["shard", "island"]).select(
            "shard", "island", "lengths", F.array("assign", "elite").alias("seeds"))
    best = grown.groupBy("shard").agg(
        F.min_by("assign", F.struct("bins", -F.col("score"), "island")).alias("assign"))
    return items.join(best, "shard")


def _placed(solved: DataFrame) -> DataFrame:
    """One row per item with its bin, the bin's fill and the offset in it."""
    flat = solved.select("shard", F.posexplode(F.arrays_zip("items", "assign")).alias("pos", "x"))
    return flat.select("shard", "pos", F.col("x.items").alias("item"), F.col("x.assign").alias("bin"))


def pack(pieces: DataFrame, *, capacity: int = 4096, shard_items: int = 2000, shard_bins: int = 64, islands: int = 2,
         epochs: int = 2, merge_shards: int = 64) -> DataFrame:
    """``pieces`` with sequence_id and offset."""
    cols = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    pieces = pieces.select(*cols)
    full = pieces.where(F.col("length") >= capacity).select(
        *cols, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.where(F.col("length") < capacity)
    n, tokens = rest.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    shards = max(1, min(-(-n // shard_items), tokens // (capacity * shard_bins)))
    item = F.struct(*cols)
    dealt = (rest.groupBy(F.pmod(F.xxhash64("row_id", "piece"), F.lit(shards)).alias("shard"))
             .agg(F.array_sort(F.collect_list(item)).alias("items")).checkpoint())
    first = _placed(solve(dealt, capacity, islands, epochs)).checkpoint()
    fill = first.groupBy("shard", "bin").agg(F.sum("item.length").alias("fill"))
    worst = (fill.groupBy("shard").agg(F.min(F.struct("fill", "bin")).alias("w"))
             .where(F.col("w.fill") < capacity).select("shard", F.col("w.bin").alias("bin"), F.lit(True).alias("open")))
    first = first.join(worst, ["shard", "bin"], "left").checkpoint()
    again = (first.where("open").groupBy(F.floor(F.col("shard") / merge_shards).alias("shard"))
             .agg(F.array_sort(F.collect_list("item")).alias("items")).checkpoint())
    second = _placed(solve(again, capacity, islands, epochs))
    shift = 1 << 30

    def placed(df: DataFrame, level: int) -> DataFrame:
        sequence = (F.col("shard") * 2 + level) * F.lit(shift) + F.col("bin")
        before = (Window.partitionBy("sequence_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
        # a sequence holds at most ``capacity`` pieces
        return df.withColumn("sequence_id", sequence).select(
            "item.*", "sequence_id", F.coalesce(F.sum("item.length").over(before), F.lit(0)).alias("offset"))

    return full.unionByName(placed(first.where("open IS NULL"), 0)).unionByName(placed(second, 1))


def pack_documents(docs: DataFrame, *, path: str | None = None, capacity: int = 4096, separator: int = 1,
                   keep_ids: bool = False, **options) -> DataFrame:
    """Token pieces of every row of ``docs`` and their places in sequences.

    With ``keep_ids`` the pieces carry their ids (they go through the packing
    shuffles then; without, a piece is a few numbers).
    """
    pieces = token_pieces(docs, path=path, capacity=capacity, separator=separator, keep_ids=keep_ids).checkpoint()
    return pack(pieces, capacity=capacity, **options)
