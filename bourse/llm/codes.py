"""Vector codes by product quantisation, fitted with Drake-Hamerly adaptive bounds.

Vectors are cut into equal parts; each part position has a codebook. A round
assigns every part to its nearest entry and moves the entries to the floored
means. What a part knows about the entries is kept between rounds, in a written
table of the shared folder:

* its entry; its ``b`` closest other entries with lower bounds on their
  distances, in order; one outer bound below the distances to all others;
* when entries move, a lower bound falls by its entry's move and the outer one
  by the largest move. The distance to the own entry is taken anew, in integers.

A part whose own distance is below all bounds keeps its entry without another
distance. If only the outer bound holds, its own entry and the ``b`` listed ones
are verified in integers; else all entries are. Bounds are 16-bit floats rounded
down, so they only decide when they are sure; a tie is never sure.

``b`` adapts between rounds: it doubles (to a quarter of the entries at most)
when over ``FULL_SHARE`` of the parts had to try every entry, else it shrinks to
the most bounds that any part needed (an eighth of the entries at least). A list
that shrinks hands its dropped bounds to the outer one.

Only sums leave the tasks: at most parts x entries x (width + 1) numbers each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bourse.llm import textcols as T
from bourse.llm.lines import discard, saved

LIMIT = 1 << 24          # components beyond it are held at it: all squares stay exact in a double
FULL_SHARE = 0.1
ROWS = 4096              # vectors of one numpy block
STATE_DDL = ("vec_id long, label string, v array<int>, code binary, near binary, low binary, outer binary, "
             "needed int, full int")


class Codebooks(NamedTuple):
    entries: np.ndarray     # int64 [parts, entries, width]

    def text(self) -> str:
        """All components by part, entry and position."""
        return ",".join(map(str, self.entries.reshape(-1).tolist()))

    def sha256(self) -> str:
        return hashlib.sha256(self.text().encode()).hexdigest()


def finite(vector: str) -> Column:
    """True for a vector that is there and holds finite numbers only."""
    x = F.col(vector).cast("array<double>")
    return F.coalesce(F.forall(x, lambda e: F.coalesce(e > F.lit(float("-inf")), F.lit(False))
                               & F.coalesce(e < F.lit(float("inf")), F.lit(False))), F.lit(False))


def floored(vector: str, scale: int, limit: int) -> Column:
    """Components as integers floor(scale * x), held within ``limit``."""
    def one(e: Column) -> Column:
        return F.floor(F.least(F.greatest(e * F.lit(float(scale)), F.lit(float(-limit))), F.lit(float(limit)))).cast("int")
    return F.transform(F.col(vector).cast("array<double>"), one)


def down(x: np.ndarray) -> np.ndarray:
    """Nonnegative 16-bit floats not above ``x``; infinity stays."""
    x = np.maximum(x, 0.0)
    y = np.where(np.isinf(x), np.inf, np.minimum(x, 65504.0)).astype(np.float16)
    over = y.astype(np.float64) > x
    return np.where(over, np.nextafter(y, np.float16(0)), y)


def fixed(a: np.ndarray) -> pa.Array:
    """Binary column of the rows of a contiguous array."""
    a = np.ascontiguousarray(a)
    n, width = len(a), a.nbytes // max(len(a), 1)
    off = np.arange(n + 1, dtype=np.int32) * np.int32(width)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(off), pa.py_buffer(a)])


def rows_of(batch: pa.RecordBatch, name: str, kind, parts: int) -> np.ndarray:
    """[rows, parts, ...] of a binary column whose rows have one width."""
    data, off = T.column(batch, name)
    n = len(off) - 1
    return data[off[0]:off[-1]].copy().view(kind).reshape(n, parts, -1)


def vectors_of(batch: pa.RecordBatch) -> np.ndarray:
    col = batch.column(batch.schema.get_field_index("v"))
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1).astype(np.int64)


def all_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances [rows, entries] of one part position."""
    x, c = x.astype(np.float64), c.astype(np.float64)
    return (x * x).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2.0 * (x @ c.T)


class Known(NamedTuple):
    """What the parts of one position know: entry, list, bounds."""
    code: np.ndarray        # uint8 [rows]
    near: np.ndarray        # uint8 [rows, b], closest first
    low: np.ndarray         # float16 [rows, b]
    outer: np.ndarray       # float16 [rows]


def ranked(d: np.ndarray, b: int) -> Known:
    """From the distances to all entries: the nearest (ties to the lower index) and the ``b`` next."""
    order = np.argsort(d, axis=1, kind="stable")
    dist = np.sqrt(np.take_along_axis(d, order[:, 1:b + 2], 1))
    outer = dist[:, b] if dist.shape[1] > b else np.full(len(d), np.inf)
    return Known(order[:, 0].astype(np.uint8), order[:, 1:b + 1].astype(np.uint8), down(dist[:, :b]), down(outer))


def moved(old: Known, moves: np.ndarray) -> Known:
    """Bounds that still hold after the entries moved."""
    slack = moves * (1 + 1e-9)
    return Known(old.code, old.near, down(old.low.astype(np.float64) - slack[old.near]),
                 down(old.outer.astype(np.float64) - slack.max(initial=0.0)))


def shortened(k: Known, b: int) -> Known:
    if k.near.shape[1] <= b:
        return k
    outer = np.minimum(k.outer, k.low[:, b:].min(1))
    return Known(k.code, k.near[:, :b], k.low[:, :b], outer)


def lengthened(k: Known, b: int) -> Known:
    """Lists of ``b`` slots; the new ones stay empty (an infinite bound) until a part tries every entry."""
    more = (len(k.near), b - k.near.shape[1])
    if more[1] <= 0:
        return k
    return Known(k.code, np.concatenate([k.near, np.repeat(k.code[:, None], more[1], 1)], 1),
                 np.concatenate([k.low, np.full(more, np.inf, np.float16)], 1), k.outer)


def reassigned(x: np.ndarray, c: np.ndarray, k: Known) -> tuple[Known, np.ndarray, np.ndarray, np.ndarray]:
    """(what is known now, squared distance, bounds needed, tried every entry) of each row."""
    own = ((x - c[k.code]) ** 2).sum(1)
    u = np.sqrt(own.astype(np.float64)) * (1 + 1e-12)
    full = u >= k.outer
    needed = np.where(full, 0, (k.low <= u[:, None]).sum(1))
    code, near, low, outer = (a.copy() for a in k)
    part = np.flatnonzero(needed)
    if len(part):
        ids = np.concatenate([code[part, None], near[part]], 1).astype(np.int64)
        d = ((x[part, None, :] - c[ids]) ** 2).sum(2).astype(np.float64)
        d[:, 1:][np.isinf(low[part])] = np.inf                   # empty slots
        order = np.lexsort((ids, d), axis=1)
        ids, d = np.take_along_axis(ids, order, 1), np.take_along_axis(d, order, 1)
        code[part], near[part], low[part], own[part] = ids[:, 0], ids[:, 1:], down(np.sqrt(d[:, 1:])), d[:, 0]
    rest = np.flatnonzero(full)
    if len(rest):
        d = all_distances(x[rest], c)
        code[rest], near[rest], low[rest], outer[rest] = ranked(d, near.shape[1])
        own[rest] = d[np.arange(len(rest)), code[rest]]
    return Known(code, near, low, outer), own, needed, full


def _first(books: np.ndarray, b: int):
    """Round one: every entry is tried."""
    parts = len(books)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in it:
            for at in range(0, big.num_rows, ROWS):
                batch = big.slice(at, ROWS)
                x = vectors_of(batch).reshape(batch.num_rows, parts, -1)
                yield _packed(batch, [ranked(all_distances(x[:, p], books[p]), b) for p in range(parts)],
                              np.zeros(batch.num_rows, np.int32), np.full(batch.num_rows, parts, np.int32))
    return run


def _packed(batch: pa.RecordBatch, known: list[Known], needed: np.ndarray, full: np.ndarray) -> pa.RecordBatch:
    def col(name: str) -> pa.Array:
        return fixed(np.stack([getattr(k, name) for k in known], 1))
    return pa.RecordBatch.from_arrays(
        [*T.keep_columns(batch, ["vec_id", "label", "v"]), col("code"), col("near"), col("low"), col("outer"),
         pa.array(needed.astype(np.int32)), pa.array(full.astype(np.int32))],
        names=["vec_id", "label", "v", "code", "near", "low", "outer", "needed", "full"])


def _next(old: np.ndarray, new: np.ndarray, b: int, last: bool):
    """Another assignment, from the written state; the last one returns codes and errors."""
    parts = len(old)
    moves = np.sqrt(((new - old).astype(np.float64) ** 2).sum(2))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in it:
            for at in range(0, big.num_rows, ROWS):
                batch = big.slice(at, ROWS)
                n = batch.num_rows
                x = vectors_of(batch).reshape(n, parts, -1)
                code, near = (rows_of(batch, c, np.uint8, parts) for c in ("code", "near"))
                low, outer = (rows_of(batch, c, np.float16, parts) for c in ("low", "outer"))
                known, error = [], np.zeros(n, np.int64)
                needed, full = np.zeros(n, np.int64), np.zeros(n, np.int64)
                for p in range(parts):
                    k = moved(Known(code[:, p, 0], near[:, p], low[:, p], outer[:, p, 0]), moves[p])
                    k, own, m, f = reassigned(x[:, p], new[p], lengthened(shortened(k, b), b))
                    known.append(k)
                    error += own
                    needed, full = np.maximum(needed, m), full + f
                if last:
                    codes = np.stack([k.code for k in known], 1)
                    yield pa.RecordBatch.from_arrays([*T.keep_columns(batch, ["vec_id", "label"]), fixed(codes), pa.array(error)],
                                                     names=["vec_id", "label", "code", "error"])
                else:
                    yield _packed(batch, known, needed, full)
    return run


def _sums(parts: int, entries: int):
    """Of each (part, entry): component sums and, as component -1, the count; as part -1, what ``b`` adapts to."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count, full, rows, needed = None, np.zeros((parts, entries), np.int64), 0, 0, 0
        for batch in it:
            if not batch.num_rows:
                continue
            x = vectors_of(batch).reshape(batch.num_rows, parts, -1)
            code = rows_of(batch, "code", np.uint8, parts)[:, :, 0]
            total = np.zeros((parts, entries, x.shape[2]), np.int64) if total is None else total
            for p in range(parts):
                np.add.at(total[p], code[:, p], x[:, p])
                count[p] += np.bincount(code[:, p], minlength=entries)
            m, f = (c.to_numpy() for c in T.keep_columns(batch, ["needed", "full"]))
            full, rows, needed = full + int(f.sum()), rows + len(f), max(needed, int(m.max()))
        if total is None:
            return
        flat = np.concatenate([count[:, :, None], total], 2)
        p, e, c = (i.reshape(-1) for i in np.indices(flat.shape))
        use = np.repeat(count.reshape(-1) > 0, flat.shape[2])
        value = flat.reshape(-1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(p[use], [-1, -1, -1]), pa.int32()), pa.array(np.append(e[use], [0, 1, 2]), pa.int32()),
             pa.array(np.append(c[use] - 1, [0, 0, 0]), pa.int32()), pa.array(np.append(value[use], [full, rows, needed]))],
            names=["part", "entry", "at", "value"])
    return run


def _recentred(state: DataFrame, books: np.ndarray, b: int) -> tuple[np.ndarray, int]:
    """The codebooks of the floored means, and the next ``b``."""
    parts, entries, width = books.shape
    # at most parts x entries x (width + 1) + 3 rows come to the driver, whatever the input
    got = (state.select("v", "code", "needed", "full").mapInArrow(
        _sums(parts, entries), "part int, entry int, at int, value long")
        .groupBy("part", "entry", "at").agg(F.sum("value").alias("total"), F.max("value").alias("most")).collect())
    sums, count = np.zeros((parts, entries, width), object), np.zeros((parts, entries), object)
    full, rows, needed = 0, 0, 0
    for r in got:
        if r["part"] < 0:
            full, rows, needed = (r["total"], rows, needed) if r["entry"] == 0 else (
                full, r["total"], needed) if r["entry"] == 1 else (full, rows, r["most"])
        elif r["at"] < 0:
            count[r["part"], r["entry"]] = r["total"]
        else:
            sums[r["part"], r["entry"], r["at"]] = r["total"]
    new = books.copy()
    for p, e in np.argwhere(count > 0):
        new[p, e] = [s // count[p, e] for s in sums[p, e]]
    least, most = max(1, entries // 8), max(1, entries // 4)
    if needed:                                   # 0: the first round, which had no bounds to use
        b = min(most, 2 * b) if full > FULL_SHARE * rows * parts else min(b, max(least, needed))
    return new, min(b, entries - 1)


def vector_codes(vectors: DataFrame, *, parts: int = 16, entries: int = 64, scale: int = 256, rounds: int = 2
                 ) -> tuple[DataFrame, Codebooks | None]:
    """Codes of ``vectors`` (vec_id, embedding, label), and the codebooks (None without a vector).

    The frame has vec_id, label (as text), code (one byte a part) and error (sum
    of the parts' squared distances to their entries).

    Vectors that are null or hold a null or non-finite component are dropped, and
    so are those that cannot be cut: a length that is no multiple of ``parts`` or
    differs from that of the smallest vec_id. The first codebooks are the ``entries``
    first vectors by (vec_id, components), fewer if there are fewer; a null vec_id
    comes last. Repeated rows each count. Other columns are ignored.
    """
    if not 1 < entries <= 256:
        raise ValueError("entries must be 2 to 256: a code is a byte")
    kept = vectors.where(finite("embedding")).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"),
        floored("embedding", scale, LIMIT).alias("v"))
    kept = kept.where((F.size("v") > 0) & (F.size("v") % parts == 0))

    def first(df: DataFrame) -> list:
        return df.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(entries).collect()   # one codebook

    seeds = first(kept)
    if not seeds:
        return kept.select("vec_id", "label", F.lit(None).cast("binary").alias("code"), F.lit(0).cast("long").alias("error")), None
    dim = len(seeds[0]["v"])
    kept = kept.where(F.size("v") == dim)
    if any(len(r["v"]) != dim for r in seeds):
        seeds = first(kept)
    books = np.array([r["v"] for r in seeds], np.int64).reshape(len(seeds), parts, -1).transpose(1, 0, 2).copy()
    b = min(max(1, entries // 8), len(seeds) - 1)
    state = saved(kept.mapInArrow(_first(books, b), STATE_DDL), "vector-state")
    for _ in range(rounds - 1):
        new, b = _recentred(state, books, b)
        was, state = state, saved(state.mapInArrow(_next(books, new, b, False), STATE_DDL), "vector-state")
        discard(was)
        books = new
    new, b = _recentred(state, books, b)
    coded = state.mapInArrow(_next(books, new, b, True), "vec_id long, label string, code binary, error long")
    return coded, Codebooks(new)


def coded_report(vectors: DataFrame, **options) -> DataFrame:
    """vec_id, code (hex), error, label_error (summed over equal labels) and the digest of the codebooks.

    The errors are written once and summed by label with partial aggregation, so
    a label of a third of all rows is one row a task.
    """
    coded, books = vector_codes(vectors, **options)
    coded = saved(coded.select("vec_id", "label", F.lower(F.hex("code")).alias("code"), "error"), "vector-codes")
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    digest = books.sha256() if books else hashlib.sha256(b"").hexdigest()
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of")), "left").select(
        "vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
