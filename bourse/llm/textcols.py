"""Vectorised numpy helpers over Arrow string columns.

Everything works on whole byte buffers: a block of documents (about 256 KiB of
text, or one longer document) is one uint8 array plus document offsets, so
memory stays bounded whatever the batch holds, and no Python loop runs per
word. Words and lines never cross a document border.

Spans of bytes are hashed by their 8-byte pieces, each mixed with its place and
the span's length before they are added, so no two spans collide by their
structure. Sequences of words that must lose a word or be cut (lines) are
polynomials modulo the prime 2^61 - 1 in random bases.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 18

_P = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
PRIME = (1 << 61) - 1
_PRIME = np.uint64(PRIME)
_BASES = [int(x) for x in np.random.default_rng(20240601).integers(1 << 32, PRIME, 2)]
_powers: list[list[np.ndarray]] = [[np.ones(1, np.uint64), np.ones(1, np.uint64)] for _ in _BASES]   # of each base and its inverse


def release() -> None:
    """Give what Arrow and the allocator hold beyond need back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)          # glibc only
    if trim is not None:
        trim(0)


def released(run):
    """``run`` over batches; a worker that stays for later tasks keeps no memory of this one."""
    @functools.wraps(run)
    def wrapped(it):
        try:
            yield from run(it)
        finally:
            release()
    return wrapped


def byte_table(members) -> np.ndarray:
    """bool[256] that is true for the given byte values."""
    t = np.zeros(256, bool)
    t[list(members)] = True
    return t


SPACE = byte_table([*range(9, 14), 32])
NOT_SPACE = ~SPACE
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32                            # A-Z only; other bytes stay


def column(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string or binary column; null is empty."""
    arr = batch.column(batch.schema.get_field_index(name))
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = pc.fill_null(arr, pa.scalar("" if pa.types.is_string(arr.type) or pa.types.is_large_string(arr.type)
                                          else b"", arr.type))
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    buf = arr.buffers()
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(buf[1], np.int64 if wide else np.int32)[arr.offset:arr.offset + len(arr) + 1].astype(np.int64)
    data = np.frombuffer(buf[2], np.uint8) if buf[2] is not None and buf[2].size else np.zeros(0, np.uint8)
    return data, off


def blocks(data: np.ndarray, off: np.ndarray, limit: int = BLOCK_BYTES
           ) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first document, end document, bytes, offsets from 0) of each block."""
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j, data[off[i]:off[j]], off[i:j + 1] - off[i]
        i = j


def spans(mask: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true bytes, cut at document borders."""
    if mask.size == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    full = off[:-1] < off[1:]
    prev = np.empty_like(mask)
    prev[0], prev[1:] = False, mask[:-1]
    prev[off[:-1][full]] = False
    nxt = np.empty_like(mask)
    nxt[-1], nxt[:-1] = False, mask[1:]
    nxt[off[1:][full] - 1] = False
    return np.flatnonzero(mask & ~prev), np.flatnonzero(mask & ~nxt) + 1


def line_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the \\n-split lines; an empty document has one empty line."""
    nl = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([off[:-1], nl + 1]), kind="stable")
    ends = np.sort(np.concatenate([off[1:], nl]), kind="stable")
    return starts, ends


def owners(off: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Document of each (nonempty) span."""
    return np.searchsorted(off, starts, "right") - 1


def mix(h: np.ndarray) -> np.ndarray:
    """Finishing step of a 64-bit hash."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def fold(x: np.ndarray) -> np.ndarray:
    """Any 64-bit numbers modulo 2^61 - 1."""
    x = (x & _PRIME) + (x >> np.uint64(61))
    return np.where(x >= _PRIME, x - _PRIME, x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo 2^61 - 1 of numbers below it, by halves of 32 bits."""
    low, half = np.uint64(0xFFFFFFFF), np.uint64(32)
    a0, a1, b0, b1 = a & low, a >> half, b & low, b >> half
    ll, mid = a0 * b0, a0 * b1 + a1 * b0
    total = (ll & _PRIME) + (ll >> np.uint64(61)) + (mid >> np.uint64(29)) + ((mid & np.uint64((1 << 29) - 1)) << half)
    return fold(fold(total) + ((a1 * b1) << np.uint64(3)))


def prefix_sums(x: np.ndarray) -> np.ndarray:
    """0 and the sums of the first 1, 2, ... numbers (below 2^61 - 1), modulo it."""
    low, high = np.cumsum(x & np.uint64(0xFFFFFFFF)), np.cumsum(x >> np.uint64(32))
    got = fold(fold(low) + (high >> np.uint64(29)) + ((high & np.uint64((1 << 29) - 1)) << np.uint64(32)))
    return np.concatenate([np.zeros(1, np.uint64), got])


def _grow(n: int, base: int) -> None:
    for k in (0, 1):
        have = _powers[base][k]
        x = _BASES[base] if k == 0 else pow(_BASES[base], -1, PRIME)
        while len(have) <= n:                              # twice as many: the known ones, further on
            have = np.concatenate([have, times(have, np.full(len(have), pow(x, len(have), PRIME), np.uint64))])
        _powers[base][k] = have


def powers(n: np.ndarray, base: int = 0) -> np.ndarray:
    _grow(int(n.max()) if len(n) else 0, base)
    return _powers[base][0][n]


def weighted_sums(h: np.ndarray, base: int = 0) -> np.ndarray:
    """Prefix sums of word hashes by place, from which ``raw_span`` takes any run of words."""
    return prefix_sums(times(fold(h), powers(np.arange(len(h)), base)))


def raw_span(c: np.ndarray, s: np.ndarray, e: np.ndarray, base: int = 0) -> np.ndarray:
    """Polynomial of words s to e; raw(xy) = raw(x) + raw(y) * base^len(x), modulo 2^61 - 1."""
    _grow(len(c), base)
    return times(fold(c[e] + (_PRIME - c[s])), _powers[base][1][s])


def joined(x: np.ndarray, y: np.ndarray, size: np.ndarray, base: int = 0) -> np.ndarray:
    """The polynomial of x followed by y, when x has ``size`` words."""
    return fold(x + times(y, powers(size, base)))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """What ``span_hash`` reads: the bytes, with room for the last piece of 8."""
    return np.concatenate([data, np.zeros(8, np.uint8)])


def span_hash(padded: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """64-bit hash of data[s:e], the same for equal bytes anywhere."""
    if not len(s):
        return np.zeros(0, np.uint64)
    pieces = np.lib.stride_tricks.as_strided(padded.view(np.uint8), (max(len(padded) - 7, 0), 8), (1, 1))
    size = (e - s).astype(np.int64)
    count = np.maximum((size + 7) >> 3, 1)
    first = np.cumsum(count) - count
    place = np.arange(int(count.sum())) - np.repeat(first, count)
    at = np.repeat(s, count) + 8 * place
    left = np.minimum(np.repeat(size, count) - 8 * place, 8)            # bytes of the piece that belong to the span
    value = np.ascontiguousarray(pieces[np.minimum(at, len(pieces) - 1)]).view(np.uint64)[:, 0]
    value &= np.uint64(0xFFFFFFFFFFFFFFFF) >> ((8 - np.maximum(left, 1)).astype(np.uint64) * np.uint64(8))
    value[left <= 0] = 0
    salt = mix(place.astype(np.uint64) * _P + np.repeat(size, count).astype(np.uint64) * _M1 + np.uint64(1))
    return mix(np.add.reduceat(mix(value ^ salt) * _M2 + salt, first))


def gram_hash(h: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words of one document, and the first word's index."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    g = np.zeros(n, np.uint64)
    for j in range(k):
        g = mix(g * _P + h[j:j + n])
    at = np.flatnonzero(doc[:n] == doc[k - 1:])
    return mix(g[at]), at


def word_hash(words: list[str]) -> np.ndarray:
    """Hash of each word of a list (for templates and lexicons)."""
    data = np.frombuffer(b" ".join(w.encode() for w in words), np.uint8)
    s, e = spans(data != 32, np.array([0, len(data)], np.int64))
    return span_hash(prefix_hash(data), s, e)


def sums(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Sum of values by document as int64."""
    return np.bincount(doc, weights=values, minlength=n).astype(np.int64)[:n] if len(doc) else np.zeros(n, np.int64)


def keep_columns(batch: pa.RecordBatch, names: list[str]) -> list[pa.Array]:
    return [batch.column(batch.schema.get_field_index(x)) for x in names]


def ragged(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """List array from flat values and the number of values of each row."""
    off = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=off[1:])
    return pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(values, kind))
