"""Token ids of whole texts, by a published tokenizer with a word cache per task.

The tokenizer (``word_bpe_49k.json``: NFC, lower case, runs of letters, single
digits, runs of other characters, each run merged on its own) gives a run the
same ids wherever it stands. So a block's runs are found with numpy, its
distinct runs are encoded once by the tokenizer and kept in a bounded cache,
and the ids of all texts are gathered from there. Texts outside what the run
finder covers (characters beyond Latin Extended-B, letters whose lower case
changes length, special-token strings) go through the tokenizer whole, and so
does every white-space-separated piece with an apostrophe.
"""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import chain

import numpy as np

from bourse.llm import textcols as T

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
SPECIAL = (b"<|startoftext|>", b"<|endoftext|>")
LIMIT = 0x250
CACHE_RUNS = 500_000     # some 40 bytes a run


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    kind, lower, safe = np.zeros(LIMIT, np.uint8), np.arange(LIMIT), np.ones(LIMIT, bool)
    for cp in range(LIMIT):
        c = chr(cp)
        cat = unicodedata.category(c)
        kind[cp] = 0 if c.isspace() and not 0x1C <= cp <= 0x1F else 1 if cat[0] == "L" else 2 if cat[0] == "N" else 3
        low = c.lower()
        if len(low) != 1 or ord(low) >= LIMIT or unicodedata.normalize("NFC", c) != c:
            safe[cp] = False
        else:
            lower[cp] = ord(low)
    return kind, lower, safe


KIND, LOWER, SAFE = _tables()
_KIND_BYTE = np.zeros(256, np.uint8)
_KIND_BYTE[:128] = KIND[:128]


class RunTokenizer:
    """Tokenizer of blocks of texts."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.run = Tokenizer(self.whole.model)             # for runs that are already normalised and split; one model in memory
        self.run.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=False)
        self._reset()

    def _reset(self) -> None:
        self.keys = np.zeros(0, np.uint64)                 # hashes of the known runs, sorted
        self.first = np.zeros(0, np.int64)                 # where each one's ids begin
        self.count = np.zeros(0, np.int32)
        self.ids = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def _encoded(self, runs: list[bytes]) -> list[list[int]]:
        """Ids of every run; one with an apostrophe is split by the tokenizer itself."""
        out = [x.ids for x in self.run.encode_batch_fast([r.decode() for r in runs], add_special_tokens=False)]
        apart = [i for i, r in enumerate(runs) if b"'" in r]
        for i, x in zip(apart, self.whole.encode_batch_fast([runs[i].decode() for i in apart], add_special_tokens=False),
                        strict=True):
            out[i] = x.ids
        return out

    def _add(self, hashes: np.ndarray, runs: list[bytes]) -> None:
        """Learn runs of sorted hashes that are not known yet."""
        got = self._encoded(runs)
        count = np.fromiter(map(len, got), np.int32, len(got))
        total = np.cumsum(count, dtype=np.int64)
        end = self.used + int(total[-1])
        if end > len(self.ids):
            grown = np.zeros(max(end, len(self.ids) * 3 // 2), np.uint32)
            grown[:self.used] = self.ids[:self.used]
            self.ids = grown
        self.ids[self.used:end] = np.fromiter(chain.from_iterable(got), np.uint32, end - self.used)
        first = self.used + total - count
        self.used = end
        # both lists are sorted: the new ones go to their places
        at = np.searchsorted(self.keys, hashes) + np.arange(len(hashes))
        old = np.ones(len(self.keys) + len(hashes), bool)
        old[at] = False
        for name, values in (("keys", hashes), ("first", first), ("count", count)):
            was = getattr(self, name)
            merged = np.empty(len(old), was.dtype)
            merged[old], merged[at] = was, values
            setattr(self, name, merged)

    def _missing(self, hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, hashes)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == hashes[known]
        return np.flatnonzero(~known)

    def block(self, d: np.ndarray, o: np.ndarray) -> list[np.ndarray]:
        """uint32 ids of every text of a block."""
        n = len(o) - 1
        raw = d.tobytes()
        lead = np.flatnonzero(d >= 0xC0)
        bad = np.zeros(n, bool)
        wide = lead[d[lead] > 0xC9]
        bad[T.owners(o, wide)] = True
        lead = lead[d[lead] <= 0xC9]
        cp = ((d[lead].astype(np.int64) & 0x1F) << 6) | (d[lead + 1] & 0x3F) if len(lead) else np.zeros(0, np.int64)
        odd = cp >= LIMIT
        odd |= ~SAFE[np.minimum(cp, LIMIT - 1)]
        bad[T.owners(o, lead[odd])] = True
        for mark in SPECIAL:
            at = raw.find(mark)
            while at >= 0:
                bad[T.owners(o, np.array([at]))] = True
                at = raw.find(mark, at + 1)
        if bad.any():
            return self._mixed(d, o, raw, bad)
        low = T.LOWER[d]
        kind = _KIND_BYTE[d]
        if len(lead):
            to = LOWER[cp]
            low[lead], low[lead + 1] = 0xC0 | (to >> 6), 0x80 | (to & 0x3F)
            kind[lead] = kind[lead + 1] = KIND[cp]
        inner = (d & 0xC0) == 0x80
        prev = np.zeros_like(kind)
        prev[1:] = kind[:-1]
        prev[o[:-1][o[:-1] < o[1:]]] = 0
        begins = (kind != 0) & ~inner & ((kind != prev) | (kind == 2))
        if b"'" in raw:
            s, e = T.spans(kind != 0, o)
            cum = np.concatenate([[0], np.cumsum(d == 39)])
            has = cum[e] > cum[s]
            cover = np.zeros(len(d) + 1, np.int8)
            cover[s[has]] += 1
            cover[e[has]] -= 1
            begins &= ~np.cumsum(cover[:-1]).astype(bool)
            begins[s[has]] = True
        stop = np.zeros(len(d) + 1, bool)
        stop[:-1] = begins | (kind == 0)
        stop[o] = True
        at = np.flatnonzero(stop)
        where = np.flatnonzero(np.append(begins, False)[at])
        s, e = at[where], at[where + 1]
        h = T.span_hash(T.prefix_hash(low), s, e)
        uniq, one, back = np.unique(h, return_index=True, return_inverse=True)
        if len(self.keys) > CACHE_RUNS:
            self._reset()
        new = self._missing(uniq)
        if len(new):
            text = low.tobytes()
            self._add(uniq[new], [text[a:b] for a, b in zip(s[one[new]].tolist(), e[one[new]].tolist(), strict=True)])
        slot = np.searchsorted(self.keys, uniq)[back]
        count = self.count[slot]
        total = np.cumsum(count)
        size = int(total[-1]) if len(total) else 0
        flat = self.ids[np.repeat(self.first[slot] - (total - count), count) + np.arange(size)]
        ends = np.concatenate([[0], total])[np.searchsorted(s, o)]
        return [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def _mixed(self, d: np.ndarray, o: np.ndarray, raw: bytes, bad: np.ndarray) -> list[np.ndarray]:
        out: list = [None] * len(bad)
        pick = np.flatnonzero(bad)
        for i, x in zip(pick, self.whole.encode_batch_fast([raw[o[i]:o[i + 1]].decode() for i in pick],
                                                            add_special_tokens=False), strict=True):
            out[i] = np.array(x.ids, np.uint32)
        good = np.flatnonzero(~bad)
        if len(good):
            data = np.frombuffer(b"".join(raw[o[i]:o[i + 1]] for i in good), np.uint8)
            off = np.concatenate([[0], np.cumsum(o[good + 1] - o[good])])
            for i, x in zip(good, self.block(data, off), strict=True):
                out[i] = x
        return out


@contextmanager
def tokenizer(path: str) -> Iterator[RunTokenizer]:
    """A tokenizer for one task. It goes with the task, and so does what it has learnt: a
    worker that later tasks use again keeps neither (a load takes tenths of a second)."""
    one = RunTokenizer(path)
    try:
        yield one
    finally:
        one.__dict__.clear()
