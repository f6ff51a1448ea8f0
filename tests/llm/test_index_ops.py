"""Conversation trie, vector search and vector codes: brute force and edge cases."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bourse.llm import codes as C
from bourse.llm import mtree as M
from bourse.llm import trie as P

EXTRA = ", a int, b string, key string, score double, rank int, v string, state string, depth string, node int, path string"
TURNS = "conv_id long, turn long, role string, text string" + EXTRA
VECTORS = "vec_id long, embedding array<float>, label int" + EXTRA
NONE = (None,) * 10


# ---------------------------------------------------------------- op11
def brute_trie(rows):
    """Nodes from all prefixes of all rebuilt conversations (no two turns equal in order)."""
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, q in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        q = tuple(own.get(c - c % 5, [])[:h] + q[h:])
        for d in range(len(q) + 1):
            members[q[:d]].append(c)
        ends[q].append(c)
    out = {}
    for q in sorted(members, key=len, reverse=True):
        kids = [x for x in members if len(x) == len(q) + 1 and x[:-1] == q]
        leaves = sum(out[x][5] for x in kids) or 1
        saved = sum(out[x][6] for x in kids) + (len(members[q]) - 1) * (len(q[-1][1].encode()) if q else 0)
        out[q] = (min(members[q]), len(q), min(members[q[:-1]]) if q else None, len(members[q]), len(kids), leaves, saved,
                  hashlib.sha256(",".join(map(str, sorted(ends[q]))).encode()).hexdigest())
    return sorted(out.values(), key=str)


def trie_rows():
    """Shared openings, one conversation of many turns, copies of one conversation, nulls and empty texts."""
    rng = np.random.default_rng(3)
    rows = []
    for c in range(60):
        n = 40 if c == 20 else int(rng.integers(0, 7))
        rows += [(c, t if t else None, "user" if t % 2 == 0 else "assistant", f"hot {t}" if c % 3 else f"é{c} {t}") for t in range(n)]
    rows += [(c, t, None if t == 1 else "user", None if t == 2 else "") for c in (101, 102, 103, 104) for t in range(4)]
    rows += [(1000 + c, t, "user", f"copy {t}") for c in range(40) for t in range(9)]
    return rows


@pytest.mark.parametrize("segment,shard", [(512, 1 << 17), (3, 11), (1, 1)])
def test_trie_brute_force(spark, segment, shard):
    rows = trie_rows()
    df = spark.createDataFrame([r + NONE for r in rows], TURNS).repartition(5)
    got = P.prefix_trie(df, segment=segment, shard=shard)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_trie(rows)


def test_trie_edges(spark):
    assert P.prefix_trie(spark.createDataFrame([], TURNS)).count() == 0
    assert P.prefix_trie(spark.createDataFrame([(None, 1, "user", "x") + NONE], TURNS).limit(1)).count() == 0
    # base absent and fewer own turns than are skipped: no turns, so only the root; repeated rows each count
    c = next(c for c in range(1, 99) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 2)
    only = [(c, 0, "user", "x"), (c, 0, "user", "x")]
    got = P.prefix_trie(spark.createDataFrame([r + NONE for r in only], TURNS)).collect()
    assert [tuple(r) for r in got] == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]
    twice = [(5, 0, "user", "x"), (5, 0, "user", "x"), (5, None, "a", "y" * 100_000)]
    got = sorted(map(tuple, P.prefix_trie(spark.createDataFrame([r + NONE for r in twice], TURNS)).collect()), key=lambda r: r[1])
    assert [r[1] for r in got] == [0, 1, 2, 3] and all(r[6] == 0 for r in got)


@settings(max_examples=40, deadline=None)
@given(st.sets(st.lists(st.integers(0, 6), min_size=1, max_size=5).map(tuple), min_size=1, max_size=30))
def test_double_array_holds_each_path(paths):
    paths = sorted(paths)
    trie, state = P.DoubleArray(7), {(): 0}
    for level in range(5):
        new = sorted({(state[p[:level]], p[level], p[:level + 1]) for p in paths if len(p) > level})
        slots = trie.add_level(np.array([x for x, _, _ in new], np.int64), np.array([x for _, x, _ in new], np.int64))
        state |= {p: int(s) for (_, _, p), s in zip(new, slots, strict=True)}
    assert len(set(state.values())) == len(state)
    for p, s in state.items():
        if p:
            assert trie.step(np.array([state[p[:-1]]]), np.array([p[-1]]))[0] == s


# ---------------------------------------------------------------- op12
def brute_top(rows, k=10, scale=1024):
    kept = {}
    for i, v, *_ in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            kept.setdefault((i, tuple(int(np.floor(scale * float(np.float32(x)))) for x in v)))
    out = []
    for q in sorted({i for i, _ in kept if i % 100 == 0}):
        qv = min(v for i, v in kept if i == q)
        s = sorted((-sum(a * b for a, b in zip(qv, v, strict=False)), i) for i, v in kept if i != q)[:k]
        out += [(q, n, i, -x) for n, (x, i) in enumerate(s, 1)]
    return out


def vector_rows(n=900, dim=16, seed=1):
    """Clusters, one vector of a third of the rows, longer and shorter ones, and rows that take no part."""
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(6, dim))
    hot = rng.normal(size=dim).tolist()
    rows = []
    for i in range(n):
        v = hot if i % 3 == 0 else (centre[i % 6] * (1 + i % 7) + 0.2 * rng.normal(size=dim)).tolist()
        rows.append((i, [float(x) for x in v], None if i % 10 == 3 else i % 4))
    rows += [(5000, None, 1), (5001, [None] * dim, 1), (5002, [float("nan")] * dim, 1), (5003, [float("inf")] + [0.0] * (dim - 1), 1)]
    return rows


def test_top_products_brute_force(spark, monkeypatch):
    rows = vector_rows()
    rows += [(700, rows[0][1], 1), (701, [0.5] * 3, 1), (702, [], 1), (None, [1.0] * 16, 1), (100, rows[5][1], 2), rows[4]]
    df = spark.createDataFrame([r + NONE for r in rows], VECTORS).repartition(4)
    got = M.top_products(df, F.col("vec_id") % 100 == 0)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == brute_top(rows)


def test_top_products_edges(spark):
    query = F.col("vec_id") % 100 == 0
    assert M.top_products(spark.createDataFrame([], VECTORS), query).count() == 0
    few = spark.createDataFrame([(0, [1.0, 2.0], 1) + NONE, (7, [1.0, 2.0], 1) + NONE], VECTORS)
    assert [tuple(r) for r in M.top_products(few, query).collect()] == [(0, 1, 7, 5 << 20)]
    empty = spark.createDataFrame([(i, [], 1) + NONE for i in (0, 3, 2)], VECTORS)
    assert sorted(map(tuple, M.top_products(empty, query, k=1).collect())) == [(0, 1, 2, 0)]
    huge = spark.createDataFrame([(0, [3e38, -3e38], 1) + NONE, (1, [3e38, 1.0], 1) + NONE], VECTORS)
    assert M.top_products(huge, query).count() == 1


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 5))
def test_search_prunes_nothing_wanted(seed, k):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.integers(-50, 50, (40, 4)), np.repeat(rng.integers(-50, 50, (1, 4)), 20, 0)])
    ids = rng.permutation(1000)[:len(x)]
    objects = x[:5]
    d = M.distances(M.products(x, objects), M.norms2(x), M.norms2(objects))
    near = d.argmin(1)
    nodes = []
    for o in range(5):
        at = np.flatnonzero(near == o)
        at = at[np.argsort(d[at, o], kind="stable")]
        if len(at):
            r = M._node_row(ids[at], x[at], d[at, o], o, objects)
            nodes.append(dict(zip(("object", "ids", "flat", "near", "far", "top", "pages"), r[:7], strict=True))
                         | {c: np.array(v) for c, v in zip(("radius", "parent", "tops"), r[7:], strict=True)})
    block = M.Block(ids[::7], x[::7], objects, ids[:5], k)
    block.search(nodes)
    got = block.rows().to_pydict()
    for q, v in zip(ids[::7], x[::7], strict=True):
        want = sorted((-int(v @ y), int(i)) for i, y in zip(ids, x, strict=True) if i != q)[:k]
        assert [(-s, i) for j, i, s in zip(got["query_id"], got["vec_id"], got["score"], strict=True) if j == q] == want


# ---------------------------------------------------------------- op13
def brute_codes(rows, parts=16, entries=64, rounds=2):
    kept = sorted(((i is None, i or 0, [int(np.floor(256 * float(np.float32(x)))) for x in v], i, g) for i, v, g in rows
                   if v is not None and all(x is not None and np.isfinite(x) for x in v)), key=lambda r: r[:3])
    x = np.array([r[2] for r in kept]).reshape(len(kept), parts, -1)
    books = x[:entries].transpose(1, 0, 2).copy()

    def assign():
        return np.stack([((x[:, p, None] - books[p][None]) ** 2).sum(2).argmin(1) for p in range(parts)], 1)
    for _ in range(rounds):
        code = assign()
        for p in range(parts):
            for e in set(code[:, p]):
                m = x[code[:, p] == e, p]
                books[p, e] = m.sum(0) // len(m)
    code = assign()
    error = sum(((x[:, p] - books[p][code[:, p]]) ** 2).sum(1) for p in range(parts))
    by = defaultdict(int)
    for r, e in zip(kept, error, strict=True):
        by[r[4]] += int(e)
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    return sorted(((r[3], bytes(c.astype(np.uint8)).hex(), int(e), by[r[4]], digest)
                   for r, c, e in zip(kept, code, error, strict=True)), key=str)


@pytest.mark.parametrize("rounds", [1, 2, 5])
def test_codes_brute_force(spark, rounds):
    rows = vector_rows(600, 32, 4)
    rows += [rows[7], (9, rows[11][1], 2), (None, rows[12][1], None)]
    df = spark.createDataFrame([r + NONE for r in rows] + [(6000, [1.0] * 31, 1) + NONE, (6001, [], 1) + NONE, (6002, [0.5] * 16, 1) + NONE],
                               VECTORS).repartition(3)
    got = C.coded_report(df, rounds=rounds)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_codes(rows, rounds=rounds)


def test_codes_edges(spark):
    assert C.coded_report(spark.createDataFrame([], VECTORS)).count() == 0
    one = [(3, [-1.0] * 16, None)]
    got = [tuple(r) for r in C.coded_report(spark.createDataFrame([one[0] + NONE], VECTORS)).collect()]
    assert got == brute_codes(one)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.integers(2, 12), st.lists(st.integers(1, 9), min_size=1, max_size=4))
def test_bounds_never_lie(seed, entries, lengths):
    rng = np.random.default_rng(seed)
    x = rng.integers(-6, 7, (50, 2))
    c = x[:entries].copy()
    known = C.ranked(C.all_distances(x, c), min(3, entries - 1))
    for b in lengths:
        new = c + rng.integers(-2, 3, c.shape)
        moves = np.sqrt(((new - c) ** 2).sum(1).astype(float))
        known, own, _, _ = C.reassigned(x, new, C.lengthened(C.shortened(C.moved(known, moves), b), min(b, entries - 1)))
        d = C.all_distances(x, new)
        assert (known.code == d.argmin(1)).all() and (own == d.min(1)).all()
        true = np.sqrt(np.take_along_axis(d, known.near.astype(int), 1))
        assert (np.isinf(known.low) | (known.low <= true)).all()
        c = new
