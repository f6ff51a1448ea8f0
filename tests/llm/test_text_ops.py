"""License scan, quality rules, classifiers: brute force and edge cases."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bourse.llm import license as L
from bourse.llm import lines as LN
from bourse.llm import quality as Q
from bourse.llm import rules as R
from bourse.llm import textcols as T
from bourse.llm import toxicity as X
from bourse.llm.sampling import remainder
from tests.llm.conftest import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LETTERS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def block(texts):
    enc = [t.encode() for t in texts]
    return np.frombuffer(b"".join(enc), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in enc])]).astype(np.int64)


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def count_rules(t):
    t = t or ""
    ws = WORD.findall(t)
    lines, seen, dup = t.split("\n"), set(), 0
    for x in lines:
        dup += bool(WORD.search(x)) and x in seen
        seen.add(x)
    grams = Counter(tuple(ws[i:i + 3]) for i in range(len(ws) - 2))
    hit = {i + j for i in range(len(ws) - 2) if grams[tuple(ws[i:i + 3])] > 1 for j in range(3)}
    return (len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t), dup, len(hit))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab A#|é\n\t\x0b\r日"), max_size=40), min_size=1, max_size=6))
def test_rule_counts_of_blocks(texts):
    r = R.block_counts(*block(texts))
    assert [tuple(int(r[c][i]) for c in R.COUNTS) for i in range(len(texts))] == [count_rules(t) for t in texts]


def phrase_places(t):
    ws = LETTERS.findall(lower(t or ""))
    at = [(k, label) for label, p in L.BASE for p in [p.split()]
          for k in range(len(ws) - len(p) + 1) if ws[k:k + len(p)] == p]
    return (len(ws), len(at), min(at)[0] if at else None, max(at)[0] if at else None,
            ",".join(sorted({x for _, x in at})))


def check_scan(rows):
    for r in rows:
        t = r["t"]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == phrase_places(t)
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(r["labels"])


def test_license_scan_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check_scan(L.license_scan(docs).join(docs.selectExpr("doc_id", "text AS t"), "doc_id").collect())


def test_license_scan_odd(spark, odd_docs, no_docs):
    got = L.license_scan(odd_docs).collect()
    assert len(got) == odd_docs.count()
    want = sorted((str(r.doc_id), phrase_places(r.text)) for r in odd_docs.collect())
    keys = ("n_words", "n_base", "first_word", "last_word", "base_labels")
    assert sorted((str(r.doc_id), tuple(r[k] for k in keys)) for r in got) == want
    assert L.license_scan(no_docs).count() == 0


def test_license_spans_merge_neighbouring_diagonals(spark):
    text = "x y redistribution and use in source and any binary forms with or without modification are permitted provided " \
           "that the following conditions are met z"
    docs = spark.createDataFrame([(1, text), (2, "cc x by general public cc by license")], "doc_id long, text string")
    got = {r.doc_id: r for r in L.license_scan(docs).collect()}
    assert got[1].labels == "bsd" and got[1].n_base == 0 and 0.8 <= got[1].score < 1
    assert got[2].base_labels == "cc-by" and (got[2].first_word, got[2].last_word) == (5, 5)


def test_quality_rules_counts_and_verdict(spark, odd_docs, no_docs):
    for docs in (spark.read.parquet(f"{SF}/documents.parquet"), odd_docs):
        rows = R.quality_rules(docs).collect()
        got = sorted((str(r.doc_id), *[r[c] for c in R.COUNTS], r.base_failed) for r in rows)
        want = []
        for r in docs.collect():
            c = count_rules(r.text)
            want.append((str(r.doc_id), *c, c[0] < 50 or 100 * c[4] > 50 * c[0]))
        assert got == sorted(want)
        assert all(not (r.kept and r.base_failed) for r in rows)
    assert R.quality_rules(no_docs).count() == 0


def test_js_distance(spark):
    from pyspark.sql import functions as F

    p, q = [0.5, 0.5, 0.0], [0.25, 0.25, 0.5]
    m = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
    kl = lambda a: sum(x * math.log2(x / y) for x, y in zip(a, m, strict=True) if x)
    got = spark.createDataFrame([(p, q)], "p array<double>, q array<double>").select(
        R.js_distance(F.col("p"), F.col("q"))).first()[0]
    assert got == pytest.approx(math.sqrt((kl(p) + kl(q)) / 2))


def test_quality_rules_reject_junk_and_keep_prose(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = R.quality_rules(docs).where("NOT base_failed").join(labels, "doc_id").collect()
    good = [r.kept for r in rows if r.quality == 1]
    assert sum(good) >= 0.99 * len(good)


def test_quality_rules_keep_rare_and_unlabelled_languages(spark):
    """The same clean texts are kept with 3 documents of a language and with 20, and with none labelled."""
    def text(letters, common, k):
        rng = np.random.default_rng(k)
        words = [w for i in range(60) for w in (common[i % len(common)], "".join(rng.choice(list(letters), 6)))]
        return " ".join(words) + "."

    latin, cyrillic, greek = "abcdefghijklmnoprstuvw", "абвгдежзиклмнопрстуфхы", "αβγδεζηθικλμνξοπρστυφω"
    base = [(k, text(latin, R.COMMON["en"], k), "en") for k in range(40)]
    base += [(900, " ".join(f"x{k}##$$%%&&{k}**" for k in range(80)), "en")]
    base += [(200 + k, text(greek, ["και", "το"], k), None) for k in range(3)]
    for n in (3, 20):
        docs = spark.createDataFrame(base + [(100 + k, text(cyrillic, ["на", "не"], k), "ru") for k in range(n)],
                                     "doc_id long, text string, lang string")
        kept = {r.doc_id: r.kept for r in R.quality_rules(docs).collect()}
        assert [i for i, k in kept.items() if not k] == [900]


def test_chunks_cover_whole_texts():
    texts = ["", "a", "b" * Q.CHUNK, "c" * (3 * Q.CHUNK + 5)]
    rows, n = Q.chunk_rows(*block(texts))
    assert n.tolist() == [1, 1, 1, 4] and rows.shape == (7, Q.CHUNK + Q.WIDTH)
    body = b"".join(r[:Q.CHUNK].tobytes() for r in rows[3:])
    assert body.rstrip(b"\0") == texts[3].encode()
    assert (rows[3, Q.CHUNK:] == rows[4, :Q.WIDTH]).all()


def test_convolution_is_the_plain_sum():
    rng = np.random.default_rng(1)
    table = rng.normal(size=(Q.WIDTH, 256, Q.FILTERS)).astype(np.float32)
    rows, _ = Q.chunk_rows(*block(["some text, twice. " * 30]))
    z = Q.convolve(rows, table)
    p = 17
    want = sum(table[w, rows[1, p * Q.STRIDE + w]] for w in range(Q.WIDTH))
    assert np.allclose(z[1, p], want, atol=1e-4)


def scores(fn, spark, sf, modulus, held, label):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    left = remainder("doc_id", modulus)
    out = fn(docs, labels, left != held, left == held)
    rows = out.join(labels, "doc_id", "left").collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    rows = [r for r in rows if r.held_out and r[label] is not None]
    pos = [r.score for r in rows if r[label] == 1]
    neg = [r.score for r in rows if r[label] == 0]
    return np.mean([[p > n or 0.5 * (p == n) for n in neg] for p in pos])


def test_quality_held_out(spark):
    assert scores(Q.quality_scores, spark, "/root/testdata/sf0.01", 5, 0, "quality") > 0.9


def test_toxicity_held_out(spark):
    assert scores(X.toxicity_scores, spark, "/root/testdata/sf0.01", 4, 2, "toxic") > 0.75


def test_classifiers_odd(spark, odd_docs, no_docs, no_labels):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, 0, 1), (8, None, None), (None, 1, 1), (99, 0, 0)],
                                   "doc_id long, quality int, toxic int")
    left = remainder("doc_id", 5)
    for fn in (Q.quality_scores, X.toxicity_scores):
        for y in (labels, no_labels):
            rows = fn(odd_docs, y, left != 9, left == 0).collect()
            assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 and r.held_out is not None for r in rows)
        assert fn(no_docs, labels, left != 9, left == 0).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text("abcdé", min_size=1, max_size=11), min_size=1, max_size=12))
def test_automaton_is_levenshtein(words):
    terms = ["abc", "abcde", "badcab", "abcdabcd", "ébcaab"]
    got = X.Automaton(terms, [1.0] * len(terms)).match(words)
    for w, t, e in zip(words, *got, strict=True):
        best = min((distance(w, x), x) for x in terms if distance(w, x) <= X.allowed(x)) if any(
            distance(w, x) <= X.allowed(x) for x in terms) else None
        assert (t >= 0) == (best is not None)
        if best:
            assert e == best[0] == distance(w, terms[t])


def test_context_separates_quotation():
    model = {"terms": ["stupid"], "weights": [4.0], "ordinary": ["stumpid"]}
    texts = ["you are so stupid", "he wrote a \"stupid\" term about it", "a stuupid thing", "a stumpid thing", "fine"]
    x = X.features(*block(texts), model)
    assert x[0, 0] > 4 > x[1, 0] > 0 and x[2, 3] > 0 and not x[3].any() and not x[4].any()


def test_span_hash_is_place_independent():
    d, o = block(["abc xyz abc", "abc"])
    s, e = T.spans(T.NOT_SPACE[d], o)
    h = T.span_hash(T.prefix_hash(d), s, e)
    assert h[0] == h[2] == h[3] != h[1]


def thue_morse(n, a, b):
    x, y = [a], [b]
    while len(x) < n:
        x, y = x + y, y + x
    return x, y


def test_structured_words_and_lines_do_not_collide():
    """abba... and baab... agree in any polynomial modulo a power of two."""
    x, y = ("".join(v) for v in thue_morse(1024, "a", "b"))
    d, o = block([f"{x} {y}"])
    s, e = T.spans(T.NOT_SPACE[d], o)
    h = T.span_hash(T.prefix_hash(d), s, e)
    assert h[0] != h[1]
    d, o = block(["\n".join(" ".join(v) for v in thue_morse(2048, "yes", "no"))])
    got = LN.BlockLines(d, o, 1)
    la, lb = got.line_hash()
    assert la[0] != la[1] and lb[0] != lb[1]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.binary(max_size=40), min_size=1, max_size=12))
def test_span_hash_tells_spans_apart(parts):
    d = np.frombuffer(b"".join(parts), np.uint8)
    e = np.cumsum([len(p) for p in parts])
    h = T.span_hash(T.prefix_hash(d), e - [len(p) for p in parts], e)
    assert len(set(h.tolist())) == len(set(parts))
    assert all(h[parts.index(p)] == x for p, x in zip(parts, h, strict=True))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=2, max_size=30), st.data())
def test_polynomials_lose_a_word(words, data):
    h = np.array(words, np.uint64)
    k = data.draw(st.integers(0, len(words) - 1))
    ends = lambda *x: [np.array([v]) for v in x]
    for base in (0, 1):
        c = T.weighted_sums(h, base)
        got = T.joined(T.raw_span(c, *ends(0, k), base), T.raw_span(c, *ends(k + 1, len(h)), base), np.array([k]), base)
        rest = np.delete(h, k)
        assert got[0] == T.raw_span(T.weighted_sums(rest, base), *ends(0, len(rest)), base)[0]
        want = sum(int(w) % T.PRIME * pow(T._BASES[base], j, T.PRIME) for j, w in enumerate(rest)) % T.PRIME
        assert got[0] == want


def test_models_do_not_share_an_automaton():
    one = {"terms": ["stupid"], "weights": [4.0], "ordinary": ["stumpid"]}
    other = one | {"ordinary": ["something"]}
    assert not X.features(*block(["a stumpid thing"]), one)[0].any()
    assert X.features(*block(["a stumpid thing"]), other)[0].any()


def test_automaton_states_are_bounded(monkeypatch):
    monkeypatch.setattr(X, "MOST_STATES", 50)
    rng = np.random.default_rng(2)
    terms = ["".join(rng.choice(list("abcdefgh"), 9)) for _ in range(40)]
    bounded, free = X.Automaton(terms, [1.0] * 40), X.Automaton(terms, [1.0] * 40)
    monkeypatch.setattr(X, "MOST_STATES", 10**9)
    for _ in range(12):
        words = ["".join(rng.choice(list("abcdefgh"), 9)) for _ in range(30)] + terms[:2]
        monkeypatch.setattr(X, "MOST_STATES", 50)
        a = bounded.match(words)
        monkeypatch.setattr(X, "MOST_STATES", 10**9)
        b = free.match(words)
        assert all((p == q).all() for p, q in zip(a, b, strict=True))
    assert len(bounded.sets) < len(free.sets) / 2
