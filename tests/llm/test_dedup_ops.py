"""Near duplicates, lines, benchmark: brute force, hot groups and edge cases."""

import itertools
import os
import random
import re
from itertools import combinations

import pytest

from bourse.llm import decontam as D
from bourse.llm import lines as LN
from bourse.llm import minhash as M
from tests.llm.conftest import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def shingles(t):
    ws = WORD.findall(lower(t))
    if len(ws) >= 5:
        return frozenset(tuple(ws[i:i + 5]) for i in range(len(ws) - 4))
    return frozenset([tuple(ws)] if ws else [])


def brute(rows, percent):
    """Sorted (doc_id, set size, component) by all pairs."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        n = len(sets[a] & sets[b])
        if n and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            parent[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[find(k)] = min(low.get(find(k), i), i)
    return sorted(((i, len(s), (low.get(find(k)) if s else i)) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True))),
                  key=str)


def check_near(docs, threshold):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = M.near_duplicates(docs, threshold=threshold).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows, round(100 * threshold))
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


@pytest.mark.parametrize("threshold", [0.85, 0.8])
def test_near_duplicates_brute_force(spark, threshold):
    check_near(spark.read.parquet(f"{SF}/documents.parquet"), threshold)


def test_near_duplicates_odd(spark, odd_docs, no_docs):
    check_near(odd_docs, 0.85)
    assert M.near_duplicates(no_docs).count() == 0
    kept = M.keep_first(odd_docs)
    assert kept.columns == odd_docs.columns
    texts = [(r.doc_id, r.text) for r in kept.collect()]
    assert len([t for t in texts if t[0] in (1, 2)]) == 1
    assert {(3, None), (4, ""), (None, None), (6, texts and next(t for i, t in texts if i == 6))} <= set(texts)
    assert not any(i in (7, 9) for i, _ in texts)


def test_near_duplicates_chain_and_large_group(spark):
    base = [f"t{i}" for i in range(120)]
    rows = [(k, " ".join(base[:k] + [f"c{k}"] + base[k + 1:])) for k in range(100)]        # one word replaced each
    chain = [f"u{i}" for i in range(200)]
    rows += [(200 + k, " ".join(chain[4 * k:4 * k + 120])) for k in range(8)]               # each near its neighbours only
    check_near(spark.createDataFrame(rows, "doc_id long, text string"), 0.85)


def test_near_duplicates_copies_with_own_edits(spark):
    """Copies of one text with 1 to 4 edits, and copies of copies: many pairs just under the threshold."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(150)]

    def edited(ws, n):
        ws = list(ws)
        for _ in range(n):
            k = rng.randrange(len(ws))
            ws[k:k + rng.randrange(2)] = [f"e{rng.randrange(10 ** 6)}"]
        return ws

    copies = [edited(base, rng.randint(1, 4)) for _ in range(120)]
    copies += [edited(rng.choice(copies), rng.randint(1, 2)) for _ in range(40)]
    check_near(spark.createDataFrame([(k, " ".join(c)) for k, c in enumerate(copies)], "doc_id long, text string"), 0.85)


def test_near_duplicates_shuffle_no_text_and_leave_little(spark, monkeypatch):
    """Whatever the sizes, texts are not dealt out; tables that nothing reads any more are removed."""
    plans, folders, saved = {}, [], M.saved

    def recorded(df, name):
        plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString())
        out = saved(df, name)
        folders.append((name, out.saved_at))
        return out

    monkeypatch.setattr(M, "saved", recorded)
    words = [f"w{i}" for i in range(60)]
    rows = [(k, " ".join(words[:k] + [f"c{k}"] + words[k + 1:])) for k in range(20)]
    rows += [(100 + k, " ".join(f"own{k}x{i}" for i in range(40))) for k in range(30)] + [(None, rows[0][1]), (None, "one two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")         # as if every table were large
    try:
        check_near(docs, 0.85)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    lines = plans["near-sets"].splitlines()
    at = next(i for i, x in enumerate(lines) if "MapInArrow" in x)
    below = list(itertools.takewhile(lambda x: len(x) - len(x.lstrip(" :+-")) > lines[at].index("MapInArrow"), lines[at + 1:]))
    assert below and not any("Exchange" in x or "Join" in x for x in below)
    left = {name for name, path in folders if os.path.exists(path.removeprefix("file:"))}
    assert not left & {"near-postings", "near-candidates", "near-lists", "near-sets", "near-elements", "near-open", "near-tested"}
    assert {"near-signatures", "near-named"} <= left                     # the lazy result reads them


def test_least_matches():
    assert M.least_matches(0.85, 48) == 27 and M.least_matches(0.8, 48) == 24 and M.least_matches(0.5, 1) == 1


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (3, 2), (5, 4), (7, 8), (8, 9), (9, 10), (10, 11)], "a long, b long")
    got = {r.node: r.comp for r in M.components(links).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 7: 7, 8: 7, 9: 7, 10: 7, 11: 7}


def brute_lines(rows, min_words=6):
    """Remaining text of every (doc_id, text) row."""
    place, where = {}, []
    for i, t in rows:
        for n, line in enumerate(t.split("\n") if t is not None else []):
            ws = tuple(WORD.findall(lower(line)))
            if ws:
                at = (i is None, i or 0, n)
                place[ws] = min(place.get(ws, at), at)
    def near(x, y):
        x, y = sorted((x, y), key=len)
        if len(y) - len(x) > 1:
            return False
        if len(x) == len(y):
            return sum(a != b for a, b in zip(x, y, strict=True)) == 1
        return any(y[:k] + y[k + 1:] == x for k in range(len(y)))
    late = {x for x in place for y in place if x != y and min(len(x), len(y)) >= min_words and place[y] < place[x] and near(x, y)}
    for i, t in rows:
        if t is None:
            where.append((i, None))
            continue
        keep = []
        for n, line in enumerate(t.split("\n")):
            ws = tuple(WORD.findall(lower(line)))
            if not ws or (ws not in late and place[ws] == (i is None, i or 0, n)):
                keep.append(line)
        where.append((i, "\n".join(keep)))
    return sorted(where, key=str)


def test_line_dedup_brute_force(spark, odd_docs, no_docs):
    assert LN.dedup_lines(no_docs).count() == 0
    base = "a line of seven words that repeats".split()
    rows = [(k, " ".join(base[:k % 7] + [f"z{k}"] + base[k % 7 + 1:]) + "\nshort\n" + " ".join(base)) for k in range(30)]
    rows += [(100, " ".join(base[:-1])), (101, " ".join([*base, "more"])), (102, " ".join(["x", *base[::-1]])),
             (103, "a a a a a a a\na a a a a a"), (None, " ".join(base)), (104, "A  LINE of\tseven words that repeats")]
    for docs in (spark.createDataFrame(rows, "doc_id long, text string"), odd_docs):
        got = LN.dedup_lines(docs)
        assert got.columns == docs.columns
        plain = [(r.doc_id, r.text) for r in docs.collect()]
        assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == brute_lines(plain)


def test_line_stage_cuts_each_text_once(spark):
    """The stage's filter and length read the cut text; a second cut would take a second Python worker in the same task."""
    import corpus_pipeline as C

    rows = [(1, "the same line stands here twice in all\nan own line of the first text here", "en", "s", 0),
            (2, "the same line stands here twice in all\nan own line of another text there", "en", "s", 0),
            (3, "the same line stands here twice in all", "en", "s", 0)]
    out = C.line_stage(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), SF)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("_without(") == 1, plan
    got = {(r.doc_id, r.text, r.n_chars) for r in out.collect()}
    assert got == {(1, rows[0][1], len(rows[0][1])), (2, rows[1][1].split("\n")[1], len(rows[1][1].split("\n")[1]))}


def test_half_keys_find_every_pair_one_edit_apart():
    import numpy as np

    def halves(ws):
        d = np.frombuffer(" ".join(ws).encode(), np.uint8)
        return set(LN.BlockLines(d, np.array([0, len(d)]), 1).halves()[0].tolist())

    for n in range(2, 9):
        x = [f"w{i}" for i in range(n)]
        for k in range(n + 1):
            assert halves(x) & halves([*x[:k], "new", *x[k:]])
            if k < n:
                assert halves(x) & halves([*x[:k], "new", *x[k + 1:]])


ITEM = "Anna bought 12 apples for 3 dollars each and Ben bought 12 pears for 5 dollars how much did Anna pay in all"


def test_contamination_slots(spark):
    docs = spark.createDataFrame([
        (1, f"Some text before. {ITEM}. And after."), (2, ITEM.replace("12", "40").replace("Anna", "Carla")),
        (3, ITEM.replace("12 apples", "40 apples")), (4, ITEM.upper()), (5, "Nothing of the kind stands in this clean text at all."),
        (6, None), (7, ""), (None, ITEM), (8, " ".join(ITEM.split()[:9])), (1, "another text")], "doc_id long, text string")
    bench = spark.createDataFrame([(70, ITEM), (71, None), (72, ""), (73, "too short"), (74, "six words make a short item")],
                                  "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.kind for r in D.contamination(docs, bench).collect()}
    assert got[1, 70] == "verbatim" and got[2, 70] == "reparameterised" and got[None, 70] == "verbatim"
    assert got[3, 70] == "reparameterised"                   # its other windows hold, whatever one value does
    assert (5, 70) not in got and (8, 70) not in got
    left = sorted(((r.doc_id, r.text) for r in D.decontaminate(docs, bench).collect()), key=str)
    assert (1, "another text") in left and (6, None) in left and len(left) == docs.count() - len({k[0] for k in got})


def test_contamination_odd(spark, odd_docs, no_docs):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert D.contamination(odd_docs, bench).count() == 0
    assert D.contamination(no_docs, bench).count() == 0
    assert D.decontaminate(odd_docs, bench.limit(0)).count() == odd_docs.count()


def test_contamination_brute_force(spark):
    """Without placeholders a match is a run of 8 equal words."""
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    items = {r.item_id: words(r.text) for r in bench.collect()}
    want = set()
    for r in docs.collect():
        ws = words(r.text)
        have = {tuple(ws[i:i + 8]) for i in range(len(ws) - 7)}
        for k, it in items.items():
            n = len(it) - 7
            if n > 0 and sum(tuple(it[i:i + 8]) in have for i in range(n)) >= 0.3 * n:
                want.add((r.doc_id, k))
    assert {(r.doc_id, r.item_id) for r in D.contamination(docs, bench).collect()} == want


def test_contamination_checks_placeholders_per_window(spark):
    """One changed value leaves the other windows; two item values may become one."""
    docs = spark.createDataFrame([
        (1, ITEM.replace("12 apples", "40 apples")), (2, ITEM.replace("3 dollars", "4 dollars").replace("5 dollars", "4 dollars")),
        (3, "Nothing of the kind stands in this clean text at all.")], "doc_id long, text string")
    bench = spark.createDataFrame([(70, ITEM)], "item_id long, text string")
    assert {r.doc_id for r in D.contamination(docs, bench).collect()} == {1, 2}


def test_registered_decontamination_checks_placeholders_per_window(spark, tmp_path):
    import corpus_pipeline
    from bourse.llm.plans import op5_benchmark_decontamination

    docs = spark.createDataFrame([(1, ITEM.replace("12 apples", "40 apples")), (2, "clean text")], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(70, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [r.doc_id for r in op5_benchmark_decontamination(spark, str(tmp_path)).collect()] == [1]
    assert [r.doc_id for r in corpus_pipeline.benchmark_stage(spark, docs, str(tmp_path)).collect()] == [2]


def test_contamination_word_for_word(spark):
    """Items of numbers or names, and items under five words, are found as they stand."""
    numbers, names = "17 4 23 8 15 42 16 99 3 5 12 77", "the Alice Bob Carol Dave Erin Frank Grace Heidi Ivan"
    docs = spark.createDataFrame([
        (1, f"see {numbers} end"), (2, f"It says {names} now"), (3, "And then: What is love? Nobody knows"), (4, "one two three Paris"),
        (5, "what love is nobody knows here " + " ".join(numbers.split()[::-1]))], "doc_id long, text string")
    bench = spark.createDataFrame([(80, numbers), (81, names), (82, "what is love"), (83, "Paris")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in D.contamination(docs, bench).collect()}
    assert set(got) == {(1, 80), (2, 81), (3, 82), (4, 83)}
    assert all(r.kind == "verbatim" and r.coverage == 1 for r in got.values())


def test_contamination_long_runs_of_long_items(spark):
    """A passage of 30 words counts whatever the item's length; scattered words of the same number do not."""
    item = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    docs = spark.createDataFrame([
        (1, "before " + " ".join(item[100:190]) + " after"), (2, " ".join(item[40:70])), (3, " ".join(item[40:69])),
        (4, " x ".join(" ".join(item[30 * k:30 * k + 15]) for k in range(6)))], "doc_id long, text string")
    bench = spark.createDataFrame([(90, " ".join(item))], "item_id long, text string")
    got = {r.doc_id: (r.matched, r.n_windows, r.kind) for r in D.contamination(docs, bench).collect()}
    assert got == {1: (83, 293, "verbatim"), 2: (23, 293, "verbatim")}


def test_short_lines_go_as_exact_copies(spark):
    """Every line that holds a word loses its later copies; near copies still need six words."""
    import corpus_pipeline

    url = "https://example.org/" + "x" * 300
    one, two = "a line of seven words that repeats", "a line of seven words that differs"
    docs = spark.createDataFrame([
        (1, f"MIT license.\n\n{url}\n中文的一行没有空格\none two three four five\n{one}"),
        (2, f"mit  LICENSE.\n\n{url}\n中文的一行没有空格\none two three four six\n{two}\nown words"), (3, "own words\nmore")],
        "doc_id long, text string")
    want = {1: docs.first().text, 2: "\n\none two three four six\nown words".removeprefix("\n"), 3: "more"}
    assert {r.doc_id: r.text for r in LN.dedup_lines(docs).collect()} == want
    assert {r.doc_id: r.text for r in corpus_pipeline.line_stage(spark, docs, "").collect()} == want
