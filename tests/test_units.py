"""Unit and property tests of the operators (edge cases of SURVEY §1.4 / §5)."""

import datetime as dt
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bourse.functions.dates import next_business_day
from bourse.operators import evaluate as EV
from bourse.operators import forecast as FC
from bourse.operators import market as M
from bourse.operators import news as N
from bourse.operators import profile as PF
from bourse.operators import text as TX
from bourse.operators.ordering import exact_split, ordered_rank
from bourse.session import scratch_path
from bourse.sources import files as S


def lcs_dp(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = d[i - 1][j - 1] + 1 if a[i - 1] == b[j - 1] else max(d[i - 1][j], d[i][j - 1])
    return d[-1][-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abcde"), max_size=40), st.lists(st.sampled_from("abcde"), max_size=40))
def test_lcs_bit_parallel_equals_dp(a, b):
    assert TX.lcs_length(a, b) == lcs_dp(a, b)


def test_lcs_long_texts():
    rng = np.random.default_rng(1)
    a = list(rng.integers(0, 50, 3000))
    b = list(rng.integers(0, 50, 2000))
    assert TX.lcs_length(a, b) == lcs_dp(a[:300], b[:300]) or TX.lcs_length(a, b) > 0
    assert TX.lcs_length(a[:300], b[:300]) == lcs_dp(a[:300], b[:300])


def test_rouge_l_udf(spark):
    df = spark.createDataFrame([(1, 1, "the cat sat on the mat", "the cat on a mat"), (2, 2, "", "x")],
                               "conv_id long, turn long, reference_text string, candidate_text string")
    r = {x.conv_id: x for x in TX.rouge_l(df, ["conv_id", "turn"]).collect()}
    assert r[1].overlap == 4 and r[1].precision == 0.8 and r[1].recall == round(4 / 6, 6)
    assert r[2].overlap == 0 and r[2].f1 == 0.0


def test_next_business_day(spark):
    days = [dt.date(2023, 9, d) for d in (7, 8, 9, 10)]  # Thu, Fri, Sat, Sun
    df = spark.createDataFrame([(d,) for d in days], "d date")
    got = [r[0] for r in df.select(next_business_day(F.col("d"))).collect()]
    assert got == [dt.date(2023, 9, 8), dt.date(2023, 9, 11), dt.date(2023, 9, 11), dt.date(2023, 9, 11)]


def test_ordered_rank_exact_under_skew(spark):
    # one group holds a third of all rows
    rows = [(i, "hot" if i % 3 == 0 else f"g{i % 7}", (i * 7919) % 1000) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, g string, k long")
    got = {r.id: r.rank for r in ordered_rank(df, ["k", "id"], ["g"]).collect()}
    for g in {r[1] for r in rows}:
        members = sorted((r for r in rows if r[1] == g), key=lambda r: (r[2], r[0]))
        assert [got[r[0]] for r in members] == list(range(1, len(members) + 1))


def test_exact_split_sizes(spark):
    df = spark.range(0, 1003).withColumnRenamed("id", "k")
    s = exact_split(df, "k", 11, 0.8)
    counts = {r.split: r["count"] for r in s.groupBy("split").count().collect()}
    assert counts == {"train": int(1003 * 0.8), "test": 1003 - int(1003 * 0.8)}


def test_exact_quantiles_match_numpy(spark):
    vals = [float(x) for x in np.random.default_rng(3).normal(size=501)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    q = {r.q: r.quantile for r in PF.exact_quantiles(PF.long_values(df, ["x"])).collect()}
    for p in (0.25, 0.5, 0.75):
        assert math.isclose(q[p], float(np.quantile(vals, p)), rel_tol=1e-12, abs_tol=1e-12)


def test_company_lookup_duplicates_and_case(spark):
    comp = spark.createDataFrame([("S03", "Three"), ("S24", "A"), ("S24", "B")], "symbol string, company_name string")
    req = spark.createDataFrame([("s03",), ("S24",), ("zz",)], "request string")
    got = {r.request: r.company_name for r in M.company_lookup(req, comp).collect()}
    assert got == {"s03": "Three", "S24": "na", "zz": "na"}


def test_ticker_suggest_min_chars(spark):
    comp = spark.createDataFrame([("S10", "x"), ("AS1", "y")], "symbol string, company_name string")
    assert M.ticker_suggest(comp, "s").count() == 0
    assert [r.symbol for r in M.ticker_suggest(comp, "s1").collect()] == ["S10", "AS1"]


def test_upsert_empty_delta_keeps_store(spark):
    store = spark.createDataFrame([("A", dt.date(2024, 1, 1), 1.0, 0)], "symbol string, trade_date date, close double, batch int")
    empty = store.limit(0)
    assert M.upsert_bars(store, empty).collect() == store.collect()


def test_lag_features_warmup_20_and_21_rows(spark):
    def series(n):
        return [("A", dt.date(2024, 1, 1) + dt.timedelta(days=i), 1.0 + i, 2.0, 3.0, 0.5, 10.0) for i in range(n)]
    schema = "symbol string, trade_date date, Open double, Close double, High double, Low double, Volume double"
    assert FC.lag_features(spark.createDataFrame(series(20), schema)).count() == 0
    one = FC.lag_features(spark.createDataFrame(series(21), schema)).collect()
    assert len(one) == 1 and one[0]["Open_0"] == 20.0 and one[0]["Open_19"] == 1.0


def test_r2_constant_target(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 1.0)], "Open double, Pred_Open double")
    assert FC.multi_target_r2(df, targets=["Open"]).first().r2 == 1.0
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 1.0)], "Open double, Pred_Open double")
    assert FC.multi_target_r2(df, targets=["Open"]).first().r2 == 0.0


def test_report_empty_class(spark):
    pred = spark.createDataFrame([(0, 0), (0, 0)], "label int, pred int")
    rep = {r["class"]: r for r in EV.classification_report(EV.confusion_counts(pred)).collect()}
    assert rep["1"].precision == 0.0 and rep["1"].support == 0 and rep["accuracy"].f1 == 1.0


def test_gaussian_nb_matches_numpy(spark):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(0, 1, (60, 2)), rng.normal(2, 1.5, (40, 2))])
    y = np.array([0] * 60 + [1] * 40)
    df = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, y)], "f1 double, f2 double, label int")
    got = [r.pred for r in EV.GaussianNB(["f1", "f2"]).fit(df).transform(df).collect()]
    eps = 1e-9 * x.var(axis=0).max()
    jll = []
    for c in (0, 1):
        m, v = x[y == c].mean(0), x[y == c].var(0) + eps
        jll.append(np.log((y == c).mean()) - 0.5 * np.log(2 * np.pi * v).sum() - 0.5 * (((x - m) ** 2) / v).sum(1))
    assert got == list(np.argmax(np.vstack(jll), 0))


def test_clean_link_rules(spark):
    df = spark.createDataFrame([(None,), ("",), ("https://a",), ("http://b",), ("c.com",)], "l string")
    got = [r[0] for r in df.select(N.clean_link(F.col("l"))).collect()]
    assert got == ["#", "#", "https://a", "https://http://b", "https://c.com"]


def test_mood_ignores_uncountable(spark):
    df = spark.createDataFrame([("A", "Positive"), ("A", "n/a"), ("A", "neutral"), ("B", "n/a")], "symbol string, label string")
    got = {r.symbol: r.mood for r in N.news_mood(df).collect()}
    assert got == {"A": 1.0, "B": 0.0}


def test_json_envelope_broken_and_empty(spark, tmp_path):
    p = tmp_path / "env"
    p.mkdir()
    (p / "a.json").write_text('{"data":[{"symbol":"A","open":1.0}]}\n{"data":[]}\n{broken\n')
    rows = S.scan_json_records(spark, str(p)).collect()
    assert [r.symbol for r in rows] == ["A"]


def test_columns_by_type(spark):
    df = spark.createDataFrame([(1.0, "a", 1)], "x double, s string, i int")
    assert M.columns_by_type(df) == {"numeric": ["x"], "text": ["s"]}


def test_empty_guard(spark):
    empty = spark.createDataFrame([], "symbol string, trade_date date, Open double, Close double, High double, "
                                      "Low double, Volume double")
    feats = FC.lag_features(empty)
    scored = FC.score_prices(FC.LagMeanModel(), feats)
    assert scored.count() == 0
    assert FC.multi_target_r2(scored, ["symbol"]).count() == 0


def test_scratch_path_under_checkpoint_dir(spark):
    base = spark.sparkContext.getCheckpointDir()
    assert scratch_path(spark, "x").startswith(base.rstrip("/"))


def test_upsert_leaves_untouched_folders_alone(spark):
    import glob
    import os

    from bourse.session import scratch_path
    from bourse.sources import files as S

    day = dt.date
    rows = [("A", day(2023, 5, 1), 1.0), ("A", day(2024, 5, 1), 2.0), ("B", day(2024, 5, 1), 3.0)]

    def bars(rs):
        return spark.createDataFrame([(d, c, c, c, c, 1, c, s) for s, d, c in rs], S.BAR_SCHEMA)

    path = S.write_yearly_store(bars(rows), scratch_path(spark, "t-store"))
    local = path.removeprefix("file:")

    def files():
        return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{local}/data/version=*/symbol=*/year=*/*.parquet")}

    before = files()
    S.upsert_yearly_store(spark, path, bars([("A", day(2024, 5, 1), 9.0), ("A", day(2024, 5, 2), 8.0)])
                          .selectExpr("*", "1 AS batch"))
    after = files()
    assert before.items() <= after.items()                # nothing is overwritten, only the touched folder is written anew
    assert {f.split("symbol=")[1].rsplit("/", 1)[0] for f in set(after) - set(before)} == {"A/year=2024"}
    got = sorted((r.symbol, r.trade_date, r.close) for r in S.read_yearly_store(spark, path).collect())
    assert got == [("A", day(2023, 5, 1), 1.0), ("A", day(2024, 5, 1), 9.0), ("A", day(2024, 5, 2), 8.0), ("B", day(2024, 5, 1), 3.0)]


def test_quantiles_of_a_hot_value(spark):
    """A value that a third of the rows hold is one row of the ranked table."""
    vals = [7.0 if i % 3 == 0 else float(i % 1000) for i in range(9000)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = {r.q: r.quantile for r in PF.exact_quantiles(PF.long_values(df, ["x"]), (0.0, 0.1, 0.25, 0.5, 0.9, 1.0)).collect()}
    for q, v in got.items():
        assert v == pytest.approx(float(np.quantile(vals, q)))
    assert len(got) == 6


def test_category_limit(spark):
    from bourse.operators.prep import fit_categories

    df = spark.createDataFrame([(f"v{i}",) for i in range(20)], "c string")
    assert len(fit_categories(df, "c", 20)) == 20
    with pytest.raises(ValueError, match="more than 19 categories"):
        fit_categories(df, "c", 19)


def test_summary_length_bounds(spark):
    from bourse.operators.text import extractive_summary

    words = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(1, ". ".join(f"{words} s{k}" for k in range(6)) + ".")], "doc_id long, text string")
    n = extractive_summary(df).first().summary_tokens
    assert 55 <= n <= 80


# ---------------------------------------------------------------- published states and streams
def store_rows(spark, rs):
    from bourse.sources import files as S

    return spark.createDataFrame([(d, c, c, c, c, 1, c, s) for s, d, c in rs], S.BAR_SCHEMA)


def store_closes(spark, path):
    from bourse.sources import files as S

    return sorted((r.symbol, r.trade_date, r.close) for r in S.read_yearly_store(spark, path).collect())


def test_store_shows_an_upsert_in_one_step(spark, monkeypatch):
    from bourse.sources import files as S

    day = dt.date
    path = S.write_yearly_store(store_rows(spark, [("A", day(2023, 5, 1), 1.0), ("B", day(2024, 5, 1), 3.0)]),
                                scratch_path(spark, "t-atomic"))
    before = store_closes(spark, path)
    delta = store_rows(spark, [("A", day(2023, 5, 1), 9.0), ("B", day(2024, 5, 1), 9.0)]).selectExpr("*", "1 AS batch")

    def fails(*_):
        raise OSError("the job dies before it publishes")

    with monkeypatch.context() as m:
        m.setattr(S, "publish", fails)
        with pytest.raises(OSError):
            S.upsert_yearly_store(spark, path, delta)
    assert store_closes(spark, path) == before            # all folders were written, none is seen
    S.upsert_yearly_store(spark, path, delta)
    assert [c for _, _, c in store_closes(spark, path)] == [9.0, 9.0]
    S.compact_yearly_store(spark, path)
    assert [c for _, _, c in store_closes(spark, path)] == [9.0, 9.0]


def test_only_one_writer_publishes(spark):
    from bourse.sources.versions import publish, published

    folder = scratch_path(spark, "t-published")
    assert published(spark, folder) == (0, None)
    assert publish(spark, folder, {"x": 1}, 0) == 1
    with pytest.raises(RuntimeError):
        publish(spark, folder, {"x": 2}, 0)
    assert published(spark, folder) == (1, {"x": 1})


def test_compaction_reads_new_batches_only(spark):
    import glob

    from bourse.sources.versions import published
    from bourse.streaming import streams as ST

    landing, out, progress, compacted = (scratch_path(spark, f"t-lsm-{x}") for x in "abcd")
    want, levels = {}, []
    for k in range(9):
        rows = [("A", dt.date(2024, 1, d), float(100 * k + d)) for d in range(1 + k, 4 + k)]
        store_rows(spark, rows).selectExpr("symbol", "trade_date", "high", "low", "open", "close", "volume", "value",
                                           f"{k} AS batch").coalesce(1).write.mode("append").parquet(landing)
        want |= {d: c for _, d, c in rows}
        ST.stream_upsert_bars(spark, landing, out, progress)
        _, state = published(spark, compacted)
        newer = ST._landed_since(spark, out, state["upto"] if state else -1)
        assert newer.count() == 3                          # a compaction's share of the landing: this batch's rows
        ST.compact_upserted_bars(spark, out, compacted)
        levels.append([r["level"] for r in published(spark, compacted)[1]["runs"]])
        got = {r.trade_date: r.close for r in ST.read_upserted_bars(spark, out, compacted).collect()}
        assert got == want
    assert levels[2] == [0, 0, 0] and levels[3] == [1] and levels[8] == [1, 1, 0]
    assert len(glob.glob(compacted.removeprefix("file:") + "/run-*")) <= 3 + ST.FAN_IN
    assert ST.compact_upserted_bars(spark, out, compacted) == published(spark, compacted)[1]["upto"]


def news_item(i, symbol, at, link="l", label="Positive"):
    return (i, symbol, f"title {i}", link, "m", None if at is None else dt.datetime(2024, 1, at, 10), label)


def land(spark, folder, rows):
    from bourse.sources import files as S

    (spark.createDataFrame(rows, S.NEWS_ITEM_SCHEMA).coalesce(1).write.mode("append")
     .option("timestampNTZFormat", S.TS_FORMAT).json(folder))


def test_mood_stream_keeps_late_and_undated_items(spark):
    import json

    from bourse.streaming import streams as ST

    landing, out, progress = (scratch_path(spark, f"t-mood-{x}") for x in "abc")
    runs = [
        [[news_item(1, "A", 1), news_item(2, "A", 1, label="Negative"), news_item(3, "A", None)], [news_item(4, "A", 20)]],
        [[news_item(5, "A", 1), news_item(6, "B", 2, label="Neutral"), news_item(7, "A", 19)], [news_item(8, "A", 20, label="Negative")]],
        [[news_item(9, "A", None), news_item(10, "A", 1, label="Negative"), news_item(11, "A", 21)]],
    ]
    every = []
    for run in runs:
        for batch in run:
            land(spark, landing, batch)
            every += batch
            got = ST.stream_news_mood(spark, landing, out, progress, 1, delay="3 days")
    want = {}
    for _, s, _, _, _, at, label in every:
        n = want.setdefault((s, at and at.date()), [0, 0])
        n[0] += {"Positive": 1, "Neutral": 0, "Negative": -1}[label]
        n[1] += 1
    assert {(r.symbol, r.day): (r.mood, r.items) for r in got.collect()} == {
        k: (round(t / n, 6), n) for k, (t, n) in want.items()}
    # late days are in the side table, and not in the state any more
    side = spark.read.parquet(*ST.published(spark, f"{out}/side")[1]["runs"]).collect()
    assert sum(r["items"] for r in side if r["day"] == dt.date(2024, 1, 1)) == 2 and sum(r["items"] for r in side) == 5
    state = spark.read.format("statestore").load(f"{progress}/days")
    days = {r["key"][1]["start"].day for r in state.collect()}
    assert days == {19, 20, 21}, json.dumps(sorted(days))


def test_first_seen_stream_calls_no_python_per_link(spark, monkeypatch):
    """A call a link was most of the job's time: the state is kept by the engine's own aggregate. Equal items are landed once."""
    from pyspark.sql.streaming import DataStreamWriter

    from bourse.streaming import streams as ST

    plans, start = [], DataStreamWriter.start
    monkeypatch.setattr(DataStreamWriter, "start", lambda self, *a, **k: plans.append(start(self, *a, **k)) or plans[-1])
    landing, out, progress = (scratch_path(spark, f"t-seen-{x}") for x in "def")
    land(spark, landing, [news_item(k, "A", None if k % 5 == 0 else k % 7 + 1, None if k % 4 == 0 else f"l{k % 6}") for k in range(60)])
    ST.stream_first_seen_news(spark, landing, out, progress, 1)
    land(spark, landing, [news_item(k, "A", None if k % 5 == 0 else k % 7 + 1, None if k % 4 == 0 else f"l{k % 6}") for k in range(60)])
    got = ST.stream_first_seen_news(spark, landing, out, progress, 1)
    best: dict = {}
    for k in range(60):
        link, place = None if k % 4 == 0 else f"l{k % 6}", (k % 5 == 0, 0 if k % 5 == 0 else k % 7, k)
        best[link] = min(best.get(link, place), place)
    assert {(r.link, r.doc_id) for r in got.collect()} == {(link, place[2]) for link, place in best.items()}
    assert spark.read.parquet(out).where("doc_id IS NOT NULL").count() == len(best)      # a replayed list lands nothing
    for query in plans:
        plan = query._jsq.explainInternal(False)
        assert "StateStoreSave" in plan and "InPandas" not in plan, plan


def test_first_seen_stream_lands_new_links_only(spark):
    from bourse.streaming import streams as ST

    landing, out, progress = (scratch_path(spark, f"t-seen-{x}") for x in "abc")
    land(spark, landing, [news_item(1, "A", 5, "x"), news_item(2, "A", 4, "x"), news_item(3, "A", None, "y"), news_item(4, "B", 7, None)])
    ST.stream_first_seen_news(spark, landing, out, progress, 1)
    first = {f for f in spark.read.parquet(out).inputFiles()}
    land(spark, landing, [news_item(5, "A", 4, "x"), news_item(6, "A", 9, "y"), news_item(7, "B", 7, None), news_item(8, "C", 1, "z"),
                          news_item(9, "C", None, "z")])
    got = ST.stream_first_seen_news(spark, landing, out, progress, 1)
    assert {(r.link, r.doc_id) for r in got.collect()} == {("x", 2), ("y", 6), (None, 4), ("z", 8)}
    later = spark.read.parquet(*[f for f in spark.read.parquet(out).inputFiles() if f not in first]).collect()
    assert {(r.link, r.doc_id) for r in later} == {("y", 6), ("z", 8)}          # an earlier item, and a new link


def test_scan_news_reads_the_whole_period(spark, monkeypatch):
    """Every item of the 30 days before the newest one comes back, one without id too."""
    from bourse.plans import news_plans as NP

    newest = dt.datetime(2024, 3, 31, 12)
    dated = [(i, "S", f"t{i}", None, "m", newest - dt.timedelta(days=i), "n/a") for i in range(40)]
    made = spark.createDataFrame([*dated, (40, "S", "undated", None, "m", None, "n/a"), (None, "S", "no id", None, "m", newest, "n/a")],
                                 "doc_id long, symbol string, title string, link string, media string, published_at timestamp_ntz, label string")
    monkeypatch.setattr(NP.X, "news", lambda *_: made)
    got = [(r.doc_id, r.title) for r in NP.q_scan_news(spark, "").collect()]
    lists = [(i, f"t{i}") for i in range(30)] + [(40, "undated"), (None, "no id")]
    both = [x for x in lists if x[0] is None or x[0] % 3 == 2]
    assert sorted(got, key=str) == sorted(lists + both, key=str)
    assert got[-1] == (40, "undated") and [x for x in got if x[0] not in (None, 40)] == sorted(x for x in got if x[0] not in (None, 40))
