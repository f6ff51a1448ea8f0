"""Bench: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs to completion through the ``noop`` sink (full execution,
no transfer of the result to the driver). The first query also pays the
JVM warm-up, so a tiny warm-up query runs before the clock starts.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "highlights",            # TOP-5: scan, bars aggregate, quotes, 4 top-k
    "upsert_bars",           # SNK-1: write store, upsert, rewrite, read back
    "lag_features",          # WIN-1: 100 lags, one window
    "recursive_forecast",    # WIN-6: 10-step forecast, all symbols
    "news_reply_json",       # news pipeline to nested JSON
    "rouge_n",               # AGG-5: n-gram overlap joins
    "extractive_summary",    # MOD-7: TF-IDF summary of every document
    "describe_numeric",      # AGG-7: exact quartiles via distributed ranks
    "classification_report", # PRE-11 + MOD-11 + AGG-15
    "knn_classifier",        # JOI-5 + MOD-10: exact k-d tree neighbours, vote
    "stream_news_mood",      # STR-2: file stream, watermark, windows
]


def main() -> None:
    from bourse.plans.registry import load_all
    from bourse.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=cpus * 2)
    reg = load_all()
    spark.range(1000).selectExpr("sum(id)").collect()  # warm-up
    times: dict[str, float] = {}
    for name in names:
        fn = reg[name][0]
        t0 = time.time()
        df = fn(spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        print(f"# {name}: {times[name]} s", file=sys.stderr, flush=True)
    # SCA-15: predictions per second of the price model over every feature row
    scored = reg["score_prices"][0](spark, sf_dir)
    t0 = time.time()
    scored.write.format("noop").mode("overwrite").save()
    rate = time.time() - t0
    rate = round(scored.select("symbol").count() / rate, 1)
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    out = {"metric": "total_headline_sec", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "predictions_per_sec": rate, "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf_dir,
           "cpus": cpus, "spark": spark.version}
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
