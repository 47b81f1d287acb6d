"""Benchmark: headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line.

Each query runs from scratch (the per-run stage memo is cleared) and is
forced with the ``noop`` sink, so the time covers the whole plan and not a
driver-side collect.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "job_pipeline",        # whole chain: raw -> norm -> iocs -> analysis -> graph -> correlation -> scores
    "pre_normalize",       # cleaning, language, tokens
    "top_iocs",            # extraction + distinct-event aggregate
    "cor_correlate",       # shared indicators, windows, components, confidence
    "cor_components_default",  # graph with IOC, cluster and 24 h window hubs
    "clu_tfidf",           # long-form TF-IDF
    "cls_model_predict",   # linear model as joins + softmax
    "wek_sector",          # weak labels with domain evidence
    "ing_collect",         # hash, in-run dedup, ledger anti-join
    "qry_events",          # serving join + order + page
    "dsh_brief",           # dashboard aggregate
    "trn_class_report",    # metrics
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    from vigil.plans import views
    from vigil.plans.catalog import load_registry
    from vigil.session import build_session, drop_tables

    spark = build_session(f"local[{cpus}]", max(cpus, 8))
    spark.sparkContext.setLogLevel("ERROR")
    reg = load_registry()
    times = {}
    for key in HEADLINE:
        views.forget()
        t0 = time.time()
        reg[key].fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[key] = round(time.time() - t0, 3)
        drop_tables(spark)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else None}))


if __name__ == "__main__":
    main()
