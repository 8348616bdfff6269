"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints ONE JSON line:
{"metric": "total_query_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ..., ...}

Each query runs to completion with the no-op sink (the whole plan executes,
nothing is collected to the driver). The flagship's rows/s is reported too.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from shiprisk.plans import catalog  # noqa: E402
from shiprisk.session import build_session  # noqa: E402

HEADLINE = [
    "enrich_shipments",          # J12 flagship: seven lookups, 27 features
    "build_training_table",      # J13: raw text -> labelled features
    "validate_shipments",        # F1
    "score_assemble",            # M13 + tier adjustment
    "weather_backfill_plan",     # Q3: distinct, anti join, ranges
    "weather_ingest",            # Q4: explode arrays, keep-first
    "roc_auc",                   # A7: exact distributed AUC
    "fit_scaler",                # A4
    "country_risk_report",       # Q1
    "route_geometry",            # N4
    "stationary_alert",          # T2 batch (skew-safe islands)
    "rolling_confidence",        # T9 batch
    "monthly_vendor_mode_report",  # T12
    "feature_drift",             # T4
    "train_pipeline",            # Q5 (the reference's settings)
    "score_shipments",           # M12
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    spark = build_session(master=f"local[{cpus}]", app="shiprisk-bench", shuffle_partitions=max(8, 2 * cpus),
                          extra={"spark.driver.memory": "16g"})
    catalog.load_all()
    times: dict[str, float] = {}
    rows: dict[str, int] = {}
    # Derived inputs (joined shipments view + stats tables) are written once,
    # like the stored tables they stand for; timed on their own.
    t0 = time.time()
    from shiprisk.plans.enrichment import _dims
    from shiprisk.sources.testdata import stage_inputs
    stage_inputs(spark, sf_dir)
    _dims(spark, sf_dir)
    times["stage_inputs"] = round(time.time() - t0, 3)
    for n in names:
        t0 = time.time()
        df = catalog.QUERIES[n](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        times[n] = round(time.time() - t0, 3)
    if "enrich_shipments" in times:
        rows["enrich_shipments"] = catalog.QUERIES["enrich_shipments"](spark, sf_dir).count()
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    out = {
        "metric": "total_query_sec",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(sf.group(1)) if sf else sf_dir,
        "cpus": cpus,
    }
    if rows:
        out["flagship_rows"] = rows["enrich_shipments"]
        out["flagship_rows_per_sec"] = round(rows["enrich_shipments"] / max(times["enrich_shipments"], 1e-9), 1)
    spark.stop()
    print(json.dumps(out))


if __name__ == "__main__":
    main()
