"""Benchmark: headline queries at $BENCH_SF_DIR (default sf0.1) on
local[$BENCH_CPUS]; prints one JSON line.

Each query is fully executed with the ``noop`` sink (the whole plan runs,
nothing is collected).  ``value`` is the sum of the query times.
Set BENCH_TRAIN=1 to also time training + scoring of the 300-tree model.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["velocity_features", "engineer_features", "asof_state_lookup", "latest_user_state",
            "user_profiles", "risk_signals", "running_totals", "idle_reset_counter",
            "user_sessions", "latency_summary", "bucket_quantiles", "roc_auc", "split_summary",
            "stream_velocity", "sliding_24h"]


def _sf_number(sf_dir: str):
    tag = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    try:
        return float(tag)
    except ValueError:
        return tag


def main() -> None:
    # The JVM and Python workers inherit fd 1; send their chatter to stderr
    # so stdout carries exactly one JSON line.
    json_out = os.fdopen(os.dup(1), "w")
    os.dup2(2, 1)
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from riskwave.session import build_session
    spark = build_session(f"local[{cpus}]", shuffle_partitions=int(cpus),
                          extra={"spark.driver.memory": "16g"})
    from riskwave.queries import QUERIES
    from riskwave.sources import transactions

    transactions(spark, sf_dir).write.format("noop").mode("overwrite").save()   # warm-up
    n_rows = transactions(spark, sf_dir).count()
    times = {}
    for name in HEADLINE:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    extra = {}
    if os.environ.get("BENCH_TRAIN") == "1":
        from riskwave.ml import model as mlm
        from riskwave.operators import scores as sc
        from pyspark.sql import functions as F
        t0 = time.perf_counter()
        b, feats = mlm.train(transactions(spark, sf_dir))
        times["train_gbt_300"] = round(time.perf_counter() - t0, 3)
        t0 = time.perf_counter()
        test = mlm.score(b, transactions(spark, sf_dir), feats).where(F.col("side") == "test")
        extra["test_auc"] = sc.roc_auc(test).first()["auc"]
        times["score_and_auc"] = round(time.perf_counter() - t0, 3)
    total = round(sum(times.values()), 3)
    out = {"metric": "headline_queries_total_sec", "value": total, "unit": "sec",
           "queries": times, "sf": _sf_number(sf_dir),
           "rows": n_rows,
           "velocity_rows_per_sec": round(n_rows / times["velocity_features"], 1),
           "stream_velocity_rows_per_sec": round(n_rows / times["stream_velocity"], 1), **extra}
    json_out.write(json.dumps(out) + "\n")
    json_out.flush()


if __name__ == "__main__":
    main()
