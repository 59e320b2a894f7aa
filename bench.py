"""Headline queries on the bench tables; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from duecourse import catalog
from duecourse.session import local_session

HEADLINE = (
    "p13_clean_loans",
    "a1_split_stats",
    "a7_cost_curve",
    "q1_roc_auc",
    "q6_calibration_table",
    "d9_monthly_summary",
    "n6_first_available",
    "k_full_report",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    queries = catalog.queries()
    spark.read.parquet(f"{sf_dir}/region.parquet").count()  # session start is not measured
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec",
                      "queries": seconds, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
