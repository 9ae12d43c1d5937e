"""Headline queries on the bench tables; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data
and cores. Every query runs to the end into a sink that discards its rows; the
time includes building the plan and all jobs the query starts.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from basketwise.session import build_session  # noqa: E402
from checks.queries import REGISTERED  # noqa: E402

HEADLINE = [
    "household_lines",
    "demographics_engagement",
    "spend_over_time",
    "top_commodities",
    "seasonal_spend",
    "loyalty_mix",
    "commodity_units_spend",
    "ingest_counts",
    "customer_features",
    "churn_features",
    "churn_label",
    "category_pivot",
    "clv_features",
    "clv_tiers",
    "clv_histogram",
    "churn_correlations",
    "roc_auc",
    "stratified_split",
    "basket_pairs",
    "top_pairs",
    "product_stats",
    "pair_features",
    "top_product_pairs",
    "recommend",
    "churn_scores",
    "clv_scores",
]

# Queries of models are run again: the first run fits, the second only loads and scores.
AGAIN = ["churn_scores", "clv_scores"]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    REGISTERED["commodity_units_spend"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    chosen = sys.argv[1:] or HEADLINE
    for name in [*chosen, *(name for name in AGAIN if name in chosen)]:
        label = f"{name}_loaded" if name in seconds else name
        started = time.perf_counter()
        REGISTERED[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[label] = round(time.perf_counter() - started, 3)
        print(f"{label} {seconds[label]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
