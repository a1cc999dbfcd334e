"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Every query runs to completion into a ``noop`` sink, so all rows and columns are computed.  The first
query pays for session start-up and is repeated as a warm-up before timing starts.
"""

from __future__ import annotations

import json
import os
import time

import pyarrow.parquet as pq

from churnlake.plans.catalog import QUERIES
from churnlake.session import build_session

HEADLINE = [
    "churn_rate_by_segment",
    "preprocess_fit",
    "preprocess_apply",
    "impute_median_mode",
    "derived_features",
    "label_encode",
    "standard_scale",
    "contract_report",
    "row_rules",
    "null_profile",
    "describe_numeric",
    "feature_types",
    "customer_360",
    "store_upsert",
    "store_insert_ignore",
    "store_export",
    "ingest_totals",
    "job_rollup",
    "classification_report",
    "roc_auc",
    "cv_summary",
    "best_threshold",
    "psi_features",
    "ks_features",
    "windowed_psi",
    "tumbling_rates",
    "stratified_folds",
    "stratified_sample",
    "smote",
    "knn_join",
    "tomek_links",
    "stream_drift",
    "train_rf",
    "score_batch",
]

# The table whose rows a query mainly works through; the customer view reads all of lineitem.
MAIN_TABLE = {
    "store_upsert": "orders", "store_insert_ignore": "orders", "store_export": "orders", "ingest_totals": "orders",
    "job_rollup": "orders", "psi_features": "events", "ks_features": "events", "windowed_psi": "events",
    "tumbling_rates": "events", "stream_drift": "events", "knn_join": "embeddings", "tomek_links": "embeddings",
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES")
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="16g"
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    run(HEADLINE[0])
    seconds, rate = {}, {}
    for name in names.split(",") if names else HEADLINE:
        seconds[name] = round(run(name), 3)
        rows = pq.ParquetFile(f"{sf_dir}/{MAIN_TABLE.get(name, 'lineitem')}.parquet").metadata.num_rows
        rate[name] = round(rows / seconds[name])
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "rows_per_sec": rate,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
