"""Time the headline queries: one JSON line with seconds per query (best of two runs) and their sum.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the local cores (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from workload.check import session  # noqa: E402
from workload.queries import REGISTRY  # noqa: E402

HEADLINE = (
    "numeric_stats", "categorical_stats", "categorical_stats_documents", "column_nulls_uniques", "dataset_summary",
    "duplicate_rows_lineitem", "correlation_matrix", "cramers_v", "point_biserial", "outliers_iqr", "row_anomalies",
    "welch_t_test", "trend_events", "change_points", "seasonality", "infer_schema", "candidate_keys",
    "find_relationships", "value_overlap", "join_related_inner", "quality_issues", "eda_findings", "deep_insights",
    "hypotheses", "mergeable_profile", "dataset_fingerprint", "flatten_json_column", "trend_lineitem", "full_profile_lineitem",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        runs = []
        for _ in range(2):
            start = time.time()
            REGISTRY[name](spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - start)
        seconds[name] = round(min(runs), 3)
        spark.catalog.clearCache()
    print(json.dumps({"metric": "headline queries, sum of best of two", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
