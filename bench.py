"""Time the headline queries on local[$BENCH_CPUS] at $BENCH_SF_DIR and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from colonnade.catalog import QUERIES  # noqa: E402
from colonnade.session import local_session  # noqa: E402

HEADLINE = [
    "core_metrics", "profile_dtype_report", "profile_numeric", "outliers_iqr", "profile_categorical", "value_counts",
    "histogram_2d", "ecdf_quantiles", "bounded_crosstab", "impute_group_median", "remove_outliers_iqr", "correlation_matrix_pearson",
    "correlation_spearman", "kruskal_wallis", "chi_square", "ols_coefficients", "robust_hc3", "ols_influence", "logistic_coefficients",
    "kaplan_meier_by_group", "log_rank", "decompose_additive", "its_coefficients", "match_with_replacement", "matched_effect",
    "weighted_effect_ate", "mixed_random_intercept", "classification_metrics", "knn_regress", "html_tables",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["row_preview"](spark, sf_dir).collect()  # start-up of the session is not a query
    times, failed = {}, {}
    for name in HEADLINE:
        start = time.perf_counter()
        try:
            # Run every row through to the end without bringing large results to the driver.
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
            print(f"{name} {times[name]}", file=sys.stderr, flush=True)
        except Exception as e:
            failed[name] = str(e)[:200]
        spark.catalog.clearCache()
    out = {"metric": "total wall time of headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir)}
    if failed:
        out["failed"] = failed
    print(json.dumps(out))


if __name__ == "__main__":
    main()
