"""Time the headline queries and print one JSON line.

BENCH_SF_DIR   folder with the parquet tables (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default: all)
BENCH_QUERIES  comma-separated names, or "all" (default: the headline set)

Each query runs twice on its whole tables: the first run includes planning and code generation
for the first time, the second is the one reported. Results go to Spark's noop sink, so that every
row is computed and none is collected."""

from __future__ import annotations

import json
import os
import time

from catalog import QUERIES
from tablescope.storage import local_session

HEADLINE = [
    "a1_load_csv", "b1_detect_types", "b4_convert_types", "b11_roles_lineitem",
    "c1_schema_summary", "c2_missing", "c3_duplicates_by_key", "c4_duplicate_count",
    "d2_fill_along_time", "d3_median", "d6_mode", "e1_date_features",
    "f1_join_inner", "f1_join_outer", "g1_describe", "g9_pearson", "g10_spearman",
    "g11_kendall", "g15_numeric_importance", "g16_categorical_importance",
    "h1_rollup", "h2_drilldown_all_levels", "h5_pivot", "h6_aggregates",
    "h6_median_of_large_groups", "i1_aggregate_month", "i2_rolling_average", "i3_i4_trend",
    "i5_anomalies", "j9_report_overview", "k1_filter_facets", "k11_histogram", "k12_box_plot",
]


def seconds(fn, spark, folder) -> float:
    start = time.perf_counter()
    fn(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if wanted == "all" else wanted.split(",") if wanted else HEADLINE
    spark = local_session(cpus, "bench")
    spark.read.parquet(f"{folder}/region.parquet").count()
    first, warm = {}, {}
    for name in names:
        first[name] = round(seconds(QUERIES[name], spark, folder), 3)
        warm[name] = round(seconds(QUERIES[name], spark, folder), 3)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(warm.values()), 3), "unit": "sec",
        "queries": warm, "first_run": first, "sf": os.path.basename(folder.rstrip("/")),
        "cpus": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
