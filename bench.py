"""Headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

os.chdir(os.path.dirname(os.path.abspath(__file__)))

from veracol.session import build_session
from workload import QUERIES

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [
    "p02_missing_cells",
    "p06_distinct_counts",
    "p08_numeric_stats",
    "p08_numeric_stats_searched",
    "p11_top_values",
    "p14_duplicate_report",
    "p15_composite_key_duplicates",
    "q01_missing_values",
    "q04_named_formats",
    "q07_case_variants",
    "q09_iqr_outliers",
    "q11_sample_values",
    "q17_composite_ids",
    "k07_scorecard",
    "k10_before_after",
    "c02_trim_strings",
    "c05_title_case",
    "c07_date_normalization",
    "c11_keep_first_per_key",
    "c14_fill_median",
    "c17_forward_fill",
    "c18_backward_fill",
    "c24_cleaned_rows",
    "s01_csv_scan",
    "s08_safe_csv_sink",
    "l09_dataset_listing",
    "l13_score_deltas",
    "l15_clean_job",
    "l17_lineage",
    "g08_fact_issues",
    "g09_fact_cleaning_jobs",
    "m28_all_measures",
    "r03_remediation_list",
    "r06_version_matrix",
    "r15_issue_resolution",
]


def run(spark, name: str) -> float:
    """Seconds until every row is computed; nothing is brought to the driver."""
    start = time.perf_counter()
    QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    spark = build_session("bench", f"local[{CPUS}]", **{"spark.sql.shuffle.partitions": CPUS, "spark.ui.enabled": "false", "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    run(spark, "p01_table_shape")  # starts the session's machinery
    times = {}
    for name in HEADLINE:
        times[name] = round(run(spark, name), 3)
        print(f"{name:34s} {times[name]:8.3f}", file=sys.stderr)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline queries, total", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(SF_DIR), "cpus": int(CPUS), "spark": spark.version}))


if __name__ == "__main__":
    main()
