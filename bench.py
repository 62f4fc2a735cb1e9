"""Time the headline queries; prints one JSON line.

    BENCH_SF_DIR  folder of the tables (default /root/testdata/sf0.1)
    BENCH_CPUS    local cores (default 8)
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from scrubline.catalog import QUERIES  # noqa: E402
from scrubline.session import local_session  # noqa: E402

HEADLINE = [
    "drop_duplicates_full", "drop_duplicates_subset", "drop_blank_rows", "drop_rows_where_regex",
    "drop_outliers", "normalize_dates", "normalize_phone", "normalize_currency",
    "standardize_categories_auto", "encode_categories_sorted", "encode_categories_wide",
    "fix_dtypes_numeric", "fix_dtypes_bool", "trim_whitespace", "format_text_title",
    "replace_values_regex", "round_numbers", "scale_minmax", "impute_median", "impute_mode",
    "flag_outliers_iqr", "flag_outliers_lineitem", "validate_rule_range", "profile_nulls",
    "profile_distinct", "profile_date_formats", "profile_top_values", "profile_dup_rows",
    "profile_outliers", "profile_full", "column_stats", "column_histogram", "issue_list",
    "suggest_steps", "pii_scan_documents", "mask_all", "mask_names", "pii_rows",
    "contract_report", "contract_lineitem", "verify_profiles", "diff_cells", "diff_summary",
    "patch_cells", "run_recipe", "recipe_audit", "auto_clean", "inject_all", "error_manifest",
    "score_summary", "score_false_fix", "read_csv_table", "clean_folder_stream",
]


def run(spark, key: str, sf_dir: str) -> float:
    """Seconds to produce every row and column of a query."""
    started = time.perf_counter()
    QUERIES[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - started, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, partitions=int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    run(spark, "drop_blank_rows", sf_dir)  # warm up the JVM
    seconds = {key: run(spark, key, sf_dir) for key in HEADLINE}
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
