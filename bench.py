"""Times headline queries and prints one JSON line.

Reads ``BENCH_SF_DIR`` (tables) and ``BENCH_CPUS`` (local cores).  Each query is
run once to warm up and then timed; ``noop`` output forces every row and column.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tablelens.queries import QUERIES  # noqa: E402
from tablelens.session import local_session  # noqa: E402

HEADLINE = (
    "prof_table", "prof_quality", "prof_unique", "prof_numeric", "prof_columns", "prof_documents",
    "clean_drop_duplicates", "clean_fill_mean", "clean_fill_median", "clean_fill_mode", "clean_ffill",
    "clean_text_title", "clean_cast_numeric", "clean_outliers_iqr", "clean_sequence",
    "eda_numeric", "eda_histogram", "eda_outliers", "eda_top_values", "eda_correlation", "eda_missing_rows",
    "ins_rank", "diff_metrics", "diff_rows_added", "prev_filter_any", "prev_page", "fingerprint",
    "dash_kpis", "dash_activity", "ml_split", "ml_classification_metrics", "ml_roc_auc", "ml_regression_metrics",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    seconds: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINE:
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries, second run",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
