"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tandem.catalog import QUERIES  # noqa: E402
from tandem.session import session  # noqa: E402

HEADLINE = [
    "a08_auroc_events", "a08_auroc_lines", "a09_average_precision", "a14_reliability_uniform",
    "a15_reliability_quantile", "a18_within_group", "a01_label_report", "w02_nauc_lines", "v03_nauc",
    "k01_best_threshold", "k04_min_fraction", "j08_interpolate", "w06_stratified_split",
    "r03_auroc_interval", "r04_paired_bootstrap", "r05_paired_auroc_difference",
    "r06_paired_nauc_difference", "l02_tfidf_words", "l02_tfidf_chars", "l05_cross_fit",
    "f20_numeric_grader", "f23_many_kind_grader", "f24_math_grader", "v05_split_evaluation",
    "v07_confidence_routing", "v09_three_tiers", "a24_tier_table",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(
        f"local[{cpus}]", "tandem-bench",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["a01_label_report"](spark, folder).collect()  # start-up is not measured
    took = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec",
        "queries": took, "sf": folder.rsplit("sf", 1)[-1], "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
