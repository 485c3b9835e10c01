"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Every query is fully materialised through the ``noop`` sink (no driver
collect). Prints ONE JSON line:
{"metric": "total_query_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "clean_html", "preprocess", "match_features", "match_builtin", "relevance_by_label",
    "dict_keywords", "dict_term_hits", "citation_metrics_orders", "journal_spread",
    "yearly_stats", "trend_table", "trend_summary", "phrase_rules", "query_year_grid",
    "dedup_keep_first", "collect_balance", "split", "split_stats", "tfidf_keywords",
    "keyword_compare", "evaluate_scorers", "model_compare", "article_extract",
    "citation_edges", "annotation_types", "logreg_eval",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    only = [a for a in sys.argv[1:]]
    from pyspark.sql import SparkSession
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("paperlens-bench")
             .config("spark.sql.shuffle.partitions", str(cpus * 2))
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "16g"))
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    from paperlens.plans.harness import QUERIES
    # warm-up (JIT, class loading) on the smallest query; not timed
    QUERIES["class_counts"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in (only or HEADLINE):
        t0 = time.perf_counter()
        try:
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - t0, 3)
        except Exception as e:  # noqa: BLE001
            print(f"# {name} failed: {type(e).__name__}: {str(e)[:200]}", file=sys.stderr)
            times[name] = None
    m = re.search(r"sf([0-9.]+)", sf_dir)
    ok = [v for v in times.values() if v is not None]
    print(json.dumps({"metric": "total_query_sec", "value": round(sum(ok), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir,
                      "cpus": cpus, "failed": [k for k, v in times.items() if v is None]}))
    spark.stop()


if __name__ == "__main__":
    main()
