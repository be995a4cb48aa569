"""Times of the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query runs once after one warm-up of the session on the smallest work there is; a query's time covers its planning,
its intermediate tables and the computation of every row of its result.
"""

from __future__ import annotations

import json
import os
import time

from offerlens.plans.catalog import QUERIES
from offerlens.session import discard, local_session

HEADLINE = [
    "rules_top10", "popularity_top10", "rules_map10", "rules_top10_targets", "predict_targets", "user_history",
    "lines_before_order", "split_summary_order_lines", "weekly_genre_snapshots_order_lines", "weekly_training_pairs",
    "weekly_training_frame", "hard_negatives", "event_time_features", "cutoff_features", "baseline_map", "ranked_requests",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cores=cores, partitions=int(cores) if cores.isdigit() else 8)
    QUERIES["scan_purchases"](spark, folder).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        spark.catalog.clearCache()
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        discard(spark)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(os.path.normpath(folder))}))


if __name__ == "__main__":
    main()
