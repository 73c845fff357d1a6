"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_ONLY (comma-separated names, default all below).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from brightweir.plans.catalog import QUERIES  # noqa: E402
from brightweir.runtime import local_session  # noqa: E402

HEADLINE = [
    "rep1_review_report",
    "rep2_city_average",
    "rep3_partition_summary",
    "fim2_apriori",
    "fim4_two_pass_frequent",
    "fim5_fp_growth",
    "grf1_cooccurrence_graph",
    "grf2_label_propagation",
    "grf5_edge_betweenness",
    "grf6_connected_components",
    "sim4_verified_pairs",
    "sim5_exact_jaccard",
    "cf1_item_pearson",
    "cf2_item_cf",
    "mdl1_feature_table",
    "mdl2_boosted_trees",
    "evl1_rmse",
    "str1_bloom_fpr",
    "str2_distinct_estimate",
    "str2_distinct_estimate_stream",
    "str4_reservoir",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [n for n in os.environ.get("BENCH_ONLY", "").split(",") if n]
    spark = local_session(cores=cpus, shuffle_partitions=max(8, int(cpus)))
    QUERIES["agg1_count"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start-up
    times = {}
    for name in only or HEADLINE:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
