"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from starloom.plans import suite
from starloom.session import local_session

HEADLINE = ["page_with_total", "bridge_join_distinct", "neighbour_self_join", "division_all_of", "rank_count_distinct", "group_concat_distinct", "pivot_max_case", "nearest_rank_percentile", "top_n_per_group", "known_for_top3", "first_per_key", "lag_lead_neighbours", "distinct_hidden_sort", "union_content_aligned", "levenshtein_block_join", "entity_resolution", "knn_topk", "cache_latest", "upsert_latest_wins", "cross_join_conditional_counts"]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "16g")
    spark.sparkContext.setLogLevel("ERROR")
    q = suite.queries()
    q["point_lookup"](spark, sf).collect()  # starts the session
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        q[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
