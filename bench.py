"""Headline queries, timed: the median of warm runs; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from loomspark.plans import catalogue
from loomspark.session import session

HEADLINE = ("click_features", "full_click_pipeline", "composite_count", "group_nunique_feature", "avg_rank", "rank_logit_blend", "left_join_renamed", "left_join_multikey_dedup", "nearest_point_km", "group_basics", "describe_table", "corr_matrix", "dedup_first", "topk_groups", "yearly_share_pct", "unpivot_long", "ols_fit", "knn_predict", "lloyd_step", "gini_best_split", "auc_rank")


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    conf = {"spark__master": f"local[{cpus}]", "spark__sql__shuffle__partitions": cpus, "spark__driver__memory": "8g", "spark__ui__enabled": "false", "spark__ui__showConsoleProgress": "false"}
    spark = session("bench", **conf)
    spark.sparkContext.setLogLevel("ERROR")
    found = {}
    for name in HEADLINE:
        times = []
        for _ in range(4):
            begin = time.perf_counter()
            catalogue.queries()[name](spark, sf).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - begin)
        found[name] = round(statistics.median(times[1:]), 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(found.values()), 3), "unit": "sec", "queries": found, "sf": sf.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
