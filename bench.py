"""Run the headline queries once each and print one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from feedloom import catalog  # noqa: E402
from feedloom.session import local_session  # noqa: E402
from feedloom.views import SPREAD  # noqa: E402

HEADLINE = [
    "dense_topics", "overall_score", "drop_counts", "recalculate", "comment_view", "sort_comments", "topic_change",
    "rating_changes", "usage_overview", "cap_crossing", "topic_f1", "model_score_report", "pairwise_agreement",
    "canonical_key", "clean_text", "is_noise", "english_ratio", "dedupe_comments", "profile_columns", "percent_rows",
    "segment_lines", "parse_replies", "topk_examples_blocked", "sheet_topics_wide",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.conf.set(SPREAD, str(spark.sparkContext.defaultParallelism))  # the text table here is one row group
    chosen = sys.argv[1:] or HEADLINE
    queries = catalog.queries()
    queries["status_summary"](spark, sf_dir).collect()  # start-up is not part of any query
    times = {}
    for name in chosen:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
