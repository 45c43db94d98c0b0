"""Headline queries, timed. Prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py [query ...]
"""

from __future__ import annotations

import json
import os
import sys
import time

from papertally.catalog import QUERIES
from papertally.session import local_session

HEADLINE = [
    "page_count_report",
    "upload_status",
    "scan_pages_left",
    "run_totals",
    "suffix_join",
    "like_candidates",
    "references_consistency",
    "scored_candidates",
    "proof_resolution",
    "memory_lookup",
    "memory_upsert",
    "semantic_topk",
    "formats_quality",
    "box_collisions",
    "line_rows",
    "review_queue_whole",
    "feedback_fold",
    "perms_effective",
    "dense_pages",
    "merge_rows",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    names = sys.argv[1:] or HEADLINE
    # the first job of a session pays for starting it
    QUERIES["merge_rows"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
