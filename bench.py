"""Benchmark the headline queries.

Runs each query over the fixture tables at ``$BENCH_SF_DIR`` (default
/root/testdata/sf0.1) on ``local[$BENCH_CPUS]`` and prints ONE JSON line:
{"metric": "total_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}.

Each query is materialised completely with the ``noop`` sink (every row is
computed, nothing is collected to the driver).  Before timing, every
headline query runs once on the tiny sf0.001 tables so JVM start-up and JIT
compilation are not charged to whichever query happens to come first; the
timed runs then start from scratch on the measured data.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from zonelens.plans.registry import QUERIES  # noqa: E402
from zonelens.session import get_session  # noqa: E402

HEADLINE = [
    "c2_j2_all_day_features",   # flagship: rankings x compacted record sets, per-type counts
    "d1_compact_records",       # record compaction, one shuffle
    "d3_group_records",         # raw grouping with multiplicities
    "d4_rank_stats",            # rank moments per domain
    "j5_entropy_table",         # name entropy
    "j6_name_features",         # name feature table
    "e1_top_n_per_day",         # top N per day window
    "d7_txt_label_counts",      # TXT taxonomy
    "j7_txt_report",            # TXT report
    "d8_soa_ranges",            # SOA timers
    "d9_query_type_counts",     # query types
    "j9_rank_record_correlation",  # per-day correlation matrix
    "d13_describe_entropy",     # exact quartiles
    "c3_registrable_domain",    # public-suffix equi-join
    "d17_group_by_registrable",  # grouping by registrable domain
    "b11_entropy_documents",    # entropy over whole document texts
    "b19_txt_labels_documents",  # taxonomy regexes over whole document texts
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_session(master=f"local[{cpus}]", shuffle_partitions=max(8, 2 * cpus),
                        app_name="zonelens-bench")
    warm = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if os.path.isdir(warm) and os.path.abspath(warm) != os.path.abspath(sf_dir):
        for name in HEADLINE:
            QUERIES[name](spark, warm).write.format("noop").mode("overwrite").save()
    timings = {}
    for name in HEADLINE:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "total_sec",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": float(m.group(1)) if m else None,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
