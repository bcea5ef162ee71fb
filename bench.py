"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sievelight.plans.session import local_session  # noqa: E402
from workload.registry import QUERIES  # noqa: E402

HEADLINES = (
    "rate_burst",
    "id_sweep",
    "machine_rhythm",
    "template_reuse",
    "abuse_findings",
    "pattern_agg",
    "triage",
    "exact_dupe",
    "near_dupe",
    "dataset_findings",
    "link_utm",
    "scoreboard_join",
    "score_answers",
    "split_compare",
    "build_index",
    "bm25_topk",
    "page_findings",
    "broken_link",
    "jargon",
    "pii_scan",
    "coverage",
    "scaffold_findings",
    "metric_ratchet",
)

# Not timed: they bring the JVM up to speed.
WARM_UP = ("scan_totals", "template_reuse", "near_dupe")


def run(spark, name: str, sf_dir: str) -> float:
    """Seconds to compute every row and column of a query, without moving rows to the driver."""
    start = time.time()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.time() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINES
    spark = local_session(cores=cores, partitions=int(cores) if cores.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    for name in WARM_UP:
        run(spark, name, sf_dir)
    times = {name: round(run(spark, name, sf_dir), 3) for name in names}
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
                "cores": cores,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
