"""Bench: headline queries on the trade network; prints one JSON line.

Each query (without the comparison rounding of the oracle check) is executed
through the no-op sink: the full plan runs, nothing is collected. Reported per query: the median of three runs after a first run;
the first run is reported separately.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from arcweave.checks.catalog import all_queries
from arcweave.session import local_session
from arcweave.sources.fixtures import fixture_store

HEADLINE = ["f1_edge_table", "b15_connected_components", "f2_node_table",
            "b17_validate_network", "h2_number_lines", "e14_edge_metric_catalogue"]


def run_once(spark, q, sf_dir) -> float:
    t0 = time.perf_counter()
    q.build(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cores=cpus, shuffle_partitions=max(8, int(cpus) * 2),
                          app_name="arcweave-bench")
    qs = all_queries()
    t0 = time.perf_counter()
    fixture_store(spark, sf_dir)  # derives and stores the trade network once
    build = round(time.perf_counter() - t0, 3)
    medians, firsts = {}, {}
    for name in names:
        q = qs[name]
        firsts[name] = round(run_once(spark, q, sf_dir), 3)
        medians[name] = round(statistics.median(run_once(spark, q, sf_dir) for _ in range(3)), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "sum_of_median_query_time", "value": round(sum(medians.values()), 3),
                      "unit": "sec", "queries": medians, "fixture_build": build, "first_run": firsts, "sf": sf,
                      "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
