"""Headline queries on stored model tables: prints one JSON line.

The tables are written once before the clock starts, as an ingest would leave them. Every query runs twice to warm up
and then three times into a sink that drops the rows; the middle time counts. `raw_` times include the projection
of the generic test tables onto the model.
"""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time

from dockpulse.adapter import StoredTables, Tables
from dockpulse.operators.occupancy import occupancy
from dockpulse.registry import REGISTRY
from dockpulse.registry.base import END, START
from dockpulse.session import local_session

HEADLINES = {
    "charging_infrastructure": "a11_charging_infrastructure",
    "system_status": "a7_system_status_grid",
    "charging_events": "a2_charging_events",
    "status_factors": "a4_factors",
    "docking_events": "a1_docking_events",
    "station_occupancy_all": "a6_occupancy",
    "information_decoding": "src1_information_documents",
    "field_integrals": "a3_integrals",
    "latest_queries": "t1_latest_queries",
    "query_history": "a12_query_history",
    "running_totals": "w10_running_totals",
    "change_capture": "i5_change_capture",
    "performance_report": "r3_performance",
    "changes_with_totals": "w11_changes_with_totals",
    "quality_report": "r14_quality_report",
    "reference_repair": "i9_reference_repair",
    "feed_log": "i7_feed_log",
}


def seconds(build) -> float:
    times = []
    for _ in range(5):
        start = time.perf_counter()
        build().write.format("noop").mode("overwrite").save()
        times.append(time.perf_counter() - start)
    return round(statistics.median(times[2:]), 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("dockpulse-bench", cores=cores)
    spark.sparkContext.setLogLevel("ERROR")
    with tempfile.TemporaryDirectory(prefix="dockpulse-bench-") as folder:
        stored, raw = StoredTables(spark, sf_dir, folder).store(), Tables(spark, sf_dir)
        times = {name: seconds(lambda q=q: REGISTRY[q].on(stored)) for name, q in HEADLINES.items()}
        times["station_occupancy_one"] = seconds(
            lambda: occupancy(stored.status(), stored.information(), START, END, 342)
        )
        times["raw_docking_events"] = seconds(lambda: REGISTRY["a1_docking_events"].on(raw))
        times["raw_system_status"] = seconds(lambda: REGISTRY["a7_system_status_grid"].on(raw))
        print(
            json.dumps(
                {
                    "metric": "sum of median query times",
                    "value": round(sum(times.values()), 3),
                    "unit": "sec",
                    "queries": times,
                    "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                }
            )
        )
        spark.stop()


if __name__ == "__main__":
    main()
