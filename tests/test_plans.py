"""What plans must not do twice: read a table, exchange it, or parse a document."""

from __future__ import annotations

import re

import pytest

from dockpulse import schemas
from dockpulse.ingest.status import as_of_version
from dockpulse.operators import events, quality
from dockpulse.plans import reports
from dockpulse.sources import gbfs, tables
from fixtures import event_status, information_table


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Status and stations as files, so that scans show in plans."""
    path = str(tmp_path_factory.mktemp("plans"))
    tables.write_status(event_status(spark), f"{path}/status", "overwrite")
    information_table(spark, [{"station_id": 7001}]).write.parquet(f"{path}/information")
    status = tables.read_table(spark, f"{path}/status", schemas.STORED_STATUS).select(*schemas.STATION_STATUS.names)
    return status, tables.read_table(spark, f"{path}/information", schemas.STATION_INFORMATION)


def final_plan(frame) -> str:
    """The plan that ran, without the one that was planned first."""
    frame.collect()
    return frame._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def status_scans(plan: str) -> int:
    return len(re.findall(r"FileScan parquet [^\n]*last_reported", plan))


@pytest.mark.parametrize(
    "decode", [gbfs.station_status, gbfs.station_information, gbfs.system_information, gbfs.regions, gbfs.system_information_count]
)
def test_documents_are_parsed_once(spark, decode):
    documents = spark.createDataFrame([("{}",)], "value string")
    plan = decode(documents)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1


def test_mismatch_summary_reads_status_once(stored):
    plan = final_plan(quality.mismatch_summary(quality.checked_capacity(*stored)))
    assert status_scans(plan) == 1


def test_quality_report_reads_status_once(stored):
    assert status_scans(final_plan(reports.quality_report(*stored))) == 1


def test_changes_with_totals_exchange_status_once(stored):
    plan = final_plan(events.changes_with_totals(stored[0]))
    assert status_scans(plan) == 1


def test_versions_are_looked_up_in_one_exchange_of_status(stored):
    plan = final_plan(as_of_version(*stored))
    full = [line for line in plan.splitlines() if "FileScan" in line and "num_bikes_available" in line]
    assert len(full) == 1
    assert "Join" not in plan


def test_rows_with_total_reads_status_once(stored):
    """The total is a subquery whose plan prints its own first plan, so the text up to there is all of it: its only source is the exchange of the counts."""
    subquery = final_plan(quality.rows_with_total(stored[0]))
    assert "Subquery" in subquery and "ReusedExchange" in subquery
    assert "FileScan" not in subquery and "Window" not in subquery


def test_summary_of_sound_data(stored):
    status, _ = stored
    counters = "num_bikes_available + num_bikes_disabled + num_docks_available + num_docks_disabled"
    capacity = status.selectExpr(f"{counters} as n").first()["n"]
    sound = status.where(f"{counters} = {capacity}")
    stations = information_table(status.sparkSession, [{"station_id": 7001, "capacity": capacity}])
    n = sound.count()
    assert n > 0
    row = quality.mismatch_summary(quality.checked_capacity(sound, stations)).first()
    assert tuple(row) == (n, 0, None, None, n)
