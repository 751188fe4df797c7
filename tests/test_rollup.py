"""Range queries by stored days: the same rows as from the status table, which is read only where a bound cuts a day."""

from __future__ import annotations

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from dockpulse import schemas
from dockpulse.adapter import Tables
from dockpulse.operators import availability, events, occupancy, rollup
from dockpulse.params import StatusQuery
from dockpulse.sources import tables

RANGES = [
    (None, None),
    (datetime(2024, 1, 8, 18, 30), datetime(2024, 1, 20, 12)),
    (datetime(2024, 1, 10), datetime(2024, 1, 12)),
    (datetime(2024, 1, 10), datetime(2024, 1, 10, 23, 59, 59)),
    (datetime(2024, 1, 10, 3), datetime(2024, 1, 10, 21)),
    (datetime(2030, 1, 1), datetime(2030, 1, 5)),
]
SUMMARIES = {"docking": rollup.DOCKINGS, "charging": rollup.CHARGES, "integrals": rollup.INTEGRALS, "occupancy": rollup.occupancy_summary(2, 3)}


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("rollup"))
    t = Tables(spark, "/root/testdata/sf0.001")
    tables.write_status(t.status().select(*schemas.STATION_STATUS.names), f"{path}/status")
    status = tables.read_table(spark, f"{path}/status", schemas.STORED_STATUS)
    days = {name: rollup.DaySums(spark, f"{path}/{name}", summary) for name, summary in SUMMARIES.items()}
    for table in days.values():
        # one day is never summarised, one only in the second batch
        rows = status.where(F.col(schemas.DATE_COLUMN) != date(2024, 1, 15))
        table.refresh(rows.where(F.col(schemas.DATE_COLUMN) != date(2024, 1, 11)), 0)
        table.refresh(status, 1, [date(2024, 1, 11)])
    return days, status, t.information()


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=str)


@pytest.mark.parametrize("earliest, latest, station", [(*bounds, None) for bounds in RANGES] + [(*RANGES[1], 5)])
def test_equal_to_all_rows(stored, earliest, latest, station):
    days, status, information = stored
    query = StatusQuery(station, earliest, latest)
    for name, direct, by_days in (
        ("docking", events.docking_events, rollup.docking_events),
        ("charging", events.charging_events, rollup.charging_events),
        ("integrals", availability.integrals, rollup.integrals),
    ):
        assert rows(by_days(days[name], status, information, query)) == rows(direct(status, information, query)), name
    if earliest is not None:
        bounds = (earliest, latest, station, 2, 3)
        expected = rows(occupancy.occupancy(status, information, *bounds))
        assert rows(rollup.occupancy(days["occupancy"], status, information, *bounds)) == expected
        assert expected or station or earliest.year == 2030


def test_rows_are_read_of_cut_days_only(stored):
    days, status, information = stored
    query = StatusQuery(None, datetime(2024, 1, 8, 18, 30), datetime(2024, 1, 14, 12))
    plan = rollup.docking_events(days["docking"], status, information, query)
    read = {f.split(f"{schemas.DATE_COLUMN}=")[1].split("/")[0] for f in scanned(plan) if f"{schemas.DATE_COLUMN}=" in f}
    assert read == {"2024-01-08", "2024-01-14"}


def scanned(frame):
    """The files that the scans of a plan open once partitions are pruned."""
    plan = frame._jdf.queryExecution().sparkPlan()
    leaves, found = plan.collectLeaves(), []
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if "FileSourceScan" in leaf.getClass().getSimpleName():
            partitions = leaf.inputRDD().partitions()
            for p in partitions:
                found += [f.filePath().toString() for f in p.files()]
    return found


def test_a_late_row_counts_after_a_refresh_of_its_day(spark, tmp_path, stored):
    _, status, information = stored
    columns = schemas.STATION_STATUS.names
    late = status.where(F.col(schemas.DATE_COLUMN) == date(2024, 1, 12)).select(*columns).orderBy("info_station_id", "last_reported").limit(1)
    late = late.withColumn("last_reported", F.col("last_reported") + F.expr("interval 1 second")).withColumn("vehicle_types_available_iconic", F.lit(11))
    days = rollup.DaySums(spark, str(tmp_path / "days"), rollup.DOCKINGS)
    days.refresh(status, 0)
    folders = dict(days.table.live())
    more = status.select(*columns).unionByName(late)
    days.refresh(more, 1, [date(2024, 1, 12)])
    days.refresh(more, 1, [date(2024, 1, 12)])
    assert {day for day, batch in days.table.live() if folders[day] != batch} == {date(2024, 1, 12)}
    query = StatusQuery(None, datetime(2024, 1, 2), datetime(2024, 1, 30) + timedelta(hours=5))
    assert rows(rollup.docking_events(days, more, information, query)) == rows(events.docking_events(more, information, query))


def test_other_thresholds_are_refused(stored):
    days, status, information = stored
    with pytest.raises(ValueError):
        rollup.occupancy(days["occupancy"], status, information, *RANGES[1])
