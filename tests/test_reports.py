"""Reports against the operators they are made of, on ranges that cut the data."""

from __future__ import annotations

from datetime import datetime

import pytest

from dockpulse.adapter import Tables
from dockpulse.operators import availability, events
from dockpulse.operators.occupancy import occupancy
from dockpulse.params import StatusQuery
from dockpulse.plans import reports
from dockpulse.sources import layouts
from fixtures import information_table, status_table

START, END = datetime(2024, 1, 10, 7), datetime(2024, 1, 20, 12)


@pytest.mark.parametrize("station", [None, 9])
def test_performance_equals_its_parts(spark, station):
    t = Tables(spark, "/root/testdata/sf0.001")
    status, stations = t.status(), t.information()
    whole = {r.station_id: r for r in reports.performance(status, stations, START, END, station).collect()}
    factors = availability.with_factors(availability.integrals(status, stations, StatusQuery(station, START, END)))
    times = {r.station_id: r for r in occupancy(status, stations, START, END, station).collect()}
    parts = factors.collect()
    assert len(parts) == len(whole) > 0
    for part in parts:
        row = whole[part.station_id].asDict()
        assert {k: row[k] for k in part.asDict()} == part.asDict()
        assert (row["empty_sec"], row["full_sec"]) == (times[part.station_id].empty_sec, times[part.station_id].full_sec)


def test_orders_of_events(spark):
    columns = [f"{b}_{k}" for b in ("boost", *events.BIKES) for k in ("undockings", "dockings")]
    rows = [
        (1, "a", 0, 0, -3, 5, -1, 0, 0, 0),
        (2, "b", 0, 0, -3, 9, -2, 0, 0, 0),
        (3, "c", 0, 0, -1, 0, 0, 0, 0, 0),
    ]
    counts = spark.createDataFrame(rows, "station_id int, name string, " + ", ".join(f"{c} long" for c in columns))
    order = lambda df: [r.station_id for r in df.collect()]
    assert order(events.by_iconic_difference(counts, "undockings")) == [3, 1, 2]
    assert order(events.by_iconic_difference(counts, "dockings", 2)) == [2, 1]
    assert order(events.by_iconic_count(counts, "undockings")) == [2, 1, 3]
    assert order(events.by_iconic_count(counts, "dockings")) == [2, 1, 3]


def test_station_without_events_has_no_row(spark):
    status = status_table(spark, [{"station_id": 1, "last_reported": datetime(2024, 1, 10, 8)}])
    stations = information_table(spark, [{"station_id": 1}, {"station_id": 2}])
    row = events.docking_events(status, stations).collect()
    assert [(r.station_id, r.iconic_dockings) for r in row] == [(1, 0)]
    header = reports.trips_header(status.limit(0), stations).first()
    assert header.all_started == 0


def test_payloads_of_many_keys_are_few_files(spark, tmp_path):
    """A key is in the line of its payload: the files do not grow with the keys, and every payload comes back with its own."""
    payloads = [(None if i == 7 else i, f'{{"count":{i},"text":"a\\"b\\\\c ü"}}') for i in range(300)]
    frame = spark.createDataFrame(payloads, "station_id int, json string").repartition(3)
    path = str(tmp_path / "json")
    layouts.write_json(frame, path, by=("station_id",))
    assert sum(f.suffix == ".txt" for f in (tmp_path / "json").rglob("*")) <= 3
    found = layouts.read_json(spark, path, station_id="int").collect()
    assert sorted((r.json, r.station_id) for r in found) == sorted((p, i) for i, p in payloads)
