"""Hand-checked results on small inputs."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest

from dockpulse.ingest import information as dimension
from dockpulse.operators import availability, events
from dockpulse.operators.occupancy import cached_occupancy, merge_cache, occupancy, as_cache_rows
from dockpulse.params import StatusQuery
from fixtures import event_status, information_table, occupancy_status, status_table

DAY = datetime(2023, 1, 1)


def until(minute: int) -> StatusQuery:
    return StatusQuery(7001, DAY, DAY + timedelta(minutes=minute))


@pytest.mark.parametrize(
    ("minute", "expected"),
    [(5, (-1, 1, 0)), (8, (-3, 2, 1)), (9, (-3, 2, 1)), (10, (-3, 2, 1)), (14, (-4, 2, 2)), (15, (-4, 2, 2))],
)
def test_charging(spark, minute, expected):
    stations = information_table(spark, [{"station_id": 7001}])
    row = events.charging_events(event_status(spark), stations, until(minute)).first()
    assert (row.bikes_disabled, row.efit_charged, row.efit_g5_charged) == expected


@pytest.mark.parametrize(
    ("minute", "dockings", "undockings"),
    [
        (5, (2, 0, 2, 0), (1, 0, 1, 0)),
        (8, (4, 0, 3, 1), (2, 0, 2, 0)),
        (9, (4, 0, 3, 1), (4, 0, 3, 1)),
        (10, (4, 0, 3, 1), (4, 0, 3, 1)),
        (14, (6, 0, 4, 2), (5, 0, 4, 1)),
        (15, (7, 1, 4, 2), (5, 0, 4, 1)),
    ],
)
def test_docking(spark, minute, dockings, undockings):
    stations = information_table(spark, [{"station_id": 7001}])
    totals = events.docking_totals(events.docking_events(event_status(spark), stations, until(minute))).first()
    bikes = ("all", "iconic", "efit", "efit_g5")
    assert tuple(totals[f"{b}_dockings"] for b in bikes) == dockings
    assert tuple(totals[f"{b}_undockings"] for b in bikes) == undockings


@pytest.mark.parametrize(
    ("station", "iconic", "dockings", "undockings"),
    [
        (7000, [0, 0, 5, 26, 29], 29, 0),
        (7006, [13, 10, 7], 0, -6),
        (7012, [10, 11, 13, 12, 12], 3, -1),
        (7148, [17, 17, 17, 19, 19], 2, 0),
    ],
)
def test_iconic_counts(spark, station, iconic, dockings, undockings):
    rows = [
        {"station_id": station, "last_reported": DAY + timedelta(hours=7 * i), "vehicle_types_available_iconic": n}
        for i, n in enumerate(iconic)
    ]
    row = events.docking_events(status_table(spark, rows), information_table(spark, [{"station_id": station}])).first()
    assert (row.iconic_dockings, row.iconic_undockings) == (dockings, undockings)


@pytest.mark.parametrize(
    ("day", "empty"), [(1, 86400), (2, 43200), (3, 0), (4, 86400), (5, 21600), (6, 300), (7, 300)]
)
def test_occupancy_days(spark, day, empty):
    start = datetime(2023, 1, day)
    stations = information_table(spark, [{"station_id": 7001}])
    rows = occupancy(occupancy_status(spark), stations, start, start + timedelta(days=1), 7001).collect()
    assert rows[0].empty_sec == empty


def test_occupancy_cache(spark):
    start, end = datetime(2023, 1, 1), datetime(2023, 1, 2)
    stations = information_table(spark, [{"station_id": 7001}])
    status = occupancy_status(spark)
    nothing = as_cache_rows(occupancy(status, stations, start, end), start, end, 0, 0, DAY).limit(0)
    first, added = cached_occupancy(nothing, status, stations, start, end, DAY)
    cache = merge_cache(nothing, added)
    later = DAY + timedelta(days=9)
    second, added_again = cached_occupancy(cache, status, stations, start, end, later)
    assert added_again.count() == 0
    assert second.collect() == first.collect()
    other, computed = cached_occupancy(cache, status, stations, start, end, later, None, 1, 0)
    assert computed.count() == 1


def test_factors(spark):
    seconds = (42805, 296528, 496422, 191565, 0, 62361, 54744, 179423)
    names = ["total_seconds", *[f"{c}_seconds" for c in availability.COUNTERS]]
    integral = spark.createDataFrame(
        [(7001, True, 23, *seconds)],
        "station_id int, charging boolean, capacity int, " + ", ".join(f"{n} long" for n in names),
    )
    row = availability.factors(integral).first()
    expected = {
        "bikes_available_factor": 0.3011919574612881,
        "bikes_disabled_factor": 0.5042300015743792,
        "docks_available_factor": 0.19457804096433268,
        "docks_disabled_factor": 0.0,
        "iconic_available_factor": 0.06334184852440035,
        "efit_available_factor": 0.05560504410801258,
        "efit_g5_available_factor": 0.18224506482887512,
        "iconic_available_factor_normalized": 0.2103039173366428,
        "efit_available_factor_normalized": 0.18461662979549995,
        "efit_g5_available_factor_normalized": 0.6050794528678574,
    }
    for name, value in expected.items():
        assert row[name] == pytest.approx(value, abs=1e-15)
    sums = availability.factor_sums(availability.factors(integral)).first()
    assert sums.station_factors == pytest.approx(1.0)
    assert sums.bike_factors == pytest.approx(1.0)


def test_factors_without_time(spark):
    integral = spark.createDataFrame(
        [(1, True, 23, 0, *[0] * 7), (2, True, 0, 10, 5, *[0] * 6)],
        "station_id int, charging boolean, capacity int, total_seconds long, "
        + ", ".join(f"{c}_seconds long" for c in availability.COUNTERS),
    )
    still, no_docks = availability.factors(integral).orderBy("station_id").collect()
    assert still.bikes_available_factor == 0.0 and still.iconic_available_factor_normalized is None
    assert no_docks.bikes_available_factor == 1.0


def test_same_record_again_inserts_nothing(spark):
    first = information_table(spark, [{"station_id": 7001}])
    empty = first.limit(0)
    snapshot = first.drop("id", "active")
    merged = dimension.merge(empty, snapshot)
    assert dimension.inserted(empty, snapshot).count() == 1
    assert dimension.inserted(merged, snapshot).count() == 0
    later = information_table(spark, [{"station_id": 7001, "reported": DAY}]).drop("id", "active")
    assert dimension.inserted(merged, later).count() == 0
    changed = information_table(spark, [{"station_id": 7001, "reported": DAY, "capacity": 30}]).drop("id", "active")
    result = dimension.merge(merged, changed).orderBy("id").collect()
    assert [(r.id, r.capacity, r.active) for r in result] == [(1, 23, False), (2, 30, True)]


def test_flapping_column_can_be_ignored(spark):
    merged = dimension.merge(
        information_table(spark, [{"station_id": 1}]).limit(0),
        information_table(spark, [{"station_id": 1}]).drop("id", "active"),
    )
    flapped = information_table(spark, [{"station_id": 1, "bluetooth_id": "x"}]).drop("id", "active")
    assert dimension.inserted(merged, flapped).count() == 1
    assert dimension.inserted(merged, flapped, ignore=("bluetooth_id",)).count() == 0
