"""The whole poll: stations and their first status together, repeated and late documents, replays."""

from __future__ import annotations

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from dockpulse.ingest import information as dimension
from dockpulse.ingest.status import status_changes
from dockpulse.operators import feed as health
from dockpulse.operators.stations import version_keys_by_id
from dockpulse.streaming import poll, store
from fixtures import information_table, status_table

NOW = datetime(2024, 1, 1)


def station(i, capacity=20, **more):
    return {
        "station_id": str(i), "name": f"Station {i}", "physical_configuration": "REGULAR", "lat": 1.5, "lon": 2.5,
        "altitude": 0.0, "address": None, "capacity": capacity, "is_charging_station": False, "rental_methods": ["KEY"],
        "is_virtual_station": False, "groups": [], "obcn": "1", "nearby_distance": 5.0, "_bluetooth_id": "",
        "_ride_code_support": True, "rental_uris": {}, **more,
    }


def status(i, seconds, iconic=0):
    return {
        "station_id": str(i), "num_bikes_available": iconic, "num_bikes_disabled": 0, "num_docks_available": 20 - iconic,
        "num_docks_disabled": 0, "last_reported": seconds, "is_charging_station": False, "status": "IN_SERVICE",
        "is_installed": True, "is_renting": True, "is_returning": True, "traffic": None, "vehicle_docks_available": [],
        "vehicle_types_available": [{"vehicle_type_id": "ICONIC", "count": iconic}],
    }


def document(endpoint, items, updated):
    return endpoint, json.dumps({"last_updated": updated, "ttl": 30, "version": "2.3", "data": {"stations": items}})


def run(spark, folder, batches, start=0):
    for n, documents in enumerate(batches, start):
        poll.poll(spark.createDataFrame(documents, "endpoint string, value string"), n, str(folder), NOW)


def table(rows, *columns):
    return sorted(tuple(r) for r in rows.select(*columns).collect())


T0 = 1_704_067_200


def test_a_thousand_stations_five_times(spark, tmp_path):
    stations = document("station_information", [station(i) for i in range(1000)], T0)
    polls = [document("station_status", [status(i, T0 + 60 * k, k) for i in range(1000)], T0 + 60 * k) for k in range(5)]
    run(spark, tmp_path, [[stations, polls[0]], polls[1:3], [polls[0]], polls[3:]])
    assert poll.status_table(spark, str(tmp_path)).count() == 5000
    assert poll.change_table(spark, str(tmp_path)).count() == 5000
    assert poll.information_table(spark, str(tmp_path)).select("id").distinct().count() == 1000
    # the document that came twice is logged once
    assert poll.query_log(spark, str(tmp_path)).count() == 6


def test_stations_that_come_later_are_seen(spark, tmp_path):
    batches = [
        [document("station_information", [station(1)], T0), document("station_status", [status(1, T0), status(2, T0)], T0)],
        [document("station_information", [station(1, 30), station(2)], T0 + 9)],
        [document("station_status", [status(1, T0 + 60), status(2, T0 + 60)], T0 + 60)],
    ]
    run(spark, tmp_path, batches)
    found = table(poll.status_table(spark, str(tmp_path)), "station_id", F.unix_timestamp("info_reported"), F.unix_timestamp("last_reported"))
    assert found == [(1, T0, T0), (1, T0 + 9, T0 + 60), (2, T0 + 9, T0 + 60)]
    lookup = table(poll.lookup_table(spark, str(tmp_path)), "info_station_id", F.unix_timestamp("status_last_reported"))
    assert lookup == [(1, T0 + 60), (2, T0 + 60)]


def test_late_rows_alter_the_change_table(spark, tmp_path):
    counts = [0, 0, 1, 1, 2, 2, 1, 1, 1, 3]
    rows = [document("station_status", [status(1, T0 + 60 * k, n)], T0 + 60 * k) for k, n in enumerate(counts)]
    stations = document("station_information", [station(1)], T0)
    for name, order in (("late", [0, 3, 9, 1, 6, 2, 5, 4, 8, 7]), ("back", list(range(9, -1, -1)))):
        folder = tmp_path / name
        run(spark, folder, [[stations, rows[order[0]]], *[[rows[i]] for i in order[1:]]])
        every = poll.status_table(spark, str(folder))
        assert every.count() == len(counts)
        expected = table(status_changes(every), "last_reported", "num_bikes_available")
        assert table(poll.change_table(spark, str(folder)), "last_reported", "num_bikes_available") == expected
        assert [n for _, n in expected] == [0, 1, 2, 1, 3]


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    stations = document("station_information", [station(1), station(2)], T0)
    one = [stations, document("station_status", [status(1, T0, 1), status(2, T0, 2)], T0)]
    two = [document("station_status", [status(1, T0 + 60, 3), status(2, T0 - 60, 2)], T0 + 60)]
    run(spark, tmp_path, [one, two])
    read = lambda: [
        table(f(spark, str(tmp_path)), *columns)
        for f, columns in (
            (poll.status_table, ["station_id", "last_reported"]),
            (poll.change_table, ["station_id", "last_reported"]),
            (poll.lookup_table, ["info_station_id", "status_last_reported"]),
            (poll.information_table, ["id", "station_id"]),
            (poll.query_log, ["id", "time"]),
        )
    ]
    before = read()
    run(spark, tmp_path, [two], 1)
    assert read() == before


def test_every_snapshot_of_a_batch_counts(spark):
    def at(hour, capacity):
        return {"station_id": 1, "reported": datetime(2024, 1, 1, hour), "capacity": capacity}

    empty = information_table(spark, [at(0, 1)]).limit(0)
    many = information_table(spark, [at(3, 10), at(1, 10), at(2, 12), at(4, 10), {**at(1, 7), "station_id": 2}])
    merged = dimension.merge(empty, many.drop("id", "active"))
    rows = table(merged, "station_id", "reported", "capacity", "active", "id")
    assert [(s, r.hour, c, a) for s, r, c, a, _ in rows] == [(1, 1, 10, False), (1, 2, 12, False), (1, 3, 10, True), (2, 1, 7, True)]
    assert len({i for *_, i in rows}) == 4
    one_by_one = empty
    for hour in range(5):
        part = many.where(F.hour("reported") == hour).drop("id", "active")
        one_by_one = dimension.merge(one_by_one, part)
    assert table(one_by_one, "station_id", "reported", "capacity", "active") == [r[:4] for r in rows]


def test_ids_name_one_version(spark):
    first = information_table(spark, [{"station_id": 1, "id": 4}, {"station_id": 2, "id": 9}])
    changed = information_table(spark, [{"station_id": i, "capacity": 5, "reported": NOW} for i in (1, 2, 3)])
    merged = dimension.merge(first, changed.drop("id", "active"))
    ids = [r.id for r in merged.collect()]
    assert sorted(ids) == [4, 9, 10, 11, 12]
    keys = version_keys_by_id(spark.createDataFrame([(i,) for i in ids], "info_id int"), merged)
    assert keys.count() == 5


def test_log_feeds_the_reports(spark, tmp_path):
    bad = ("station_status", '{"message": "limit"}')
    good = document("station_status", [status(1, T0)], T0)
    run(spark, tmp_path, [[bad, good, ("versions", "<html>")], [bad]])
    log = poll.query_log(spark, str(tmp_path))
    assert sorted((r.endpoint, r.success) for r in log.collect()) == [("station_status", False), ("station_status", True), ("versions", False)]
    assert health.query_errors(log, 10).count() == 2
    assert health.latest_queries(log).count() >= 1


def test_times_that_cannot_be_ordered_fail(spark):
    from dockpulse.operators.stations import station_lookup

    for when in (datetime(2070, 1, 1), datetime(2024, 1, 1, 0, 0, 0, 5), datetime(1999, 1, 1)):
        with pytest.raises(Exception, match="no whole second"):
            station_lookup(status_table(spark, [{"station_id": 1, "last_reported": when}])).collect()


def test_versions_are_read_together(spark, tmp_path):
    path = str(tmp_path / "parts")
    for n in (0, 4, 7):
        store.write_version(spark.range(n, n + 2).selectExpr("id"), path, n)
    (tmp_path / "parts" / "version=9").mkdir()
    assert sorted(r.id for r in store.read_all(spark, path, spark.range(1).schema).collect()) == [0, 1, 4, 5, 7, 8]
