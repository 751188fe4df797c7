"""Feed files, dumps, delimited text and tables by day."""

from __future__ import annotations

import gzip
import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from dockpulse import schemas
from dockpulse.ingest import feedlog
from dockpulse.ingest.status import new_rows
from dockpulse.operators import feed
from dockpulse.params import StatusQuery
from dockpulse.sources import gbfs, tables
from fixtures import event_status, information_table

# Field names and value sets are those of the feed (fixed); the values are invented.
STATUS = {
    "station_id": "9101",
    "num_bikes_available": 6,
    "num_bikes_disabled": 0,
    "num_docks_available": 5,
    "num_docks_disabled": 0,
    "last_reported": 1700000405,
    "is_charging_station": False,
    "status": "IN_SERVICE",
    "is_installed": True,
    "is_renting": True,
    "is_returning": True,
    "traffic": None,
    "vehicle_docks_available": [{"vehicle_type_ids": ["ICONIC", "EFIT"], "count": 5}, {"vehicle_type_ids": [], "count": 7}],
    "vehicle_types_available": [
        {"vehicle_type_id": "ICONIC", "count": 4},
        {"vehicle_type_id": "EFIT G5", "count": 1},
    ],
}
INFORMATION = {
    "station_id": "9207",
    "name": "Quay",
    "physical_configuration": "REGULAR",
    "lat": 43.6,
    "lon": -79.3,
    "altitude": 0.0,
    "post_code": "M4Y",
    "capacity": 22,
    "is_charging_station": False,
    "rental_methods": ["key", "PHONE"],
    "is_virtual_station": False,
    "groups": [],
    "obcn": "000",
    "nearby_distance": 120.0,
    "_bluetooth_id": "",
    "_ride_code_support": True,
    "rental_uris": {"ios": "app"},
}


def envelope(key, items, updated=1700000595):
    data = items if key is None else {key: items}
    return json.dumps({"last_updated": updated, "ttl": 36, "data": data, "version": "2.3"}, indent=1)


def test_status_files(spark, tmp_path):
    never = {k: v for k, v in STATUS.items() if k != "last_reported"} | {"station_id": "1"}
    no_docks = STATUS | {"station_id": "2", "vehicle_docks_available": [], "vehicle_types_available": []}
    (tmp_path / "a.json").write_text(envelope("stations", [STATUS, never]))
    with gzip.open(tmp_path / "b.json.gz", "wt") as file:
        file.write(envelope("stations", [no_docks]))
    rows = gbfs.station_status(gbfs.read_documents(spark, str(tmp_path))).orderBy("station_id").collect()
    assert [r.station_id for r in rows] == [2, 9101]
    assert rows[1].last_reported == datetime(2023, 11, 14, 22, 20, 5)
    assert rows[1].vehicle_docks_available == 5
    assert (rows[1].vehicle_types_available_iconic, rows[1].vehicle_types_available_efit_g5) == (4, 1)
    assert (rows[1].vehicle_types_available_boost, rows[1].vehicle_types_available_efit) == (0, 0)
    assert (rows[0].vehicle_docks_available, rows[0].vehicle_types_available_iconic) == (0, 0)


def test_information_file(spark, tmp_path):
    (tmp_path / "a.json").write_text(envelope("stations", [INFORMATION]))
    row = gbfs.station_information(gbfs.read_documents(spark, str(tmp_path))).first()
    assert row.station_id == 9207 and row.reported == datetime(2023, 11, 14, 22, 23, 15)
    assert row.rental_methods == ["KEY", "PHONE"] and row.rental_uris == ["", "app", ""]
    assert row.bluetooth_id is None and row.address is None and row.is_valet_station is False


def test_system_information_file(spark, tmp_path):
    data = {
        "_station_count": 756,
        "_vehicle_count": {"_ebike_count": 825, "_mechanical_count": 8126},
        "build_hash": "2a5",
        "build_label": "2023",
        "build_number": "267",
        "build_version": "2023.1",
        "language": "en",
        "name": "bikes",
        "system_id": "bikes",
        "mobile_head_version": "2",
        "mobile_minimum_supported_version": "1",
        "timezone": "America/Toronto",
    }
    (tmp_path / "a.json").write_text(envelope(None, data, 1701217248))
    information, counts = feedlog.system_rows(gbfs.read_documents(spark, str(tmp_path)))
    assert tuple(counts.first()) == (datetime(2023, 11, 29, 0, 20, 48), 756, 8126, 825)
    assert information.first().mobile_head_version == 2


def test_one_bad_item_spoils_a_document(spark):
    good = envelope("stations", [STATUS])
    bad = [
        {**STATUS, "status": "CLOSED"},
        {**STATUS, "vehicle_types_available": [{"vehicle_type_id": "TRICYCLE", "count": 1}]},
        {**STATUS, "num_bikes_available": None},
        {**STATUS, "num_docks_available": "many"},
        {**STATUS, "station_id": "x"},
    ]
    documents = spark.createDataFrame([(good,), *[(envelope("stations", [STATUS, b]),) for b in bad]], "value string")
    assert gbfs.station_status(documents).count() == 1
    stations = [
        {**INFORMATION, "physical_configuration": None},
        {**INFORMATION, "physical_configuration": "TENT"},
        {**INFORMATION, "rental_methods": ["COINS"]},
    ]
    documents = spark.createDataFrame([(envelope("stations", [s]),) for s in stations], "value string")
    assert gbfs.station_information(documents).count() == 1


def test_empty_dimension(spark, tmp_path):
    (tmp_path / "a.json").write_text(envelope("regions", []))
    assert gbfs.regions(gbfs.read_documents(spark, str(tmp_path))).count() == 0


def test_log_of_good_and_bad_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(envelope("stations", [STATUS]))
    (tmp_path / "b.json").write_text('{"message": "limit"}')
    (tmp_path / "c.json").write_text("<html>")
    now = datetime(2024, 1, 1)
    documents = gbfs.read_documents(spark, str(tmp_path)).orderBy("file")
    rows = feedlog.log_rows(documents, gbfs.STATION_STATUS, now).collect()
    assert [r.success for r in rows] == [True, False, False]
    assert [r.time for r in rows] == [datetime(2023, 11, 14, 22, 23, 15), now, now]
    assert [r.error_json for r in rows] == [None, '{"message": "limit"}', "null"]


def test_status_dump_as_one_array(spark, tmp_path):
    records = [STATUS, STATUS | {"station_id": "8", "traffic": "busy"}]
    (tmp_path / "dump.json").write_text(json.dumps(records))
    rows = tables.read_status_dump(spark, str(tmp_path / "dump.json"), array=True).orderBy("station_id").collect()
    assert [(r.station_id, r.vehicle_types_available_iconic, r.traffic) for r in rows] == [(8, 4, "busy"), (9101, 4, None)]
    assert rows[0].last_reported == datetime(2023, 11, 14, 22, 20, 5)


RECORD = {
    "info_id": 12, "station_id": 7000, "name": "Fort", "physical_configuration": "REGULAR", "lat": 1.5, "lon": 2.5,
    "altitude": 3.0, "address": None, "capacity": 35, "is_charging_station": False, "rental_methods": ["KEY"],
    "is_valet_station": False, "is_virtual_station": False, "groups": ["a"], "obcn": "647", "nearby_distance": 500.0,
    "_bluetooth_id": "b1", "_ride_code_support": True, "rental_uris": ["", "", "x"], "active": True,
    "reported": "2023-10-30T04:00:05Z",
}


def test_information_dump(spark, tmp_path):
    (tmp_path / "dump.json").write_text(json.dumps([RECORD]))
    row = tables.read_information_dump(spark, str(tmp_path / "dump.json"), array=True).first()
    assert (row.id, row.bluetooth_id, row.ride_code_support) == (12, "b1", True)
    assert row.reported == datetime(2023, 10, 30, 4, 0, 5) and row.rental_uris == ["", "", "x"]


@pytest.mark.parametrize("bad", ["{}", "not json", json.dumps(RECORD | {"info_id": "twelve"})])
def test_bad_information_records_raise(spark, tmp_path, bad):
    (tmp_path / "dump.json").write_text(json.dumps(RECORD) + "\n" + bad + "\n")
    with pytest.raises(Exception):
        tables.read_information_dump(spark, str(tmp_path / "dump.json")).collect()


@pytest.mark.parametrize("bad", ["{}", "[1", json.dumps(STATUS | {"num_docks_available": "two"}), json.dumps(RECORD)])
def test_bad_status_records_raise(spark, tmp_path, bad):
    (tmp_path / "dump.json").write_text(json.dumps(STATUS) + "\n" + bad + "\n")
    with pytest.raises(Exception):
        tables.read_status_dump(spark, str(tmp_path / "dump.json")).collect()


PSQL = r'''id^station_id^name^capacity^is_charging_station^rental_methods^groups^bluetooth_id^active^reported
1^7000^"Fort ^ ""York"""^35^t^"{KEY,""TRANSIT, CARD"",NULL,""say \""hi\""""}"^{}^""^f^2023-12-19 05:20:38+00
2^7001^^40^f^{}^{a}^^t^2023-12-19 05:20:38.5-05
'''


def test_psql_file(spark, tmp_path):
    (tmp_path / "t.csv").write_text(PSQL)
    one, two = tables.read_delimited(spark, str(tmp_path / "t.csv"), schemas.STATION_INFORMATION).orderBy("id").collect()
    assert (one.name, one.is_charging_station, one.active) == ('Fort ^ "York"', True, False)
    assert one.rental_methods == ["KEY", "TRANSIT, CARD", None, 'say "hi"'] and one.groups == []
    assert one.reported == datetime(2023, 12, 19, 5, 20, 38) and one.bluetooth_id == ""
    assert (two.name, two.bluetooth_id, two.lat, two.groups) == (None, None, None, ["a"])
    assert two.reported == datetime(2023, 12, 19, 10, 20, 38, 500000)


@pytest.mark.parametrize("old, new", [("^t^", "^yes^"), ("35^", "many^"), ("2023-12-19 05:20:38+00", "noon"), ("{a}", "a")])
def test_values_of_psql_files_that_do_not_parse(spark, tmp_path, old, new):
    (tmp_path / "t.csv").write_text(PSQL.replace(old, new, 1))
    with pytest.raises(Exception, match="not a value of"):
        tables.read_delimited(spark, str(tmp_path / "t.csv"), schemas.STATION_INFORMATION).collect()


def test_delimited_text_round_trip(spark, tmp_path):
    odd = {"station_id": 7, "name": 'a^"b"', "rental_methods": ["KEY", 'x"y', "back\\slash", "a,b", "{c}", "", "null", None], "bluetooth_id": "", "address": None}
    stations = information_table(spark, [odd])
    tables.write_delimited(stations, str(tmp_path / "t"))
    again = tables.read_delimited(spark, str(tmp_path / "t"), schemas.STATION_INFORMATION)
    assert again.collect() == stations.collect()


def test_delimited_lists(spark, tmp_path):
    stations = information_table(spark, [{"station_id": 7, "rental_methods": ["KEY", "PHONE"], "groups": []}])
    tables.write_delimited(stations, str(tmp_path / "t"))
    again = tables.read_delimited(spark, str(tmp_path / "t"), schemas.STATION_INFORMATION)
    assert again.collect() == stations.collect()


def test_days_are_pruned(spark, tmp_path):
    path = str(tmp_path / "status")
    status = event_status(spark)
    later = status.withColumn("last_reported", F.expr("last_reported + interval 3 days"))
    tables.write_status(status.unionByName(later), path, "overwrite")
    found = StatusQuery(None, datetime(2023, 1, 4), datetime(2023, 1, 4, 12)).on_status(tables.read_table(spark, path))
    assert found.count() == 15
    plan = found._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "reported_date" in filters and "last_reported" in plan.split("PushedFilters: [")[1]


def test_insert_again_adds_nothing(spark):
    status = event_status(spark)
    stations = information_table(spark, [{"station_id": 7001}])
    feed = status.select(*schemas.STATUS_FEED_COLUMNS)
    assert new_rows(feed, stations, status.limit(0)).count() == 15
    assert new_rows(feed, stations, status).count() == 0
    assert new_rows(feed, information_table(spark, [{"station_id": 1}]), status.limit(0)).count() == 0


def test_export_names():
    day = datetime(2024, 1, 3).date()
    assert tables.export_name("status", day, day) == "station_status_all_2024-01-03_2024-01-03.json"
    assert tables.range_label(None, datetime(2024, 1, 3), datetime(2024, 1, 4)) == (
        "system-performance-2024-01-03-00:00:00-2024-01-04-00:00:00.csv"
    )


def test_bodies_as_variant(spark, tmp_path):
    """Bodies are stored typed; their fields are those of the text form."""
    bodies = ['{"k": 5, "a": {"b": [1, {"c": "x"}]}}', '{"k": "five"}', '{"k": null}', '{"a": {"b": []}}', "[1, 2]", "7", "null", "no json", "", None]
    log = spark.createDataFrame(list(enumerate(bodies)), "id long, error_json string")
    feedlog.append_log(feedlog.typed_bodies(log.where("id < 4")), feedlog.typed_bodies(log)).write.parquet(f"{tmp_path}/log")
    stored = spark.read.parquet(f"{tmp_path}/log")
    assert dict(stored.dtypes)["error_json"] == "variant" and stored.count() == len(bodies)
    assert [r.id for r in stored.where("error_json is null").collect()] == [9]
    assert [r.id for r in stored.where("is_variant_null(error_json)").orderBy("id").collect()] == [6, 7, 8]
    expected = {"$.k": {0: "5", 1: "five"}, "$.a.b[1].c": {0: "x"}, "$.a.b": {0: '[1,{"c":"x"}]', 3: "[]"}, "$[1]": {4: "2"}}
    for path, values in expected.items():
        for rows in (stored, log.where("id < 7")):
            found = feed.error_field(rows, path, "value").where("value is not null").collect()
            assert {r.id: r.value for r in found} == values
