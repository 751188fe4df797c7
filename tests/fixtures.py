"""Small tables with known results."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from dockpulse import schemas

REPORTED = datetime(2022, 12, 1)


def status_table(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Status rows; counters that are not given are 0."""
    zero = {f.name: 0 for f in schemas.STATION_STATUS if f.dataType.typeName() == "integer"}
    flags = {"is_charging_station": True, "is_installed": True, "is_renting": True, "is_returning": True}
    base = {**zero, **flags, "status": "IN_SERVICE", "traffic": None, "info_reported": REPORTED}
    full = [{**base, **row} for row in rows]
    for row in full:
        row["info_station_id"] = row.get("info_station_id") or row["station_id"]
    names = schemas.STATION_STATUS.names
    return spark.createDataFrame([tuple(row[n] for n in names) for row in full], schemas.STATION_STATUS)


def information_table(spark: SparkSession, rows: list[dict]) -> DataFrame:
    base = {
        "name": "Station",
        "physical_configuration": "REGULAR",
        "lat": 43.66,
        "lon": -79.38,
        "altitude": 0.0,
        "address": "Street",
        "capacity": 23,
        "is_charging_station": True,
        "rental_methods": ["KEY"],
        "is_valet_station": False,
        "is_virtual_station": False,
        "groups": [],
        "obcn": "416",
        "nearby_distance": 500.0,
        "bluetooth_id": None,
        "ride_code_support": True,
        "rental_uris": ["", "", ""],
        "active": True,
        "reported": REPORTED,
        "id": 1,
    }
    names = schemas.STATION_INFORMATION.names
    data = [tuple({**base, **row}[n] for n in names) for row in rows]
    return spark.createDataFrame(data, schemas.STATION_INFORMATION)


# (minute, iconic, efit, efit_g5, disabled) of one charging station with ten docks
EVENT_MINUTES = [
    (1, 0, 0, 0, 0),
    (2, 0, 1, 0, 0),
    (3, 0, 0, 0, 0),
    (4, 0, 0, 0, 1),
    (5, 0, 1, 0, 0),
    (6, 0, 0, 0, 1),
    (7, 0, 0, 0, 2),
    (8, 0, 1, 1, 0),
    (9, 0, 0, 0, 1),
    (10, 0, 0, 0, 0),
    (11, 0, 0, 0, 1),
    (12, 0, 1, 0, 1),
    (13, 0, 0, 0, 1),
    (14, 0, 0, 1, 0),
    (15, 1, 0, 1, 0),
]


def event_status(spark: SparkSession) -> DataFrame:
    return status_table(
        spark,
        [
            {
                "station_id": 7001,
                "last_reported": datetime(2023, 1, 1, 0, minute),
                "num_bikes_available": iconic + efit + g5,
                "num_bikes_disabled": disabled,
                "num_docks_available": 10 - iconic - efit - g5 - disabled,
                "vehicle_types_available_iconic": iconic,
                "vehicle_types_available_efit": efit,
                "vehicle_types_available_efit_g5": g5,
            }
            for minute, iconic, efit, g5, disabled in EVENT_MINUTES
        ],
    )


# (day, hour, minute, bikes available); no docks are ever available
OCCUPANCY_TIMES = [
    (1, 0, 0, 0),
    (1, 12, 0, 0),
    (2, 0, 0, 0),
    (2, 12, 0, 1),
    (4, 0, 0, 0),
    (5, 0, 0, 1),
    (5, 6, 0, 1),
    (5, 12, 0, 0),
    (5, 18, 0, 1),
    (6, 0, 0, 1),
    (6, 23, 55, 0),
    (7, 0, 5, 1),
]


def occupancy_status(spark: SparkSession) -> DataFrame:
    return status_table(
        spark,
        [
            {"station_id": 7001, "last_reported": datetime(2023, 1, d, h, m), "num_bikes_available": bikes}
            for d, h, m, bikes in OCCUPANCY_TIMES
        ],
    )
