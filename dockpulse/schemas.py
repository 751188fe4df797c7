"""Fixed table schemas and value sets."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


INT, LONG, DOUBLE, TEXT, FLAG = T.IntegerType(), T.LongType(), T.DoubleType(), T.StringType(), T.BooleanType()
TIME, TEXTS = T.TimestampNTZType(), T.ArrayType(T.StringType())

# Fixed values of the feed.
STATION_STATES = ("IN_SERVICE", "MAINTENANCE", "PLANNED", "END_OF_LIFE")
PHYSICAL_CONFIGURATIONS = (
    "ELECTRICBIKESTATION",
    "REGULAR",
    "REGULARLITMAPFRAME",
    "SMARTLITMAPFRAME",
    "SMARTMAPFRAME",
    "VAULT",
)
RENTAL_METHODS = ("KEY", "TRANSITCARD", "CREDITCARD", "PHONE")
VEHICLE_TYPES = ("FIT", "BOOST", "ICONIC", "EFIT", "EFIT G5", "CHLOE")
ENDPOINTS = (
    "versions",
    "vehicle_types",
    "station_information",
    "station_status",
    "system_regions",
    "system_information",
    "system_pricing_plans",
)

STATION_INFORMATION = _struct(
    ("id", INT),
    ("station_id", INT),
    ("name", TEXT),
    ("physical_configuration", TEXT),
    ("lat", DOUBLE),
    ("lon", DOUBLE),
    ("altitude", DOUBLE),
    ("address", TEXT),
    ("capacity", INT),
    ("is_charging_station", FLAG),
    ("rental_methods", TEXTS),
    ("is_valet_station", FLAG),
    ("is_virtual_station", FLAG),
    ("groups", TEXTS),
    ("obcn", TEXT),
    ("nearby_distance", DOUBLE),
    ("bluetooth_id", TEXT),
    ("ride_code_support", FLAG),
    ("rental_uris", TEXTS),
    ("active", FLAG),
    ("reported", TIME),
)

# Columns that make a new version of a station when they differ.
INFORMATION_COMPARED = tuple(
    f.name for f in STATION_INFORMATION if f.name not in ("id", "station_id", "active", "reported")
)

STATION_STATUS = _struct(
    ("info_station_id", INT),
    ("info_reported", TIME),
    ("station_id", INT),
    ("last_reported", TIME),
    ("num_bikes_available", INT),
    ("num_bikes_disabled", INT),
    ("num_docks_available", INT),
    ("num_docks_disabled", INT),
    ("is_charging_station", FLAG),
    ("status", TEXT),
    ("is_installed", FLAG),
    ("is_renting", FLAG),
    ("is_returning", FLAG),
    ("traffic", TEXT),
    ("vehicle_docks_available", INT),
    ("vehicle_types_available_boost", INT),
    ("vehicle_types_available_iconic", INT),
    ("vehicle_types_available_efit", INT),
    ("vehicle_types_available_efit_g5", INT),
)
# Status as stored: partitioned by the day of last_reported.
DATE_COLUMN = "reported_date"
STORED_STATUS = T.StructType([*STATION_STATUS.fields, T.StructField(DATE_COLUMN, T.DateType(), True)])
STATUS_KEY = ("info_station_id", "info_reported", "last_reported")
# Status columns that come from the feed; the two info columns are attached when rows are stored.
STATUS_FEED_COLUMNS = tuple(f.name for f in STATION_STATUS if f.name not in ("info_station_id", "info_reported"))

SYSTEM_INFORMATION = _struct(
    ("reported", TIME),
    ("build_hash", TEXT),
    ("build_label", TEXT),
    ("build_number", TEXT),
    ("build_version", TEXT),
    ("language", TEXT),
    ("mobile_head_version", INT),
    ("mobile_minimum_supported_version", INT),
    ("name", TEXT),
    ("system_id", TEXT),
    ("timezone", TEXT),
)
SYSTEM_INFORMATION_COUNT = _struct(
    ("reported", TIME), ("station_count", INT), ("mechanical_count", INT), ("ebike_count", INT)
)
QUERY_LOG = _struct(
    ("id", LONG), ("time", TIME), ("endpoint", TEXT), ("success", FLAG), ("error_msg", TEXT), ("error_json", TEXT)
)
OCCUPANCY_KEY = ("station_id", "reported", "range_start", "range_end", "empty_thresh", "full_thresh")

# Items of the feed documents, one struct per element of `data.<key>`.
_COUNTED = _struct(("vehicle_type_id", TEXT), ("count", INT))
FEED_STATION_INFORMATION = _struct(
    ("station_id", TEXT),
    ("name", TEXT),
    ("physical_configuration", TEXT),
    ("lat", DOUBLE),
    ("lon", DOUBLE),
    ("altitude", DOUBLE),
    ("address", TEXT),
    ("capacity", INT),
    ("is_charging_station", FLAG),
    ("rental_methods", TEXTS),
    ("is_valet_station", FLAG),
    ("is_virtual_station", FLAG),
    ("groups", TEXTS),
    ("obcn", TEXT),
    ("nearby_distance", DOUBLE),
    ("_bluetooth_id", TEXT),
    ("_ride_code_support", FLAG),
    ("rental_uris", _struct(("android", TEXT), ("ios", TEXT), ("web", TEXT))),
)
FEED_STATION_STATUS = _struct(
    ("station_id", TEXT),
    ("num_bikes_available", INT),
    ("num_bikes_disabled", INT),
    ("num_docks_available", INT),
    ("num_docks_disabled", INT),
    ("last_reported", LONG),
    ("is_charging_station", FLAG),
    ("status", TEXT),
    ("is_installed", FLAG),
    ("is_renting", FLAG),
    ("is_returning", FLAG),
    ("traffic", TEXT),
    ("vehicle_docks_available", T.ArrayType(_struct(("vehicle_type_ids", TEXTS), ("count", INT)))),
    ("vehicle_types_available", T.ArrayType(_COUNTED)),
)
FEED_SYSTEM_INFORMATION = _struct(
    ("_station_count", INT),
    ("_vehicle_count", _struct(("_mechanical_count", INT), ("_ebike_count", INT))),
    ("build_hash", TEXT),
    ("build_label", TEXT),
    ("build_number", TEXT),
    ("build_version", TEXT),
    ("language", TEXT),
    ("mobile_head_version", TEXT),
    ("mobile_minimum_supported_version", TEXT),
    ("name", TEXT),
    ("system_id", TEXT),
    ("timezone", TEXT),
)
FEED_VEHICLE_TYPE = _struct(
    ("vehicle_type_id", TEXT),
    ("form_factor", TEXT),
    ("propulsion_type", TEXT),
    ("max_range_meters", DOUBLE),
    ("name", TEXT),
    ("default_pricing_plan_id", TEXT),
)
FEED_REGION = _struct(("region_id", TEXT), ("region_name", TEXT))
FEED_PRICING_PLAN = _struct(
    ("plan_id", TEXT),
    ("name", TEXT),
    ("currency", TEXT),
    ("price", DOUBLE),
    ("description", TEXT),
    ("is_taxable", FLAG),
)
FEED_VERSION = _struct(("version", TEXT), ("url", TEXT))


def envelope(key: str | None, item: T.StructType) -> T.StructType:
    """Feed document: a header around `data.<key>[]`, or around `data` itself when there is no list."""
    data = item if key is None else _struct((key, T.ArrayType(item)))
    return _struct(("last_updated", LONG), ("ttl", INT), ("version", TEXT), ("data", data))
