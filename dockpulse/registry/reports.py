"""Composite reports and export layouts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockpulse.adapter import Tables
from dockpulse.functions.neighbours import STATION
from dockpulse.operators import events, occupancy, stations, system
from dockpulse.plans import reports
from dockpulse.registry.base import END, START, ZONE, query
from dockpulse.registry.ingest import _folder
from dockpulse.registry.operators import (
    CHARGING_SQL,
    DOCKING_SQL,
    FACTOR_SQL,
    GRID_SQL,
    HISTORY_SQL,
    INTEGRAL_SQL,
    LATEST_QUERY_SQL,
    MISMATCH_SQL,
    TOTALS_SQL,
    WHOLE,
    docking,
    factors,
    integrals,
    occupancy_sql,
)
from dockpulse.sources import layouts

# The end of the data, so that the 24 hours before it hold rows of many stations.
LIST_END = datetime(2024, 1, 31)
_LATEST = """(select * from ss where last_reported between timestamp '2024-01-30' and timestamp '2024-01-31'
  qualify rank() over (partition by info_station_id order by last_reported desc) = 1)"""
_WITH_VERSION = f"""{_LATEST} l join si on si.station_id = l.info_station_id and si.reported = l.info_reported"""


def _labelled(columns: dict[str, str], prefix: str = "") -> str:
    return ", ".join(f'{prefix}{c} "{label}"' for c, label in columns.items())


@query(
    "r1_station_series",
    f"""select info_station_id "Station ID", last_reported "Last Reported", is_charging_station "Charging",
          {_labelled(reports.CHART)} from ss where info_station_id = 9
          and last_reported between timestamp '2024-01-01' and timestamp '2024-02-01'""",
)
def station_series(t):
    return reports.station_series(t.status(), 9, START, END)


# 31 days in 20 steps: 2232 minutes
@query(
    "r2_system_series",
    f"""select cast(null as int) "Station ID", "time" "Last Reported", true "Charging", {_labelled(reports.CHART)}
        from ({GRID_SQL.format(start="2024-01-01", last="2024-02-01", step=2232)}) g""",
)
def system_series(t):
    return reports.system_series(t.status(), START, END)


@query(
    "r3_performance",
    f"""select f.*, o.empty_sec, o.full_sec from ({FACTOR_SQL}) f
        left join ({occupancy_sql("2024-01-01", "2024-02-01")}) o on o.station_id = f.station_id""",
)
def performance(t):
    return reports.performance(t.status(), t.information(), START, END)


@query(
    "r4_occupancy_list",
    f"""select l.info_station_id, si."name", l.last_reported, l.num_bikes_available, o.empty_sec, o.full_sec
        from {_WITH_VERSION} join ({occupancy_sql("2024-01-01", "2024-01-31")}) o on o.station_id = l.info_station_id""",
)
def occupancy_list(t):
    rows = reports.occupancy_list(t.status(), t.information(), START, LIST_END)
    return rows.select(
        STATION, F.col("version_name").alias("name"), "last_reported", "num_bikes_available", "empty_sec", "full_sec"
    )


@query(
    "j11_latest_with_occupancy",
    f"""select l.info_station_id, l.last_reported, o.full_sec
        from {_LATEST} l join ({occupancy_sql("2024-01-30", "2024-01-31")}) o on o.station_id = l.info_station_id""",
)
def latest_with_occupancy(t):
    start = datetime(2024, 1, 30)
    latest = stations.latest_between(t.status(), start, LIST_END)
    times = occupancy.occupancy(t.status(), t.information(), start, LIST_END)
    return stations.join_occupancy(latest, times).select(STATION, "last_reported", "full_sec")


@query("r5_station_list", f'select l.info_station_id, si."name", si.capacity, l.last_reported, l.status from {_WITH_VERSION}')
def station_list(t):
    rows = reports.station_list(t.status(), t.information(), LIST_END)
    return rows.select(
        STATION,
        F.col("version_name").alias("name"),
        F.col("version_capacity").alias("capacity"),
        "last_reported",
        "status",
    )


@query("r6_docking_report", f"select * from ({DOCKING_SQL}) d where station_id is not null")
def docking_report(t):
    return docking(t)


@query(
    "r7_charging_report",
    f"""select * from (select station_id, efit_charged "E-Fit", efit_g5_charged "E-Fit G5" from ({CHARGING_SQL}) c) x
        unpivot ("count" for bike_type in ("E-Fit", "E-Fit G5"))""",
)
def charging_report(t):
    return reports.charging_report(t.status(), t.information(), WHOLE)


@query(
    "r8_trips_header",
    "select "
    + ", ".join(
        f"{b}_{k} {b}_{n}" for k, n in (("undockings", "started"), ("dockings", "ended")) for b in ("all", *events.BIKES)
    )
    + f" from ({TOTALS_SQL} from ({DOCKING_SQL}) d) x",
)
def trips_header(t):
    return reports.trips_header(t.status(), t.information(), WHOLE)


# Toronto is five hours behind UTC in January.
@query("r9_latest_updates", f"""select endpoint, "time" - interval 5 hour updated from ({LATEST_QUERY_SQL}) x""")
def latest_updates(t):
    return reports.latest_updates(t.query_log(), ZONE)


_LEGS = ("total", "successful", "failed")


@query(
    "r10_query_history",
    "select endpoint, "
    + ", ".join(
        f"{n}_count, cast(round_even({n}_avg_interval, 0) as bigint) {n}_avg_interval, {n}_latest - interval 5 hour {n}_latest"
        for n in _LEGS
    )
    + f" from ({HISTORY_SQL}) x",
)
def query_history(t):
    return reports.query_history_report(t.query_log(), ZONE)


@query(
    "r11_system_information_history",
    """select min(reported) "Reported", station_count "Station Count", mechanical_count "Mechanical Count",
         ebike_count "E-Bike Count" from sc group by 2, 3, 4""",
)
def system_information_history(t):
    return system.system_count_history(t.system_counts()).select(
        F.col("reported").alias("Reported"),
        F.col("station_count").alias("Station Count"),
        F.col("mechanical_count").alias("Mechanical Count"),
        F.col("ebike_count").alias("E-Bike Count"),
    )


_LOOKUP = """select n.station_id, n."name", l.last_reported, l.num_bikes_available, l.num_docks_available
  from (select distinct station_id, "name" from si where {0}) n
  join (select * from ss qualify row_number() over (partition by info_station_id order by last_reported desc) = 1) l
    on l.info_station_id = n.station_id"""
_LOOKUP_COLUMNS = ("station_id", "name", "last_reported", "num_bikes_available", "num_docks_available")


@query("r12_lookup_by_name", _LOOKUP.format("""\"name" like '%1'"""))
def lookup_by_name(t):
    return reports.station_lookup_report(t.status(), t.information(), "suffix", "1").select(*_LOOKUP_COLUMNS)


@query("r12_lookup_by_id", _LOOKUP.format("station_id = 9"))
def lookup_by_id(t):
    status = t.status()
    lookup = stations.station_lookup(status)
    return reports.station_lookup_by_id(status, t.information(), lookup, 9).select(*_LOOKUP_COLUMNS)


@query("r13_station_name", 'select distinct station_id, "name" from si where station_id = 9')
def station_name(t):
    status = t.status()
    return reports.station_name(status, t.information(), stations.station_lookup(status), 9)


@query(
    "r14_quality_report",
    f"""select 'orphaned status' "check", count(*) "found" from orphaned o where not exists
          (select 1 from si where si.station_id = o.info_station_id and si.reported = o.info_reported)
        union all select 'capacity mismatch', count(*) from ({MISMATCH_SQL.replace("from ss join", "from (select * from orphaned) ss join")}) m
        union all select 'duplicate version', count(*) from
          (select station_id, reported from si group by 1, 2 having count(*) > 1) d""",
)
def quality_report(t):
    return reports.quality_report(t.orphaned_status(), t.information())


# Export layouts. Each is written to files and read back.


def _csv_file(t: Tables, rows: DataFrame, header: dict[str, str]) -> DataFrame:
    path = _folder(t, "csv")
    layouts.write_csv(rows, header, path)
    return layouts.read_csv(t.spark, path, layouts.as_csv(rows, header).schema)


def _json_file(t: Tables, payload: DataFrame, **keys: tuple[str, str]) -> DataFrame:
    """The written payloads, with key columns taken from the JSON itself: name -> type and path."""
    path = _folder(t, "json")
    layouts.write_json(payload, path)
    lines = t.spark.read.text(path)
    columns = [
        F.get_json_object("value", where).cast(kind).alias(name) for name, (kind, where) in keys.items()
    ]
    return lines.select(*columns, F.col("value").alias("json"))


@query(
    "snk2_performance_csv",
    f"""select {_labelled({k: v for k, v in layouts.PERFORMANCE_CSV.items() if k != "charging"})},
          case when charging then 'TRUE' else 'FALSE' end "Charging" from ({FACTOR_SQL}) f""",
)
def performance_csv(t):
    rows = reports.performance(t.status(), t.information(), START, END)
    return _csv_file(t, rows, layouts.PERFORMANCE_CSV)


@query(
    "snk3_integral_csv",
    f"""select {_labelled({k: v for k, v in layouts.INTEGRAL_CSV.items() if k != "charging"})},
          case when charging then 'TRUE' else 'FALSE' end "Charging" from ({INTEGRAL_SQL}) f""",
)
def integral_csv(t):
    return _csv_file(t, integrals(t), layouts.INTEGRAL_CSV)


@query(
    "snk3_factor_csv",
    f"""select {_labelled({k: v for k, v in layouts.FACTOR_CSV.items() if k != "charging"})},
          case when charging then 'TRUE' else 'FALSE' end "Charging" from ({FACTOR_SQL}) f""",
)
def factor_csv(t):
    return _csv_file(t, factors(t), layouts.FACTOR_CSV)


def _counts_sql(kind: str) -> str:
    return f"""json_object('iconic', abs(iconic_{kind}), 'efit', abs(efit_{kind}), 'efit-g5', abs(efit_g5_{kind}))"""


@query(
    "snk4_docking_json",
    f"""select station_id, json_object('station-id', station_id, 'dockings', {_counts_sql("dockings")},
          'undockings', {_counts_sql("undockings")})::varchar "json" from ({DOCKING_SQL}) d""",
)
def docking_json(t):
    return _json_file(t, layouts.docking_json(docking(t)), station_id=("int", "$.station-id"))


@query(
    "snk4_charging_json",
    f"""select station_id, bike_type, json_object('bike-type', bike_type, 'count', "count")::varchar "json" from
        (select * from (select station_id, efit_charged "E-Fit", efit_g5_charged "E-Fit G5" from ({CHARGING_SQL}) c) x
         unpivot ("count" for bike_type in ("E-Fit", "E-Fit G5"))) u""",
)
def charging_json(t):
    """A payload does not name its station: that stands beside it in its line."""
    path = _folder(t, "json")
    layouts.write_json(layouts.charging_json(reports.charging_report(t.status(), t.information(), WHOLE)), path, by=("station_id",))
    return layouts.read_json(t.spark, path, station_id="int").select("station_id", F.get_json_object("json", "$.bike-type").alias("bike_type"), "json")


@query(
    "snk4_integral_json",
    f"""select station_id, json_object({", ".join(f"'{c}', {c}" for c in layouts.INTEGRAL_CSV)})::varchar "json"
        from ({INTEGRAL_SQL}) i""",
)
def integral_json(t):
    return _json_file(t, layouts.integral_json(integrals(t)), station_id=("int", "$.station_id"))


@query("snk4_factor_json", f"select * exclude ({', '.join(k for k in layouts.INTEGRAL_CSV if k.endswith('_seconds') and k != 'total_seconds')}) from ({FACTOR_SQL}) f")
def factor_json(t):
    """The payload, read back from its file into columns: engines spell doubles differently."""
    path, rows = _folder(t, "json"), factors(t)
    layouts.write_json(layouts.factor_json(rows), path)
    payload, kinds = layouts.read_json(t.spark, path), dict(rows.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in layouts.FACTOR_CSV)
    return payload.select(F.from_json("json", schema).alias("p")).select("p.*")


_PAYLOAD_STATION, _PAYLOAD_STATUS = ["station_id", "name", "capacity"], ["num_bikes_available", "status"]
_STATION_JSON = """'station_information', json_object('station_id', si.station_id, 'name', si."name", 'capacity', si.capacity),
  'station_status', json_object('num_bikes_available', l.num_bikes_available, 'status', l.status)"""


@query(
    "snk4_occupancy_json",
    f"""select l.info_station_id, json_object({_STATION_JSON},
          'durations', json_object('empty', o.empty_sec, 'full', o.full_sec))::varchar "json"
        from {_WITH_VERSION} join ({occupancy_sql("2024-01-01", "2024-01-31")}) o on o.station_id = l.info_station_id""",
)
def occupancy_json(t):
    rows = reports.occupancy_list(t.status(), t.information(), START, LIST_END)
    payload = layouts.occupancy_json(rows, _PAYLOAD_STATION, _PAYLOAD_STATUS)
    return _json_file(t, payload, info_station_id=("int", "$.station_information.station_id"))


@query("snk4_station_list_json", f"""select l.info_station_id, json_object({_STATION_JSON})::varchar "json" from {_WITH_VERSION}""")
def station_list_json(t):
    rows = reports.station_list(t.status(), t.information(), LIST_END)
    payload = layouts.station_list_json(rows, _PAYLOAD_STATION, _PAYLOAD_STATUS)
    return _json_file(t, payload, info_station_id=("int", "$.station_information.station_id"))


@query(
    "snk4_system_information_json",
    """select reported, json_object('Reported', strftime(reported, '%Y-%m-%d %H:%M:%S'), 'Station Count', station_count,
         'Mechanical Count', mechanical_count, 'E-Bike Count', ebike_count)::varchar "json" from sc""",
)
def system_information_json(t):
    payload = layouts.system_information_json(t.system_counts())
    return _json_file(t, payload, reported=("timestamp_ntz", "$.Reported"))


def _leg_json(name: str) -> str:
    return f"""'{name}', json_object('num-queries', {name}_count, 'avg-interval', cast(round_even({name}_avg_interval, 0) as bigint),
      'latest-query', strftime({name}_latest - interval 5 hour, '%Y-%m-%d %H:%M:%S'))"""


@query(
    "snk4_query_history_json",
    f"""select endpoint, json_object('endpoint', endpoint, {", ".join(_leg_json(n) for n in _LEGS)})::varchar "json" from ({HISTORY_SQL}) h""",
)
def query_history_json(t: Tables):
    payload = layouts.query_history_json(reports.query_history_report(t.query_log(), ZONE))
    return _json_file(t, payload, endpoint=("string", "$.endpoint"))


