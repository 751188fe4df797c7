"""Filters, joins, aggregates, windows and orderings."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockpulse import schemas
from dockpulse.adapter import Tables
from dockpulse.functions import labels
from dockpulse.functions.neighbours import STATION, with_neighbours
from dockpulse.ingest import status as status_ingest
from dockpulse.operators import availability, events, feed, occupancy, quality, stations, system
from dockpulse.params import StatusQuery, for_station, recent_days
from dockpulse.registry.base import END, NOW, START, query

INFO = (
    "id",
    "station_id",
    "name",
    "physical_configuration",
    "lat",
    "lon",
    "address",
    "capacity",
    "is_charging_station",
    "active",
    "reported",
)
FROM, TO = datetime(2024, 1, 10), datetime(2024, 1, 20, 12)
WHOLE = StatusQuery(None, START, END)
IN_RANGE = "last_reported between timestamp '2024-01-10' and timestamp '2024-01-20 12:00:00'"


def info(t: Tables) -> DataFrame:
    return t.information().select(*INFO)


# Scan


@query(
    "src7_table_scan",
    "select 'station_status' t, info_station_id a, last_reported b from ss"
    " union all select 'station_information', station_id, reported from si",
)
def scan(t):
    status = t.status().select(F.lit("station_status").alias("t"), F.col(STATION).alias("a"), F.col("last_reported").alias("b"))
    return status.unionAll(t.information().select(F.lit("station_information"), "station_id", "reported"))


# Filters and projections


@query("f1_status_filter", f"select * from ss where {IN_RANGE}")
def status_filter(t):
    return StatusQuery(None, FROM, TO).on_status(t.status())


@query("f2_information_filter", "select * from si where reported >= timestamp '2024-01-10' and reported <= timestamp '2024-01-20 12:00:00'")
def information_filter(t):
    return StatusQuery(None, FROM, TO).on_information(info(t))


@query("f3_information_until", "select * from si where reported <= timestamp '2024-01-10'")
def information_until(t):
    return StatusQuery(None, START, FROM).on_information_until(info(t))


@query("f4_station_predicate", "select 'status' kind, count(*) n from ss where station_id = 9 union all select 'information', count(*) from si where station_id = 9 union all select 'all', count(*) from ss")
def station_predicate(t):
    def counted(kind: str, rows: DataFrame) -> DataFrame:
        return rows.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")

    return (
        counted("status", for_station(t.status(), 9))
        .unionAll(counted("information", for_station(t.information(), 9, "station_id")))
        .unionAll(counted("all", for_station(t.status(), None)))
    )


@query("f5_system_status_between", f"select ss.* from ss join si on si.station_id = ss.info_station_id where {IN_RANGE}")
def system_status_between(t):
    return stations.system_status_between(t.status(), t.information(), FROM, TO)


@query("f6_station_status_between", f"select * from ss where info_station_id = 9 and {IN_RANGE}")
def station_status_between(t):
    return stations.status_between(t.status(), 9, FROM, TO)


@query(
    "f7_station_status_with_version",
    f"""select ss.info_station_id, ss.last_reported, ss.num_bikes_available, si.id "version", si.capacity
        from ss join si on si.station_id = ss.info_station_id and si.reported = ss.info_reported
        where ss.info_station_id = 9 and {IN_RANGE}""",
)
def station_status_with_version(t):
    rows = stations.status_information_between(t.status(), t.information(), 9, FROM, TO)
    return rows.select(
        STATION,
        "last_reported",
        "num_bikes_available",
        F.col("version_id").alias("version"),
        F.col("version_capacity").alias("capacity"),
    )


@query("f8_disabled_docks", 'select "name", num_docks_disabled from ss join si on si.station_id = ss.info_station_id where num_docks_disabled > 0')
def disabled_docks(t):
    return stations.disabled_docks(t.status(), t.information())


@query("f9_status_with_station", 'select ss.info_station_id, ss.last_reported, ss.status, si.id version, si."name" from ss join si on si.station_id = ss.info_station_id')
def status_with_station(t):
    rows = stations.status_sample(t.status(), t.information())
    return rows.select(STATION, "last_reported", "status", F.col("version_id").alias("version"), F.col("version_name").alias("name"))


@query("f10_status_fields", 'select "name", num_bikes_available, num_bikes_disabled, num_docks_available, num_docks_disabled from ss join si on si.station_id = ss.info_station_id')
def status_fields(t):
    return stations.status_fields(t.status(), t.information())


@query("f11_information_by_ids", "select * from si where station_id in (3, 8, 9, 21)")
def information_by_ids(t):
    return stations.information_by_ids(info(t), [3, 8, 9, 21])


@query("f11_information_in_table", "select * from si where station_id in (select station_id from ss where status = 'MAINTENANCE')")
def information_in_table(t):
    return stations.information_in(info(t), t.status().where("status = 'MAINTENANCE'")).select(*INFO)


@query("f12_station_by_name", """select distinct station_id, "name" from si where "name" = 'Customer#000000021'""")
def station_by_name(t):
    return stations.station_by_name(t.information(), "Customer#000000021")


@query("f13_stations_like", """select distinct station_id, "name" from si where "name" like '%01_'""")
def stations_like(t):
    return stations.stations_like(t.information(), "%01_")


@query(
    "f14_match_modes",
    """select 'exact' mode, station_id from si where "name" like 'Customer#000000021' group by 2
       union all select 'prefix', station_id from si where "name" like 'Customer#00000004%' group by 2
       union all select 'suffix', station_id from si where "name" like '%7' group by 2
       union all select 'wildcard', station_id from si where "name" like '%00003%' group by 2""",
)
def match_modes(t):
    texts = {"exact": "Customer#000000021", "prefix": "Customer#00000004", "suffix": "7", "wildcard": "00003"}
    parts = [
        stations.stations_like(t.information(), stations.like_pattern(mode, text)).select(F.lit(mode).alias("mode"), "station_id")
        for mode, text in texts.items()
    ]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3])


@query("f15_query_errors", """select * from ql where not success order by "time" desc, id desc limit 100""")
def query_errors(t):
    return feed.query_errors(t.query_log(), 100)


@query(
    "f15_recent_errors_with_body",
    """select * from (select * from ql where not success and "time" >= timestamp '2024-01-26'
         order by "time" desc, id desc limit 100) x where error_json is not null""",
)
def recent_errors_with_body(t):
    return feed.query_errors(t.query_log(), 100, 5, NOW, with_json=True)


@query(
    "f15_error_field",
    "select id, json_extract_string(error_json, '$.k') k from ql where not success and error_json is not null",
)
def error_field(t):
    errors = t.query_log().where("not success and error_json is not null")
    return feed.error_field(errors, "$.k", "k").select("id", "k")


@query("f16_station_list_filter", """select id from si where is_charging_station and (contains(lower("name"), '1') or contains(lower(address), 'build') or contains(station_id::varchar, 'build')) and (contains(lower(address), 'build'))""")
def station_list_filter(t):
    return stations.station_list_filter(t.information(), "charging", "BUILD").select("id")


@query("f17_recent_days", "select * from ss where last_reported >= timestamp '2024-01-28'")
def recent(t):
    return recent_days(t.status(), "last_reported", 3, NOW)


# Joins


@query("j1_status_by_station", "select ss.info_station_id, ss.last_reported, si.reported from ss join si on si.station_id = ss.info_station_id")
def status_by_station(t):
    return stations.status_with_station(t.status(), t.information()).select(STATION, "last_reported", F.col("version_reported").alias("reported"))


@query("j2_status_by_version", "select ss.info_station_id, ss.last_reported, si.capacity from ss join si on si.station_id = ss.info_station_id and si.reported = ss.info_reported")
def status_by_version(t):
    return stations.status_with_version(t.status(), t.information()).select(STATION, "last_reported", F.col("version_capacity").alias("capacity"))


@query(
    "j3_latest_by_lookup",
    """select ss.info_station_id, ss.last_reported, ss.num_bikes_available, si.id version, si."name"
       from lk join ss on ss.info_station_id = lk.info_station_id and ss.info_reported = lk.info_reported
         and ss.last_reported = lk.status_last_reported
       join si on si.station_id = ss.info_station_id and si.reported = ss.info_reported""",
)
def latest_by_lookup(t):
    status = t.status()
    rows = stations.latest_with_information(status, t.information(), stations.station_lookup(status))
    return rows.select(STATION, "last_reported", "num_bikes_available", F.col("version_id").alias("version"), F.col("version_name").alias("name"))


@query(
    "j4_latest_status_between",
    f"select * from ss where {IN_RANGE} qualify rank() over (partition by info_station_id order by last_reported desc) = 1",
)
def latest_status_between(t):
    return stations.latest_between(t.status(), FROM, TO)


GRID_SQL = """
  select "time", cast(sum(num_bikes_available) as bigint) num_bikes_available,
         cast(sum(num_bikes_disabled) as bigint) num_bikes_disabled,
         cast(sum(num_docks_available) as bigint) num_docks_available,
         cast(sum(num_docks_disabled) as bigint) num_docks_disabled,
         cast(sum(vehicle_types_available_iconic) as bigint) vehicle_types_available_iconic,
         cast(sum(vehicle_types_available_efit) as bigint) vehicle_types_available_efit,
         cast(sum(vehicle_types_available_efit_g5) as bigint) vehicle_types_available_efit_g5
  from (select g."time", ss.*, row_number() over (partition by g."time", info_station_id order by last_reported desc) rn
        from (select unnest(generate_series(timestamp '{start}', timestamp '{last}', interval {step} minute)) "time") g
        join ss on ss.last_reported >= g."time" - interval {step} minute and ss.last_reported < g."time") x
  where rn = 1 group by 1"""


@query("j5_status_on_grid", GRID_SQL.format(start="2024-01-01", last="2024-02-01", step=360))
def status_on_grid(t):
    return system.system_status(t.status(), START, END, 360)


@query("j7_stations_reporting", f"select * exclude rn from (select si.*, row_number() over (partition by station_id order by reported desc) rn from si where reported <= timestamp '2024-01-20 12:00:00') x where rn = 1 and station_id in (select info_station_id from ss where {IN_RANGE})")
def stations_reporting(t):
    return occupancy.stations_reporting(t.status(), info(t), FROM, TO).select(*INFO)


ORPHAN_SQL = """from orphaned o where not exists
  (select 1 from si where si.station_id = o.info_station_id and si.reported = o.info_reported)
  and last_reported >= timestamp '2024-01-10'"""


@query("j8_orphaned_status", f"select o.* {ORPHAN_SQL}")
def orphaned_status(t):
    return quality.orphaned_status(t.orphaned_status(), t.information(), FROM)


@query("j8_orphan_counts", f"select station_id, count(*) num {ORPHAN_SQL} group by 1")
def orphan_counts(t):
    return quality.orphan_counts(t.orphaned_status(), t.information(), FROM)


@query("j8_orphan_keys", f"select station_id, last_reported, info_reported {ORPHAN_SQL}")
def orphan_keys(t):
    return quality.orphan_keys(t.orphaned_status(), t.information(), FROM)


@query(
    "j9_as_of_version",
    """select info_station_id, last_reported,
         (select max(reported) from si where si.station_id = ss.info_station_id and si.reported <= ss.last_reported) version
       from ss""",
)
def as_of_version(t):
    return status_ingest.as_of_version(t.status(), t.information()).select(STATION, "last_reported", "version")


@query("j10_rows_with_total", "select info_station_id, count(*) n, (select count(*) from ss) examined from ss group by 1")
def rows_with_total(t):
    return quality.rows_with_total(t.status())


@query(
    "j12_attach_active_version",
    """select si.station_id info_station_id, si.reported info_reported, ss.last_reported, ss.num_bikes_available
       from ss join si on si.station_id = ss.station_id and si.active""",
)
def attach_active_version(t):
    rows = stations.attach_active_version(t.status().drop(STATION, "info_reported"), t.information())
    return rows.select(STATION, "info_reported", "last_reported", "num_bikes_available")


@query(
    "j14_version_keys_by_id",
    """select s.info_id, s.last_reported, si.station_id info_station_id, si.reported info_reported
       from (select ss.station_id * 2 + 1 info_id, last_reported from ss) s join si on si.id = s.info_id""",
)
def version_keys_by_id(t):
    rows = t.status().select((F.col("station_id") * 2 + 1).alias("info_id"), "last_reported")
    return stations.version_keys_by_id(rows, t.information())


# Aggregates

LAGGED = """(select *, vehicle_types_available_iconic - lag(vehicle_types_available_iconic) over w d_iconic,
    vehicle_types_available_efit - lag(vehicle_types_available_efit) over w d_efit,
    vehicle_types_available_efit_g5 - lag(vehicle_types_available_efit_g5) over w d_efit_g5,
    num_bikes_disabled - lag(num_bikes_disabled) over w d_disabled
  from ss window w as (partition by info_station_id order by last_reported))"""


def _sum(value: str, when: str) -> str:
    return f"cast(coalesce(sum({value}) filter ({when}), 0) as bigint)"


DOCKING_SQL = f"""
  select l.info_station_id station_id, any_value(n."name") "name", any_value(n.capacity) capacity,
    any_value(n.is_charging_station) is_charging_station,
    cast(0 as bigint) boost_undockings, cast(0 as bigint) boost_dockings,
    {", ".join(f"{_sum(f'd_{b}', f'd_{b} < 0')} {b}_undockings, {_sum(f'd_{b}', f'd_{b} > 0')} {b}_dockings" for b in events.BIKES)}
  from {LAGGED} l
  join (select * from si where reported <= timestamp '2024-02-01'
        qualify rank() over (partition by station_id order by id desc) = 1) n on n.station_id = l.info_station_id
  group by 1"""

CHARGING_SQL = f"""
  select l.info_station_id station_id, any_value(n."name") "name", any_value(n.capacity) capacity,
    {_sum("d_disabled", "d_disabled < 0 and (d_efit > 0 or d_efit_g5 > 0)")} bikes_disabled,
    {_sum("d_efit", "d_disabled < 0 and d_efit > 0")} efit_charged,
    {_sum("d_efit_g5", "d_disabled < 0 and d_efit_g5 > 0")} efit_g5_charged
  from {LAGGED} l join si n on n.station_id = l.info_station_id and n.active and n.is_charging_station
  group by 1"""


def docking(t: Tables) -> DataFrame:
    return events.docking_events(t.status(), t.information(), WHOLE)


def charging(t: Tables) -> DataFrame:
    return events.charging_events(t.status(), t.information(), WHOLE)


query("a1_docking_events", DOCKING_SQL)(docking)
query("a2_charging_events", CHARGING_SQL)(charging)

INTEGRAL_SQL = f"""
  select l.info_station_id station_id, any_value(n.is_charging_station) charging, any_value(n.capacity) capacity,
    cast(coalesce(sum(dt), 0) as bigint) total_seconds,
    {", ".join(f"cast(coalesce(sum({c} * dt), 0) as bigint) {k}_seconds" for k, c in availability.COUNTERS.items())}
  from (select *, date_diff('second', lag(last_reported) over (partition by info_station_id order by last_reported),
                            last_reported) dt from ss) l
  join si n on n.station_id = l.info_station_id and n.active
  group by 1"""


def _factor_sql(name: str) -> str:
    return f"""case when total_seconds = 0 or capacity = 0 then case when {name}_seconds = 0 then 0.0::double else 1.0::double end
      else {name}_seconds::double / total_seconds::double / capacity::double end {name}_factor"""


_BIKE_SUM = "(iconic_available_factor + efit_available_factor + efit_g5_available_factor)"
FACTOR_SQL = f"""
  select *, {", ".join(f"case when {_BIKE_SUM} <> 0 then {b}_factor / {_BIKE_SUM} end {b}_factor_normalized" for b in availability.BIKE_FACTORS)}
  from (select *, {", ".join(_factor_sql(c) for c in availability.COUNTERS)} from ({INTEGRAL_SQL}) i) f"""
_SECONDS = ", ".join(f"{c}_seconds" for c in availability.COUNTERS)


def integrals(t: Tables) -> DataFrame:
    return availability.integrals(t.status(), t.information(), WHOLE)


query("a3_integrals", INTEGRAL_SQL)(integrals)


@query("a4_factors", f"select * exclude ({_SECONDS}) from ({FACTOR_SQL}) x")
def factors(t):
    return availability.factors(integrals(t))


@query(
    "a5_factor_sums",
    f"""select station_id, bikes_available_factor + bikes_disabled_factor + docks_available_factor + docks_disabled_factor
          station_factors, iconic_available_factor_normalized + efit_available_factor_normalized
          + efit_g5_available_factor_normalized bike_factors
        from ({FACTOR_SQL}) x""",
)
def factor_sums(t):
    return availability.factor_sums(factors(t))


def occupancy_rows_sql(start: str, end: str, empty: int = 0, full: int = 0) -> str:
    return f"""
      select * from (
        select info_station_id, last_reported, num_bikes_available, num_docks_available,
          lead(last_reported, 1, timestamp '{end}') over w next_reported,
          lag(last_reported, 1, timestamp '{start}') over w prev_reported,
          lag(num_bikes_available, 1, 0) over w prev_bikes, lag(num_docks_available, 1, 0) over w prev_docks
        from ss
        where last_reported between timestamp '{start}' - interval 12 hour and timestamp '{end}' + interval 1 hour
        window w as (partition by info_station_id order by last_reported)) o
      where ((last_reported < timestamp '{end}' and next_reported >= timestamp '{start}')
             or (prev_reported < timestamp '{start}' and last_reported >= timestamp '{start}'))
        and (num_bikes_available <= {empty} or prev_bikes <= {empty}
             or num_docks_available <= {full} or prev_docks <= {full})"""


def occupancy_sql(start: str, end: str, empty: int = 0, full: int = 0) -> str:
    a, b = f"greatest(last_reported, timestamp '{start}')", f"least(next_reported, timestamp '{end}')"

    def held(column: str, threshold: int) -> str:
        case = f"case when {column} = {threshold} then date_diff('second', {a}, {b}) else 0 end"
        return f"cast(coalesce(sum({case}) filter ({a} < {b}), 0) as bigint)"

    return f"""
      select n.station_id, n."name", n.capacity, n.reported, o.empty_sec, o.full_sec
      from (select * from si where reported <= timestamp '{end}'
            qualify row_number() over (partition by station_id order by reported desc) = 1) n
      left join (select info_station_id, {held("num_bikes_available", empty)} empty_sec,
                        {held("num_docks_available", full)} full_sec
                 from ({occupancy_rows_sql(start, end, empty, full)}) r group by 1) o on o.info_station_id = n.station_id
      where n.station_id in (select info_station_id from ss
                             where last_reported between timestamp '{start}' and timestamp '{end}')"""


@query("a6_occupancy", occupancy_sql("2024-01-01", "2024-02-01"))
def whole_occupancy(t):
    return occupancy.occupancy(t.status(), t.information(), START, END)


@query("a6_occupancy_thresholds", occupancy_sql("2024-01-10", "2024-01-20 12:00:00", 2, 3))
def threshold_occupancy(t):
    return occupancy.occupancy(t.status(), t.information(), FROM, TO, None, 2, 3)


@query(
    "j6_versions_with_occupancy",
    f"select station_id, empty_sec from ({occupancy_sql('2024-01-10', '2024-01-20 12:00:00')}) x",
)
def versions_with_occupancy(t):
    return occupancy.occupancy(t.status(), t.information(), FROM, TO).select("station_id", "empty_sec")


@query("a7_system_status_grid", GRID_SQL.format(start="2024-01-01", last="2024-02-01", step=60))
def system_status_grid(t):
    return system.system_status(t.status(), START, END, 60)


@query(
    "a8_system_status_now",
    GRID_SQL.format(start="2024-01-30 23:00:00", last="2024-01-31", step=15) + ' order by "time" desc limit 1',
)
def system_status_now(t):
    return system.system_status_now(t.status(), NOW)


def _bikes_sql(rows: str) -> str:
    b, i, e, g = (f"coalesce(sum(vehicle_types_available_{x}), 0)" for x in ("boost", "iconic", "efit", "efit_g5"))
    return f"""cast({b} + {i} + {e} + {g} as bigint) total, cast({b} + {i} as bigint) mechanical,
      cast({e} + {g} as bigint) ebikes, cast({e} as bigint) efit, cast({g} as bigint) efit_g5 from {rows}"""


@query(
    "a9_bikes_at_moment",
    "select "
    + _bikes_sql(
        """(select * from ss where last_reported between timestamp '2024-01-20 11:00:00' and timestamp '2024-01-20 12:00:00'
            qualify row_number() over (partition by info_station_id order by last_reported desc) = 1) x"""
    ),
)
def bikes_at_moment(t):
    return system.bikes_at(t.status(), TO)


@query(
    "a10_bikes_over_days",
    'select "time", '
    + _bikes_sql(
        """(select g."time", ss.* from
              (select unnest(generate_series(timestamp '2024-01-01', timestamp '2024-01-31 22:00:00', interval 2 hour)) "time") g
            left join ss on ss.last_reported between g."time" - interval 1 hour and g."time"
            qualify row_number() over (partition by g."time", info_station_id order by last_reported desc) = 1) x
           group by 1"""
    ),
)
def bikes_over_days(t):
    return system.bikes_over_days(t.status(), date(2024, 1, 1), date(2024, 1, 31))


INFRASTRUCTURE = """select count(*) stations, cast(coalesce(sum(capacity), 0) as bigint) docks from
  (select * from si where reported <= timestamp '2024-01-31' {when}
   qualify rank() over (partition by station_id order by id desc) = 1) x {then}"""


@query("a11_charging_infrastructure", INFRASTRUCTURE.format(when="and is_charging_station", then=""))
def charging_infrastructure(t):
    return system.charging_infrastructure(t.information(), NOW)


@query("a11_charging_infrastructure_current", INFRASTRUCTURE.format(when="", then="where is_charging_station"))
def charging_infrastructure_current(t):
    return system.charging_infrastructure(t.information(), NOW, current_only=True)


def _history_leg(name: str, when: str) -> str:
    return f"""(select endpoint, count(*) {name}_count,
        coalesce(avg(d), 0.0::double) {name}_avg_interval, max("time") {name}_latest
      from (select *, cast(date_diff('second', lag("time", 1, "time") over (partition by endpoint order by "time"), "time") as double) d
            from ql where {when}) x group by 1)"""


HISTORY_SQL = f"""select * from {_history_leg("total", "true")} a join {_history_leg("successful", "success")} b using (endpoint)
  join {_history_leg("failed", "not success")} c using (endpoint)"""


@query("a12_query_history", HISTORY_SQL)
def query_history(t):
    return feed.query_history(t.query_log())


@query("a13_row_counts", """select 'station_status' "table", count(*) "rows" from ss union all select 'station_information', count(*) from si union all select 'queries', count(*) from ql union all select 'system_information_count', count(*) from sc""")
def row_counts(t):
    return quality.row_counts(
        {
            "station_status": t.status(),
            "station_information": t.information(),
            "queries": t.query_log(),
            "system_information_count": t.system_counts(),
        }
    )


_SUM4 = "num_bikes_available + num_bikes_disabled + num_docks_available + num_docks_disabled"
MISMATCH_SQL = f"""
  select ss.info_station_id, ss.last_reported, {_SUM4} counter_sum, si.capacity,
         (select count(*) from ss) examined
  from ss join si on si.station_id = ss.info_station_id and si.reported = ss.info_reported
  where {_SUM4} <> si.capacity"""


def mismatches(t: Tables) -> DataFrame:
    return quality.capacity_mismatches(t.status(), t.information())


@query("a14_capacity_mismatches", MISMATCH_SQL)
def capacity_mismatches(t):
    return mismatches(t).select(
        STATION, "last_reported", "counter_sum", F.col("version_capacity").alias("capacity"), "examined"
    )


@query(
    "a15_mismatch_summary",
    f"""select (select count(*) from ss) examined, count(*) mismatched, min(capacity) min_capacity, max(capacity) max_capacity,
          (select count(*) from ss) - count(*) okay from ({MISMATCH_SQL}) m""",
)
def mismatch_summary(t):
    return quality.mismatch_summary(quality.checked_capacity(t.status(), t.information()))


@query("a15_mismatch_frequencies", f"select counter_sum, count(*) times from ({MISMATCH_SQL}) m group by 1")
def mismatch_frequencies(t):
    return quality.mismatch_frequencies(mismatches(t))


def _total(kind: str, bikes) -> str:
    return f"cast(coalesce(abs(sum({' + '.join(f'{b}_{kind}' for b in bikes)})), 0) as bigint)"


TOTALS_SQL = "select " + ", ".join(
    f"{_total(kind, events.BIKES if bike == 'all' else [bike])} {bike}_{kind}"
    for kind in ("undockings", "dockings")
    for bike in ("all", *events.BIKES)
)


@query("a16_docking_totals", f"{TOTALS_SQL} from ({DOCKING_SQL}) d")
def docking_totals(t):
    return events.docking_totals(docking(t))


@query("a17_charging_totals", f"select cast(sum(bikes_disabled) as bigint) bikes_disabled, cast(sum(efit_charged) as bigint) efit_charged, cast(sum(efit_g5_charged) as bigint) efit_g5_charged from ({CHARGING_SQL}) d")
def charging_totals(t):
    return events.charging_totals(charging(t))


@query(
    "a18_duplicate_versions",
    "select station_id, reported, count(*) copies from (select * from si union all select * from si where is_charging_station) x group by 1, 2 having count(*) > 1",
)
def duplicate_versions(t):
    versions = info(t)
    return quality.duplicate_versions(versions.unionAll(versions.where("is_charging_station")))


@query("a19_latest_times", f"select info_station_id, max(last_reported) last_reported from ss where {IN_RANGE} group by 1")
def latest_times(t):
    return quality.latest_times(t.status(), StatusQuery(None, FROM, TO))


# Windows


@query("w1_previous_values", f"select info_station_id, last_reported, coalesce(d_iconic, 0) d_iconic, coalesce(d_efit, 0) d_efit from {LAGGED} l")
def previous_values(t):
    names = {"d_iconic": "vehicle_types_available_iconic", "d_efit": "vehicle_types_available_efit"}
    rows = with_neighbours(t.status(), list(names.values()))
    deltas = [F.coalesce(F.col(c) - F.col("_prev")[c], F.lit(0)).alias(n) for n, c in names.items()]
    return rows.select(STATION, "last_reported", *deltas)


@query("w2_occupancy_rows", occupancy_rows_sql("2024-01-10", "2024-01-20 12:00:00"))
def occupancy_rows(t):
    return occupancy.occupancy_rows(t.status(), FROM, TO)


_COMPARED = " or ".join(f"{c} <> p_{c}" for c in status_ingest.BATCH_COLUMNS)
_BEFORE = ", ".join(f"lag({c}) over w p_{c}" for c in status_ingest.BATCH_COLUMNS)


@query(
    "w3_newest_row_changed",
    f"""select {", ".join(schemas.STATION_STATUS.names)} from
        (select *, {_BEFORE}, row_number() over (partition by info_station_id order by last_reported desc) rn from ss
         window w as (partition by info_station_id order by last_reported)) x
        where rn = 1 and ({_COMPARED})""",
)
def newest_row_changed(t):
    return status_ingest.changes_of_newest(t.status())


@query("w4_latest_information", "select * from si qualify rank() over (partition by station_id order by id desc) = 1")
def latest_information(t):
    return stations.latest_information(info(t))


@query("w5_latest_information_until", "select * from si where reported <= timestamp '2024-01-10' qualify rank() over (partition by station_id order by id desc) = 1")
def latest_information_until(t):
    return stations.latest_information(info(t), FROM)


@query("w6_one_row_per_time", "select info_station_id, last_reported, max(info_reported) info_reported from (select * from ss union all select * from orphaned) x group by 1, 2")
def one_row_per_time(t):
    both = t.status().unionByName(t.orphaned_status())
    return stations.one_per_time(both).select(STATION, "last_reported", "info_reported")


@query("w7_newest_reported_information", "select * from si where reported <= timestamp '2024-01-20 12:00:00' qualify row_number() over (partition by station_id order by reported desc) = 1")
def newest_reported_information(t):
    return stations.newest_reported_information(info(t), TO)


@query("w8_system_count_history", "select min(reported) reported, station_count, mechanical_count, ebike_count from sc group by 2, 3, 4")
def system_count_history(t):
    return system.system_count_history(t.system_counts())


LATEST_QUERY_SQL = """select * from ql qualify row_number() over (partition by endpoint order by "time" desc, id desc) = 1"""


@query("w9_query_per_endpoint", LATEST_QUERY_SQL)
def query_per_endpoint(t):
    return feed.latest_queries(t.query_log())


_DIFF = ", ".join(
    f"coalesce({c} - lag({c}) over w, {c}) {b}_diff" for b, c in events.BIKES.items()
)
_RUN = ", ".join(
    f"""cast(sum(case when {b}_diff > 0 then {b}_diff else 0 end) over r as bigint) total_{b}_dockings,
        cast(sum(case when {b}_diff < 0 then -{b}_diff else 0 end) over r as bigint) total_{b}_undockings"""
    for b in events.BIKES
)
_COLS = ", ".join(events.BIKES.values())


@query(
    "w10_running_totals",
    f"""select station_id, last_reported, is_charging_station, {_COLS}, {", ".join(f"{b}_diff" for b in events.BIKES)}, {_RUN}
        from (select *, {_DIFF} from ss window w as (partition by station_id order by last_reported)) x
        window r as (partition by station_id order by last_reported)""",
)
def running_totals(t):
    return events.running_totals(t.status())


_WHEN = " or ".join(f"coalesce(d_{b}, 0) <> 0" for b in events.BIKES)


@query(
    "w11_changes_with_totals",
    "select station_id, last_reported, "
    + ", ".join(
        f"""{c} {b}, {c} - d_{b} prev_{b}, coalesce(d_{b}, 0) delta_{b},
            cast(sum(d_{b}) filter (d_{b} > 0) over p as bigint) dockings_{b},
            cast(sum(d_{b}) filter (d_{b} < 0) over p as bigint) undockings_{b}"""
        for b, c in events.BIKES.items()
    )
    + f" from {LAGGED} l where {_WHEN} window p as (partition by station_id)",
)
def changes_with_totals(t):
    return events.changes_with_totals(t.status())


@query(
    "w12_status_deltas",
    "select * from (select station_id, last_reported, "
    + ", ".join(f"{c} - lag({c}) over w {n}" for n, c in events.DELTA_FIELDS.items())
    + " from ss window w as (partition by station_id order by last_reported)) x where iconic is not null",
)
def status_deltas(t):
    return events.status_deltas(t.status())


# Orderings, top-k and set operations


@query("t1_latest_queries", LATEST_QUERY_SQL)
def latest_queries(t):
    return feed.latest_queries(t.query_log())


@query("t2_latest_of_station", "select * from ss where info_station_id = 9 order by last_reported desc limit 1")
def latest_of_station(t):
    return stations.latest_of_station(t.status(), t.information(), 9)


@query(
    "t3_top_differences",
    f"""select station_id, "name", iconic_undockings + iconic_dockings difference from ({DOCKING_SQL}) d
        order by difference desc, station_id limit 20""",
)
def top_differences(t):
    return events.by_iconic_difference(docking(t), "dockings", 20)


@query(
    "t4_top_counts",
    f"""select *, cast(iconic_undockings + efit_undockings + efit_g5_undockings as bigint) total from ({DOCKING_SQL}) d
        order by iconic_undockings, total, station_id limit 20""",
)
def top_counts(t):
    return events.by_iconic_count(docking(t), "undockings", 20)


# Each ordering of the station list both ways, with the place of every station: the order itself is compared.
_PLACES = " union all ".join(
    f"""select '{option}' "option", {way == "desc"} descending, station_id,
        cast(row_number() over (order by {column} {way} nulls {"first" if way == "asc" else "last"}, station_id) as int) place from listed"""
    for option, column in stations.LIST_ORDERINGS.items()
    for way in ("asc", "desc")
)


@query(
    "t5_station_list_order",
    f"""with listed as (
          select si.*, l.* exclude (station_id, is_charging_station), o.empty_sec, o.full_sec from si
          join (select * from ss qualify row_number() over (partition by info_station_id order by last_reported desc) = 1) l
            on l.info_station_id = si.station_id
          join ({occupancy_sql("2024-01-10", "2024-01-20 12:00:00")}) o on o.station_id = si.station_id where si.active)
        {_PLACES}""",
)
def station_list_order(t):
    status, active = t.status(), stations.active_information(t.information())
    latest = stations.latest_status_by_lookup(status, stations.station_lookup(status))
    times = occupancy.occupancy(status, t.information(), FROM, TO).select("station_id", "empty_sec", "full_sec")
    listed = active.join(latest.drop("station_id", "is_charging_station"), F.col("station_id") == F.col(STATION))
    listed = listed.join(times, "station_id")
    return stations.station_places(listed).withColumn("place", F.col("place").cast("int"))


@query("t6_newest_errors", """select id, "time", endpoint, error_msg from ql where not success order by "time" desc, id desc limit 50""")
def newest_errors(t):
    return feed.query_errors(t.query_log(), 50).select("id", "time", "endpoint", "error_msg")


@query("u1_union_all", "select station_id, reported t from si union all select info_station_id, last_reported from ss")
def union_all(t):
    return t.information().select("station_id", F.col("reported").alias("t")).unionAll(t.status().select(STATION, "last_reported"))


@query("u2_distinct_rows", "select distinct * from (select * from si union all select * from si) x")
def distinct_rows(t):
    versions = info(t)
    return versions.unionAll(versions).dropDuplicates()


@query(
    "u3_long_form",
    """select * from (select reported, mechanical_count::bigint "Mechanical Count", ebike_count::bigint "E-Bike Count" from sc) x
       unpivot ("Count" for "Type" in ("Mechanical Count", "E-Bike Count"))""",
)
def long_form(t):
    names = {"mechanical_count": "Mechanical Count", "ebike_count": "E-Bike Count"}
    return system.long_form(t.system_counts(), ["reported"], names)


@query(
    "x_value_labels",
    """select case endpoint when 'station_status' then 'Station status' when 'station_information' then 'Station information'
         when 'system_information' then 'System information' when 'versions' then 'Versions'
         when 'vehicle_types' then 'Vehicle types' end label, count(*) n from ql group by 1
       union all select case physical_configuration when 'REGULAR' then 'Regular' else 'Vault' end, count(*) from si group by 1""",
)
def value_labels(t):
    log = t.query_log().select(labels.label("endpoint", labels.ENDPOINTS).alias("label"))
    kinds = t.information().select(labels.label("physical_configuration", labels.PHYSICAL_CONFIGURATIONS).alias("label"))
    counted = [rows.groupBy("label").agg(F.count("*").alias("n")) for rows in (log, kinds)]
    return counted[0].unionAll(counted[1])
