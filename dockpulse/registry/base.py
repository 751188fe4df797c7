"""Registration and the SQL form of the model tables."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from dockpulse.adapter import Tables

# The whole time range of the test tables.
START, END = datetime(2024, 1, 1), datetime(2024, 2, 1)
NOW = datetime(2024, 1, 31)
ZONE = "America/Toronto"

# The model tables as SQL, in the order in which they depend on each other.
VIEWS = {
    "ev": """
      select *, cast(json_extract_string(props, '$.k') as int) k, date_trunc('second', ts) s from events""",
    "base": """
      select cast(user_id as int) station_id, s last_reported, event_type,
             cast(floor(value) as int) % 12 iconic, k % 5 efit, cast(event_id % 4 as int) efit_g5,
             k % 4 bikes_disabled, cast(event_id % 2 as int) docks_disabled,
             user_id % 3 = 0 and s >= timestamp '2024-01-15 12:00:00' late
      from (select *, row_number() over (partition by user_id, s order by event_id desc) rn from ev) x
      where rn = 1""",
    "ss": """
      select station_id info_station_id,
             case when late then timestamp '2024-01-15 12:00:00' else timestamp '2023-12-01 00:00:00' end
               info_reported,
             station_id, last_reported,
             iconic + efit + efit_g5 num_bikes_available, bikes_disabled num_bikes_disabled,
             greatest(0, case when late then 20 else 18 end - iconic - efit - efit_g5 - bikes_disabled
                         - docks_disabled) num_docks_available,
             docks_disabled num_docks_disabled, station_id % 4 = 0 is_charging_station,
             case when event_type = 'error' then 'MAINTENANCE' else 'IN_SERVICE' end status,
             true is_installed, event_type <> 'error' is_renting, event_type <> 'signup' is_returning,
             cast(null as varchar) traffic,
             greatest(0, case when late then 20 else 18 end - iconic - efit - efit_g5 - bikes_disabled
                         - docks_disabled) vehicle_docks_available,
             0 vehicle_types_available_boost, iconic vehicle_types_available_iconic,
             efit vehicle_types_available_efit, efit_g5 vehicle_types_available_efit_g5
      from base""",
    "orphaned": """
      select * replace (case when station_id % 7 = 0 then timestamp '2023-12-20 05:20:38' else info_reported end
                        as info_reported) from ss""",
    "described": """
      select c.*, cast(c_custkey as int) station_id, c_name "name",
             case when c_custkey % 2 = 0 then 'REGULAR' else 'VAULT' end physical_configuration,
             43.0::double + c_nationkey / 100.0::double lat, -79.0::double - c_nationkey / 100.0::double lon,
             c_mktsegment address, c_custkey % 4 = 0 is_charging_station
      from customer c""",
    "si": """
      select cast(c_custkey * 2 + v + 1 as int) id, station_id, "name", physical_configuration, lat, lon, address,
             18 + 2 * v capacity, is_charging_station, c_custkey % 3 <> 0 or v = 1 active,
             case when v = 1 then timestamp '2024-01-15 12:00:00' else timestamp '2023-12-01 00:00:00' end reported
      from described cross join (select 0 v union all select 1) vs
      where (v = 0 or c_custkey % 3 = 0) and c_custkey in (select user_id from events)""",
    "snap": """
      select station_id, "name", physical_configuration, lat, lon, address,
             18 + 2 * cast(c_custkey % 3 = 0 as int) + case when c_acctbal < 0 then 1 else 0 end capacity,
             is_charging_station, timestamp '2024-02-01 00:00:00' reported
      from described
      where c_custkey in (select user_id from events) or c_acctbal > 9000""",
    "ql": """
      select event_id id, s "time",
             case event_type when 'view' then 'station_status' when 'click' then 'station_information'
               when 'signup' then 'system_information' when 'error' then 'versions' else 'vehicle_types' end endpoint,
             k % 10 <> 0 success,
             case when k % 10 = 0 then 'Decode failure: ' || event_type end error_msg,
             case when k % 20 = 0 then props end error_json
      from ev""",
    "sc": """
      select date_trunc('day', ts)::timestamp reported, cast(count(distinct user_id) as int) station_count,
             cast(count(*) filter (where event_type in ('view', 'click')) as int) mechanical_count,
             cast(count(*) filter (where event_type not in ('view', 'click')) as int) ebike_count
      from events group by 1""",
    "lk": """
      select info_station_id, max_by(info_reported, last_reported) info_reported,
             max(last_reported) status_last_reported
      from ss group by 1""",
}


@dataclass(frozen=True)
class Entry:
    run: Callable[[SparkSession, str], DataFrame]
    on: Callable[[Tables], DataFrame]
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def with_views(sql: str) -> str:
    """The statement with the model tables it names, directly or through each other, as leading CTEs."""

    def named(text: str) -> set[str]:
        return {view for view in VIEWS if re.search(rf"\b{view}\b", text)}

    used, pending = set(), named(sql)
    while pending:
        view = pending.pop()
        used.add(view)
        pending |= named(VIEWS[view]) - used - {view}
    ctes = [f"{view} as ({VIEWS[view]})" for view in VIEWS if view in used]
    if not ctes:
        return sql.strip()
    body = sql.strip()
    for start in ("with recursive ", "with "):
        if body.startswith(start):
            return start + ",\n".join(ctes) + ",\n" + body.removeprefix(start)
    return "with " + ",\n".join(ctes) + "\n" + body


def query(name: str, sql: str | None = None):
    """Register a function of the model tables under a name."""

    def register(function: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return function(Tables(spark, sf_dir))

        run.__doc__ = function.__doc__
        REGISTRY[name] = Entry(run, function, None if sql is None else with_views(sql))
        return function

    return register
