"""Sources, sinks and the batch ingest."""

from __future__ import annotations

import uuid
from datetime import date, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockpulse import schemas
from dockpulse.adapter import SENTINEL, Tables
from dockpulse.functions.neighbours import STATION
from dockpulse.ingest import feedlog, information, status
from dockpulse.operators import feed, occupancy, stations
from dockpulse.params import StatusQuery
from dockpulse.registry.base import END, NOW, START, query
from dockpulse.registry.operators import FROM, INFO, TO, occupancy_sql
from dockpulse.session import shared_dir
from dockpulse.sources import gbfs, tables
from dockpulse.sources.merged import MergedTable

# Feed documents and file formats

_FEED = ", ".join(schemas.STATUS_FEED_COLUMNS)
_DESCRIBED = [c for c in INFO if c not in ("id", "active")]


@query("src1_information_documents", f"select {', '.join(_DESCRIBED)}, 'KEY,PHONE' methods, ',,' uris from si")
def information_documents(t):
    rows = gbfs.station_information(t.information_documents())
    return rows.select(
        *_DESCRIBED,
        F.array_join("rental_methods", ",").alias("methods"),
        F.array_join("rental_uris", ",").alias("uris"),
    )


@query("src2_status_documents", f"select {_FEED} from ss")
def status_documents(t):
    return gbfs.station_status(t.status_documents())


@query("src3_system_information_documents", "select reported, '1.0' build_version, 12 mobile_head_version, 8 mobile_minimum_supported_version, 'bike_share' \"name\", 'America/Toronto' timezone from sc")
def system_information_documents(t):
    rows = gbfs.system_information(t.system_documents())
    return rows.select(
        "reported", "build_version", "mobile_head_version", "mobile_minimum_supported_version", "name", "timezone"
    )


@query("src3_system_count_documents", "select * from sc")
def system_count_documents(t):
    return gbfs.system_information_count(t.system_documents())


_AT = "timestamp '2024-01-01' reported"


@query("src4_regions", f"select {_AT}, n_nationkey::varchar region_id, n_name region_name from nation")
def regions(t):
    return gbfs.regions(t.dimension_documents("regions"))


@query("src4_versions", f'select {_AT}, r_regionkey::varchar "version", r_name url from region')
def versions(t):
    return gbfs.versions(t.dimension_documents("versions"))


@query(
    "src4_pricing_plans",
    f"""select {_AT}, p_partkey::varchar plan_id, p_name "name", 'CAD' currency, p_retailprice price, p_brand description,
          p_partkey % 2 = 0 is_taxable from part""",
)
def pricing_plans(t):
    return gbfs.pricing_plans(t.dimension_documents("plans"))


@query(
    "src4_vehicle_types",
    f"""select {_AT}, s_suppkey::varchar vehicle_type_id, 'bicycle' form_factor, 'human' propulsion_type,
          s_acctbal max_range_meters, s_name "name", s_nationkey::varchar default_pricing_plan_id from supplier""",
)
def vehicle_types(t):
    return gbfs.vehicle_types(t.dimension_documents("vehicle_types"))


def _folder(t: Tables, name: str) -> str:
    """A new folder for every run, so that no run replaces the files another one still reads."""
    return f"{shared_dir(t.spark)}/tables/{name}-{uuid.uuid4().hex}"


FIRST_DAY, LAST_DAY = date(2024, 1, 1), date(2024, 1, 20)
_EXPORTED = "last_reported between timestamp '2024-01-01' and timestamp '2024-01-20 12:00:00'"


def _export(t: Tables, folder: str) -> tuple[str, str]:
    return tables.export_dump(t.status(), t.information(), _folder(t, folder), FIRST_DAY, LAST_DAY)


@query("snk1_export_status", f"select {_FEED} from ss where {_EXPORTED}")
def export_status(t):
    """Export of a range in feed records, read back from the written files."""
    return tables.read_status_dump(t.spark, _export(t, "export")[1])


@query("snk1_export_information", f"select * from si where (station_id, reported) in (select (info_station_id, info_reported) from ss where {_EXPORTED})")
def export_information(t):
    return tables.read_information_dump(t.spark, _export(t, "export")[0]).select(*INFO)


_IMPORTED = f"""select si.station_id info_station_id, si.reported info_reported, {", ".join(f"ss.{c}" for c in schemas.STATUS_FEED_COLUMNS)}
  from ss join si on si.station_id = ss.station_id and si.active"""


def _imported(t: Tables, **form) -> DataFrame:
    """The whole history exported, both files; the status file inserted into an empty table with the active versions of the other."""
    info, status_ = tables.export_dump(t.status(), t.information(), _folder(t, "import"), **form)
    versions = tables.read_information_dump(t.spark, info)
    active = t.information().where("active").select("id")
    # a version that no status refers to is not exported, so the active one of such a station comes from the table
    known = versions.unionByName(t.information().join(versions.select("id"), "id", "left_anti").join(active, "id", "left_semi"))
    empty = t.spark.createDataFrame([], schemas.STATION_STATUS)
    return status.new_rows(tables.read_status_dump(t.spark, status_), known, empty).select(*schemas.STATION_STATUS.names)


@query("src5_import_dump", _IMPORTED)
def import_dump(t):
    return _imported(t)


@query("src5_import_zstd", _IMPORTED)
def import_zstd(t):
    """The same through Zstandard files of one JSON array each."""
    return _imported(t, zstd=True, array=True)


@query("snk1_export_zstd", f"select {_FEED} from ss where {_EXPORTED}")
def export_zstd(t):
    """Export of a range as Zstandard files of a record per line, read back."""
    paths = tables.export_dump(t.status(), t.information(), _folder(t, "export"), FIRST_DAY, LAST_DAY, zstd=True)
    return tables.read_status_dump(t.spark, paths[1])


@query("src5_round_trip_status", f"select {_FEED} from ss")
def round_trip_status(t):
    """Documents to rows to feed records to rows, every column of the whole table."""
    path = _folder(t, "round_trip")
    rows = gbfs.station_status(t.status_documents())
    gbfs.status_items(rows).write.option("ignoreNullFields", "false").json(path)
    return tables.read_status_dump(t.spark, path)


_LISTS = ("rental_methods", "groups", "rental_uris")
_ALL_INFO = [f"array_join({c}, ',') {c}" if c in _LISTS else c for c in schemas.STATION_INFORMATION.names]
_ALL_INFO_SQL = f"""select {", ".join(INFO)}, 0.0::double altitude, 'KEY,PHONE' rental_methods, false is_valet_station,
  false is_virtual_station, 'zone' "groups", '416' obcn, 500.0::double nearby_distance, cast(null as varchar) bluetooth_id,
  true ride_code_support, ',,' rental_uris from si"""


@query("src5_round_trip_information", _ALL_INFO_SQL)
def round_trip_information(t):
    path = _folder(t, "round_trip")
    records = tables.information_records(t.information())
    records.write.option("ignoreNullFields", "false").json(path)
    return tables.read_information_dump(t.spark, path).selectExpr(*_ALL_INFO)


@query("src6_delimited_tables", _ALL_INFO_SQL)
def delimited_tables(t):
    """All versions written as psql writes them and read back, every column."""
    path = _folder(t, "delimited")
    tables.write_delimited(t.information(), path)
    return tables.read_delimited(t.spark, path, schemas.STATION_INFORMATION).selectExpr(*_ALL_INFO)


@query("src6_delimited_status", "select * from ss")
def delimited_status(t):
    path = _folder(t, "delimited")
    tables.write_delimited(t.status(), path)
    return tables.read_delimited(t.spark, path, schemas.STATION_STATUS)


@query("i11_status_by_day", "select * from ss where last_reported between timestamp '2024-01-10' and timestamp '2024-01-20 12:00:00'")
def status_by_day(t):
    """The whole history written by day; the read names the day partitions of its range."""
    path = _folder(t, "status_by_day")
    tables.write_status(t.status(), path, "overwrite")
    rows = StatusQuery(None, FROM, TO).on_status(tables.read_table(t.spark, path))
    return rows.select(*schemas.STATION_STATUS.names)


# Ingest

_SNAPSHOT_JOIN = "from snap n left join (select * from si where active) o on o.station_id = n.station_id"
_SAME = """o.station_id is not null and o."name" = n."name" and o.capacity = n.capacity and o.address = n.address"""


@query(
    "j13_snapshot_comparison",
    f"select n.station_id, case when o.station_id is null then 'new' when {_SAME} then 'same' else 'changed' end state {_SNAPSHOT_JOIN}",
)
def snapshot_comparison(t):
    return information.compare(t.information(), t.information_snapshot()).select("station_id", "state")


_DESCRIPTION = ", ".join(f'n."{c}"' for c in INFO if c not in ("id", "active", "reported"))
_FRESH = f"""select cast((select max(id) from si) + row_number() over (order by n.reported, n.station_id) as int) id,
  {_DESCRIPTION}, true active, n.reported {_SNAPSHOT_JOIN} where not coalesce({_SAME}, false)"""
_VERSION = INFO


@query(
    "i1_information_merge",
    f"""select si.* replace (si.active and si.station_id not in (select station_id from ({_FRESH}) f) as active) from si
        union all by name {_FRESH}""",
)
def information_merge(t):
    return information.merge(t.information(), t.information_snapshot()).select(*_VERSION)


@query("i1_information_inserted", _FRESH)
def information_inserted(t):
    return information.inserted(t.information(), t.information_snapshot()).select(*_VERSION)


@query(
    "i1_information_updated",
    f"""select * replace (false as active) from si
        where active and station_id in (select station_id from ({_FRESH}) f)""",
)
def information_updated(t):
    return information.updated(t.information(), t.information_snapshot()).select(*_VERSION)


def _stored(t: Tables) -> DataFrame:
    """What an earlier ingest stored: rows up to a time."""
    return StatusQuery(None, None, FROM).on_status(t.status())


_STORED = "(select * from ss where last_reported <= timestamp '2024-01-10')"
_OFFERED = f"({_IMPORTED})"
_NEW = f"""(select * from {_OFFERED} o where not exists (select 1 from {_STORED} e
  where e.info_station_id = o.info_station_id and e.info_reported = o.info_reported and e.last_reported = o.last_reported))"""


def _offered(t: Tables) -> DataFrame:
    return t.status().select(*schemas.STATUS_FEED_COLUMNS)


@query("i2_status_insert", f"select * from {_STORED} s union all by name select * from {_NEW} n")
def status_insert(t):
    return status.insert(_offered(t), t.information(), _stored(t))


@query(
    "i3_lookup_update",
    f"""select info_station_id, arg_max(info_reported, (last_reported, info_reported)) info_reported,
          max(last_reported) status_last_reported
        from (select * from {_STORED} s union all by name select * from {_NEW} n) x group by 1""",
)
def lookup_update(t):
    stored = _stored(t)
    inserted = status.new_rows(_offered(t), t.information(), stored)
    return status.updated_lookup(stations.station_lookup(stored), inserted)


@query("snk5_merge_by_key", f"select * from {_STORED} s union all select * replace (least(num_bikes_available, 3) as num_bikes_available) from ss where last_reported > timestamp '2024-01-10'")
def merge_by_key(t):
    """Every row is offered twice with different values: stored rows stay, and of new ones the least wins."""
    other = t.status().withColumn("num_bikes_available", F.least("num_bikes_available", F.lit(3)))
    return tables.merge_by_key(_stored(t), t.status().unionByName(other), schemas.STATUS_KEY)


@query("snk5_merged_table", f"select * from {_STORED} s union all select * replace (least(num_bikes_available, 3) as num_bikes_available) from ss where last_reported > timestamp '2024-01-10'")
def merged_table(t):
    """The same offers to a stored table: only keys of the days that are offered are read, and only new rows are written."""
    table = _merged_status(t)
    table.insert(_stored(t), 0)
    other = t.status().withColumn("num_bikes_available", F.least("num_bikes_available", F.lit(3)))
    table.insert(t.status().unionByName(other), 1)
    return table.rows()


def _merged_status(t: Tables) -> MergedTable:
    return MergedTable(t.spark, _folder(t, "merged_status"), t.status().schema, schemas.STATUS_KEY, F.col("last_reported"))


@query("snk5_upserted_table", "select * replace (case when last_reported > timestamp '2024-01-10' then num_bikes_available else 0 end as num_bikes_available) from ss")
def upserted_table(t):
    """All rows are stored without bikes; the later ones come again as they are and take their places."""
    table = _merged_status(t)
    table.insert(t.status().withColumn("num_bikes_available", F.lit(0)), 0)
    table.upsert(t.status().where(F.col("last_reported") > F.lit(FROM)), 1)
    table.compact(2, most=0)
    return table.rows()


_BEFORE = ", ".join(f"lag({c}) over w p_{c}" for c in status.BATCH_COLUMNS)
_COMPARED = " or ".join(f"{c} <> p_{c}" for c in status.BATCH_COLUMNS)
CHANGES_SQL = f"""(select * exclude (rn, {", ".join(f"p_{c}" for c in status.BATCH_COLUMNS)}) from
  (select *, {_BEFORE}, row_number() over w rn from ss window w as (partition by info_station_id order by last_reported)) x
  where {{first}} ({_COMPARED}))"""


@query("i4_changes_backfill", f"select * from {CHANGES_SQL.format(first='')} c")
def changes_backfill(t):
    return status.changes_backfill(t.status())


@query("i5_change_capture", f"select * from {CHANGES_SQL.format(first='rn = 1 or')} c")
def change_capture(t):
    return status.status_changes(t.status())


@query("snk5_append_changes", f"select * from {CHANGES_SQL.format(first='rn = 1 or')} c")
def append_changes(t):
    """All changes appended to a table that holds the earlier ones already."""
    changes = status.status_changes(t.status())
    return status.append_changes(StatusQuery(None, None, FROM).on_status(changes), changes)


@query(
    "i7_typed_log",
    """select id, json_extract_string(error_json, '$.k') k, error_json is not null as has_body from ql""",
)
def typed_log(t):
    """The log stored with VARIANT bodies, half of it first and all of it merged into that; then a field of the bodies."""
    log = feedlog.typed_bodies(t.query_log())
    path = _folder(t, "typed_log")
    feedlog.append_log(log.where(F.col("id") % 2 == 0), log).write.parquet(path)
    stored = feed.error_field(t.spark.read.parquet(path), "$.k", "k")
    return stored.select("id", "k", F.col("error_json").isNotNull().alias("has_body"))


@query("i6_system_information_insert", "select * replace (case when reported < timestamp '2024-01-10' then 0 else station_count end as station_count) from sc")
def system_information_insert(t):
    """Earlier days are stored, with another count; all days come as documents; the table is written and read again."""
    path = _folder(t, "system_counts")
    earlier = t.system_counts().where(F.col("reported") < F.lit(FROM)).withColumn("station_count", F.lit(0))
    known = gbfs.system_information(t.system_documents()).limit(0)
    feedlog.append_system(known, earlier, t.system_documents())[1].write.parquet(path)
    return t.spark.read.parquet(path)


@query("i6_system_description_insert", "select reported, 'bikes' system_id, 12 mobile_head_version from sc")
def system_description_insert(t):
    known = gbfs.system_information(t.system_documents()).where(F.col("reported") < F.lit(FROM))
    empty = t.system_counts().limit(0)
    rows = feedlog.append_system(known, empty, t.system_documents())[0]
    return rows.select("reported", "system_id", "mobile_head_version")


LOG_SQL = """select case when k % 10 <> 0 then s else timestamp '2024-01-31' end "time", 'system_regions' endpoint,
  k % 10 <> 0 success, case when k % 10 = 0 then 'Decode failure: system_regions' end error_msg,
  case when k % 20 = 0 then 'null' when k % 10 = 0 then props end error_json from ev"""


@query("i7_feed_log", LOG_SQL)
def feed_log(t):
    return feedlog.log_rows(t.log_documents(), gbfs.REGIONS, NOW).drop("id")


def _appended_log(t: Tables) -> DataFrame:
    """The log after two appends, the second of documents that the first had in part."""
    path = _folder(t, "log")
    rows = feedlog.log_rows(t.log_documents(), gbfs.REGIONS, NOW)
    feedlog.append_log(rows.limit(0), rows.where("success")).write.parquet(path)
    return feedlog.append_log(t.spark.read.parquet(path), rows)


# a document that comes twice is logged once: good ones differ by user, kind and time, bad ones by their text
_LOGGED = f"""(select distinct on (success, v) * from (select d.*, case when success then concat_ws('|', user_id, event_type, s)
  when k % 20 = 0 then 'gateway timeout' else props end v from (select ev.*, {LOG_SQL.removeprefix("select ")}) d) x)"""


@query("i7_log_insert", f"""select "time", endpoint, success, error_msg, error_json from {_LOGGED} l""")
def log_insert(t):
    return _appended_log(t).drop("id")


@query("i7_latest_of_log", f"""select endpoint, max("time") "time" from {_LOGGED} l group by 1""")
def latest_of_log(t):
    """T1 on the log as it was appended."""
    return feed.latest_queries(_appended_log(t)).select("endpoint", "time")


CALCULATED = datetime(2024, 2, 2)
_OCCUPANCY = occupancy_sql("2024-01-10", "2024-01-20 12:00:00")
_CACHE = f"""select station_id, reported, timestamp '2024-01-10' range_start, timestamp '2024-01-20 12:00:00' range_end,
  0 empty_thresh, 0 full_thresh, {{calculated}} calculated, empty_sec, full_sec from ({_OCCUPANCY}) o"""


@query("i8_occupancy_cache", _CACHE.format(calculated="case when station_id % 2 = 0 then timestamp '2024-02-01' else timestamp '2024-02-02' end"))
def occupancy_cache(t):
    """Half of the stations were computed earlier and stored; the other half is computed now."""
    path = _folder(t, "occupancy_cache")
    even = StatusQuery(None, None, None).on_status(t.status()).where(F.col(STATION) % 2 == 0)
    first = occupancy.occupancy(even, t.information(), FROM, TO)
    occupancy.as_cache_rows(first, FROM, TO, 0, 0, END).write.mode("overwrite").parquet(path)
    cache = t.spark.read.parquet(path)
    result, added = occupancy.cached_occupancy(cache, t.status(), t.information(), FROM, TO, CALCULATED)
    merged = occupancy.merge_cache(cache, added)
    keys = list(schemas.OCCUPANCY_KEY)
    return merged.join(result.select(*keys), keys, "left_semi").select(*result.columns)


@query("i8_stored_cache", _CACHE.format(calculated="case when station_id % 2 = 0 then timestamp '2024-02-01' else timestamp '2024-02-02' end"))
def stored_cache(t):
    """The cache as a stored table: rows of an outdated computation, replaced for half of the stations, and then for the other half."""
    even = F.col("station_id") % 2 == 0
    first = occupancy.as_cache_rows(occupancy.occupancy(t.status(), t.information(), FROM, TO), FROM, TO, 0, 0, END)
    cache = MergedTable(t.spark, _folder(t, "cache_table"), first.schema, schemas.OCCUPANCY_KEY, F.col("range_start"))
    cache.insert(first.withColumn("empty_sec", -F.col("empty_sec") - 1), 0)
    cache.upsert(first.where(even), 1)
    result, _ = occupancy.cached_occupancy(cache.rows().where(even), t.status(), t.information(), FROM, TO, CALCULATED)
    cache.upsert(result, 2)
    return cache.rows()


def _repair_sql(version: str) -> str:
    return f"""
      select * replace (coalesce(case when info_reported = timestamp '2023-12-20 05:20:38' then {version} end,
             info_reported) as info_reported) from orphaned o"""


@query("i9_reference_repair", _repair_sql("(select max(reported) from si where si.station_id = o.info_station_id and si.reported <= o.last_reported)"))
def reference_repair(t):
    return status.repair_references(t.orphaned_status(), t.information(), SENTINEL, StatusQuery(None, START, END))


@query(
    "i9_reference_repair_batch_max",
    _repair_sql(
        """(select max(reported) from si where si.station_id = o.info_station_id and si.reported <=
            (select max(last_reported) from orphaned m where m.info_station_id = o.info_station_id))"""
    ),
)
def reference_repair_batch_max(t):
    return status.repair_references(
        t.orphaned_status(), t.information(), SENTINEL, StatusQuery(None, START, END), mode="batch_max"
    )


_TWICE = "(select * from si union all select * replace (id + 1000000 as id) from si where is_charging_station)"


def _twice(t: Tables) -> DataFrame:
    versions = t.information()
    copies = versions.where("is_charging_station").withColumn("id", F.col("id") + 1_000_000)
    return versions.unionByName(copies)


@query("i10_deduplicated_information", f"select * from {_TWICE} x qualify row_number() over (partition by station_id, reported order by id) = 1")
def deduplicated_information(t):
    return information.deduplicated(_twice(t)).select(*INFO)


@query(
    "i10_repointed_status",
    f"""select s.info_id % 1000000 info_id, s.last_reported from
        (select station_id * 2 + 1 + case when is_charging_station then 1000000 else 0 end info_id, last_reported from ss) s""",
)
def repointed_status(t):
    shift = F.when(F.col("is_charging_station"), 1_000_000).otherwise(0)
    rows = t.status().select((F.col("station_id") * 2 + 1 + shift).alias("info_id"), "last_reported")
    return information.repointed(rows, _twice(t))


