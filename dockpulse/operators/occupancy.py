"""How long stations were empty or full."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dockpulse import schemas
from dockpulse.functions.neighbours import STATION, sums_over_neighbours, with_neighbours
from dockpulse.operators.stations import newest_reported_information
from dockpulse.params import StatusQuery, at, epoch, epoch_of, in_time_range

LOOK_BACK, LOOK_AHEAD = timedelta(hours=12), timedelta(hours=1)
OCCUPANCY_COLUMNS = ("ts", "num_bikes_available", "num_docks_available")


def occupancy_terms(start: datetime, end: datetime, empty_thresh: int = 0, full_thresh: int = 0) -> dict[str, str]:
    """Terms of the occupancy sums over rows with a `ts` column; `next_ts` is needed."""
    first, last = epoch_of(start), epoch_of(end)
    bikes, docks = "num_bikes_available", "num_docks_available"
    # seconds for which a row holds inside the range
    held = f"greatest(0, least(coalesce(next_ts, {last}), {last}) - greatest(ts, {first}))"
    # rows that decide between null and a number of seconds
    before, after = f"coalesce(prev_ts, {first})", f"coalesce(next_ts, {last})"
    in_range = f"(ts < {last} and {after} >= {first} or {before} < {first} and ts >= {first})"
    low = f"least({bikes}, coalesce(prev_{bikes}, 0)) <= {empty_thresh}"
    full = f"least({docks}, coalesce(prev_{docks}, 0)) <= {full_thresh}"
    return {
        "empty": f"if({bikes} = {empty_thresh}, {held}, 0)",
        "full": f"if({docks} = {full_thresh}, {held}, 0)",
        "relevant": f"if({in_range} and ({low} or {full}), 1, 0)",
        "reported": f"if(ts between {first} and {last}, 1, 0)",
    }


def rows_around(status: DataFrame, start: datetime, end: datetime, station_id: int | None = None) -> DataFrame:
    """The status rows that can matter for a range, with `ts`."""
    rows = StatusQuery(station_id, start - LOOK_BACK, end + LOOK_AHEAD).on_status(status)
    return rows.withColumn("ts", epoch("last_reported"))


def occupancy_seconds() -> list[Column]:
    """empty_sec and full_sec from the occupancy sums."""
    decided = F.col("relevant") > 0
    return [F.when(decided, F.col(kind)).alias(f"{kind}_sec") for kind in ("empty", "full")]


def occupancy(
    status: DataFrame,
    information: DataFrame,
    start: datetime,
    end: datetime,
    station_id: int | None = None,
    empty_thresh: int = 0,
    full_thresh: int = 0,
) -> DataFrame:
    """Seconds empty and full in [start, end] per station that reported in the range.

    Null seconds: the station was never empty or full, nor just after either, in the range.
    """
    sums = sums_over_neighbours(
        rows_around(status, start, end, station_id),
        occupancy_terms(start, end, empty_thresh, full_thresh),
        OCCUPANCY_COLUMNS,
        following=["ts"],
    )
    return occupied(sums, information, end, station_id)


def occupied(sums: DataFrame, information: DataFrame, end: datetime, station_id: int | None = None) -> DataFrame:
    """Occupancy from its sums per station."""
    sums = sums.where("reported > 0")
    stations = newest_reported_information(
        StatusQuery(station_id).on_information_station(information), end
    ).select(F.col("station_id").alias(STATION), "name", "capacity", F.col("reported").alias("version"))
    return sums.join(stations, STATION, "inner").select(
        F.col(STATION).alias("station_id"),
        "name",
        "capacity",
        F.col("version").alias("reported"),
        *occupancy_seconds(),
    )


def occupancy_rows(
    status: DataFrame,
    start: datetime,
    end: datetime,
    station_id: int | None = None,
    empty_thresh: int = 0,
    full_thresh: int = 0,
) -> DataFrame:
    """The status rows that count for occupancy, with the neighbours' values: a missing next row means the range
    end, a missing previous row the range start without bikes and docks."""
    rows = StatusQuery(station_id, start - LOOK_BACK, end + LOOK_AHEAD).on_status(status)
    rows = with_neighbours(rows, ["last_reported", "num_bikes_available", "num_docks_available"], following=True)
    rows = rows.select(
        STATION,
        "last_reported",
        "num_bikes_available",
        "num_docks_available",
        F.coalesce("_next.last_reported", at(end)).alias("next_reported"),
        F.coalesce("_prev.last_reported", at(start)).alias("prev_reported"),
        F.coalesce("_prev.num_bikes_available", F.lit(0)).alias("prev_bikes"),
        F.coalesce("_prev.num_docks_available", F.lit(0)).alias("prev_docks"),
    )
    time = F.col("last_reported")
    holds = (time < at(end)) & (F.col("next_reported") >= at(start))
    opens = (F.col("prev_reported") < at(start)) & (time >= at(start))
    low = F.least("num_bikes_available", "prev_bikes") <= empty_thresh
    full = F.least("num_docks_available", "prev_docks") <= full_thresh
    return rows.where((holds | opens) & (low | full))


def stations_reporting(
    status: DataFrame, information: DataFrame, start: datetime, end: datetime
) -> DataFrame:
    """Newest version, up to the end, of the stations with at least one status in the range."""
    ids = in_time_range(status, "last_reported", start, end).select(F.col(STATION).alias("station_id")).distinct()
    return newest_reported_information(information, end).join(ids, "station_id", "left_semi")


def as_cache_rows(
    result: DataFrame, start: datetime, end: datetime, empty_thresh: int, full_thresh: int, calculated: datetime
) -> DataFrame:
    """Occupancy result in the layout of the cache table."""
    return result.select(
        "station_id",
        "reported",
        at(start).alias("range_start"),
        at(end).alias("range_end"),
        F.lit(empty_thresh).alias("empty_thresh"),
        F.lit(full_thresh).alias("full_thresh"),
        at(calculated).alias("calculated"),
        "empty_sec",
        "full_sec",
    )


def cached_occupancy(
    cache: DataFrame,
    status: DataFrame,
    information: DataFrame,
    start: datetime,
    end: datetime,
    calculated: datetime,
    station_id: int | None = None,
    empty_thresh: int = 0,
    full_thresh: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """(result, rows to add to the cache): cached rows of the exact key, and the missing stations computed.

    The status rows of cached stations are dropped before the computation.
    """
    hits = cache.where(
        (F.col("range_start") == at(start))
        & (F.col("range_end") == at(end))
        & (F.col("empty_thresh") == empty_thresh)
        & (F.col("full_thresh") == full_thresh)
    )
    if station_id is not None:
        hits = hits.where(F.col("station_id") == station_id)
    known = hits.select(F.col("station_id").alias(STATION)).distinct()
    misses = status.join(known, STATION, "left_anti")
    computed = occupancy(misses, information, start, end, station_id, empty_thresh, full_thresh)
    added = as_cache_rows(computed, start, end, empty_thresh, full_thresh, calculated)
    return hits.select(*added.columns).unionByName(added), added


def merge_cache(cache: DataFrame, added: DataFrame) -> DataFrame:
    """Cache with the added rows in place of those of equal key."""
    kept = cache.join(added.select(*schemas.OCCUPANCY_KEY), list(schemas.OCCUPANCY_KEY), "left_anti")
    return kept.select(*added.columns).unionByName(added)
