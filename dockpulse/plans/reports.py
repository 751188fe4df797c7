"""User-level reports: operators put together into one plan each."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockpulse.functions.neighbours import STATION, sums_over_neighbours
from dockpulse.operators import availability, events, feed, quality, stations, system
from dockpulse.operators.occupancy import occupancy, occupancy_seconds, occupancy_terms, rows_around
from dockpulse.params import StatusQuery, epoch_of, seconds_per_step

MAX_STEPS = 20

# Labels of the chart columns.
CHART = {
    "num_bikes_available": "Available Bikes",
    "num_bikes_disabled": "Disabled Bikes",
    "num_docks_available": "Available Docks",
    "num_docks_disabled": "Disabled Docks",
    "vehicle_types_available_iconic": "Available Mechanical",
    "vehicle_types_available_efit": "Available E-Fit",
    "vehicle_types_available_efit_g5": "Available E-Fit G5",
}
# Count columns a stacked chart shows.
STACKED = {c: CHART[c] for c in CHART if c != "num_bikes_available"}
SYSTEM_COUNTS = {"mechanical_count": "Mechanical Count", "ebike_count": "E-Bike Count"}


def station_series(status: DataFrame, station_id: int, start: datetime, end: datetime) -> DataFrame:
    rows = stations.status_between(status, station_id, start, end)
    return rows.select(
        F.col(STATION).alias("Station ID"),
        F.col("last_reported").alias("Last Reported"),
        F.col("is_charging_station").alias("Charging"),
        *[F.col(c).alias(label) for c, label in CHART.items()],
    )


def system_series(status: DataFrame, start: datetime, end: datetime, max_steps: int = MAX_STEPS) -> DataFrame:
    """System totals on a grid of about `max_steps` steps, at least a minute each."""
    minutes = max(1, seconds_per_step(start, end, max_steps) // 60)
    grid = system.system_status(status, start, end, minutes)
    return grid.select(
        F.lit(None).cast("int").alias("Station ID"),
        F.col("time").alias("Last Reported"),
        F.lit(True).alias("Charging"),
        *[F.col(c).alias(label) for c, label in CHART.items()],
    )


def performance(
    status: DataFrame, information: DataFrame, start: datetime, end: datetime, station_id: int | None = None
) -> DataFrame:
    """Integrals, factors and time empty and full of each active station, from one pass over the status rows.

    The integrals count only pairs of rows inside the range, as if the rows around it were not there.
    """
    terms = availability.integral_terms((epoch_of(start), epoch_of(end)))
    sums = sums_over_neighbours(
        rows_around(status, start, end, station_id),
        terms | occupancy_terms(start, end),
        ["ts", *availability.COUNTERS.values()],
        following=["ts"],
    ).where("reported > 0")
    rows = availability.with_active_station(sums, information, StatusQuery(station_id))
    # times are known for stations that had a version by the end of the range
    versions = StatusQuery(station_id, None, end).on_information_until(information).select("station_id").distinct()
    rows = rows.join(versions.withColumn("_known", F.lit(True)), "station_id", "left")
    integral = rows.select(
        "station_id",
        "charging",
        "capacity",
        *terms,
        *[F.when(F.col("_known"), seconds).alias(n) for n, seconds in zip(("empty_sec", "full_sec"), occupancy_seconds(), strict=True)],
    )
    return availability.with_factors(integral)


def station_list(status: DataFrame, information: DataFrame, end: datetime) -> DataFrame:
    """Latest status of each station within 24 hours before a time, with its station."""
    return stations.latest_before(status, information, end)


def occupancy_list(status: DataFrame, information: DataFrame, start: datetime, end: datetime) -> DataFrame:
    latest = stations.latest_before(status, information, end)
    return stations.join_occupancy(latest, occupancy(status, information, start, end))


def charging_report(status: DataFrame, information: DataFrame, query: StatusQuery = StatusQuery()) -> DataFrame:
    """Two rows per charging station: bikes charged by type."""
    rows = events.charging_events(status, information, query)
    wide = rows.select("station_id", F.col("efit_charged").alias("E-Fit"), F.col("efit_g5_charged").alias("E-Fit G5"))
    return wide.unpivot(["station_id"], ["E-Fit", "E-Fit G5"], "bike_type", "count")


def trips_header(status: DataFrame, information: DataFrame, query: StatusQuery = StatusQuery()) -> DataFrame:
    """Trips started and ended, for all and by bike type."""
    totals = events.docking_totals(events.docking_events(status, information, query))
    names = {"undockings": "started", "dockings": "ended"}
    return totals.select(
        *[
            F.col(f"{bike}_{kind}").alias(f"{bike}_{label}")
            for kind, label in names.items()
            for bike in ("all", *events.BIKES)
        ]
    )


def latest_updates(log: DataFrame, zone: str) -> DataFrame:
    rows = feed.latest_queries(log).select("endpoint", F.col("time").alias("updated"))
    return feed.local_time(rows, "updated", zone)


def query_history_report(log: DataFrame, zone: str, endpoint: str | None = None) -> DataFrame:
    """Request statistics with whole-second intervals and local times."""
    rows = feed.query_history(log, endpoint)
    for leg in ("total", "successful", "failed"):
        interval = f"{leg}_avg_interval"
        rows = rows.withColumn(interval, F.bround(interval).cast("long"))
        rows = feed.local_time(rows, f"{leg}_latest", zone)
    return rows


def station_lookup_report(status: DataFrame, information: DataFrame, mode: str, text: str) -> DataFrame:
    """Latest status of every station whose name matches, in one job."""
    found = stations.stations_like(information, stations.like_pattern(mode, text))
    return _latest_of(status, found)


def station_lookup_by_id(status: DataFrame, information: DataFrame, lookup: DataFrame, station_id: int) -> DataFrame:
    """The same for an id; the name is that of the version the latest status refers to."""
    found = stations.information_by_lookup(status, information, lookup, [station_id]).select("station_id", "name")
    return _latest_of(status, found)


def _latest_of(status: DataFrame, found: DataFrame) -> DataFrame:
    keys = found.select(F.col("station_id").alias(STATION), "name")
    rows = status.join(keys.select(STATION).distinct(), STATION, "left_semi")
    newest = rows.groupBy(STATION).agg(
        *[
            F.max_by(c, stations.latest_key()).alias(c)
            for c in ("info_reported", *stations.STATION_COUNTS, *events.BIKES.values())
        ],
        F.max("last_reported").alias("last_reported"),
    )
    return keys.join(newest, STATION, "inner").withColumnRenamed(STATION, "station_id")


def station_name(status: DataFrame, information: DataFrame, lookup: DataFrame, station_id: int) -> DataFrame:
    return stations.information_by_lookup(status, information, lookup, [station_id]).select("station_id", "name")


def quality_report(status: DataFrame, information: DataFrame) -> DataFrame:
    """Counts of orphaned rows, capacity mismatches and duplicate versions."""
    status_checks = quality.status_counts(status, information).selectExpr(
        "inline(array(struct('orphaned status' as check, orphaned as found), struct('capacity mismatch' as check, mismatched as found)))"
    )
    copies = quality.duplicate_versions(information).agg(F.count("*").alias("found"))
    return status_checks.unionByName(copies.select(F.lit("duplicate version").alias("check"), "found"))
