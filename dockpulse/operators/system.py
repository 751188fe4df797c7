"""Totals over all stations, at one time or on a grid."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dockpulse.functions.neighbours import STATION
from dockpulse.operators.stations import latest_key
from dockpulse.params import (
    Grid,
    at,
    epoch,
    epoch_of,
    from_epoch,
    hour_before,
    in_time_range,
    midnight,
    minutes_per_hourly_step,
)

GRID_COUNTERS = (
    "num_bikes_available",
    "num_bikes_disabled",
    "num_docks_available",
    "num_docks_disabled",
    "vehicle_types_available_iconic",
    "vehicle_types_available_efit",
    "vehicle_types_available_efit_g5",
)
BIKE_COUNTERS = (
    "vehicle_types_available_boost",
    "vehicle_types_available_iconic",
    "vehicle_types_available_efit",
    "vehicle_types_available_efit_g5",
)


def _latest_per_station(rows: DataFrame, keys: list[str], counters: tuple[str, ...]) -> DataFrame:
    """Counters of the latest row of each (keys, station). Numbers only, so this is a hash aggregate that is
    reduced before the exchange: a hot station sends one row per task and group."""
    order = latest_key()
    return rows.groupBy(*keys, STATION).agg(*[F.max_by(c, order).alias(c) for c in counters])


def _totals(rows: DataFrame, keys: list[str], counters: tuple[str, ...]) -> DataFrame:
    return rows.groupBy(*keys).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counters])


def system_status(status: DataFrame, start: datetime, end: datetime, step_minutes: int) -> DataFrame:
    """Per grid time t, the sum over stations of their latest status in [t - step, t).

    The row's grid time is arithmetic on its report time, so that no range join is needed.
    """
    grid = Grid.over(start, end, step_minutes)
    opening = grid.start - timedelta(seconds=grid.step_seconds)
    rows = in_time_range(status, "last_reported", opening, grid.last).where(F.col("last_reported") < at(grid.last))
    offset = epoch("last_reported") - epoch_of(grid.start)
    step = F.floor(offset / grid.step_seconds) + 1
    rows = rows.withColumn("time", from_epoch(step * grid.step_seconds + epoch_of(grid.start)))
    return _totals(_latest_per_station(rows, ["time"], GRID_COUNTERS), ["time"], GRID_COUNTERS)


def system_status_now(status: DataFrame, now: datetime) -> DataFrame:
    """The last point of the 15-minute grid over the hour before now."""
    grid = system_status(status, hour_before(now), now, minutes_per_hourly_step(4))
    return grid.orderBy(F.desc("time")).limit(1)


def _bikes(totals: DataFrame) -> DataFrame:
    boost, iconic, efit, g5 = (F.coalesce(F.col(c), F.lit(0)) for c in BIKE_COUNTERS)
    keys = [c for c in totals.columns if c not in BIKE_COUNTERS]
    return totals.select(
        *keys,
        (boost + iconic + efit + g5).alias("total"),
        (boost + iconic).alias("mechanical"),
        (efit + g5).alias("ebikes"),
        efit.alias("efit"),
        g5.alias("efit_g5"),
    )


def bikes_at(status: DataFrame, moment: datetime) -> DataFrame:
    """Bikes in the system: latest status of each station in the hour up to the moment."""
    rows = in_time_range(status, "last_reported", hour_before(moment), moment)
    return _bikes(_totals(_latest_per_station(rows, [], BIKE_COUNTERS), [], BIKE_COUNTERS))


def bikes_over_days(status: DataFrame, first_day: date, last_day: date, hours: int = 2) -> DataFrame:
    """Bikes in the system every two hours of the days, as one job. Moments without data count 0."""
    start, step = midnight(first_day), hours * 3600
    if hours < 2 or 24 % hours:
        raise ValueError("moments must be at least two hours apart and divide the day")
    points = ((last_day - first_day).days + 1) * 24 // hours
    last = start + timedelta(seconds=step * (points - 1))
    rows = in_time_range(status, "last_reported", hour_before(start), last)
    offset = epoch("last_reported") - epoch_of(start)
    moment = F.ceil(offset / step) * step
    rows = rows.where(moment - offset <= 3600).withColumn("time", from_epoch(moment + epoch_of(start)))
    found = _totals(_latest_per_station(rows, ["time"], BIKE_COUNTERS), ["time"], BIKE_COUNTERS)
    grid = Grid(start, step, points).times(status.sparkSession)
    return _bikes(grid.join(found, "time", "left"))


def charging_infrastructure(information: DataFrame, moment: datetime, current_only: bool = False) -> DataFrame:
    """Number of charging stations and of their docks at a time.

    A station counts with its newest charging version even if a later version no longer charges, unless
    `current_only` asks for stations whose newest version charges.
    """
    rows = information.where(F.col("reported") <= at(moment))
    if not current_only:
        rows = rows.where("is_charging_station")
    newest = rows.groupBy("station_id").agg(
        F.max_by("capacity", "id").alias("capacity"), F.max_by("is_charging_station", "id").alias("charging")
    )
    return newest.where("charging").agg(
        F.count("*").alias("stations"), F.coalesce(F.sum("capacity"), F.lit(0)).alias("docks")
    )


def system_count_history(counts: DataFrame) -> DataFrame:
    """One row per distinct (stations, mechanical, e-bikes), at its earliest report."""
    triple = ["station_count", "mechanical_count", "ebike_count"]
    return counts.groupBy(*triple).agg(F.min("reported").alias("reported")).select("reported", *triple)


def long_form(rows: DataFrame, ids: list[str], counts: dict[str, str]) -> DataFrame:
    """Chart-ready rows: one (Type, Count) per count column."""
    named: list[Column] = [F.col(c).cast("long").alias(label) for c, label in counts.items()]
    wide = rows.select(*ids, *named)
    return wide.unpivot(ids, list(counts.values()), "Type", "Count")
