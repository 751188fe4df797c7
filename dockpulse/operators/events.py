"""Trips started and ended, bikes charged, and per-row differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dockpulse.functions.neighbours import STATION, running_changes, sums_over_neighbours, with_neighbours
from dockpulse.operators.stations import active_information, latest_information
from dockpulse.params import StatusQuery

BIKES = {
    "iconic": "vehicle_types_available_iconic",
    "efit": "vehicle_types_available_efit",
    "efit_g5": "vehicle_types_available_efit_g5",
}


def _change(column: str) -> str:
    return f"({column} - prev_{column})"


def _sum_where(column: str, condition: str) -> str:
    return f"case when {condition} then {_change(column)} end"


def docking_terms() -> dict[str, str]:
    terms = {}
    for bike, column in BIKES.items():
        terms[f"{bike}_undockings"] = _sum_where(column, f"{_change(column)} < 0")
        terms[f"{bike}_dockings"] = _sum_where(column, f"{_change(column)} > 0")
    return terms


def docking_events(status: DataFrame, information: DataFrame, query: StatusQuery = StatusQuery()) -> DataFrame:
    """Undockings (negative) and dockings of each station and bike type.

    The first row of a station counts as no change. Stations appear with their newest version within the bounds.
    """
    return docked(sums_over_neighbours(query.on_status(status), docking_terms(), list(BIKES.values())), information, query)


def docked(sums: DataFrame, information: DataFrame, query: StatusQuery) -> DataFrame:
    """Docking events from their sums per station."""
    stations = latest_information(query.on_information_until(information)).select(
        F.col("station_id").alias(STATION), "name", "capacity", "is_charging_station"
    )
    zero = F.lit(0).cast("long")
    return sums.join(stations, STATION, "inner").select(
        F.col(STATION).alias("station_id"),
        "name",
        "capacity",
        "is_charging_station",
        zero.alias("boost_undockings"),
        zero.alias("boost_dockings"),
        *docking_terms(),
    )


CHARGING_COLUMNS = ("num_bikes_disabled", BIKES["efit"], BIKES["efit_g5"])


def charging_terms() -> dict[str, str]:
    enabled = f"{_change('num_bikes_disabled')} < 0"
    efit, g5 = (f"{_change(BIKES[bike])} > 0" for bike in ("efit", "efit_g5"))
    return {
        "bikes_disabled": _sum_where("num_bikes_disabled", f"{enabled} and ({efit} or {g5})"),
        "efit_charged": _sum_where(BIKES["efit"], f"{enabled} and {efit}"),
        "efit_g5_charged": _sum_where(BIKES["efit_g5"], f"{enabled} and {g5}"),
    }


def charging_events(status: DataFrame, information: DataFrame, query: StatusQuery = StatusQuery()) -> DataFrame:
    """Bikes charged at active charging stations: a disabled bike becomes an available e-bike."""
    return charged(sums_over_neighbours(query.on_status(status), charging_terms(), CHARGING_COLUMNS), information, query)


def charged(sums: DataFrame, information: DataFrame, query: StatusQuery) -> DataFrame:
    """Charging events from their sums per station."""
    stations = (
        active_information(query.on_information_station(information))
        .where("is_charging_station")
        .select(F.col("station_id").alias(STATION), "name", "capacity")
    )
    return sums.join(stations, STATION, "inner").select(
        F.col(STATION).alias("station_id"), "name", "capacity", *charging_terms()
    )


def docking_totals(events: DataFrame) -> DataFrame:
    """Absolute dockings and undockings of all stations together, per bike type and for all."""

    def total(kind: str, bikes) -> Column:
        return F.coalesce(F.abs(F.sum(sum((F.col(f"{b}_{kind}") for b in bikes), F.lit(0)))), F.lit(0))

    return events.agg(
        *[
            total(kind, [bike] if bike != "all" else BIKES).alias(f"{bike}_{kind}")
            for kind in ("undockings", "dockings")
            for bike in ("all", *BIKES)
        ]
    )


def charging_totals(events: DataFrame) -> DataFrame:
    return events.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("bikes_disabled", "efit_charged", "efit_g5_charged")]
    )


def by_iconic_difference(events: DataFrame, kind: str = "undockings", limit: int | None = None) -> DataFrame:
    """Stations by dockings plus undockings of iconic bikes; the limit is the top-N of the report."""
    rows = events.select(
        "station_id", "name", (F.col("iconic_undockings") + F.col("iconic_dockings")).alias("difference")
    )
    order = F.desc("difference") if kind == "dockings" else F.asc("difference")
    rows = rows.orderBy(order, "station_id")
    return rows if limit is None else rows.limit(limit)


def by_iconic_count(events: DataFrame, kind: str = "undockings", limit: int | None = None) -> DataFrame:
    """Stations by iconic count (most events first), equal ones by the ascending total over all types."""
    total = sum((F.col(f"{b}_{kind}") for b in ("boost", *BIKES)), F.lit(0))
    rows = events.withColumn("total", total)
    iconic = F.col(f"iconic_{kind}")
    rows = rows.orderBy(iconic.desc() if kind == "dockings" else iconic.asc(), "total", "station_id")
    return rows if limit is None else rows.limit(limit)


def running_totals(status: DataFrame) -> DataFrame:
    """Each row with its differences and the station's running dockings and undockings.

    Here the first row of a station counts its whole stock as docked.
    """
    columns = [STATION, "info_reported", "station_id", "last_reported", "is_charging_station", *BIKES.values()]
    rows = running_changes(status.select(*columns), BIKES)
    ways = {"dockings": "rises", "undockings": "falls"}
    return rows.select(
        *columns[2:],
        *[f"{bike}_diff" for bike in BIKES],
        *[F.col(f"{b}_{way}").alias(f"total_{b}_{name}") for b in BIKES for name, way in ways.items()],
    )


def changes_with_totals(status: DataFrame, query: StatusQuery = StatusQuery()) -> DataFrame:
    """Rows where a bike count changed, with the station's total dockings and undockings (null if none)."""
    wanted = query.on_status(status)
    rows = with_neighbours(wanted.select(STATION, "info_reported", "last_reported", *BIKES.values()), list(BIKES.values()))
    columns = []
    for bike, column in BIKES.items():
        before = F.col("_prev")[column]
        columns += [
            F.col(column).alias(bike),
            before.alias(f"prev_{bike}"),
            (F.col(column) - F.coalesce(before, F.col(column))).alias(f"delta_{bike}"),
        ]
    deltas = rows.select(F.col(STATION).alias("station_id"), "last_reported", *columns)
    changed = deltas.where(" or ".join(f"delta_{b} != 0" for b in BIKES))
    # the sums come from the same finished rows: status is read, exchanged and compared once
    pairs = rows.select(STATION, *BIKES.values(), *[F.col("_prev")[c].alias(f"prev_{c}") for c in BIKES.values()])
    sums = pairs.groupBy(STATION).agg(*[F.expr(f"sum({term}) as {name}") for name, term in docking_terms().items()])
    totals = sums.select(
        F.col(STATION).alias("station_id"),
        *[F.nullif(f"{b}_{kind}", F.lit(0)).alias(f"{kind}_{b}") for b in BIKES for kind in ("dockings", "undockings")],
    )
    return changed.join(totals, "station_id")


DELTA_FIELDS = {
    "bikes_available": "num_bikes_available",
    "bikes_disabled": "num_bikes_disabled",
    "docks_available": "num_docks_available",
    "docks_disabled": "num_docks_disabled",
    "vehicle_docks_available": "vehicle_docks_available",
    "boost": "vehicle_types_available_boost",
    "iconic": "vehicle_types_available_iconic",
    "efit": "vehicle_types_available_efit",
    "efit_g5": "vehicle_types_available_efit_g5",
}


def status_deltas(status: DataFrame) -> DataFrame:
    """Field-wise difference of consecutive rows of a station, from its second row on."""
    rows = with_neighbours(status, list(DELTA_FIELDS.values())).where("_prev is not null")
    return rows.select(
        F.col(STATION).alias("station_id"),
        "last_reported",
        *[(F.col(column) - F.col("_prev")[column]).alias(name) for name, column in DELTA_FIELDS.items()],
    )
