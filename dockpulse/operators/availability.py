"""Time integrals of the station counters and the factors made from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dockpulse.functions.neighbours import STATION, sums_over_neighbours
from dockpulse.operators.stations import active_information
from dockpulse.params import StatusQuery, epoch

COUNTERS = {
    "bikes_available": "num_bikes_available",
    "bikes_disabled": "num_bikes_disabled",
    "docks_available": "num_docks_available",
    "docks_disabled": "num_docks_disabled",
    "iconic_available": "vehicle_types_available_iconic",
    "efit_available": "vehicle_types_available_efit",
    "efit_g5_available": "vehicle_types_available_efit_g5",
}
BIKE_FACTORS = ("iconic_available", "efit_available", "efit_g5_available")
STATION_FACTORS = tuple(c for c in COUNTERS if c not in BIKE_FACTORS)


def integral_terms(within: tuple[int, int] | None = None) -> dict[str, str]:
    """Terms of the integrals over rows with a `ts` column; only between rows inside the range if one is given."""
    elapsed = "ts - prev_ts"
    if within is not None:
        elapsed = f"if(prev_ts >= {within[0]} and ts <= {within[1]}, {elapsed}, 0)"
    terms = {"total_seconds": elapsed}
    return terms | {f"{name}_seconds": f"{column} * ({elapsed})" for name, column in COUNTERS.items()}


def with_active_station(sums: DataFrame, information: DataFrame, query: StatusQuery) -> DataFrame:
    stations = active_information(query.on_information_station(information)).select(
        F.col("station_id").alias(STATION), F.col("is_charging_station").alias("charging"), "capacity"
    )
    return sums.join(stations, STATION, "inner").withColumnRenamed(STATION, "station_id")


def integrals(status: DataFrame, information: DataFrame, query: StatusQuery = StatusQuery()) -> DataFrame:
    """Per active station: each counter times the seconds since the row before, summed, and the seconds in all."""
    rows = query.on_status(status).withColumn("ts", epoch("last_reported"))
    return integrated(sums_over_neighbours(rows, integral_terms(), ["ts", *COUNTERS.values()]), information, query)


def integrated(sums: DataFrame, information: DataFrame, query: StatusQuery) -> DataFrame:
    """Integrals from their sums per station."""
    return with_active_station(sums, information, query).select("station_id", "charging", "capacity", *integral_terms())


def _factor(seconds: str) -> Column:
    """seconds / total / capacity; 1 where that is infinite, 0 where it is not a number."""
    value, total, capacity = F.col(seconds), F.col("total_seconds"), F.col("capacity")
    undefined = (total == 0) | (capacity == 0)
    return F.when(undefined, F.when(value == 0, F.lit(0.0)).otherwise(F.lit(1.0))).otherwise(
        value.cast("double") / total.cast("double") / capacity.cast("double")
    )


def with_factors(integral: DataFrame) -> DataFrame:
    """Integral rows with their factors; bike types also relative to their sum (null if that is 0)."""
    rows = integral.select("*", *[_factor(f"{name}_seconds").alias(f"{name}_factor") for name in COUNTERS])
    total = sum((F.col(f"{b}_factor") for b in BIKE_FACTORS[1:]), F.col(f"{BIKE_FACTORS[0]}_factor"))
    return rows.select(
        "*",
        *[F.when(total != 0, F.col(f"{b}_factor") / total).alias(f"{b}_factor_normalized") for b in BIKE_FACTORS],
    )


def factors(integral: DataFrame) -> DataFrame:
    """Availability factors alone."""
    return with_factors(integral).drop(*[f"{name}_seconds" for name in COUNTERS])


def factor_sums(factor: DataFrame) -> DataFrame:
    """Checks: the four station factors and the three normalised bike factors of a station add up to 1."""

    def total(names) -> Column:
        return sum((F.col(n) for n in names[1:]), F.col(names[0]))

    return factor.select(
        "station_id",
        total([f"{n}_factor" for n in STATION_FACTORS]).alias("station_factors"),
        total([f"{n}_factor_normalized" for n in BIKE_FACTORS]).alias("bike_factors"),
    )
