"""Data-quality checks."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dockpulse.functions.neighbours import STATION
from dockpulse.operators.stations import STATION_COUNTS, one_per_time, status_with_version
from dockpulse.params import StatusQuery


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows") for name, df in tables.items()]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionAll(part)
    return result


def orphaned_status(status: DataFrame, information: DataFrame, since: datetime | None = None) -> DataFrame:
    """Status rows whose information version does not exist."""
    keys = information.select(F.col("station_id").alias(STATION), F.col("reported").alias("info_reported"))
    return StatusQuery(earliest=since).on_status(status).join(keys, [STATION, "info_reported"], "left_anti")


def orphan_counts(status: DataFrame, information: DataFrame, since: datetime | None = None) -> DataFrame:
    return orphaned_status(status, information, since).groupBy("station_id").agg(F.count("*").alias("num"))


def orphan_keys(status: DataFrame, information: DataFrame, since: datetime | None = None) -> DataFrame:
    return orphaned_status(status, information, since).select("station_id", "last_reported", "info_reported")


def counter_sum() -> Column:
    return sum((F.col(c) for c in STATION_COUNTS[1:]), F.col(STATION_COUNTS[0]))


def checked_capacity(status: DataFrame, information: DataFrame, query: StatusQuery = StatusQuery()) -> DataFrame:
    """Status rows, one per time, with their version (null if it does not exist), `counter_sum` and `mismatch`."""
    rows = status_with_version(one_per_time(query.on_status(status)), information, "left")
    rows = rows.withColumn("counter_sum", counter_sum())
    return rows.withColumn("mismatch", F.coalesce(F.col("counter_sum") != F.col("version_capacity"), F.lit(False)))


def capacity_mismatches(status: DataFrame, information: DataFrame, query: StatusQuery = StatusQuery()) -> DataFrame:
    """Status rows whose counters do not add up to the capacity, with the number of rows examined."""
    examined = query.on_status(status).select(STATION, "last_reported").distinct().agg(F.count("*")).scalar()
    wrong = checked_capacity(status, information, query).where("mismatch").drop("mismatch")
    return wrong.withColumn("examined", examined)


def mismatch_summary(checked: DataFrame) -> DataFrame:
    """Rows examined, mismatched and right, with the range of capacities, of checked rows: one pass, also if all are right."""
    wrong = F.count_if("mismatch")
    capacity = F.when(F.col("mismatch"), F.col("version_capacity"))
    return checked.agg(
        F.count("*").alias("examined"),
        wrong.alias("mismatched"),
        F.min(capacity).alias("min_capacity"),
        F.max(capacity).alias("max_capacity"),
        (F.count("*") - wrong).alias("okay"),
    )


def status_counts(status: DataFrame, information: DataFrame) -> DataFrame:
    """One row: status rows without a version, and capacity mismatches, in one pass over the status table.

    Every row is looked up once; the rows of a station and time are then reduced to their number without version and the check of the newest.
    """
    versions = information.groupBy(
        F.col("station_id").alias(STATION), F.col("reported").alias("info_reported")
    ).agg(F.max("capacity").alias("_capacity"), F.lit(1).alias("_known"))
    rows = status.join(versions, [STATION, "info_reported"], "left")
    wrong = F.coalesce(counter_sum() != F.col("_capacity"), F.lit(False)).cast("int")
    per_time = rows.groupBy(STATION, "last_reported").agg(
        F.count_if(F.col("_known").isNull()).alias("_orphans"), F.max_by(wrong, "info_reported").alias("_wrong")
    )
    return per_time.agg(
        F.coalesce(F.sum("_orphans"), F.lit(0)).alias("orphaned"), F.coalesce(F.sum("_wrong"), F.lit(0)).alias("mismatched")
    )


def mismatch_frequencies(mismatches: DataFrame) -> DataFrame:
    return mismatches.groupBy("counter_sum").agg(F.count("*").alias("times"))


def rows_with_total(status: DataFrame) -> DataFrame:
    """Rows per station, each with the number of all rows: a scalar summed over the same counts, whose exchange is reused. No task sees all stations."""
    per_station = status.groupBy(STATION).agg(F.count("*").alias("n"))
    return per_station.withColumn("examined", F.coalesce(per_station.agg(F.sum("n")).scalar(), F.lit(0).cast("bigint")))


def duplicate_versions(information: DataFrame) -> DataFrame:
    return information.groupBy("station_id", "reported").agg(F.count("*").alias("copies")).where("copies > 1")


def latest_times(status: DataFrame, query: StatusQuery = StatusQuery()) -> DataFrame:
    return query.on_status(status).groupBy(STATION).agg(F.max("last_reported").alias("last_reported"))
