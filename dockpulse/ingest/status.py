"""Status rows: insert without copies, latest-row pointers, change capture and reference repair."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dockpulse import schemas
from dockpulse.functions.neighbours import STATION, TIME_ORDER, as_of, segment_of, with_neighbours
from dockpulse.operators.stations import attach_active_version, station_lookup
from dockpulse.params import StatusQuery, at
from dockpulse.sources.tables import merge_by_key, one_per_key

KEY = list(schemas.STATUS_KEY)


def new_rows(feed_status: DataFrame, information: DataFrame, existing: DataFrame) -> DataFrame:
    """Feed rows to append: known stations, with their active version, whose key is not stored yet.

    Only the time range of the feed rows needs to be passed as `existing`.
    """
    rows = attach_active_version(feed_status.where("last_reported is not null"), information)
    return one_per_key(rows, KEY).join(existing.select(*KEY), KEY, "left_anti").select(*rows.columns)


def insert(feed_status: DataFrame, information: DataFrame, existing: DataFrame) -> DataFrame:
    """The status table after the insert."""
    return existing.unionByName(new_rows(feed_status, information, existing).select(*existing.columns))


def updated_lookup(lookup: DataFrame, inserted: DataFrame) -> DataFrame:
    """Pointer table after an insert: the latest row of each station among the old pointer and the new rows."""
    pointers = lookup.select(
        "info_station_id", "info_reported", F.col("status_last_reported").alias("last_reported")
    ).unionByName(inserted.select(*KEY))
    return station_lookup(pointers)


# Columns whose change makes a row worth keeping.
TRIGGER_COLUMNS = tuple(c for c in schemas.STATION_STATUS.names if c not in ("info_reported", "last_reported"))
BATCH_COLUMNS = (
    "num_bikes_available",
    "num_bikes_disabled",
    "num_docks_available",
    "num_docks_disabled",
    "is_charging_station",
    "status",
    "is_installed",
    "is_renting",
    "is_returning",
    "vehicle_docks_available",
    "vehicle_types_available_iconic",
    "vehicle_types_available_efit",
    "vehicle_types_available_efit_g5",
)


def _changed(columns: Sequence[str]) -> Column:
    """Null never counts as a change, as in SQL `<>`."""
    result = F.lit(False)
    for name in columns:
        result = result | F.coalesce(F.col(name) != F.col("_prev")[name], F.lit(False))
    return result


def status_changes(
    status: DataFrame, columns: Sequence[str] = TRIGGER_COLUMNS, keep_first: bool = True
) -> DataFrame:
    """Rows that differ from the row before them. Since a stored change equals all rows up to the next change,
    this is also the comparison with the last stored change."""
    rows = with_neighbours(status, list(columns))
    wanted = _changed(columns)
    if keep_first:
        wanted = wanted | F.col("_prev").isNull()
    return rows.where(wanted).select(*status.columns)


def changes_backfill(status: DataFrame) -> DataFrame:
    """Change table of the whole history, without the first row of each station."""
    return status_changes(status, BATCH_COLUMNS, keep_first=False)


def changes_of_newest(status: DataFrame) -> DataFrame:
    """The newest row of each station if it differs from the one before it.

    Only two rows per station and task reach the exchange: the rank limit is applied before it.
    """
    newest = Window.partitionBy(STATION).orderBy(*[F.desc(c) for c in TIME_ORDER])
    two = status.withColumn("_n", F.row_number().over(newest)).where("_n <= 2")
    rows = two.withColumn("_prev", F.lead(F.struct(*BATCH_COLUMNS)).over(newest)).where("_n = 1")
    return rows.where(_changed(BATCH_COLUMNS)).select(*status.columns)


def append_changes(existing: DataFrame, changes: DataFrame) -> DataFrame:
    return merge_by_key(existing, changes, KEY)


def day_edges(status: DataFrame) -> DataFrame:
    """`info_station_id, _segment, first, last`: the first and the last row of each station and day, as structs. Those of several batches may be united and reduced again."""
    row, order = F.struct(*schemas.STATION_STATUS.names), F.struct(*TIME_ORDER)
    days = status.groupBy(STATION, segment_of("last_reported").alias("_segment"))
    return days.agg(F.min_by(row, order).alias("first"), F.max_by(row, order).alias("last"))


def _around(late: DataFrame, status: DataFrame, days: DataFrame) -> DataFrame:
    """The rows of the stations and days of late rows, and of each such day the last row before it and the first after it.

    The neighbouring days that have rows are found among `days`, a row per station and day; of the status table only the partitions of the late days are read.
    """
    touched = late.select(STATION, segment_of("last_reported").alias("_segment")).distinct()
    order = F.struct(*[F.col(f"row.{c}") for c in TIME_ORDER])
    edges = days.join(late.select(STATION).distinct(), STATION, "left_semi")
    edges = edges.select(STATION, "_segment", F.explode(F.array("first", "last")).alias("row")).groupBy(STATION, "_segment")
    edges = edges.agg(F.min_by("row", order).alias("first"), F.max_by("row", order).alias("last"))
    along = Window.partitionBy(STATION).orderBy("_segment")
    beside = edges.select(STATION, "_segment", F.lag("last").over(along).alias("before"), F.lead("first").over(along).alias("after"))
    beside = beside.join(touched, [STATION, "_segment"], "left_semi")
    beside = beside.select(F.explode(F.array_compact(F.array("before", "after"))).alias("row")).select("row.*")
    dates = [r[0] for r in late.select(F.to_date("last_reported")).distinct().collect()]
    inside = status.where(F.col(schemas.DATE_COLUMN).isin(dates)) if schemas.DATE_COLUMN in status.columns else status
    inside = inside.withColumn("_segment", segment_of("last_reported")).join(touched, [STATION, "_segment"], "left_semi")
    names = schemas.STATION_STATUS.names
    return inside.select(*names).unionByName(beside.select(*names)).dropDuplicates(KEY)


def corrected_changes(
    late: DataFrame, status: DataFrame, columns: Sequence[str] = TRIGGER_COLUMNS, days: DataFrame | None = None
) -> DataFrame:
    """What rows that came late alter: they and the rows after them, each with `_changed`, whether it differs from the row before it now.

    `status` holds all rows, the late ones included. With `days`, the `day_edges` of all these rows, only the days of late rows are read and the edges of the days
    beside them; without, all rows of the stations of late rows.
    """
    names = schemas.STATION_STATUS.names
    marks = late.select(*KEY, F.lit(True).alias("_late"))
    if days is None:
        rows = status.select(*names).join(late.select(STATION).distinct(), STATION, "left_semi")
    else:
        rows = _around(late, status, days)
    rows = rows.join(marks, KEY, "left").withColumn("_late", F.coalesce("_late", F.lit(False)))
    rows = with_neighbours(rows.select(*names, "_late"), [*columns, "_late"])
    touched = rows.where(F.col("_late") | F.coalesce(F.col("_prev")["_late"], F.lit(False)))
    return touched.select(*names, (_changed(columns) | F.col("_prev").isNull()).alias("_changed"))


# Repair of broken version references


def as_of_version(status: DataFrame, information: DataFrame, name: str = "version") -> DataFrame:
    """Status rows with the report time of the newest version that is not after the row."""
    versions = information.select("station_id", "reported").distinct()
    return as_of(status, versions, STATION, "last_reported", "station_id", "reported", name)


def repair_references(
    status: DataFrame,
    information: DataFrame,
    sentinel: datetime,
    query: StatusQuery = StatusQuery(),
    mode: str = "per_row",
    upper_limit: datetime | None = None,
) -> DataFrame:
    """Status with the sentinel references of the range replaced, rows that would become copies left out.

    `per_row` takes the newest version not after the row; `batch_max` the newest version not after the station's
    last broken row of the range. An upper limit replaces both times. Rows without such a version stay broken.
    """
    target = (F.col("info_reported") == at(sentinel)) & _within(query)
    broken, sound = status.where(target), status.where(~F.coalesce(target, F.lit(False)))
    versions = information.select(F.col("station_id").alias(STATION), "reported")
    if upper_limit is not None:
        newest = versions.where(F.col("reported") <= at(upper_limit)).groupBy(STATION).agg(F.max("reported").alias("_v"))
        fixed = broken.join(newest, STATION, "left")
    elif mode == "batch_max":
        limits = broken.groupBy(STATION).agg(F.max("last_reported").alias("_limit"))
        newest = (
            versions.join(limits, STATION)
            .where(F.col("reported") <= F.col("_limit"))
            .groupBy(STATION)
            .agg(F.max("reported").alias("_v"))
        )
        fixed = broken.join(newest, STATION, "left")
    elif mode == "per_row":
        fixed = as_of_version(broken, information, "_v")
    else:
        raise ValueError(f"unknown mode {mode}")
    fixed = fixed.withColumn("info_reported", F.coalesce("_v", "info_reported")).select(*status.columns)
    # a repaired row never replaces a row that was right; copies among repaired rows have one winner
    fresh = one_per_key(fixed, KEY).join(sound.select(*KEY), KEY, "left_anti").select(*status.columns)
    return sound.unionByName(fresh)


def _within(query: StatusQuery) -> Column:
    result = F.lit(True)
    if query.earliest is not None:
        result = result & (F.col("last_reported") >= at(query.earliest))
    if query.latest is not None:
        result = result & (F.col("last_reported") <= at(query.latest))
    if query.station_id is not None:
        result = result & (F.col(STATION) == query.station_id)
    return result
