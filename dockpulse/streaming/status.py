"""Streams of status rows: without copies, changes only, latest row per station, totals on a grid.

The stateful steps run in `foreachBatch` with the batch operators, so that a station which sends most of the rows
is split by time there as well; the state between batches is one row per station, in a versioned table.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from dockpulse import schemas
from dockpulse.functions.neighbours import STATION
from dockpulse.ingest import status as batch
from dockpulse.operators.stations import latest_key
from dockpulse.operators.system import GRID_COUNTERS
from dockpulse.params import epoch_of
from dockpulse.schemas import DATE_COLUMN
from dockpulse.sources import gbfs
from dockpulse.sources.tables import one_per_key, write_status
from dockpulse.streaming import store

KEY = list(schemas.STATUS_KEY)
LOOKUP = T.StructType(
    [
        T.StructField("info_station_id", T.IntegerType()),
        T.StructField("info_reported", T.TimestampNTZType()),
        T.StructField("status_last_reported", T.TimestampNTZType()),
    ]
)


def rows(documents: DataFrame) -> DataFrame:
    """Status rows of a document stream; the batch function, unchanged."""
    return gbfs.station_status(documents)


def event_time(stream: DataFrame, delay: str) -> DataFrame:
    """Watermarks need a zoned timestamp: an extra column, the stored one stays."""
    return stream.withColumn("event_time", F.col("last_reported").cast("timestamp")).withWatermark("event_time", delay)


def _existing(spark: SparkSession, path: str, batch_rows: DataFrame, schema: T.StructType = schemas.STORED_STATUS) -> DataFrame:
    """Stored rows of the days that a batch touches, and of no day between them."""
    if not store.exists(spark, path):
        return spark.createDataFrame([], schema)
    days = [r[0] for r in batch_rows.select(F.to_date("last_reported")).distinct().collect()]
    stored = spark.read.schema(schema).parquet(path)
    return stored.where(F.col(DATE_COLUMN).isin([d for d in days if d is not None]))


def _append(spark: SparkSession, rows: DataFrame, path: str, key: list[str], schema: T.StructType) -> None:
    """Append by day the rows whose key is not stored yet: a replayed batch finds its rows and appends nothing. The rows are computed once, for their days and for themselves."""
    rows = rows.persist()
    try:
        existing = _existing(spark, path, rows, schema)
        fresh = one_per_key(rows, key).join(existing.select(*key), key, "left_anti")
        write_status(fresh.select(*[n for n in schema.names if n != DATE_COLUMN]), path)
    finally:
        rows.unpersist()


FEED_KEY = ["station_id", "last_reported"]
STORED_FEED = T.StructType([f for f in schemas.STORED_STATUS if f.name not in ("info_station_id", "info_reported")])


def without_copies_each(stream: DataFrame, path: str) -> DataStreamWriter:
    """Feed rows by day, one per station and time, however late a copy or a row arrives."""

    def keep(frame: DataFrame, batch_id: int) -> None:
        _append(frame.sparkSession, frame.where("last_reported is not null"), path, FEED_KEY, STORED_FEED)

    return stream.writeStream.foreachBatch(keep)


# The current stations: a frame, or a function that reads them anew for each batch.
Stations = DataFrame | Callable[[SparkSession], DataFrame]


def insert_each(stream: DataFrame, information: Stations, path: str) -> DataStreamWriter:
    """Append new rows to the status table by day, with the version of their station that is active when the batch runs.

    A replayed batch finds its rows stored and appends nothing. A frame of stations is fixed when the stream starts; pass a function, such as one that calls
    `feed.current_information`, to see stations and versions that come later.
    """

    def insert(frame: DataFrame, batch_id: int) -> None:
        spark, frame = frame.sparkSession, frame.persist()
        try:
            current = information(spark) if callable(information) else information
            fresh = batch.new_rows(frame, current, _existing(spark, path, frame))
            write_status(fresh.select(*schemas.STATION_STATUS.names), path)
        finally:
            frame.unpersist()

    return stream.writeStream.foreachBatch(insert)


CORRECTION = T.StructType(
    [*schemas.STATION_STATUS.fields, T.StructField("_changed", T.BooleanType()), T.StructField("_batch", T.LongType())]
)


DAYS = T.StructType(
    [
        T.StructField(STATION, T.IntegerType()),
        T.StructField("_segment", T.IntegerType()),
        T.StructField("first", schemas.STATION_STATUS),
        T.StructField("last", schemas.STATION_STATUS),
    ]
)


def capture(frame: DataFrame, batch_id: int, path: str, status: DataFrame | None = None) -> None:
    """Change rows of one batch under `path/changes`, by day; the latest row per station under `path/latest`.

    A row that is not newer than the station's latest known row falls between rows already compared. With `status`, all stored rows
    including this batch, it and the row after it are compared anew, and the results go to `path/corrections`; without, such
    rows are kept under `path/late`. The first and last row of every station and day are kept under `path/days`, so that a late row costs the rows
    of its day, and not the history of its station; `status` has no rows that did not pass here.
    """
    spark, columns = frame.sparkSession, schemas.STATION_STATUS.names
    frame = one_per_key(frame.select(*columns), KEY).persist()
    try:
        known = store.read_before(spark, f"{path}/latest", batch_id, schemas.STATION_STATUS)
        times = known.select(STATION, F.col("last_reported").alias("_known"))
        dated = frame.join(times, STATION, "left")
        is_late = F.coalesce(F.col("last_reported") <= F.col("_known"), F.lit(False))
        timely, late = dated.where(~is_late).select(*columns), dated.where(is_late).select(*columns)
        # a row that is known as the latest comes again when a batch is replayed or its source repeats itself
        late = late.join(known.select(*KEY), KEY, "left_anti").select(*columns)
        tagged = timely.withColumn("_new", F.lit(True)).unionByName(known.withColumn("_new", F.lit(False)))
        changes = batch.status_changes(tagged).where("_new").select(*columns)
        _append(spark, changes, f"{path}/changes", KEY, schemas.STORED_STATUS)
        if status is None:
            _append(spark, late, f"{path}/late", KEY, schemas.STORED_STATUS)
        else:
            store.write_version(batch.day_edges(frame), f"{path}/days", batch_id)
        if status is not None and not late.isEmpty():
            days = store.read_all(spark, f"{path}/days", DAYS)
            found = batch.corrected_changes(late, status, days=days).withColumn("_batch", F.lit(batch_id).cast("long"))
            store.write_version(found, f"{path}/corrections", batch_id)
        newest = tagged.groupBy(STATION).agg(*[F.max_by(c, latest_key()).alias(c) for c in columns if c != STATION])
        store.write_version(newest.select(*columns), f"{path}/latest", batch_id)
        store.drop_old_versions(spark, f"{path}/latest", batch_id)
    finally:
        frame.unpersist()


def changes_each(stream: DataFrame, path: str, status: Stations | None = None) -> DataStreamWriter:
    """Capture the changes of every batch of status rows with their information key; see `capture`."""

    def run(frame: DataFrame, batch_id: int) -> None:
        rows = status(frame.sparkSession) if callable(status) else status
        capture(frame, batch_id, path, rows)

    return stream.writeStream.foreachBatch(run)


def captured_changes(spark: SparkSession, path: str) -> DataFrame:
    """The change table: of rows that were compared again, the last comparison counts."""
    columns = schemas.STATION_STATUS.names
    changes = _stored(spark, f"{path}/changes", schemas.STORED_STATUS).select(*columns)
    again = store.read_all(spark, f"{path}/corrections", CORRECTION)
    last = again.groupBy(*KEY).agg(F.max("_batch").alias("_batch"))
    again = again.join(last, [*KEY, "_batch"], "left_semi")
    kept = changes.join(again.select(*KEY), KEY, "left_anti")
    return kept.select(*columns).unionByName(again.where("_changed").select(*columns))


def late_rows(spark: SparkSession, path: str) -> DataFrame:
    return _stored(spark, f"{path}/late", schemas.STORED_STATUS).select(*schemas.STATION_STATUS.names)


def _stored(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path) if store.exists(spark, path) else spark.createDataFrame([], schema)


def lookup_each(stream: DataFrame, path: str) -> DataStreamWriter:
    """Keep the pointer to every station's latest row."""

    def update(frame: DataFrame, batch_id: int) -> None:
        spark = frame.sparkSession
        known = store.read_before(spark, path, batch_id, LOOKUP)
        store.write_version(batch.updated_lookup(known, frame), path, batch_id)
        store.drop_old_versions(spark, path, batch_id)

    return stream.writeStream.foreachBatch(update)


def grid_totals(stream: DataFrame, step: timedelta, delay: str, start: datetime | None = None) -> DataFrame:
    """System totals per window, as in the batch grid: the latest status of each station, then their sum.

    Windows begin at `start`, as the batch grid does, or at midnight of 1970 without one. They are emitted in append mode once the watermark has passed them; rows that
    come later are in the status table and so in the batch grid.
    """
    order = latest_key() if "info_reported" in stream.columns else F.col("last_reported")
    seconds = int(step.total_seconds())
    offset = 0 if start is None else epoch_of(start) % seconds
    window = F.window("event_time", f"{seconds} seconds", startTime=f"{offset} seconds")
    latest = (
        event_time(stream, delay).groupBy(window, STATION).agg(*[F.max_by(c, order).alias(c) for c in GRID_COUNTERS])
    )
    totals = latest.groupBy("window").agg(*[F.sum(c).alias(c) for c in GRID_COUNTERS])
    return totals.select(F.col("window.end").cast("timestamp_ntz").alias("time"), *GRID_COUNTERS)
