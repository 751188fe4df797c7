"""The whole poll as one stream: documents of the feed become rows of all tables.

Every batch runs the same steps in the same order, each on what the ones before it stored: log, information, status, lookup, system counts,
changes. Each step writes a version of its own or appends by key, so that a batch that is replayed after any of them writes the same again.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from dockpulse import schemas
from dockpulse.ingest import feedlog, information
from dockpulse.ingest import status as batch
from dockpulse.sources import gbfs
from dockpulse.sources.tables import write_status
from dockpulse.streaming import status as stream
from dockpulse.streaming import store

LOGGED = (
    gbfs.STATION_INFORMATION,
    gbfs.STATION_STATUS,
    gbfs.SYSTEM_INFORMATION,
    gbfs.VEHICLE_TYPES,
    gbfs.REGIONS,
    gbfs.PRICING_PLANS,
    gbfs.VERSIONS,
)

DOCUMENTS = T.StructType([T.StructField("endpoint", T.StringType()), T.StructField("value", T.StringType())])


def poll(documents: DataFrame, batch_id: int, folder: str, now: datetime | None = None, ignore: Sequence[str] = ()) -> None:
    """Take documents `endpoint, value` into the tables below a folder.

    Status rows of stations that are in no information document so far are left out; a station and its first status may come in the
    same batch. The documents are written once, by endpoint, and each step reads those of its own: what a batch costs does not depend on whether its documents fit the
    executors' memory.
    """
    spark = documents.sparkSession
    store.write_version(documents.select(*DOCUMENTS.names).where(F.col("endpoint").isin([f.endpoint for f in LOGGED])), f"{folder}/documents", batch_id, "endpoint")
    kept = spark.read.schema(DOCUMENTS).parquet(f"{folder}/documents/version={batch_id}")
    offered = None
    try:
        of = lambda feed: kept.where(F.col("endpoint") == feed.endpoint).select("value")
        logs = [feedlog.log_rows(of(feed), feed, now) for feed in LOGGED]
        rows = logs[0]
        for more in logs[1:]:
            rows = rows.unionByName(more)
        store.write_version(rows.dropDuplicates(["id"]), f"{folder}/queries", batch_id)

        known = store.read_before(spark, f"{folder}/information", batch_id, schemas.STATION_INFORMATION)
        store.write_version(
            information.merge(known, gbfs.station_information(of(gbfs.STATION_INFORMATION)), ignore),
            f"{folder}/information",
            batch_id,
        )
        stations = store.read_before(spark, f"{folder}/information", batch_id + 1, schemas.STATION_INFORMATION)
        store.drop_old_versions(spark, f"{folder}/information", batch_id)

        # what this batch inserts is written before it is appended: a replay finds it, although the status table has the rows already
        path = f"{folder}/inserted/version={batch_id}"
        if not store.exists(spark, f"{path}/_SUCCESS"):
            offered = gbfs.station_status(of(gbfs.STATION_STATUS)).persist()
            fresh = batch.new_rows(offered, stations, stream._existing(spark, f"{folder}/status", offered))
            store.write_version(fresh.select(*schemas.STATION_STATUS.names), f"{folder}/inserted", batch_id)
        inserted = spark.read.schema(schemas.STATION_STATUS).parquet(path)
        stored = stream._existing(spark, f"{folder}/status", inserted)
        write_status(inserted.join(stored.select(*stream.KEY), stream.KEY, "left_anti").select(*schemas.STATION_STATUS.names), f"{folder}/status")

        pointers = store.read_before(spark, f"{folder}/lookup", batch_id, stream.LOOKUP)
        store.write_version(batch.updated_lookup(pointers, inserted), f"{folder}/lookup", batch_id)
        store.drop_old_versions(spark, f"{folder}/lookup", batch_id)

        counts = store.read_before(spark, f"{folder}/system_counts", batch_id, schemas.SYSTEM_INFORMATION_COUNT)
        described = store.read_before(spark, f"{folder}/system_information", batch_id, schemas.SYSTEM_INFORMATION)
        described, counts = feedlog.append_system(described, counts, of(gbfs.SYSTEM_INFORMATION))
        for name, table in (("system_information", described), ("system_counts", counts)):
            store.write_version(table, f"{folder}/{name}", batch_id)
            store.drop_old_versions(spark, f"{folder}/{name}", batch_id)

        stream.capture(inserted, batch_id, folder, spark.read.schema(schemas.STORED_STATUS).parquet(f"{folder}/status"))
        store.drop_old_versions(spark, f"{folder}/inserted", batch_id)
        store.drop_old_versions(spark, f"{folder}/documents", batch_id, keep=1)
    finally:
        if offered is not None:
            offered.unpersist()


def poll_each(documents: DataFrame, folder: str, now: datetime | None = None, ignore: Sequence[str] = ()) -> DataStreamWriter:
    """Run `poll` on every batch of a stream of documents."""
    return documents.writeStream.foreachBatch(lambda frame, batch_id: poll(frame, batch_id, folder, now, ignore))


def status_table(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.read.schema(schemas.STORED_STATUS).parquet(f"{folder}/status")
    return rows.select(*schemas.STATION_STATUS.names)


def information_table(spark: SparkSession, folder: str) -> DataFrame:
    return store.read_latest(spark, f"{folder}/information", schemas.STATION_INFORMATION)


def lookup_table(spark: SparkSession, folder: str) -> DataFrame:
    return store.read_latest(spark, f"{folder}/lookup", stream.LOOKUP)


def query_log(spark: SparkSession, folder: str) -> DataFrame:
    """The log; of a document that came in several batches the row of the first time counts."""
    return store.read_all(spark, f"{folder}/queries", schemas.QUERY_LOG).dropDuplicates(["id"])


def system_counts(spark: SparkSession, folder: str) -> DataFrame:
    return store.read_latest(spark, f"{folder}/system_counts", schemas.SYSTEM_INFORMATION_COUNT)


def change_table(spark: SparkSession, folder: str) -> DataFrame:
    return stream.captured_changes(spark, folder)
