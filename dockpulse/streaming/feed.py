"""Streams of station information, request log rows and feed envelopes."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from dockpulse import schemas
from dockpulse.ingest import feedlog, information
from dockpulse.operators import staleness
from dockpulse.sources import gbfs
from dockpulse.streaming import store


def merge_information_each(stream: DataFrame, path: str, ignore: Sequence[str] = ()) -> DataStreamWriter:
    """Merge every batch of station rows into the versioned dimension. However snapshots are dealt into batches in the order of
    their times, the versions are the same."""

    def merge(frame: DataFrame, batch_id: int) -> None:
        spark = frame.sparkSession
        known = store.read_before(spark, path, batch_id, schemas.STATION_INFORMATION)
        store.write_version(information.merge(known, frame, ignore), path, batch_id)
        store.drop_old_versions(spark, path, batch_id)

    return stream.writeStream.foreachBatch(merge)


def current_information(spark: SparkSession, path: str) -> DataFrame:
    return store.read_latest(spark, path, schemas.STATION_INFORMATION)


def log_stream(documents: DataFrame, kind: gbfs.Feed, now: datetime | None = None) -> DataFrame:
    """Log rows of a document stream; failed documents are the error stream."""
    return feedlog.log_rows(documents, kind, now)


def envelopes(documents: DataFrame, kind: gbfs.Feed, feed: str) -> DataFrame:
    """(feed, endpoint, updated, ttl, value) of every document that decodes."""
    parsed = gbfs.parse(documents, kind).where(gbfs.decoded(kind))
    return parsed.select(
        F.lit(feed).alias("feed"),
        F.lit(kind.endpoint).alias("endpoint"),
        F.col("doc.last_updated").alias("updated"),
        F.col("doc.ttl").cast("long").alias("ttl"),
        "value",
    )


_DUE = T.StructType([T.StructField("endpoint", T.StringType()), T.StructField("due", T.LongType())])


def fresh_each(stream: DataFrame, path: str) -> DataStreamWriter:
    """Envelopes (feed, endpoint, updated, ttl) that are not stale, a part per batch under `path/accepted`.

    One is accepted if its update time is at least that of the last accepted one plus its ttl. That sum is all the state, one number
    per feed and endpoint. Inside a batch the batch operator runs, split by day, so a backlog is not one task. Of envelopes with equal times one counts.
    """
    names = ("feed", "endpoint", "updated", "ttl")

    def accept(frame: DataFrame, batch_id: int) -> None:
        spark = frame.sparkSession
        due = store.read_before(spark, f"{path}/due", batch_id, _DUE)
        both = F.concat_ws("\n", "feed", "endpoint").alias("endpoint")
        ttl = F.col("ttl").cast("long")
        fresh = staleness.fresh_responses(frame.select(both, "updated", ttl.alias("ttl"), ttl.alias("id")), due)
        parts = F.split("endpoint", "\n")
        rows = fresh.select(parts[0].alias("feed"), parts[1].alias("endpoint"), "updated", "ttl")
        store.write_version(rows, f"{path}/accepted", batch_id)
        written = spark.read.schema(rows.schema).parquet(f"{path}/accepted/version={batch_id}")
        left = written.groupBy(both).agg(F.max(F.col("updated") + F.col("ttl")).alias("due"))
        left = left.unionByName(due).groupBy("endpoint").agg(F.max("due").alias("due"))
        store.write_version(left, f"{path}/due", batch_id)
        store.drop_old_versions(spark, f"{path}/due", batch_id)

    return stream.select(*names).writeStream.foreachBatch(accept)


def accepted(spark: SparkSession, path: str) -> DataFrame:
    return store.read_all(spark, f"{path}/accepted", ACCEPTED)


ACCEPTED = T.StructType(
    [
        T.StructField("feed", T.StringType()),
        T.StructField("endpoint", T.StringType()),
        T.StructField("updated", T.LongType()),
        T.StructField("ttl", T.LongType()),
    ]
)
