"""Request log and system information rows from feed documents."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockpulse.params import at, from_epoch
from dockpulse.sources import gbfs
from dockpulse.sources.tables import merge_by_key


def log_rows(documents: DataFrame, feed: gbfs.Feed, now: datetime | None = None) -> DataFrame:
    """One log row per document: its update time if it decodes, else the time of reading, a message, and the body if
    it is JSON at all (`null` otherwise).

    The id is a hash of the endpoint, the time and the document, so that a document that is read again in the same batch, or in a batch that is replayed
    with the same `now`, has the id it had. Different documents of one time differ in id."""
    read_at = F.current_timestamp().cast("timestamp_ntz") if now is None else at(now)
    rows = gbfs.parse(documents, feed).withColumn("success", gbfs.decoded(feed))
    body = F.when(F.try_parse_json("value").isNull(), F.lit("null")).otherwise(F.col("value"))
    time = F.when(F.col("success"), from_epoch(F.col("doc.last_updated"))).otherwise(read_at)
    return rows.select(
        F.xxhash64(F.lit(feed.endpoint), time.cast("string"), "value").alias("id"),
        time.alias("time"),
        F.lit(feed.endpoint).alias("endpoint"),
        "success",
        F.when(~F.col("success"), F.concat(F.lit("Decode failure: "), F.lit(feed.endpoint))).alias("error_msg"),
        F.when(~F.col("success"), body).alias("error_json"),
    )


def typed_bodies(log: DataFrame) -> DataFrame:
    """The log with its bodies as VARIANT: parsed once, before they are stored. No body stays null; a text that is no JSON is a JSON null, as in `log_rows`."""
    body = F.coalesce(F.try_parse_json("error_json"), F.parse_json(F.lit("null")))
    return log.withColumn("error_json", F.when(F.col("error_json").isNotNull(), body))


def system_rows(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(information, counts): one row each per document."""
    return gbfs.system_information(documents), gbfs.system_information_count(documents)


def append_log(existing: DataFrame, rows: DataFrame) -> DataFrame:
    """The log after new rows; rows whose id it has are left out."""
    return merge_by_key(existing, rows, ("id",))


def append_system(
    information: DataFrame, counts: DataFrame, documents: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(information, counts) after the documents: one row each per report time, the stored one if there is one."""
    new_information, new_counts = system_rows(documents)
    return merge_by_key(information, new_information, ("reported",)), merge_by_key(counts, new_counts, ("reported",))
