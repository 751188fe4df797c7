"""Versioned station information."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dockpulse import schemas
from dockpulse.functions.ranking import ranked


def _differs(columns: Sequence[str]) -> Column:
    result = F.lit(False)
    for name in columns:
        result = result | ~F.col(f"new.{name}").eqNullSafe(F.col(f"old.{name}"))
    return result


def latest_snapshot(snapshot: DataFrame) -> DataFrame:
    """One row per station: the last reported one."""
    last = Window.partitionBy("station_id").orderBy(F.desc("reported"))
    return snapshot.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def compare(information: DataFrame, snapshot: DataFrame, ignore: Sequence[str] = ()) -> DataFrame:
    """Each station of the snapshot with `old` and `new` structs and its state: new, changed or same.

    Versions are compared on all described columns, not on the report time; `ignore` leaves out columns that
    flap, such as bluetooth_id.
    """
    columns = [c for c in schemas.INFORMATION_COMPARED if c not in ignore and c in information.columns]
    old = information.where("active").select("station_id", F.struct(*information.columns).alias("old"))
    new = latest_snapshot(snapshot).select("station_id", F.struct(*snapshot.columns).alias("new"))
    state = F.when(F.col("old").isNull(), "new").when(_differs(columns), "changed").otherwise("same")
    return new.join(old, "station_id", "left").withColumn("state", state)


def versions(information: DataFrame, snapshots: DataFrame, ignore: Sequence[str] = ()) -> DataFrame:
    """The versions that snapshots add: for each station, in the order of their report times, those that differ from the one before,
    the first of them from the active version. A batch of many snapshots adds what they would add one by one.

    Rows `_station`, `new` (a struct of the snapshot) and `_last` (whether it is the station's newest). A station has as many rows here as snapshots
    arrived together: one per poll.
    """
    columns = [c for c in schemas.INFORMATION_COMPARED if c not in ignore and c in information.columns]
    described = F.struct(*columns)
    stored = information.where("active").select(
        F.col("station_id").alias("_station"),
        F.lit(0).alias("_new"),
        F.col("reported").alias("_time"),
        described.alias("_described"),
        F.lit(None).cast(snapshots.select(F.struct(*snapshots.columns).alias("s")).schema["s"].dataType).alias("new"),
    )
    added = snapshots.select(
        F.col("station_id").alias("_station"),
        F.lit(1).alias("_new"),
        F.col("reported").alias("_time"),
        described.alias("_described"),
        F.struct(*snapshots.columns).alias("new"),
    )
    order = Window.partitionBy("_station").orderBy("_new", "_time", "_described")
    before = F.lag("_described").over(order)
    rows = stored.unionByName(added).withColumn("_changed", ~before.eqNullSafe(F.col("_described")))
    rows = rows.where("_new = 1 and _changed")
    newest = F.lead("_station").over(Window.partitionBy("_station").orderBy("_time", "_described"))
    return rows.select("_station", "new", newest.isNull().alias("_last"))


def inserted(information: DataFrame, snapshot: DataFrame, ignore: Sequence[str] = ()) -> DataFrame:
    """Versions to add, of each station the last one active. Ids go on from the greatest of the table, by report time and station: unique
    over all stations, because status rows and lookups name a version by its id. The added rows are numbered by ranges of that order and written with their numbers,
    so a first load of any size is no single task and two readers see the same ids."""
    top = F.coalesce(information.agg(F.max("id")).scalar(), F.lit(0))
    rows = ranked(versions(information, snapshot, ignore), F.col("new.reported").asc(), F.col("_station").asc(), name="_number")
    rows = rows.withColumn("_id", (top + F.col("_number")).cast("int"))
    values = {"id": F.col("_id"), "active": F.col("_last")}
    return rows.select(
        *[
            values.get(f.name, F.col(f"new.{f.name}") if f.name in snapshot.columns else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in information.schema
        ]
    )


def updated(information: DataFrame, snapshot: DataFrame, ignore: Sequence[str] = ()) -> DataFrame:
    """Active versions that the snapshot replaces, as inactive rows."""
    replaced = versions(information, snapshot, ignore).select(F.col("_station").alias("station_id")).distinct()
    rows = information.where("active").join(replaced, "station_id", "left_semi")
    return rows.select(*information.columns).withColumn("active", F.lit(False))


def merge(information: DataFrame, snapshot: DataFrame, ignore: Sequence[str] = ()) -> DataFrame:
    """The whole dimension after the snapshots; stations missing from them stay active."""
    fresh = inserted(information, snapshot, ignore)
    replaced = fresh.select("station_id").distinct().withColumn("_replaced", F.lit(True))
    kept = information.join(replaced, "station_id", "left").withColumn(
        "active", F.col("active") & F.col("_replaced").isNull()
    )
    return kept.select(*information.columns).unionByName(fresh)


def deduplicated(information: DataFrame) -> DataFrame:
    """One row per station and report time: the one of the smallest id."""
    first = Window.partitionBy("station_id", "reported").orderBy("id")
    return information.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def repointed(status_ids: DataFrame, information: DataFrame) -> DataFrame:
    """Rows whose info_id is replaced by the kept id of the same station version.

    The kept ids come from an aggregate that is reduced before the exchange, so that a version with very many copies
    is never gathered in one task.
    """
    version = ["station_id", "reported"]
    first = information.groupBy(*version).agg(F.min("id").alias("_kept"))
    kept = information.join(first, version).select(F.col("id").alias("info_id"), "_kept")
    rows = status_ids.join(kept, "info_id", "left")
    return rows.withColumn("info_id", F.coalesce("_kept", "info_id")).select(*status_ids.columns)
