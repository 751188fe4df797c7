"""Rows that come late: compared with their neighbours of any day, by reading their own days only."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from dockpulse import schemas
from dockpulse.ingest.status import changes_backfill, corrected_changes, day_edges
from dockpulse.sources import tables
from fixtures import status_table

NAMES = schemas.STATION_STATUS.names
KEY = list(schemas.STATUS_KEY)


def history(days=40):
    rng, rows = random.Random(6), []
    for station in (1, 2, 3):
        for day in range(days):
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                when = datetime(2024, 1, 1) + timedelta(days=day, seconds=rng.randrange(86400))
                rows.append({"station_id": station, "last_reported": when, "num_bikes_available": rng.randrange(3)})
    return list({(r["station_id"], r["last_reported"]): r for r in rows}.values())


def plain(rows, late):
    """(station, time) -> changed, of the late rows and those after them."""
    found = {}
    for station in {r["station_id"] for r in rows}:
        mine = sorted((r for r in rows if r["station_id"] == station), key=lambda r: r["last_reported"])
        for before, r in zip([None, *mine], mine):
            if any(x is not None and (station, x["last_reported"]) in late for x in (r, before)):
                found[station, r["last_reported"]] = before is None or before["num_bikes_available"] != r["num_bikes_available"]
    return found


@pytest.mark.parametrize("seed, share", [(1, 0.02), (2, 0.3), (3, 1.0)])
def test_corrections_are_those_of_the_whole_history(spark, tmp_path, seed, share):
    rng, rows = random.Random(seed), history()
    late = {(r["station_id"], r["last_reported"]) for r in rows if rng.random() < share}
    status = status_table(spark, rows)
    tables.write_status(status, str(tmp_path / "status"), "overwrite")
    stored = spark.read.schema(schemas.STORED_STATUS).parquet(str(tmp_path / "status"))
    is_late = F.struct("station_id", "last_reported").isin([F.struct(F.lit(a), F.lit(b).cast("timestamp_ntz")) for a, b in late])
    few = status.where(is_late)
    # the edges come from two batches: all other rows, then the late ones
    days = day_edges(status.where(~is_late)).unionByName(day_edges(few))
    found = corrected_changes(few, stored, days=days)
    got = {(r.station_id, r.last_reported): r._changed for r in found.collect()}
    assert got == plain(rows, late)
    assert found.count() == len(got)
    whole = corrected_changes(few, stored)
    assert sorted(whole.collect(), key=str) == sorted(found.select(whole.columns).collect(), key=str)


def test_one_late_row_reads_its_day_only(spark, tmp_path):
    rows = history()
    status = status_table(spark, rows)
    tables.write_status(status, str(tmp_path / "status"), "overwrite")
    day_edges(status).write.parquet(str(tmp_path / "days"))
    stored = spark.read.schema(schemas.STORED_STATUS).parquet(str(tmp_path / "status"))
    one = status.where(F.col("last_reported") == rows[len(rows) // 2]["last_reported"])
    found = corrected_changes(one, stored, days=spark.read.parquet(str(tmp_path / "days")))
    assert 1 <= found.count() <= 2
    plan = found._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line and "PartitionFilters" in line and "reported_date" in line]
    day = str(rows[len(rows) // 2]["last_reported"].date())
    assert scans and all(day in line.split("PartitionFilters: [")[1].split("]")[0] for line in scans)


def test_changes_of_a_history_are_unaffected(spark):
    assert changes_backfill(status_table(spark, history())).count() > 0
