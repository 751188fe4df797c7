"""Merges into a stored table: which rows win, which files stay, and what a lost or repeated batch leaves."""

from __future__ import annotations

from datetime import datetime
from pathlib import Path

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dockpulse.sources.merged import MergedTable

SCHEMA = T.StructType(
    [T.StructField("station", T.IntegerType()), T.StructField("time", T.TimestampNTZType()), T.StructField("bikes", T.IntegerType())]
)
ONE, TWO, THREE = (datetime(2024, 1, day, 12) for day in (1, 2, 3))


@pytest.fixture
def table(spark, tmp_path):
    return MergedTable(spark, str(tmp_path / "table"), SCHEMA, ("station", "time"), F.col("time"))


def rows(spark, *values):
    return spark.createDataFrame(values, SCHEMA)


def content(table):
    return sorted(tuple(r) for r in table.rows().collect())


def files(table, day):
    return {p: p.stat().st_mtime_ns for p in Path(table.path, "rows").glob(f"*/part={day:%Y-%m-%d}/*.parquet")}


def test_stored_rows_stay_and_new_ones_are_added(spark, table):
    assert table.rows().collect() == []
    table.insert(rows(spark, (1, ONE, 5), (1, TWO, 6)), 0)
    table.insert(rows(spark, (1, ONE, 9), (2, TWO, 8), (2, TWO, 7), (2, TWO, 7)), 1)
    assert content(table) == [(1, ONE, 5), (1, TWO, 6), (2, TWO, 7)]


def test_files_of_other_days_stay(spark, table):
    table.insert(rows(spark, (1, ONE, 5), (1, TWO, 6), (1, THREE, 7)), 0)
    before = [files(table, day) for day in (ONE, TWO, THREE)]
    table.insert(rows(spark, (2, TWO, 1)), 1)
    table.upsert(rows(spark, (1, THREE, 70), (2, THREE, 71)), 2)
    assert content(table) == [(1, ONE, 5), (1, TWO, 6), (1, THREE, 70), (2, TWO, 1), (2, THREE, 71)]
    assert files(table, ONE) == before[0] and len(before[0]) == 1
    # no merge changes a file: a day has its old ones and those of the merges that touch it
    assert before[1].items() < files(table, TWO).items() and before[2].items() < files(table, THREE).items()
    assert table.vacuum() == 0  # the version before the last is still whole
    table.upsert(rows(spark, (1, THREE, 72)), 3)
    assert table.vacuum() == 1 and content(table)[2] == (1, THREE, 72)
    assert not before[2].keys() & files(table, THREE).keys()


def test_only_the_days_that_are_touched_are_read(spark, table):
    table.insert(rows(spark, (1, ONE, 5), (1, TWO, 6), (1, THREE, 7)), 0)
    assert {Path(f).parent.name for f in table.rows(TWO.date(), TWO.date()).inputFiles()} == {"part=2024-01-02"}
    for file in files(table, ONE):
        file.write_bytes(b"not read")
        Path(file.parent, f".{file.name}.crc").write_bytes(b"")
    table.insert(rows(spark, (2, TWO, 1)), 1)
    table.upsert(rows(spark, (1, THREE, 70)), 2)
    assert table.rows(TWO.date()).count() == 3


@pytest.mark.parametrize("merge", [MergedTable.insert, MergedTable.upsert])
def test_a_batch_that_runs_again_changes_nothing(spark, table, merge):
    table.insert(rows(spark, (1, ONE, 5), (1, TWO, 6)), 0)
    merge(table, rows(spark, (1, ONE, 9), (2, TWO, 7)), 1)
    after = content(table)
    merge(table, rows(spark, (1, ONE, 9), (2, TWO, 7)), 1)
    assert content(table) == after


@pytest.mark.parametrize("merge", [MergedTable.insert, MergedTable.upsert])
def test_a_batch_that_is_lost_before_its_end_is_not_seen(spark, table, merge, monkeypatch):
    table.insert(rows(spark, (1, ONE, 5)), 0)
    with monkeypatch.context() as patch:
        patch.setattr(table, "_publish", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            merge(table, rows(spark, (1, ONE, 9), (2, TWO, 7)), 1)
    assert content(table) == [(1, ONE, 5)]
    merge(table, rows(spark, (1, ONE, 9), (2, TWO, 7)), 1)
    assert content(table) == [(1, ONE, 5 if merge is MergedTable.insert else 9), (2, TWO, 7)]


def test_compaction_keeps_rows(spark, table):
    for n in range(4):
        table.insert(rows(spark, (n, ONE, n), *([(n, TWO, n)] if n == 0 else [])), n)
    assert len(table.live()) == 5
    kept, after = files(table, TWO), content(table)
    table.compact(4, most=3)
    assert table.live() == [(ONE.date(), 4), (TWO.date(), 0)] and content(table) == after and files(table, TWO) == kept


def test_nothing_to_merge(spark, table):
    table.insert(rows(spark), 0)
    table.upsert(rows(spark), 1)
    table.compact(2)
    assert table.rows().collect() == [] and table.live() == []


def test_rows_without_a_day_fail(spark, table):
    with pytest.raises(PySparkException, match="without a day"):
        table.insert(rows(spark, (1, None, 5)), 0)
    with pytest.raises(ValueError):
        MergedTable(spark, table.path, T.StructType([T.StructField("part", T.DateType())]), ("part",), F.col("part"))
