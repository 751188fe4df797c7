"""Late rows, replays and restarts of the streams."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from dockpulse import schemas
from dockpulse.adapter import Tables
from dockpulse.ingest.status import status_changes
from dockpulse.registry import streams
from dockpulse.streaming import status as stream
from dockpulse.streaming import store
from fixtures import event_status


def run(spark, folder, sink):
    rows = spark.readStream.schema(schemas.STATION_STATUS).parquet(f"{folder}/in")
    job = sink(rows).option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).start()
    job.awaitTermination()


def test_late_rows_are_kept_aside(spark, tmp_path):
    status = event_status(spark)
    middle = F.col("last_reported") == F.lit(datetime(2023, 1, 1, 0, 5))
    for part in (status.where(~middle), status.where(middle)):
        part.write.mode("append").parquet(f"{tmp_path}/in")
        run(spark, tmp_path, lambda s: stream.changes_each(s, f"{tmp_path}/out"))
    late = stream.late_rows(spark, f"{tmp_path}/out")
    assert [r.last_reported for r in late.collect()] == [datetime(2023, 1, 1, 0, 5)]
    timely = status_changes(status.where(~middle)).count()
    assert stream.captured_changes(spark, f"{tmp_path}/out").count() == timely


def test_replayed_batch_overwrites_itself(spark, tmp_path):
    path = str(tmp_path / "state")
    one, two = spark.range(1), spark.range(2)
    store.write_version(one, path, 0)
    store.write_version(two, path, 1)
    store.write_version(two, path, 1)
    assert store.read_before(spark, path, 1, one.schema).count() == 1
    assert store.read_latest(spark, path, one.schema).count() == 2
    store.write_version(one, path, 2)
    store.drop_old_versions(spark, path, 2)
    assert store._versions(spark, path) == [1, 2]


def test_incomplete_version_is_not_read(spark, tmp_path):
    path = tmp_path / "state"
    store.write_version(spark.range(1), str(path), 0)
    (path / "version=1").mkdir()
    assert store.read_before(spark, str(path), 2, spark.range(1).schema).count() == 1


def test_lookup_never_goes_back(spark, tmp_path):
    status = event_status(spark)
    cut = datetime(2023, 1, 1) + timedelta(minutes=8)
    for part in (status.where(F.col("last_reported") >= F.lit(cut)), status.where(F.col("last_reported") < F.lit(cut))):
        part.write.mode("append").parquet(f"{tmp_path}/in")
        run(spark, tmp_path, lambda s: stream.lookup_each(s, f"{tmp_path}/lookup"))
    lookup = store.read_latest(spark, f"{tmp_path}/lookup", stream.LOOKUP).collect()
    assert [r.status_last_reported for r in lookup] == [datetime(2023, 1, 1, 0, 15)]


def test_slices_of_documents_are_cut_before_they_are_documents(spark):
    """A slice neither makes nor parses the documents of the others, and the slices are the whole."""
    t = Tables(spark, "/root/testdata/sf0.001")
    slices = streams._document_slices(t)
    assert all("$.last_updated" not in s._jdf.queryExecution().optimizedPlan().toString() for s in slices)
    found = [r.value for s in slices for r in s.collect()]
    assert sorted(found) == sorted(r.value for r in t.status_documents().collect())
