"""Streams, run to the end over files that Spark derives from the test tables.

The files arrive in slices of time, one run of the stream per slice on the same checkpoint, so that every stream
also restarts from its state three times.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from dockpulse import schemas
from dockpulse.adapter import SNAPSHOT, Tables
from dockpulse.operators import staleness
from dockpulse.params import at, epoch
from dockpulse.registry.base import NOW, START, query
from dockpulse.registry.ingest import _IMPORTED, _LOGGED, _VERSION, CHANGES_SQL, LOG_SQL
from dockpulse.registry.operators import GRID_SQL
from dockpulse.session import shared_dir
from dockpulse.sources import gbfs
from dockpulse.streaming import feed, poll, status, store

SHUFFLED = (2, 0, 3, 1)
SLICES = (datetime(2024, 1, 9), datetime(2024, 1, 17), datetime(2024, 1, 25), datetime(2024, 2, 2))


def _slices(rows: DataFrame, time: str) -> list[DataFrame]:
    """The rows split by time into parts that together are the whole."""
    parts, lower = [], F.lit(True)
    for end in SLICES[:-1]:
        parts.append(rows.where(lower & (F.col(time) < at(end))))
        lower = F.col(time) >= at(end)
    return [*parts, rows.where(lower)]


class Run:
    """A fresh folder for the input, checkpoint and output of one streaming run."""

    def __init__(self, t: Tables, name: str):
        self.spark, self.name = t.spark, name
        self.folder = f"{shared_dir(t.spark)}/streams/{name}-{uuid.uuid4().hex}"

    def path(self, part: str) -> str:
        return f"{self.folder}/{part}"

    def feed_slices(self, slices: list[DataFrame], sink: Callable[[DataFrame], DataStreamWriter], text: bool) -> None:
        """Write each slice and run the stream over what is new."""
        for rows in slices:
            writer = rows.write.mode("append")
            writer.text(self.path("in")) if text else writer.parquet(self.path("in"))
            reader = self.spark.readStream
            stream = reader.format("text").load(self.path("in")) if text else reader.schema(rows.schema).parquet(self.path("in"))
            job = sink(stream).option("checkpointLocation", self.path("checkpoint")).trigger(availableNow=True).start()
            job.awaitTermination()

    def to_parquet(self, stream: DataFrame) -> DataStreamWriter:
        return stream.writeStream.format("parquet").option("path", self.path("out"))

    def result(self) -> DataFrame:
        return self.spark.read.parquet(self.path("out"))


_FEED = ", ".join(schemas.STATUS_FEED_COLUMNS)


def _document_slices(t: Tables) -> list[DataFrame]:
    """The documents by time. The rows are cut before they become documents: a slice reads its own part, and no document is parsed for its time."""
    return [t.status_documents(part) for part in _slices(t.status(), "last_reported")]


@query("st1_status_rows", f"select {_FEED} from ss")
def status_rows(t):
    run = Run(t, "rows")
    run.feed_slices(_document_slices(t), lambda s: run.to_parquet(status.rows(s)), text=True)
    return run.result()


@query("st2_without_copies", f"select {_FEED} from ss")
def without_copies(t):
    """Every slice is delivered with a copy of its rows, the slices out of order."""
    run = Run(t, "copies")
    slices = [part.unionAll(part) for part in _slices(t.status().select(*schemas.STATUS_FEED_COLUMNS), "last_reported")]
    run.feed_slices([slices[i] for i in SHUFFLED], lambda s: status.without_copies_each(s, run.path("out")), text=False)
    return run.result().select(*schemas.STATUS_FEED_COLUMNS)


@query("st2_exact_insert", _IMPORTED)
def exact_insert(t):
    """The first slice is delivered twice, in two runs; the stations are read anew for each batch."""
    run = Run(t, "insert")
    slices = _slices(t.status().select(*schemas.STATUS_FEED_COLUMNS), "last_reported")
    sink = lambda s: status.insert_each(s, lambda _: t.information(), run.path("out"))
    run.feed_slices([slices[0], *slices], sink, text=False)
    return run.result().select(*schemas.STATION_STATUS.names)


@query("st3_change_stream", f"select * from {CHANGES_SQL.format(first='rn = 1 or')} c")
def change_stream(t):
    run = Run(t, "changes")
    run.feed_slices(_slices(t.status(), "last_reported"), lambda s: status.changes_each(s, run.path("out")), text=False)
    return status.captured_changes(t.spark, run.path("out"))


_RESPONSES = """(select endpoint, epoch("time")::bigint updated, (30 * (1 + cast(id % 40 as int)))::bigint ttl, id
  from ql qualify row_number() over (partition by endpoint, "time" order by id) = 1)"""
FRESH_SQL = f"""
  with recursive rs as materialized (
    select *, row_number() over (partition by endpoint order by updated) n from {_RESPONSES} r),
  nx as materialized (
    select a.endpoint, a.n, min(b.n) m from rs a join rs b on a.endpoint = b.endpoint and b.updated >= a.updated + a.ttl
    group by 1, 2),
  chain as (select endpoint, 1::bigint n from rs where n = 1
            union all select chain.endpoint, nx.m from chain join nx on nx.endpoint = chain.endpoint and nx.n = chain.n)
  select {{columns}} from chain join rs on rs.endpoint = chain.endpoint and rs.n = chain.n"""


def _responses(t: Tables) -> DataFrame:
    ttl = (F.lit(30) * (1 + F.col("id") % 40)).cast("long")
    return t.query_log().select("endpoint", epoch("time").alias("updated"), ttl.alias("ttl"), "id")


@query("st4_fresh_responses", FRESH_SQL.format(columns="rs.endpoint, rs.updated, rs.ttl, rs.id"))
def fresh_responses(t):
    return staleness.fresh_responses(_responses(t))


@query("st4_fresh_stream", FRESH_SQL.format(columns="'feed' feed, rs.endpoint, rs.updated, rs.ttl"))
def fresh_stream(t):
    run = Run(t, "fresh")
    first = _responses(t).groupBy("endpoint", "updated").agg(F.min_by("ttl", "id").alias("ttl"))
    rows = first.withColumn("feed", F.lit("feed")).withColumn("_time", F.timestamp_seconds("updated").cast("timestamp_ntz"))
    run.feed_slices(_slices(rows, "_time"), lambda s: feed.fresh_each(s, run.path("out")), text=False)
    return feed.accepted(t.spark, run.path("out"))


@query("st5_latest_status", "select * from lk")
def latest_status(t):
    run = Run(t, "latest")
    keys = t.status().select(*schemas.STATUS_KEY)
    run.feed_slices(_slices(keys, "last_reported"), lambda s: status.lookup_each(s, run.path("out")), text=False)
    return store.read_latest(t.spark, run.path("out"), status.LOOKUP)


# All versions of a station in the order of their times, those that differ from the one before.
INFORMATION_SQL = f"""
  with versions as (
    select * exclude (id, active), 1 k from si union all by name select *, 2 k from snap),
  marked as (
    select *, lag(capacity) over (partition by station_id order by reported) before from versions),
  kept as (select * from marked where before is null or before <> capacity)
  select cast(row_number() over (order by reported, station_id) as int) id,
    {", ".join(f'"{c}"' for c in _VERSION if c not in ("id", "active"))},
    row_number() over (partition by station_id order by reported desc) = 1 active from kept"""


def _snapshots(t: Tables) -> list[DataFrame]:
    """The first versions, the second versions, and the later state of the stations."""
    columns = [c for c in schemas.STATION_INFORMATION.names if c not in ("id", "active")]
    versions = t.information().select(*columns)
    return [
        versions.where(F.col("reported") < at(datetime(2024, 1, 1))),
        versions.where(F.col("reported") >= at(datetime(2024, 1, 1))),
        t.information_snapshot().where(F.col("reported") == at(SNAPSHOT)).select(*columns),
    ]


@query("st6_information_merge", INFORMATION_SQL)
def information_merge(t):
    """Three snapshots, a batch each."""
    run = Run(t, "information")
    run.feed_slices(_snapshots(t), lambda s: feed.merge_information_each(s, run.path("out")), text=False)
    return feed.current_information(t.spark, run.path("out")).select(*_VERSION)


@query("st6_information_merge_at_once", INFORMATION_SQL)
def information_merge_at_once(t):
    """The same three snapshots in one batch."""
    run = Run(t, "information")
    first, second, third = _snapshots(t)
    together = third.unionByName(first).unionByName(second)
    run.feed_slices([together], lambda s: feed.merge_information_each(s, run.path("out")), text=False)
    return feed.current_information(t.spark, run.path("out")).select(*_VERSION)


@query("st7_feed_log", LOG_SQL)
def feed_log(t):
    run = Run(t, "log")
    slices = [part.select("value") for part in _slices(t.log_documents(), "s")]
    run.feed_slices(slices, lambda s: run.to_parquet(feed.log_stream(s, gbfs.REGIONS, NOW)), text=True)
    return run.result().drop("id")


def _grid(t: Tables, step: int, end: datetime) -> DataFrame:
    """Two rows of later months close the last windows; their own windows stay open."""
    run = Run(t, "grid")
    rows = t.status()
    closing = [
        t.spark.range(1).select(
            *[
                (at(month) if f.name == "last_reported" else F.lit(None).cast(f.dataType)).alias(f.name)
                for f in rows.schema
            ]
        )
        for month in (datetime(2024, 4, 1), datetime(2024, 6, 1))
    ]
    slices = [*_slices(rows, "last_reported"), *closing]
    minutes = timedelta(minutes=step)
    run.feed_slices(slices, lambda s: run.to_parquet(status.grid_totals(s, minutes, "1 hour", START)), text=False)
    return run.result().where(F.col("time") < at(end))


@query("st8_grid_totals", GRID_SQL.format(start="2024-01-01", last="2024-02-01", step=360))
def grid_totals(t):
    return _grid(t, 360, datetime(2024, 3, 1))


@query("st8_grid_totals_uneven", GRID_SQL.format(start="2024-01-01", last="2024-02-02 12:00:00", step=2232))
def grid_totals_uneven(t):
    """A step that does not divide a day, as a month in twenty steps has."""
    return _grid(t, 2232, datetime(2024, 3, 1))


# The whole poll. The station documents come first, all in one batch; the status documents then in one batch, in slices, or in slices out
# of order. All tables are the same.


def _envelopes(documents: DataFrame, endpoint: str) -> DataFrame:
    return documents.select(F.to_json(F.struct(F.lit(endpoint).alias("endpoint"), "value")).alias("value"))


def _polled(t: Tables, how: str) -> str:
    """The folder of the tables after a run; runs are kept for the queries of one session."""
    key = (t.spark.sparkContext.applicationId, t.sf_dir, how)
    if key not in _RUNS:
        run = Run(t, f"poll-{how}")
        statuses = _document_slices(t)
        if how == "one":
            whole = statuses[0]
            for part in statuses[1:]:
                whole = whole.unionAll(part)
            statuses = [whole]
        elif how == "shuffled":
            statuses = [statuses[i] for i in SHUFFLED]
        first = _envelopes(t.information_documents(), "station_information")
        first = first.unionAll(_envelopes(t.system_documents(), "system_information"))
        first = first.unionAll(_envelopes(t.log_documents().select("value"), "system_regions"))
        slices = [first, *[_envelopes(part, "station_status") for part in statuses]]

        def sink(stream: DataFrame) -> DataStreamWriter:
            documents = stream.select(F.from_json("value", "endpoint string, value string").alias("d")).select("d.*")
            return poll.poll_each(documents, run.path("tables"), NOW)

        run.feed_slices(slices, sink, text=True)
        _RUNS[key] = run.path("tables")
    return _RUNS[key]


_RUNS: dict[tuple, str] = {}
_POLLED_CHANGES = CHANGES_SQL.format(first="rn = 1 or").replace("from ss window", f"from ({_IMPORTED}) p window")

for _how in ("one", "slices", "shuffled"):

    @query(f"ingest_status_{_how}", _IMPORTED)
    def _status(t, how=_how):
        return poll.status_table(t.spark, _polled(t, how))

    @query(f"ingest_changes_{_how}", f"select * from {_POLLED_CHANGES} c")
    def _changes(t, how=_how):
        return poll.change_table(t.spark, _polled(t, how))

    @query(
        f"ingest_lookup_{_how}",
        f"""select info_station_id, any_value(info_reported) info_reported, max(last_reported) status_last_reported
            from ({_IMPORTED}) p group by 1""",
    )
    def _lookup(t, how=_how):
        return poll.lookup_table(t.spark, _polled(t, how))


@query(
    "ingest_information",
    f"""select cast(row_number() over (order by reported, station_id) as int) id, * exclude (id) from si""",
)
def polled_information(t):
    return poll.information_table(t.spark, _polled(t, "slices")).select(*_VERSION)


@query("ingest_system_counts", "select * from sc")
def polled_counts(t):
    return poll.system_counts(t.spark, _polled(t, "slices"))


@query(
    "ingest_query_log",
    f"""select "time", endpoint, success, error_msg, error_json from {_LOGGED} l
        union all select last_reported, 'station_status', true, null, null from ss
        union all select reported, 'station_information', true, null, null from si
        union all select reported, 'system_information', true, null, null from sc""",
)
def polled_log(t):
    return poll.query_log(t.spark, _polled(t, "slices")).drop("id")
