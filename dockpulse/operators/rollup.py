"""Stored summaries of days, and range queries that read them in place of the rows.

Sums over neighbouring rows are made per station and day first, from rows of that day alone (`neighbours.segment_sums`). For a day that lies whole inside a range
that part does not depend on the range, so it can be stored: the inner sums, and the first and last row, a row per station. A range query takes the days inside it from
the table and reads status rows only of the days that its bounds cut, and of days that were never summarised. What lies between days is added at the query.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from datetime import date, datetime, time, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dockpulse import schemas
from dockpulse.functions.neighbours import STATION, bridged_sums, segment_sums
from dockpulse.operators import availability, events, occupancy as occupied
from dockpulse.params import StatusQuery, epoch, for_station
from dockpulse.schemas import DATE_COLUMN
from dockpulse.sources.merged import MergedTable


@dataclass(frozen=True)
class Summary:
    """Terms over a row and its neighbours, the columns that they need, and those of them that they need of the next row."""

    terms: dict[str, str]
    carried: tuple[str, ...]
    following: tuple[str, ...] = ()

    def of(self, status: DataFrame, terms: dict[str, str] | None = None) -> DataFrame:
        rows = status.withColumn("ts", epoch("last_reported"))
        return segment_sums(rows, terms or self.terms, self.carried, following=self.following)


DOCKINGS = Summary(events.docking_terms(), tuple(events.BIKES.values()))
CHARGES = Summary(events.charging_terms(), events.CHARGING_COLUMNS)
INTEGRALS = Summary(availability.integral_terms(), ("ts", *availability.COUNTERS.values()))


def occupancy_summary(empty_thresh: int = 0, full_thresh: int = 0) -> Summary:
    """Seconds empty and full of days that lie inside a range; a table per pair of thresholds."""
    terms = occupied.occupancy_terms(datetime.min, datetime.max, empty_thresh, full_thresh)
    return Summary(terms, occupied.OCCUPANCY_COLUMNS, ("ts",))


def inside(day: date, earliest: datetime | None, latest: datetime | None) -> bool:
    """Whether a day lies whole between two times."""
    after = earliest is None or datetime.combine(day, time()) >= earliest
    return after and (latest is None or datetime.combine(day, time()) + timedelta(days=1) <= latest)


def _day(status: DataFrame):
    return F.col(DATE_COLUMN) if DATE_COLUMN in status.columns else F.to_date("last_reported")


class DaySums:
    """The table of one summary. It is right for the rows that the last `refresh` of a day has seen: days with later rows are refreshed."""

    def __init__(self, spark: SparkSession, path: str, summary: Summary):
        self.summary = summary
        self.schema = summary.of(spark.createDataFrame([], schemas.STATION_STATUS)).schema
        self.table = MergedTable(spark, path, self.schema, (STATION, "_segment"), F.date_from_unix_date("_segment"))

    def refresh(self, status: DataFrame, batch_id: int, days: Iterable[date] | None = None) -> None:
        """Summarise some days anew, or all that `status` has; it holds every row of them. A batch that runs again writes the same."""
        rows = status if days is None else status.where(_day(status).isin(list(days)))
        self.table.upsert(self.summary.of(rows), batch_id)

    def sums(
        self,
        status: DataFrame,
        query: StatusQuery,
        whole: tuple[datetime | None, datetime | None] | None = None,
        terms: dict[str, str] | None = None,
    ) -> DataFrame:
        """The sums per station over the rows within the bounds of a query.

        Days between the times `whole`, by default the bounds, come from the table. `terms` are the terms of this range, if they differ from the summary's for
        days that its bounds cut.
        """
        earliest, latest = whole or (query.earliest, query.latest)
        found = sorted({day for day, _ in self.table.live() if inside(day, earliest, latest)})
        rows = query.on_status(status)
        if not found:
            return self._bridged(self.summary.of(rows, terms), terms)
        rows = rows.where(~_day(status).isin(found))
        stored = for_station(self.table.rows(found[0], found[-1]), query.station_id)
        return self._bridged(stored.unionByName(self.summary.of(rows, terms)), terms)

    def _bridged(self, segments: DataFrame, terms: dict[str, str] | None) -> DataFrame:
        return bridged_sums(segments, terms or self.summary.terms, self.summary.carried, following=self.summary.following)


def docking_events(days: DaySums, status: DataFrame, information: DataFrame, query: StatusQuery = StatusQuery()) -> DataFrame:
    """`events.docking_events` by a table of `DOCKINGS`."""
    return events.docked(days.sums(status, query), information, query)


def charging_events(days: DaySums, status: DataFrame, information: DataFrame, query: StatusQuery = StatusQuery()) -> DataFrame:
    """`events.charging_events` by a table of `CHARGES`."""
    return events.charged(days.sums(status, query), information, query)


def integrals(days: DaySums, status: DataFrame, information: DataFrame, query: StatusQuery = StatusQuery()) -> DataFrame:
    """`availability.integrals` by a table of `INTEGRALS`."""
    return availability.integrated(days.sums(status, query), information, query)


def occupancy(
    days: DaySums,
    status: DataFrame,
    information: DataFrame,
    start: datetime,
    end: datetime,
    station_id: int | None = None,
    empty_thresh: int = 0,
    full_thresh: int = 0,
) -> DataFrame:
    """`occupancy.occupancy` by a table of `occupancy_summary` with the same thresholds."""
    if days.summary != occupancy_summary(empty_thresh, full_thresh):
        raise ValueError("the table holds other thresholds")
    query = StatusQuery(station_id, start - occupied.LOOK_BACK, end + occupied.LOOK_AHEAD)
    terms = occupied.occupancy_terms(start, end, empty_thresh, full_thresh)
    return occupied.occupied(days.sums(status, query, (start, end), terms), information, end, station_id)
