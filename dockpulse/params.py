"""Query parameters and time grids. All times are naive datetimes in UTC."""

from __future__ import annotations

import math
from dataclasses import dataclass
from datetime import date, datetime, time, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dockpulse.schemas import DATE_COLUMN


def at(moment: datetime) -> Column:
    """Time literal without a zone, so that it compares with stored times and is pushed to the scan."""
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")


def epoch(column: str | Column) -> Column:
    """Whole seconds since 1970 as a long; needs the UTC session."""
    column = F.col(column) if isinstance(column, str) else column
    return F.unix_seconds(column.cast("timestamp"))


def epoch_of(moment: datetime) -> int:
    """Driver-side twin of `epoch`."""
    return int((moment - datetime(1970, 1, 1)).total_seconds())


def from_epoch(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds).cast("timestamp_ntz")


def in_time_range(
    df: DataFrame, column: str, earliest: datetime | None = None, latest: datetime | None = None
) -> DataFrame:
    """Inclusive bounds on a time column, and the matching bounds on the date partitions if the table has them."""
    dated = DATE_COLUMN in df.columns and column == "last_reported"
    if earliest is not None:
        df = df.where(F.col(column) >= at(earliest))
        if dated:
            df = df.where(F.col(DATE_COLUMN) >= F.lit(earliest.date()))
    if latest is not None:
        df = df.where(F.col(column) <= at(latest))
        if dated:
            df = df.where(F.col(DATE_COLUMN) <= F.lit(latest.date()))
    return df


@dataclass(frozen=True)
class StatusQuery:
    """Optional station and inclusive time bounds; the filter most operators take."""

    station_id: int | None = None
    earliest: datetime | None = None
    latest: datetime | None = None

    def on_status(self, status: DataFrame) -> DataFrame:
        return in_time_range(for_station(status, self.station_id), "last_reported", self.earliest, self.latest)

    def on_information(self, information: DataFrame) -> DataFrame:
        rows = for_station(information, self.station_id, "station_id")
        return in_time_range(rows, "reported", self.earliest, self.latest)

    def on_information_station(self, information: DataFrame) -> DataFrame:
        return for_station(information, self.station_id, "station_id")

    def on_information_until(self, information: DataFrame) -> DataFrame:
        """Upper time bound only."""
        return StatusQuery(self.station_id, None, self.latest).on_information(information)


def for_station(df: DataFrame, station_id: int | None, column: str = "info_station_id") -> DataFrame:
    return df if station_id is None else df.where(F.col(column) == F.lit(station_id))


def recent_days(df: DataFrame, column: str, days: int | None, now: datetime) -> DataFrame:
    """Rows at most `days` old; None keeps all."""
    return df if days is None else df.where(F.col(column) >= at(now - timedelta(days=days)))


@dataclass(frozen=True)
class Grid:
    """Times start, start+step, ..., up to the first one at or after end."""

    start: datetime
    step_seconds: int
    points: int

    @staticmethod
    def over(start: datetime, end: datetime, step_minutes: int) -> Grid:
        step = max(1, step_minutes) * 60
        return Grid(start, step, math.ceil((end - start).total_seconds() / step) + 1)

    @property
    def last(self) -> datetime:
        return self.start + timedelta(seconds=self.step_seconds * (self.points - 1))

    def times(self, spark: SparkSession, name: str = "time") -> DataFrame:
        """One row per grid time, made by Spark."""
        seconds = F.col("id") * self.step_seconds + epoch_of(self.start)
        return spark.range(self.points).select(from_epoch(seconds).alias(name))


def steps_per_range(start: datetime, end: datetime, step_minutes: int) -> int:
    return math.ceil((end - start).total_seconds() / (step_minutes * 60))


def minutes_per_hourly_step(steps: int) -> int:
    return math.ceil(60 / steps)


def seconds_per_step(start: datetime, end: datetime, max_steps: int) -> int:
    return math.floor((end - start).total_seconds() / max_steps)


def hour_before(moment: datetime) -> datetime:
    return moment - timedelta(hours=1)


def previous_day(day: date) -> date:
    return day - timedelta(days=1)


def local_to_utc(moment: datetime, zone: str) -> datetime:
    return moment.replace(tzinfo=ZoneInfo(zone)).astimezone(ZoneInfo("UTC")).replace(tzinfo=None)


def local_range(
    start: datetime | None, end: datetime | None, zone: str, now: datetime
) -> tuple[datetime, datetime]:
    """Local bounds as UTC; a missing end means now, a missing start means 24 hours before now."""
    first = local_to_utc(start, zone) if start else now - timedelta(days=1)
    last = local_to_utc(end, zone) if end else now
    return first, last


def midnight(day: date) -> datetime:
    return datetime.combine(day, time())


def noon(day: date) -> datetime:
    return datetime.combine(day, time(12))
