"""Health of the feed: statistics and errors of the request log."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dockpulse.params import epoch, recent_days


def latest_queries(log: DataFrame) -> DataFrame:
    """Latest log row of each endpoint. The rank limit runs before the exchange: one row per task and endpoint."""
    newest = Window.partitionBy("endpoint").orderBy(F.desc("time"), F.desc("id"))
    return log.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def query_history(log: DataFrame, endpoint: str | None = None) -> DataFrame:
    """Per endpoint, for all, successful and failed queries: count, mean seconds between queries, latest time.

    The first interval counts as 0, so the intervals add up to last minus first and no window is needed.
    Endpoints without a success or without a failure are left out.
    """
    if endpoint is not None:
        log = log.where(F.col("endpoint") == endpoint)
    legs = {"total": F.lit(True), "successful": F.col("success"), "failed": ~F.col("success")}
    rows = log.withColumn("_s", epoch("time"))

    def leg(name: str, when: Column) -> list[Column]:
        seconds = F.when(when, F.col("_s"))
        count = F.count(seconds)
        mean = (F.max(seconds) - F.min(seconds)).cast("double") / F.nullif(count, F.lit(0)).cast("double")
        return [
            count.alias(f"{name}_count"),
            F.coalesce(mean, F.lit(0.0)).alias(f"{name}_avg_interval"),
            F.max(F.when(when, F.col("time"))).alias(f"{name}_latest"),
        ]

    stats = rows.groupBy("endpoint").agg(*[c for name, when in legs.items() for c in leg(name, when)])
    return stats.where("successful_count > 0 and failed_count > 0")


def query_errors(
    log: DataFrame, limit: int, days: int | None = None, now: datetime | None = None, with_json: bool = False
) -> DataFrame:
    """Newest failed queries, up to the limit; `with_json` then drops those without an error body."""
    rows = recent_days(log.where("not success"), "time", days, now)
    rows = rows.orderBy(F.desc("time"), F.desc("id")).limit(limit)
    return rows.where("error_json is not null") if with_json else rows


def error_field(errors: DataFrame, path: str, name: str) -> DataFrame:
    """Errors with one field, as text, of their JSON body, which is text or VARIANT; null if the body has no such field."""
    typed = dict(errors.dtypes)["error_json"] == "variant"
    value = F.try_variant_get("error_json", path, "string") if typed else F.get_json_object("error_json", path)
    return errors.select("*", value.alias(name))


def local_time(rows: DataFrame, column: str, zone: str) -> DataFrame:
    local = F.from_utc_timestamp(F.col(column).cast("timestamp"), zone).cast("timestamp_ntz")
    return rows.withColumn(column, local)
