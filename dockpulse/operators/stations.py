"""Station versions, status lookups and their joins."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dockpulse import schemas
from dockpulse.functions.ranking import ranked
from dockpulse.params import StatusQuery, at, for_station, in_time_range, recent_days

# None of the joins carries a broadcast hint. Catalyst broadcasts the station table when its size, known from the
# files, is under the threshold; otherwise a sort-merge join runs and AQE splits the partitions of hot stations.

STATION_COUNTS = (
    "num_bikes_available",
    "num_bikes_disabled",
    "num_docks_available",
    "num_docks_disabled",
)


def prefixed(df: DataFrame, prefix: str, columns: Sequence[str] | None = None) -> DataFrame:
    return df.select(*[F.col(c).alias(prefix + c) for c in (columns or df.columns)])


def _attached(information: DataFrame) -> DataFrame:
    """Station columns under names that do not clash with status columns."""
    return prefixed(information, "version_")


# Versions of a station


def latest_information(information: DataFrame, until: datetime | None = None) -> DataFrame:
    """Newest version of each station by id, optionally of those reported up to a time."""
    rows = information if until is None else information.where(F.col("reported") <= at(until))
    newest = Window.partitionBy("station_id").orderBy(F.desc("id"))
    return rows.withColumn("_rank", F.rank().over(newest)).where("_rank = 1").drop("_rank")


def newest_reported_information(information: DataFrame, until: datetime) -> DataFrame:
    """Newest version of each station by report time, up to a time."""
    newest = Window.partitionBy("station_id").orderBy(F.desc("reported"), F.desc("id"))
    rows = information.where(F.col("reported") <= at(until))
    return rows.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def active_information(information: DataFrame) -> DataFrame:
    return information.where("active")


def information_by_ids(information: DataFrame, ids: Sequence[int]) -> DataFrame:
    return information.where(F.col("station_id").isin(list(ids)))


def information_in(information: DataFrame, ids: DataFrame) -> DataFrame:
    """The same for a long list of ids, given as a DataFrame with a station_id column."""
    return information.join(ids.select("station_id").distinct(), "station_id", "left_semi")


def station_by_name(information: DataFrame, name: str) -> DataFrame:
    return information.where(F.col("name") == name).select("station_id", "name").distinct()


def stations_like(information: DataFrame, pattern: str) -> DataFrame:
    return information.where(F.col("name").like(pattern)).select("station_id", "name").distinct()


def like_pattern(mode: str, text: str) -> str:
    """SQL LIKE pattern of a match mode; wildcards in the text keep their meaning."""
    before, after = {"exact": ("", ""), "prefix": ("", "%"), "suffix": ("%", ""), "wildcard": ("%", "%")}[mode]
    return f"{before}{text}{after}"


def station_list_filter(stations: DataFrame, kind: str = "all", text: str = "") -> DataFrame:
    """Stations of a kind (all, regular, charging) whose id, name or address contains the text."""
    if kind == "charging":
        stations = stations.where("is_charging_station")
    elif kind == "regular":
        stations = stations.where("not is_charging_station")
    elif kind != "all":
        raise ValueError(f"unknown station kind {kind}")
    needle = F.lit(text.lower())
    fields = (F.col("station_id").cast("string"), F.col("name"), F.coalesce("address", F.lit("")))
    found = F.lit(False)
    for field in fields:
        found = found | F.lower(field).contains(needle)
    return stations.where(found)


# Orderings of the station list: option name -> columns.
LIST_ORDERINGS = {
    "station-id": "station_id",
    "station-name": "name",
    "station-type": "is_charging_station",
    "station-capacity": "capacity",
    "mechanical-available": "vehicle_types_available_iconic",
    "efit-available": "vehicle_types_available_efit",
    "efit-g5-available": "vehicle_types_available_efit_g5",
    "bikes-disabled": "num_bikes_disabled",
    "time-full": "full_sec",
    "time-empty": "empty_sec",
}


def order_stations(stations: DataFrame, option: str, descending: bool = False) -> DataFrame:
    column = F.col(LIST_ORDERINGS[option])
    return stations.orderBy(column.desc() if descending else column.asc(), "station_id")


def station_places(stations: DataFrame) -> DataFrame:
    """`option, descending, station_id, place`: the place of every station in every ordering both ways, from 1 on, for lists that are read page by page.

    All orderings are sorted and numbered together in one exchange by ranges: no task and no driver sees a whole ordering, and the stations are read once.
    """
    kinds = dict(stations.dtypes)
    keys = []
    for number, (option, column) in enumerate(LIST_ORDERINGS.items()):
        text = kinds[column] == "string"
        value, nothing = F.col(column), F.lit(None)
        for descending in (False, True):
            amount = nothing if text else value.cast("double") * (-1 if descending else 1)
            keys.append(
                F.struct(
                    F.lit(2 * number + descending).alias("number"),
                    F.lit(option).alias("option"),
                    F.lit(descending).alias("descending"),
                    (value.isNull() if descending else value.isNotNull()).alias("late"),  # nulls first, from below
                    amount.cast("double").alias("amount"),
                    (value if text and not descending else nothing).cast("string").alias("up"),
                    (value if text and descending else nothing).cast("string").alias("down"),
                    "station_id",
                )
            )
    rows = stations.select(F.explode(F.array(*keys)).alias("key")).select("key.*")
    order = [F.col(c).asc() for c in ("number", "late", "amount", "up")] + [F.col("down").desc(), F.col("station_id").asc()]
    placed = ranked(rows, *order, name="overall")
    first = placed.groupBy("number").agg(F.min("overall").alias("first"))
    place = (F.col("overall") - F.col("first") + 1).alias("place")
    return placed.join(first, "number").select("option", "descending", "station_id", place)


# Status rows


def one_per_time(status: DataFrame) -> DataFrame:
    """One row per station and report time: the one of the newest information version."""
    newest = Window.partitionBy("info_station_id", "last_reported").orderBy(F.desc("info_reported"))
    return status.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def status_between(status: DataFrame, station_id: int, start: datetime, end: datetime) -> DataFrame:
    """Status of a station, both bounds included, one row per report time."""
    return one_per_time(StatusQuery(station_id, start, end).on_status(status))


def status_with_version(status: DataFrame, information: DataFrame, how: str = "inner") -> DataFrame:
    """Status rows with the information version they refer to, as version_* columns."""
    info = _attached(information)
    on = (F.col("info_station_id") == F.col("version_station_id")) & (
        F.col("info_reported") == F.col("version_reported")
    )
    return status.join(info, on, how)


def status_with_station(status: DataFrame, information: DataFrame) -> DataFrame:
    """Status rows with every version of their station."""
    return status.join(_attached(information), F.col("info_station_id") == F.col("version_station_id"), "inner")


def status_information_between(
    status: DataFrame, information: DataFrame, station_id: int, start: datetime, end: datetime
) -> DataFrame:
    versions = for_station(information, station_id, "station_id").dropDuplicates(["station_id", "reported"])
    return status_with_version(status_between(status, station_id, start, end), versions)


def system_status_between(status: DataFrame, information: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Status rows of known stations in a time range, once per information version of the station."""
    rows = in_time_range(status, "last_reported", start, end)
    versions = information.select(F.col("station_id").alias("info_station_id"))
    return rows.join(versions, "info_station_id", "inner").select(*status.columns)


def disabled_docks(status: DataFrame, information: DataFrame) -> DataFrame:
    rows = status.where("num_docks_disabled > 0")
    return status_with_station(rows, information).select(F.col("version_name").alias("name"), "num_docks_disabled")


def status_sample(status: DataFrame, information: DataFrame, limit: int | None = None) -> DataFrame:
    """Status with station; the optional limit takes status rows before the join."""
    return status_with_station(status if limit is None else status.limit(limit), information)


def status_fields(status: DataFrame, information: DataFrame) -> DataFrame:
    return status_with_station(status, information).select(F.col("version_name").alias("name"), *STATION_COUNTS)


def latest_between(status: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Latest status of each station in a range, both bounds included.

    Ties (two information versions at one time) are all kept. The rank limit runs before the exchange.
    """
    latest = Window.partitionBy("info_station_id").orderBy(F.desc("last_reported"))
    rows = in_time_range(status, "last_reported", start, end)
    return rows.withColumn("_rank", F.rank().over(latest)).where("_rank = 1").drop("_rank")


def latest_of_station(status: DataFrame, information: DataFrame, station_id: int) -> DataFrame:
    known = for_station(information, station_id, "station_id").select(F.col("station_id").alias("info_station_id"))
    rows = for_station(status, station_id).join(known.distinct(), "info_station_id", "left_semi")
    return rows.orderBy(F.desc("last_reported"), F.desc("info_reported")).limit(1)


def latest_before(status: DataFrame, information: DataFrame, end: datetime) -> DataFrame:
    """Latest status of each station within the 24 hours before a time, with its information version."""
    return status_with_version(latest_between(status, end - timedelta(days=1), end), information)


def station_lookup(status: DataFrame) -> DataFrame:
    """Pointer to the latest status of every station."""
    return status.groupBy("info_station_id").agg(
        F.max_by("info_reported", latest_key()).alias("info_reported"),
        F.max("last_reported").alias("status_last_reported"),
    )


def latest_key() -> Column:
    """Order of a station's rows as one long, so that max_by stays a hash aggregate: seconds, then version (null first).

    Both parts are whole seconds since 2000 and fit 31 bits until 2068. A time that is not, and would be out of order or tie, fails the job.
    """

    def part(name: str) -> Column:
        micros = F.unix_micros(F.col(name).cast("timestamp")) - F.lit(946_684_800_000_000)
        whole = micros.between(0, 2**31 * 1_000_000 - 1) & (micros % 1_000_000 == 0)
        wrong = F.concat(F.lit(f"{name} is no whole second from 2000 to 2068: "), F.col(name).cast("string"))
        seconds = F.when(whole, F.floor(micros / 1_000_000)).when(micros.isNotNull(), F.raise_error(wrong).cast("long"))
        return seconds.cast("long")

    return F.shiftleft(part("last_reported"), 31) + F.coalesce(part("info_reported"), F.lit(0))


def latest_status_by_lookup(
    status: DataFrame, lookup: DataFrame, days: int | None = None, now: datetime | None = None
) -> DataFrame:
    """The status rows a lookup table points to."""
    rows = status if days is None else recent_days(status, "last_reported", days, now)
    keys = lookup.select("info_station_id", "info_reported", F.col("status_last_reported").alias("last_reported"))
    return rows.join(keys, list(schemas.STATUS_KEY), "left_semi")


def latest_with_information(status: DataFrame, information: DataFrame, lookup: DataFrame) -> DataFrame:
    return status_with_version(latest_status_by_lookup(status, lookup), information)


def information_by_lookup(
    status: DataFrame,
    information: DataFrame,
    lookup: DataFrame,
    ids: Sequence[int] | None = None,
    days: int | None = None,
    now: datetime | None = None,
) -> DataFrame:
    """Information versions that the latest statuses refer to."""
    if ids is not None:
        lookup = lookup.where(F.col("info_station_id").isin(list(ids)))
    keys = latest_status_by_lookup(status, lookup, days, now).select(
        F.col("info_station_id").alias("station_id"), F.col("info_reported").alias("reported")
    )
    return information.join(keys, ["station_id", "reported"], "left_semi").select(*information.columns)


def join_occupancy(latest: DataFrame, occupancy: DataFrame) -> DataFrame:
    """Latest statuses with the occupancy of the same station; stations without either are left out."""
    extra = occupancy.select(F.col("station_id").alias("info_station_id"), "empty_sec", "full_sec")
    return latest.join(extra, "info_station_id", "inner")


def attach_active_version(feed_status: DataFrame, information: DataFrame) -> DataFrame:
    """Feed rows of known stations with the reference to the station's active version."""
    active = active_information(information).select(
        F.col("station_id"), F.col("station_id").alias("info_station_id"), F.col("reported").alias("info_reported")
    )
    columns = ["info_station_id", "info_reported", *feed_status.columns]
    return feed_status.join(active, "station_id", "inner").select(*columns)


def version_keys_by_id(status_ids: DataFrame, information: DataFrame) -> DataFrame:
    """Replace an information id by the (station, reported) key of that version."""
    keys = information.select(
        F.col("id").alias("info_id"),
        F.col("station_id").alias("info_station_id"),
        F.col("reported").alias("info_reported"),
    )
    return status_ids.join(keys, "info_id", "inner")
