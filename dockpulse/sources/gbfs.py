"""Feed documents to rows. The same functions serve batch files, file streams and text columns.

A document is one string in a column named `value`; it is as large as one response of the feed, one entry per
station, and is exploded at once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dockpulse import schemas
from dockpulse.params import epoch, from_epoch

CORRUPT = "_corrupt"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per file; plain and gzip files."""
    return spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())


def stream_documents(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    return (
        spark.readStream.format("text")
        .option("wholetext", "true")
        .option("maxFilesPerTrigger", files_per_trigger)
        .load(path)
    )


@dataclass(frozen=True)
class Feed:
    """A kind of feed document: the endpoint it comes from, where its items are, and what makes an item valid."""

    endpoint: str
    key: str | None
    item: T.StructType
    optional: tuple[str, ...] = ()
    check: Callable[[Column], Column] | None = None

    def valid(self, item: Column) -> Column:
        result = F.lit(True)
        for name in self.item.names:
            if name not in self.optional:
                result = result & item[name].isNotNull()
        return result if self.check is None else result & F.coalesce(self.check(item), F.lit(False))


def _known(value: Column, allowed: tuple[str, ...]) -> Column:
    return value.isNull() | value.isin(*allowed)


def _check_status(item: Column) -> Column:
    known = F.forall(
        item["vehicle_types_available"],
        lambda v: v["vehicle_type_id"].isin(*schemas.VEHICLE_TYPES) & v["count"].isNotNull(),
    )
    numbered = item["station_id"].try_cast("int").isNotNull()
    return numbered & item["status"].isin(*schemas.STATION_STATES) & known


def _check_information(item: Column) -> Column:
    methods = F.coalesce(item["rental_methods"], F.array().cast("array<string>"))
    return (
        item["station_id"].try_cast("int").isNotNull()
        & _known(item["physical_configuration"], schemas.PHYSICAL_CONFIGURATIONS)
        & F.forall(methods, lambda m: F.upper(m).isin(*schemas.RENTAL_METHODS))
    )


STATION_INFORMATION = Feed(
    "station_information",
    "stations",
    schemas.FEED_STATION_INFORMATION,
    ("physical_configuration", "altitude", "address", "rental_methods", "is_valet_station"),
    _check_information,
)
STATION_STATUS = Feed(
    "station_status", "stations", schemas.FEED_STATION_STATUS, ("last_reported", "traffic"), _check_status
)
SYSTEM_INFORMATION = Feed("system_information", None, schemas.FEED_SYSTEM_INFORMATION)
VEHICLE_TYPES = Feed("vehicle_types", "vehicle_types", schemas.FEED_VEHICLE_TYPE)
REGIONS = Feed("system_regions", "regions", schemas.FEED_REGION)
PRICING_PLANS = Feed("system_pricing_plans", "plans", schemas.FEED_PRICING_PLAN)
VERSIONS = Feed("versions", "versions", schemas.FEED_VERSION)


def parse(documents: DataFrame, feed: Feed) -> DataFrame:
    """Documents with a `doc` struct; `doc._corrupt` holds the text if it is not JSON of the right shape.

    The struct comes out of a generator: filters and projections on its fields are not pushed below one, so a document is parsed
    once and not once for each field that somebody looks at.
    """
    schema = schemas.envelope(feed.key, feed.item)
    schema = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType(), True)])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    return documents.select("*", F.explode(F.array(F.from_json("value", schema, options))).alias("doc"))


def decoded(feed: Feed) -> Column:
    """Whether a parsed document has its header and nothing but valid items: one bad item spoils the document."""
    data = F.col("doc.data") if feed.key is None else F.col("doc.data")[feed.key]
    header = F.col(f"doc.{CORRUPT}").isNull() & F.col("doc.last_updated").isNotNull() & F.col("doc.ttl").isNotNull()
    content = feed.valid(data) if feed.key is None else F.forall(data, feed.valid)
    return header & data.isNotNull() & F.coalesce(content, F.lit(False))


def items(documents: DataFrame, feed: Feed) -> DataFrame:
    """One row per element of the data list of documents that decode: the header columns and an `item` struct."""
    return (
        parse(documents, feed)
        .where(decoded(feed))
        .select("doc.last_updated", "doc.ttl", "doc.version", F.explode(F.col("doc.data")[feed.key]).alias("item"))
    )


def dimension(documents: DataFrame, feed: Feed) -> DataFrame:
    """Small feed dimensions as they come: vehicle types, regions, pricing plans, versions."""
    return items(documents, feed).select(from_epoch(F.col("last_updated")).alias("reported"), "item.*")


def vehicle_types(documents: DataFrame) -> DataFrame:
    return dimension(documents, VEHICLE_TYPES)


def regions(documents: DataFrame) -> DataFrame:
    return dimension(documents, REGIONS)


def pricing_plans(documents: DataFrame) -> DataFrame:
    return dimension(documents, PRICING_PLANS)


def versions(documents: DataFrame) -> DataFrame:
    return dimension(documents, VERSIONS)


def station_information(documents: DataFrame) -> DataFrame:
    """Station rows of information documents, reported at the time of their document."""
    rows = items(documents, STATION_INFORMATION).select(from_epoch(F.col("last_updated")).alias("reported"), "item.*")
    return information_rows(rows)


def information_rows(rows: DataFrame) -> DataFrame:
    """Feed items with a `reported` time as station rows."""
    text = F.lit("")
    uris = [F.coalesce(F.col(f"rental_uris.{n}"), text) for n in ("android", "ios", "web")]
    methods = F.coalesce("rental_methods", F.array().cast("array<string>"))
    values = {
        "station_id": F.col("station_id").cast("int"),
        "rental_methods": F.transform(methods, F.upper),
        "is_valet_station": F.coalesce("is_valet_station", F.lit(False)),
        "bluetooth_id": F.nullif("_bluetooth_id", text),
        "ride_code_support": F.col("_ride_code_support"),
        "rental_uris": F.array(*uris),
    }
    names = [n for n in schemas.STATION_INFORMATION.names if n not in ("id", "active")]
    return rows.select(*[values.get(n, F.col(n)).alias(n) for n in names])


def station_status(documents: DataFrame) -> DataFrame:
    """Status rows of status documents; stations that never reported are left out."""
    return status_rows(items(documents, STATION_STATUS).select("item.*"))


def status_rows(rows: DataFrame) -> DataFrame:
    """Feed items as status rows."""
    counts = F.map_from_entries(
        F.transform("vehicle_types_available", lambda v: F.struct(v["vehicle_type_id"], v["count"]))
    )
    rows = rows.where("last_reported is not null").withColumn("_counts", counts)
    values = {
        "station_id": F.col("station_id").cast("int"),
        "last_reported": from_epoch(F.col("last_reported")),
        "vehicle_docks_available": F.coalesce(F.get("vehicle_docks_available", F.lit(0))["count"], F.lit(0)),
    }
    for name, kind in (("boost", "BOOST"), ("iconic", "ICONIC"), ("efit", "EFIT"), ("efit_g5", "EFIT G5")):
        values[f"vehicle_types_available_{name}"] = F.coalesce(F.col("_counts")[kind], F.lit(0))
    return rows.select(*[values.get(n, F.col(n)).alias(n) for n in schemas.STATUS_FEED_COLUMNS])


def status_items(status: DataFrame) -> DataFrame:
    """Status rows as feed items: the inverse of `status_rows`."""
    kinds = (("BOOST", "boost"), ("ICONIC", "iconic"), ("EFIT", "efit"), ("EFIT G5", "efit_g5"))
    counted = [
        F.struct(F.lit(kind).alias("vehicle_type_id"), F.col(f"vehicle_types_available_{name}").alias("count"))
        for kind, name in kinds
    ]
    docks = F.struct(
        F.array(*[F.lit(kind) for kind, _ in kinds]).alias("vehicle_type_ids"),
        F.col("vehicle_docks_available").alias("count"),
    )
    values = {
        "station_id": F.col("station_id").cast("string"),
        "last_reported": epoch("last_reported"),
        "vehicle_docks_available": F.array(docks),
        "vehicle_types_available": F.array(*counted),
    }
    return status.select(*[values.get(n, F.col(n)).alias(n) for n in schemas.FEED_STATION_STATUS.names])


def _system(documents: DataFrame) -> DataFrame:
    rows = parse(documents, SYSTEM_INFORMATION).where(decoded(SYSTEM_INFORMATION))
    return rows.select(from_epoch(F.col("doc.last_updated")).alias("reported"), "doc.data.*")


def system_information(documents: DataFrame) -> DataFrame:
    rows = _system(documents)
    for name in ("mobile_head_version", "mobile_minimum_supported_version"):
        rows = rows.withColumn(name, F.col(name).cast("int"))
    return rows.select(*schemas.SYSTEM_INFORMATION.names)


def system_information_count(documents: DataFrame) -> DataFrame:
    return _system(documents).select(
        "reported",
        F.col("_station_count").alias("station_count"),
        F.col("_vehicle_count._mechanical_count").alias("mechanical_count"),
        F.col("_vehicle_count._ebike_count").alias("ebike_count"),
    )
