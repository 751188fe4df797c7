"""Stored tables: Parquet by day, delimited text, and JSON dumps."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dockpulse import schemas
from dockpulse.operators.stations import status_with_version
from dockpulse.params import StatusQuery, midnight, noon
from dockpulse.schemas import DATE_COLUMN
from dockpulse.sources import gbfs, zstd_json


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def with_date(status: DataFrame) -> DataFrame:
    return status.withColumn(DATE_COLUMN, F.to_date("last_reported"))


def write_status(status: DataFrame, path: str, mode: str = "append") -> None:
    """Status by day. The rebalance hint gathers a day into few files and splits a day or station that is large;
    sorting by station and time lets readers skip row groups."""
    dated = with_date(status)
    station = "info_station_id" if "info_station_id" in status.columns else "station_id"
    (
        dated.hint("rebalance", F.col(DATE_COLUMN))
        .sortWithinPartitions(DATE_COLUMN, station, "last_reported")
        .write.mode(mode)
        .partitionBy(DATE_COLUMN)
        .parquet(path)
    )


# Delimited text as psql writes it: a header, `^` between fields, flags as t and f, times with their offset from UTC, lists
# as {a,"b c"}, null as nothing and the empty text as "".

_LIST_ITEM = r'"(?:[^"\\\\]|\\\\.)*"|[^,]+'


def _parsed(text: Column, kind: T.DataType, name: str) -> Column:
    """A value of delimited text; one that does not parse fails the job and never becomes null."""
    if isinstance(kind, T.StringType):
        return text
    if isinstance(kind, T.ArrayType):
        inner = F.regexp_replace(text, r"^\{|\}$", "")
        quoted = lambda x: F.regexp_replace(F.substring(x, F.lit(2), F.length(x) - 2), r"\\(.)", "$1")
        item = lambda x: F.when(x.startswith('"'), quoted(x)).when(F.upper(x) != "NULL", x)
        value = F.when(text.rlike(r"(?s)^\{.*\}$"), F.transform(F.regexp_extract_all(inner, F.lit(_LIST_ITEM), F.lit(0)), item))
    elif isinstance(kind, T.BooleanType):
        value = F.when(text.isin("t", "true"), True).when(text.isin("f", "false"), False)
    elif isinstance(kind, T.TimestampNTZType):
        zoned = F.when(text.rlike(r"[+-]\d\d(:?\d\d)?$|Z$"), text).otherwise(F.concat(text, F.lit("+00")))
        value = F.to_utc_timestamp(zoned.try_cast("timestamp"), F.current_timezone()).cast("timestamp_ntz")
    else:
        value = text.try_cast(kind)
    wrong = F.concat(F.lit(f"not a value of {name}: "), text)
    return F.when(text.isNotNull() & value.isNull(), F.raise_error(wrong).cast(kind)).otherwise(value)


def read_delimited(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of delimited text. Columns are found by their name in the header; those that the files lack are null."""
    # a null value that no file holds: else the quoted empty text would be null too
    rows = spark.read.csv(path, sep="^", header=True, escape='"', nullValue="\x01", emptyValue="")
    return rows.select(
        *[
            (_parsed(F.col(f.name), f.dataType, f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in schema
        ]
    )


def write_delimited(rows: DataFrame, path: str) -> None:
    def text(field: T.StructField) -> Column:
        column = F.col(field.name)
        if isinstance(field.dataType, T.ArrayType):
            escaped = lambda x: F.regexp_replace(x, r'(["\\])', r"\\$1")
            plain = lambda x: x.rlike(r"^[\w.:/+-]+$") & (F.upper(x) != "NULL")
            quoted = lambda x: F.concat(F.lit('"'), escaped(x), F.lit('"'))
            item = lambda x: F.when(x.isNull(), "NULL").when(plain(x), x).otherwise(quoted(x))
            return F.concat(F.lit("{"), F.array_join(F.transform(column, item), ","), F.lit("}"))
        if isinstance(field.dataType, T.BooleanType):
            return F.when(column, "t").when(~column, "f")
        if isinstance(field.dataType, T.TimestampNTZType):
            return F.concat(column.cast("string"), F.lit("+00"))
        return column

    flat = [text(f).alias(f.name) for f in rows.schema]
    rows.select(*flat).write.mode("overwrite").csv(path, sep="^", header=True, escape='"')


# JSON dumps: information records, and status records in the form of the feed. Each line is one record, so that a dump of any size is read
# and written in parallel; a dump that is one JSON array in one file is read too. A path that ends in .zst holds Zstandard files of either form.

_RENAMED = {"id": "info_id", "bluetooth_id": "_bluetooth_id", "ride_code_support": "_ride_code_support"}
_STAMP = "yyyy-MM-dd'T'HH:mm:ss'Z'"
INFORMATION_RECORD = T.StructType(
    [
        T.StructField(_RENAMED.get(f.name, f.name), T.StringType() if f.name == "reported" else f.dataType)
        for f in schemas.STATION_INFORMATION
    ]
)


ZSTD = ".zst"


def read_dump(spark: SparkSession, path: str, schema: T.StructType, array: bool = False) -> DataFrame:
    """Records of a dump; one that is no JSON or has a value of another type fails the job. Zstandard files tell by themselves whether they hold an array."""
    if path.endswith(ZSTD):
        return zstd_json.parsed(zstd_json.read_records(spark, path), schema)
    reader = spark.read.schema(schema).option("mode", "FAILFAST")
    if array:
        reader = reader.option("multiLine", "true")
    return reader.json(path)


def _required(rows: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """The rows; one without a value that every record has fails the job instead of being stored with nulls."""
    for name in names:
        missing = F.raise_error(F.lit(f"a record without {name}")).cast(rows.schema[name].dataType)
        rows = rows.withColumn(name, F.coalesce(F.col(name), missing))
    return rows


def read_status_dump(spark: SparkSession, path: str, array: bool = False) -> DataFrame:
    """Status rows of a dump of feed records; the version a row belongs to is attached when it is inserted."""
    records = read_dump(spark, path, schemas.FEED_STATION_STATUS, array)
    names = tuple(n for n in records.columns if n != "traffic")
    return gbfs.status_rows(_required(records, names))


def read_information_dump(spark: SparkSession, path: str, array: bool = False) -> DataFrame:
    """All versions of a dump of information records, with their ids, times and active flags."""
    records = _required(read_dump(spark, path, INFORMATION_RECORD, array), ("info_id", "station_id", "active", "reported"))
    values = {"reported": F.to_timestamp_ntz("reported", F.lit(_STAMP))}
    return records.select(
        *[values.get(n, F.col(_RENAMED.get(n, n))).alias(n) for n in schemas.STATION_INFORMATION.names]
    )


def information_records(information: DataFrame) -> DataFrame:
    values = {"reported": F.date_format("reported", _STAMP)}
    return information.select(
        *[values.get(n, F.col(n)).alias(_RENAMED.get(n, n)) for n in schemas.STATION_INFORMATION.names]
    )


def export_rows(
    status: DataFrame, information: DataFrame, first: date | None = None, last: date | None = None, station_id: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """(information, status) of a range from midnight of the first to noon of the last day, without copies; from the first row, or to the last, without such a day."""
    earliest, latest = None if first is None else midnight(first), None if last is None else noon(last)
    rows = StatusQuery(station_id, earliest, latest).on_status(status)
    versions = information.dropDuplicates(["station_id", "reported"])
    joined = status_with_version(rows, versions)
    info = joined.select(*[F.col(f"version_{c}").alias(c) for c in information.columns])
    keys = ["station_id", "reported"]
    return info.dropDuplicates(keys), joined.select(*status.columns).dropDuplicates()


def export_name(kind: str, first: date | None, last: date | None, station_id: int | None = None) -> str:
    days = "_".join(str(d) for d in (first, last) if d is not None) or "ever"
    return f"station_{kind}_{'all' if station_id is None else station_id}_{days}.json"


def export_dump(
    status: DataFrame,
    information: DataFrame,
    folder: str,
    first: date | None = None,
    last: date | None = None,
    station_id: int | None = None,
    zstd: bool = False,
    array: bool = False,
) -> tuple[str, str]:
    """Write both dumps of a range, open where a day is not given, in their record forms; returns the paths. With `zstd` as Zstandard files, of one JSON array each with `array`."""
    info, rows = export_rows(status, information, first, last, station_id)
    end = ZSTD if zstd else ""
    paths = tuple(f"{folder}/{export_name(kind, first, last, station_id)}{end}" for kind in ("information", "status"))
    for records, path in zip((information_records(info), gbfs.status_items(rows)), paths, strict=True):
        if zstd:
            zstd_json.write_records(records, path, array)
        else:
            records.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    return paths


def range_label(station_id: int | None, start: datetime, end: datetime, kind: str = "performance") -> str:
    """File name of a report on a station or the whole system."""
    who = "system" if station_id is None else str(station_id)
    return f"{who}-{kind}-{start}-{end}.csv".replace(" ", "-")


def merge_by_key(existing: DataFrame, added: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Existing rows and those added rows whose key is new; of several added rows of a key the least by all columns."""
    fresh = one_per_key(added.select(*existing.columns), key).join(existing.select(*key), list(key), "left_anti")
    return existing.unionByName(fresh.select(*existing.columns))


def one_per_key(rows: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """One row of each key, the same one in every run: the least by all columns that have an order. Spark limits the ranks before the exchange."""
    order = [c for c, kind in rows.dtypes if not kind.startswith(("map", "variant"))]
    least = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(least)).where("_n = 1").drop("_n")


STATUS_KEY = schemas.STATUS_KEY
