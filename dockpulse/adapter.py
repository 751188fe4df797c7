"""The model's tables, projected from the generic test tables.

`events` plays the station status series (a user is a station), `customer` the stations, `events` again the feed
request log, `nation`, `region`, `part` and `supplier` the small feed dimensions. Every projection covers its whole table.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dockpulse import schemas
from dockpulse.params import at, epoch
from dockpulse.session import configure
from dockpulse.sources.tables import read_table, write_status

FIRST_VERSION = datetime(2023, 12, 1)
SECOND_VERSION = datetime(2024, 1, 15, 12)
SNAPSHOT = datetime(2024, 2, 1)
SENTINEL = datetime(2023, 12, 20, 5, 20, 38)


def _int(column: Column) -> Column:
    return column.cast("int")


class Tables:
    """Lazy access to the model tables of one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = configure(spark)
        self.sf_dir = sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def events(self) -> DataFrame:
        second = F.date_trunc("second", "ts").cast("timestamp_ntz")
        k = F.get_json_object("props", "$.k").cast("int")
        return self.raw("events").withColumn("s", second).withColumn("k", k)

    def status(self) -> DataFrame:
        """One row per station and second. The rank limit runs before the exchange, so copies never travel."""
        latest = Window.partitionBy("user_id", "s").orderBy(F.desc("event_id"))
        e = self.events().withColumn("rn", F.row_number().over(latest)).where("rn = 1")
        station = _int(F.col("user_id"))
        v = _int(F.floor("value"))
        late = (F.col("user_id") % 3 == 0) & (F.col("s") >= at(SECOND_VERSION))
        capacity = F.when(late, 20).otherwise(18)
        iconic, efit, g5 = v % 12, F.col("k") % 5, _int(F.col("event_id") % 4)
        disabled, docks_disabled = F.col("k") % 4, _int(F.col("event_id") % 2)
        free = capacity - iconic - efit - g5 - disabled - docks_disabled
        in_service = F.col("event_type") != "error"
        return e.select(
            station.alias("info_station_id"),
            F.when(late, at(SECOND_VERSION)).otherwise(at(FIRST_VERSION)).alias("info_reported"),
            station.alias("station_id"),
            F.col("s").alias("last_reported"),
            (iconic + efit + g5).alias("num_bikes_available"),
            disabled.alias("num_bikes_disabled"),
            F.greatest(F.lit(0), free).alias("num_docks_available"),
            docks_disabled.alias("num_docks_disabled"),
            (station % 4 == 0).alias("is_charging_station"),
            F.when(in_service, "IN_SERVICE").otherwise("MAINTENANCE").alias("status"),
            F.lit(True).alias("is_installed"),
            in_service.alias("is_renting"),
            (F.col("event_type") != "signup").alias("is_returning"),
            F.lit(None).cast("string").alias("traffic"),
            F.greatest(F.lit(0), free).alias("vehicle_docks_available"),
            F.lit(0).alias("vehicle_types_available_boost"),
            iconic.alias("vehicle_types_available_iconic"),
            efit.alias("vehicle_types_available_efit"),
            g5.alias("vehicle_types_available_efit_g5"),
        )

    def orphaned_status(self) -> DataFrame:
        """Status rows whose information reference is broken for every seventh station."""
        broken = F.col("station_id") % 7 == 0
        return self.status().withColumn("info_reported", F.when(broken, at(SENTINEL)).otherwise(F.col("info_reported")))

    def information(self) -> DataFrame:
        """Versions of every station that has events; every third station has a second version."""
        stations = self.raw("events").select(F.col("user_id").alias("c_custkey")).distinct()
        versions = F.when(F.col("c_custkey") % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
        c = (
            self.raw("customer")
            .join(stations, "c_custkey", "left_semi")
            .select("*", F.explode(versions).alias("v"))
        )
        return self._describe(c).select(
            _int(F.col("c_custkey") * 2 + F.col("v") + 1).alias("id"),
            *[F.col(name) for name in schemas.STATION_INFORMATION.names[1:-2]],
            ((F.col("c_custkey") % 3 != 0) | (F.col("v") == 1)).alias("active"),
            F.when(F.col("v") == 1, at(SECOND_VERSION)).otherwise(at(FIRST_VERSION)).alias("reported"),
        )

    def _describe(self, customers: DataFrame) -> DataFrame:
        key = F.col("c_custkey")
        return customers.select(
            "*",
            _int(key).alias("station_id"),
            F.col("c_name").alias("name"),
            F.when(key % 2 == 0, "REGULAR").otherwise("VAULT").alias("physical_configuration"),
            (F.lit(43.0) + F.col("c_nationkey") / F.lit(100.0)).alias("lat"),
            (F.lit(-79.0) - F.col("c_nationkey") / F.lit(100.0)).alias("lon"),
            F.lit(0.0).alias("altitude"),
            F.col("c_mktsegment").alias("address"),
            (F.lit(18) + 2 * F.col("v")).alias("capacity"),
            (key % 4 == 0).alias("is_charging_station"),
            F.array(F.lit("KEY"), F.lit("PHONE")).alias("rental_methods"),
            F.lit(False).alias("is_valet_station"),
            F.lit(False).alias("is_virtual_station"),
            F.array(F.lit("zone")).alias("groups"),
            F.lit("416").alias("obcn"),
            F.lit(500.0).alias("nearby_distance"),
            F.lit(None).cast("string").alias("bluetooth_id"),
            F.lit(True).alias("ride_code_support"),
            F.array(F.lit(""), F.lit(""), F.lit("")).alias("rental_uris"),
        )

    def information_snapshot(self) -> DataFrame:
        """A later snapshot of the stations: capacity changed where the balance is negative, some stations new."""
        customers = self.raw("customer").withColumn("v", _int(F.col("c_custkey") % 3 == 0))
        stations = self.raw("events").select(F.col("user_id").alias("c_custkey")).distinct()
        known = customers.join(stations, "c_custkey", "left_semi")
        new = customers.where("c_acctbal > 9000").join(stations, "c_custkey", "left_anti")
        shift = F.when(F.col("c_acctbal") < 0, 1).otherwise(0)
        return (
            self._describe(known.unionByName(new))
            .withColumn("capacity", F.col("capacity") + shift)
            .withColumn("reported", at(SNAPSHOT))
            .select(*[n for n in schemas.STATION_INFORMATION.names if n not in ("id", "active")])
        )

    def query_log(self) -> DataFrame:
        k, kind = F.col("k"), F.col("event_type")
        ok = k % 10 != 0
        endpoint = (
            F.when(kind == "view", "station_status")
            .when(kind == "click", "station_information")
            .when(kind == "signup", "system_information")
            .when(kind == "error", "versions")
            .otherwise("vehicle_types")
        )
        return self.events().select(
            F.col("event_id").alias("id"),
            F.col("s").alias("time"),
            endpoint.alias("endpoint"),
            ok.alias("success"),
            F.when(~ok, F.concat(F.lit("Decode failure: "), kind)).alias("error_msg"),
            F.when(~ok & (k % 20 == 0), F.col("props")).alias("error_json"),
        )

    def system_counts(self) -> DataFrame:
        """One row per day; users are bucketed into counts first, so no day is collected into one task."""
        day = F.date_trunc("day", "ts").cast("timestamp_ntz")
        kind = F.col("event_type")
        return (
            self.raw("events")
            .groupBy(day.alias("reported"))
            .agg(
                _int(F.count_distinct("user_id")).alias("station_count"),
                _int(F.count_if(kind.isin("view", "click"))).alias("mechanical_count"),
                _int(F.count_if(~kind.isin("view", "click"))).alias("ebike_count"),
            )
        )

    # Feed documents, one small document per row, built from the tables above.

    def status_documents(self, rows: DataFrame | None = None) -> DataFrame:
        """One document per status row, of all rows or of some."""

        def counted(name: str, column: str) -> Column:
            return F.struct(F.lit(name).alias("vehicle_type_id"), F.col(column).alias("count"))

        item = F.struct(
            F.col("station_id").cast("string").alias("station_id"),
            "num_bikes_available",
            "num_bikes_disabled",
            "num_docks_available",
            "num_docks_disabled",
            epoch("last_reported").alias("last_reported"),
            "is_charging_station",
            "status",
            "is_installed",
            "is_renting",
            "is_returning",
            "traffic",
            F.array(
                F.struct(
                    F.array(F.lit("ICONIC")).alias("vehicle_type_ids"),
                    F.col("vehicle_docks_available").alias("count"),
                )
            ).alias("vehicle_docks_available"),
            F.array(
                counted("ICONIC", "vehicle_types_available_iconic"),
                counted("EFIT", "vehicle_types_available_efit"),
                counted("EFIT G5", "vehicle_types_available_efit_g5"),
            ).alias("vehicle_types_available"),
        )
        rows = self.status() if rows is None else rows
        return rows.select(document("stations", item, epoch("last_reported")).alias("value"))

    def information_documents(self) -> DataFrame:
        item = F.struct(
            F.col("station_id").cast("string").alias("station_id"),
            *[
                n
                for n in schemas.FEED_STATION_INFORMATION.names
                if n not in ("station_id", "_bluetooth_id", "_ride_code_support", "rental_uris")
            ],
            F.lit("").alias("_bluetooth_id"),
            F.col("ride_code_support").alias("_ride_code_support"),
            F.struct(F.lit("").alias("android")).alias("rental_uris"),
        )
        return self.information().select(document("stations", item, epoch("reported")).alias("value"))

    def system_documents(self) -> DataFrame:
        data = F.struct(
            F.col("station_count").alias("_station_count"),
            F.struct(
                F.col("mechanical_count").alias("_mechanical_count"), F.col("ebike_count").alias("_ebike_count")
            ).alias("_vehicle_count"),
            *[F.lit("1.0").alias(f"build_{part}") for part in ("hash", "label", "number", "version")],
            F.lit("en").alias("language"),
            F.lit("bikes").alias("system_id"),
            F.lit("12").alias("mobile_head_version"),
            F.lit("8").alias("mobile_minimum_supported_version"),
            F.lit("bike_share").alias("name"),
            F.lit("America/Toronto").alias("timezone"),
        )
        return self.system_counts().select(document(None, data, epoch("reported")).alias("value"))

    def log_documents(self) -> DataFrame:
        """One region document per event: good ones, JSON of another shape, and text that is not JSON."""
        region = F.struct(F.col("user_id").cast("string").alias("region_id"), F.col("event_type").alias("region_name"))
        good = document("regions", region, epoch("s"))
        value = F.when(F.col("k") % 20 == 0, F.lit("gateway timeout")).when(F.col("k") % 10 == 0, F.col("props"))
        return self.events().select("s", value.otherwise(good).alias("value"))

    def dimension_documents(self, kind: str) -> DataFrame:
        text = lambda name: F.col(name).cast("string")
        rows, key, item = {
            "regions": (
                self.raw("nation"),
                "regions",
                F.struct(text("n_nationkey").alias("region_id"), F.col("n_name").alias("region_name")),
            ),
            "versions": (
                self.raw("region"),
                "versions",
                F.struct(text("r_regionkey").alias("version"), F.col("r_name").alias("url")),
            ),
            "plans": (
                self.raw("part"),
                "plans",
                F.struct(
                    text("p_partkey").alias("plan_id"),
                    F.col("p_name").alias("name"),
                    F.lit("CAD").alias("currency"),
                    F.col("p_retailprice").alias("price"),
                    F.col("p_brand").alias("description"),
                    (F.col("p_partkey") % 2 == 0).alias("is_taxable"),
                ),
            ),
            "vehicle_types": (
                self.raw("supplier"),
                "vehicle_types",
                F.struct(
                    text("s_suppkey").alias("vehicle_type_id"),
                    F.lit("bicycle").alias("form_factor"),
                    F.lit("human").alias("propulsion_type"),
                    F.col("s_acctbal").alias("max_range_meters"),
                    F.col("s_name").alias("name"),
                    text("s_nationkey").alias("default_pricing_plan_id"),
                ),
            ),
        }[kind]
        return rows.select(document(key, item, F.lit(1_704_067_200)).alias("value"))


class StoredTables(Tables):
    """The same tables read from a folder of model tables, as an ingest would leave them."""

    def __init__(self, spark: SparkSession, sf_dir: str, folder: str):
        super().__init__(spark, sf_dir)
        self.folder = folder

    def store(self) -> StoredTables:
        write_status(Tables.status(self), f"{self.folder}/status", "overwrite")
        for name, rows in (("information", Tables.information(self)), ("query_log", Tables.query_log(self))):
            rows.write.mode("overwrite").parquet(f"{self.folder}/{name}")
        Tables.information_documents(self).write.mode("overwrite").text(f"{self.folder}/information_documents")
        return self

    def status(self) -> DataFrame:
        return read_table(self.spark, f"{self.folder}/status", schemas.STORED_STATUS)

    def information(self) -> DataFrame:
        return read_table(self.spark, f"{self.folder}/information", schemas.STATION_INFORMATION)

    def query_log(self) -> DataFrame:
        return read_table(self.spark, f"{self.folder}/query_log", schemas.QUERY_LOG)

    def information_documents(self) -> DataFrame:
        return self.spark.read.text(f"{self.folder}/information_documents")


def document(key: str | None, item: Column, updated: Column) -> Column:
    data = item if key is None else F.struct(F.array(item).alias(key))
    return F.to_json(
        F.struct(
            updated.alias("last_updated"), F.lit(30).alias("ttl"), F.lit("2.3").alias("version"), data.alias("data")
        )
    )
