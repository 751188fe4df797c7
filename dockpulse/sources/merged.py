"""Tables in a folder whose merges write only the days they touch.

The rows of a merge go to a folder of their own, `rows/batch=n/part=<day>`. Which folders count for a day is a small versioned table of (part, batch), one
row per day and live folder; its new version is complete or absent, and with it the merge. So files are never changed: days that a merge does
not touch keep theirs, readers of an older version are not disturbed, and a batch that is run again, whatever it left before, writes its own folder
and version anew.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dockpulse.sources.tables import one_per_key
from dockpulse.streaming import store

PART, BATCH = "part", "batch"
LIVE = T.StructType([T.StructField(PART, T.DateType()), T.StructField(BATCH, T.LongType())])
NEWEST = 2**62


class MergedTable:
    """Rows of a schema with a key, stored by the day that `day`, an expression over the key, gives. One writer at a time, batches in ascending order.

    A row whose day is null fails the merge. Key values that are null are equal to nothing that is stored. Columns of the table may not be called part or batch.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: tuple[str, ...], day: Column):
        if {PART, BATCH} & set(schema.names):
            raise ValueError("a column called part or batch")
        self.spark, self.path, self.schema, self.key = spark, path, schema, list(key)
        self.day = F.coalesce(day.cast("date"), F.raise_error(F.lit("a row without a day")).cast("date")).alias(PART)

    def live(self, batch_id: int = NEWEST) -> list[tuple[date, int]]:
        """(day, batch) of the folders that count before a batch: as many as there are days, or a few times that until they are compacted."""
        return sorted(tuple(r) for r in store.read_before(self.spark, f"{self.path}/live", batch_id, LIVE).collect())

    def _read(self, folders: list[tuple[date, int]]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        paths = [f"{self.path}/rows/{BATCH}={batch}/{PART}={day}" for day, batch in folders]
        return self.spark.read.schema(self.schema).parquet(*paths)

    def rows(self, first: date | None = None, last: date | None = None) -> DataFrame:
        """All rows, or those of some days; only the folders of these days are opened."""
        return self._read([f for f in self.live() if (first is None or f[0] >= first) and (last is None or f[0] <= last)])

    def _write(self, rows: DataFrame, batch_id: int) -> set[date]:
        """Write a batch's rows by day, in few files a day; returns the days."""
        path = f"{self.path}/rows/{BATCH}={batch_id}"
        parted = rows.select(*self.schema.names, self.day)
        parted.hint("rebalance", F.col(PART)).sortWithinPartitions(PART, *self.key).write.mode("overwrite").partitionBy(PART).parquet(path)
        found = self.spark.read.schema(T.StructType([*self.schema.fields, LIVE[PART]])).parquet(path)
        return {r[0] for r in found.select(PART).distinct().collect()}

    def _publish(self, folders: list[tuple[date, int]], batch_id: int) -> None:
        store.write_version(self.spark.createDataFrame(folders, LIVE).coalesce(1), f"{self.path}/live", batch_id)

    def _offered(self, added: DataFrame, batch_id: int) -> tuple[DataFrame, set[date]]:
        """One row per key of what is added, written once, and its days."""
        store.write_version(one_per_key(added.select(*self.schema.names), self.key), f"{self.path}/added", batch_id)
        rows = self.spark.read.schema(self.schema).parquet(f"{self.path}/added/version={batch_id}")
        return rows, {r[0] for r in rows.select(self.day).distinct().collect()}

    def insert(self, added: DataFrame, batch_id: int) -> None:
        """Add the rows whose key is not stored; of several of a key the least by all columns. Stored rows stay, and so do all files: of the days that are touched the keys are read."""
        before = self.live(batch_id)
        offered, days = self._offered(added, batch_id)
        known = self._read([f for f in before if f[0] in days]).select(*self.key)
        written = self._write(offered.join(known, self.key, "left_anti"), batch_id)
        self._publish(before + [(day, batch_id) for day in written], batch_id)
        self._tidy(batch_id)

    def upsert(self, added: DataFrame, batch_id: int) -> None:
        """Add rows in place of those of equal key; of several of a key the least by all columns. The days that are touched are written anew."""
        before = self.live(batch_id)
        offered, days = self._offered(added, batch_id)
        kept = self._read([f for f in before if f[0] in days]).join(offered.select(*self.key), self.key, "left_anti")
        written = self._write(kept.select(*self.schema.names).unionByName(offered), batch_id)
        self._publish([f for f in before if f[0] not in days] + [(day, batch_id) for day in written], batch_id)
        self._tidy(batch_id)

    def compact(self, batch_id: int, most: int = 8) -> None:
        """Write the days anew that lie in more than `most` folders; a batch of its own that changes no row."""
        before = self.live(batch_id)
        counts: dict[date, int] = {}
        for day, _ in before:
            counts[day] = counts.get(day, 0) + 1
        full = {day for day, n in counts.items() if n > most}
        written = self._write(self._read([f for f in before if f[0] in full]), batch_id)
        self._publish([f for f in before if f[0] not in full] + [(day, batch_id) for day in written], batch_id)
        self._tidy(batch_id)

    def _tidy(self, batch_id: int) -> None:
        """Offered rows and lists of live folders before the last two batches go; folders of rows stay until `vacuum`."""
        for part in ("added", "live"):
            store.drop_old_versions(self.spark, f"{self.path}/{part}", batch_id)

    def vacuum(self) -> int:
        """Remove folders of rows that neither the newest list nor the one before it names, when nobody reads older ones; returns how many."""
        versions = [int(n) for n in store.children(self.spark, f"{self.path}/live", "version=")]
        named = {f for version in versions for f in self.live(version + 1)}
        gone = 0
        for batch in store.children(self.spark, f"{self.path}/rows", f"{BATCH}="):
            for day in store.children(self.spark, f"{self.path}/rows/{BATCH}={batch}", f"{PART}="):
                if (date.fromisoformat(day), int(batch)) not in named and int(batch) <= max(versions, default=-1):
                    store.remove(self.spark, f"{self.path}/rows/{BATCH}={batch}/{PART}={day}")
                    gone += 1
        return gone
