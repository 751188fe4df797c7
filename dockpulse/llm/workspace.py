"""Tables between two jobs of one operator, in the folder all executors share."""

from __future__ import annotations

import sys
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dockpulse.session import shared_dir
from dockpulse.streaming import store

# The white space that separates words, as the inside of a character class.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


def ship(module: str) -> None:
    """Send a module's functions to the workers as code, so that the executors need not have the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def folder(spark: SparkSession, name: str) -> str:
    """A new folder of one run. What a failed or repeated run left is never read."""
    return f"{shared_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"


def stored(frame: DataFrame, name: str) -> DataFrame:
    """The rows written once and read back: cuts the lineage, and fixes what only one evaluation can fix."""
    path = folder(frame.sparkSession, name)
    frame.write.option("compression", "zstd").parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


class Passing:
    """Tables of one run whose operator says itself when it has read them for the last time.

    The shuffle files of a table go once it is written, the table when it is dropped, so what a run of many steps has on disk at once is what its steps still read.
    """

    CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def write(self, frame: DataFrame, name: str) -> DataFrame:
        """As `stored`. The frame is evaluated here alone."""
        path, before = folder(self.spark, name), self.spark.conf.get(self.CLEAN, "false")
        self.spark.conf.set(self.CLEAN, "true")
        try:
            frame.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(self.CLEAN, before)
        table = self.spark.read.schema(frame.schema).parquet(path)
        self.paths[id(table)] = (table, path)
        return table

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more, results that are still to be computed included."""
        for table in tables:
            store.remove(self.spark, self.paths.pop(id(table))[1])


def numbered(docs: DataFrame, name: str, **more: Column) -> DataFrame:
    """Stored rows `uid`, `row` (all columns of `docs`, whatever their names) and further columns.

    Row numbers are written, not computed again: a second evaluation could number the rows differently.
    """
    columns = [F.monotonically_increasing_id().alias("uid"), F.struct(*docs.columns).alias("row")]
    return stored(docs.select(*columns, *[c.alias(k) for k, c in more.items()]), name)


def rows_of(numbered_rows: DataFrame, uids: DataFrame) -> DataFrame:
    """The original rows, with their own columns only, whose `uid` is in `uids`."""
    return numbered_rows.join(uids.select("uid"), "uid", "left_semi").select("row.*")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))
