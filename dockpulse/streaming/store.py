"""Tables that micro-batches replace or extend, safe against replays.

A versioned table is a folder with one subfolder per batch. Batch n reads the newest complete version below n and
writes version n; a replay after a lost driver overwrites its own version only. Nothing depends on executor memory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _folder(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def exists(spark: SparkSession, path: str) -> bool:
    files, folder = _folder(spark, path)
    return files.exists(folder)


def children(spark: SparkSession, path: str, prefix: str) -> list[str]:
    """Names below a folder that begin with a prefix, without it, by one listing."""
    files, folder = _folder(spark, path)
    if not files.exists(folder):
        return []
    names = [entry.getPath().getName() for entry in files.listStatus(folder)]
    return [name.removeprefix(prefix) for name in names if name.startswith(prefix)]


def remove(spark: SparkSession, path: str) -> None:
    files, folder = _folder(spark, path)
    files.delete(folder, True)


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of all versions, also of one that is not complete."""
    return sorted(int(name) for name in children(spark, path, "version="))


def _newest(spark: SparkSession, path: str, batch_id: int) -> int | None:
    """The newest complete version older than a batch."""
    for version in reversed(_versions(spark, path)):
        if version < batch_id and exists(spark, f"{path}/version={version}/_SUCCESS"):
            return version
    return None


def read_before(spark: SparkSession, path: str, batch_id: int, schema: T.StructType) -> DataFrame:
    """The newest complete version older than a batch, or no rows."""
    version = _newest(spark, path, batch_id)
    if version is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/version={version}")


def read_latest(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return read_before(spark, path, 2**62, schema)


def read_all(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All versions together: for outputs of which every batch wrote its own part. One folder is read, whatever the number of batches; only
    the newest version can be incomplete."""
    version = _newest(spark, path, 2**62)
    if version is None:
        return spark.createDataFrame([], schema)
    parts = T.StructType([*schema.fields, T.StructField("version", T.LongType())])
    return spark.read.schema(parts).parquet(path).where(F.col("version") <= version).select(*schema.names)


def write_version(rows: DataFrame, path: str, batch_id: int, *parts: str) -> None:
    rows.write.mode("overwrite").partitionBy(*parts).parquet(f"{path}/version={batch_id}")


def drop_old_versions(spark: SparkSession, path: str, batch_id: int, keep: int = 2) -> None:
    """Remove all but the newest versions up to a batch; the last ones stay for replays."""
    for version in [v for v in _versions(spark, path) if v <= batch_id][:-keep]:
        remove(spark, f"{path}/version={version}")
