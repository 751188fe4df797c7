"""Exact de-duplication against a persistent index of text digests."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dockpulse.llm.workspace import SPACE, folder, numbered, rows_of, stored, text_or_empty


def digest(text: Column) -> Column:
    """SHA-256, as bytes, of the text without white space. Null counts as empty."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACE}]+", "").cast("binary"), 256))


class DigestIndex:
    """A table (digest, keep_id, code_points, uid, batch_id) with one row per text seen so far, bucketed and sorted by digest.

    A batch is grouped by digest, joined against the index by a sort-merge anti-join that leaves the index where it
    lies, and its new digests are appended with the index's own bucketing. Appending the same batch again
    adds nothing, so a job that died after its append can be run again. One writer at a time.
    """

    SCHEMA = "digest binary, keep_id bigint, code_points bigint, uid bigint, batch_id string"

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        """Open the index in a folder, or make it. `buckets` must be the same each time; about 128 MB each is a good size."""
        self.spark, self.path = spark, path
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.table = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"create table {self.table} ({self.SCHEMA}) using parquet "
            f"clustered by (digest) sorted by (digest) into {self.buckets} buckets location '{path}'"
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def append(self, batch: DataFrame, batch_id: str = "") -> None:
        """Add the texts of a batch `uid, doc_id, digest, code_points` that the index does not have.

        Of equal texts in the batch the one with most code points stays, then the smallest doc_id (null last), then
        the smallest uid. Copies are reduced before the exchange, so a digest with a third of all rows is no hot task.
        """
        best = F.min(F.struct(-F.col("code_points"), F.col("doc_id").isNull(), F.col("doc_id"), F.col("uid"))).alias("best")
        groups = batch.groupBy("digest").agg(best)
        new = groups.join(self.rows().select("digest").hint("merge"), "digest", "left_anti").select(
            "digest",
            F.col("best.doc_id").alias("keep_id"),
            (-F.col("best.col1")).alias("code_points"),
            F.col("best.uid").alias("uid"),
            F.lit(batch_id).alias("batch_id"),
        )
        new = new.repartition(self.buckets, "digest")  # one file per bucket and batch
        new.write.format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").mode("append").saveAsTable(
            self.table
        )
        self.spark.catalog.refreshTable(self.table)

    def judge(self, batch: DataFrame, batch_id: str = "") -> DataFrame:
        """The batch with `keep_id`, `group_size` (rows of the batch with this text) and `kept`, by a merge join with the index.

        A row is kept if the index took it from this batch, which a uid alone does not tell: every batch numbers its rows anew. A replay passes
        the batch_id of the first run. Repeated rows with one doc_id differ in uid, so one of them is kept.
        """
        sizes = batch.groupBy("digest").agg(F.count("*").alias("group_size"))
        own = F.when(F.col("batch_id") == batch_id, F.col("uid"))
        index = self.rows().select("digest", "keep_id", own.alias("keep_uid")).hint("merge")
        # written, so that the join with the batch has an exchange on both sides and Spark can split a hot digest
        groups = stored(sizes.join(index, "digest"), "digest-groups")
        found = batch.join(groups, "digest")
        return found.withColumn("kept", F.col("uid").eqNullSafe(F.col("keep_uid"))).drop("keep_uid")


def exact_duplicates(docs: DataFrame, path: str | None = None, batch_id: str | None = None) -> DataFrame:
    """`uid, doc_id, keep_id, group_size, kept, text_sha256` of every document, from the index at `path`, or a new one. Without `batch_id` it is a new batch.

    Null and empty texts, and texts of white space only, are equal to each other. An empty table gives no rows.
    """
    spark = docs.sparkSession
    return _judged(_narrow(_stored_with_digest(docs.select("doc_id", "text"))), spark, path, batch_id)


def _stored_with_digest(docs: DataFrame) -> DataFrame:
    text = text_or_empty()
    return docs.select(
        F.monotonically_increasing_id().alias("uid"),
        F.col("doc_id").cast("bigint").alias("doc_id"),
        digest(F.col("text")).alias("digest"),
        F.char_length(text).cast("bigint").alias("code_points"),
    )


def _narrow(rows: DataFrame) -> DataFrame:
    return stored(rows, "digests")


def _judged(batch: DataFrame, spark: SparkSession, path: str | None, batch_id: str | None) -> DataFrame:
    batch_id = batch_id or uuid.uuid4().hex
    index = DigestIndex(spark, path or folder(spark, "digest-index"))
    index.append(batch, batch_id)
    return index.judge(batch, batch_id).select(
        "uid", "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


def drop_exact_duplicates(docs: DataFrame, path: str | None = None, batch_id: str | None = None) -> DataFrame:
    """The documents that stay, with their own columns only."""
    rows = numbered(
        docs,
        "exact",
        doc_id=F.col("doc_id").cast("bigint"),
        digest=digest(F.col("text")),
        code_points=F.char_length(text_or_empty()).cast("bigint"),
    )
    judged = _judged(rows.select("uid", "doc_id", "digest", "code_points"), docs.sparkSession, path, batch_id)
    return rows_of(rows, judged.where("kept"))
