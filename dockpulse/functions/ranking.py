"""Numbers 1, 2, 3, ... over all rows in an order, without a task or a driver that sees them all."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dockpulse.session import shared_dir

# monotonically_increasing_id() has the number of the partition above these bits and the place in the partition in them.
PLACE_BITS = 33


def ranked(frame: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """The rows with `name` (long), their place in the given order from 1 on.

    One exchange by ranges of the order, a sort of each range, and the rows are written with their place in their range; then the sizes of
    the ranges, one number per partition, give each range its offset. Equal rows get different numbers in an arbitrary order that is fixed
    when they are written; they may lie in several ranges, so a tie of a third of all rows is no hot task. No rows give no rows.
    A column of the frame called like `name`, `rank_part_` or `rank_place_` is an error.
    """
    taken = {name, "rank_part_", "rank_place_", "rank_tie_"} & set(frame.columns)
    if taken:
        raise ValueError(f"columns of these names exist already: {sorted(taken)}")
    spark = frame.sparkSession
    path = f"{shared_dir(spark)}/ranks/{uuid.uuid4().hex}"
    keys = [*order, F.col("rank_tie_").asc()]
    rows = frame.withColumn("rank_tie_", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("rank_tie_")
    place = F.monotonically_increasing_id()
    rows.select(
        "*",
        F.shiftright(place, PLACE_BITS).alias("rank_part_"),
        place.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).alias("rank_place_"),
    ).write.option("compression", "zstd").parquet(path)
    found = spark.read.parquet(path)
    sizes = dict(found.groupBy("rank_part_").count().collect())
    offsets, before = [], 0
    for part in sorted(sizes):
        offsets.append((part, before))
        before += sizes[part]
    table = spark.createDataFrame(offsets, "rank_part_ bigint, rank_before_ bigint")
    numbered = found.join(table, "rank_part_")
    return numbered.select(*frame.columns, (F.col("rank_before_") + F.col("rank_place_") + 1).alias(name))
