"""Numbers over all rows against sorted lists."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from dockpulse.functions.ranking import ranked


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_ranks_are_places_in_the_sorted_list(spark, partitions):
    rng = random.Random(5)
    rows = [(i, rng.choice([None, 1, 2, 3, rng.randrange(10**6)]), f"t{i}") for i in range(3000)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        frame = spark.createDataFrame(rows, "id bigint, v bigint, text string").repartition(5)
        found = ranked(frame, F.col("v").desc_nulls_last(), F.col("id")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    wanted = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert [tuple(r)[:3] for r in sorted(found, key=lambda r: r["rank"])] == wanted
    assert sorted(r["rank"] for r in found) == list(range(1, 3001))


def test_ties_over_the_edges_of_ranges(spark):
    """A value that most rows share lies in several ranges; every row still has a number of its own."""
    frame = spark.range(0, 5000, 1, 9).select((F.col("id") % 10 == 0).cast("int").alias("v"), F.lit("same").alias("w"))
    found = ranked(frame, F.col("v").asc()).collect()
    assert sorted(r["rank"] for r in found) == list(range(1, 5001))
    assert {r["v"] for r in found if r["rank"] <= 4500} == {0}
    assert max(frame.repartitionByRange(8, F.col("v"), F.monotonically_increasing_id()).groupBy(F.spark_partition_id()).count().toPandas()["count"]) < 1500


def test_no_rows_and_clashing_names(spark):
    assert ranked(spark.createDataFrame([], "a int"), F.col("a")).collect() == []
    with pytest.raises(ValueError, match="rank"):
        ranked(spark.createDataFrame([(1,)], "rank int"), F.col("rank"))


def test_no_window_in_the_plan(spark):
    found = ranked(spark.range(100).toDF("a"), F.col("a").desc())
    assert "Window" not in found._jdf.queryExecution().toString()
