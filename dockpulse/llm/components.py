"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockpulse.llm.workspace import stored


def _mark(edges: DataFrame) -> tuple:
    """Row count and an order-free sum over the edges: equal marks of two rounds mean that nothing changed."""
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(edges: DataFrame) -> DataFrame:
    """`node`, `root` for every node of the edges `a`, `b`: the root is the component's smallest node.

    Alternating large and small stars. Each star is one aggregate and one equi-join; no neighbour list is gathered, so a hub with
    a third of all edges is a skewed join that Spark can split. Every round is a written table. Empty edges give no rows;
    loops and repeated edges count once.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    edges = stored(edges.where("a <> b").select(high.alias("a"), low.alias("b")).distinct(), "edges")
    mark = _mark(edges)
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        below = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stored(least.select("a", F.col("m").alias("b")).unionByName(below).distinct(), "edges")
        last, mark = mark, _mark(edges)
        if mark == last:
            break
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def united(first: DataFrame, second: DataFrame) -> DataFrame:
    """The rows `uid, root, ...` of the first grouping with the roots of both: groups that share a row are one. The second has `uid, root` of the same rows."""
    both = stored(first.join(second.select("uid", F.col("root").alias("other")), "uid"), "both")
    least = both.groupBy("other").agg(F.min("root").alias("b"))
    links = both.select(F.col("root").alias("a"), "other").distinct().join(least, "other").select("a", "b")
    roots = components(links).select(F.col("node").alias("root"), F.col("root").alias("of"))
    return both.drop("other").join(roots, "root", "left").withColumn("root", F.coalesce("of", "root")).drop("of")
