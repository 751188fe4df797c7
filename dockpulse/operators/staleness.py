"""Which feed responses were fresh: the batch form.

A response is accepted if its update time is at least that of the last accepted response plus that one's ttl. So every row
points to the one that would be accepted after it, and the accepted rows are those on the way from the first. Rows are split
by (endpoint, day). Every day first tells, for each row it could start with, the time from which it would let the next day go
on; these few rows are chained per endpoint; then each day marks its rows, knowing its start. Pointers are followed by
doubling: after k rounds a pointer is 2^k rows long. A day holds one row per second at most, since equal times are reduced
first, so its pointers are an array of bounded length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["endpoint", "segment"]
SEGMENT_SECONDS = 86_400
# A time before all others.
EVER = -(1 << 62)


def _pointed(rows: DataFrame, keys: list[str], *more: str) -> DataFrame:
    """A row per key: `nodes`, its rows (at, due, more) by time, and `following`, for each the place of the first row at or after its due time, or null.

    Times are unique in a key. Each row goes through the window twice, at its own time and at its due time, where the rows before it are counted.
    """
    node = F.struct("at", "due", *more)
    twice = F.array(F.struct(F.col("due").alias("time"), F.lit(0).alias("own")), F.struct(F.col("at").alias("time"), F.lit(1).alias("own")))
    events = rows.select(*keys, node.alias("node"), F.explode(twice).alias("event")).select(*keys, "node", "event.*")
    earlier = Window.partitionBy(*keys).orderBy("time", "own").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    events = events.withColumn("place", F.sum("own").over(earlier).cast("int"))
    own, due = F.col("own") == 1, F.col("own") == 0
    found = events.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.when(own, F.col("node")))).alias("nodes"),
        F.sort_array(F.collect_list(F.when(due, F.struct("node.at", "place")))).alias("places"),
    )
    following = F.transform("places", lambda x: F.when(x["place"] < F.size("nodes"), x["place"]))
    return found.select(*keys, "nodes", following.alias("following"))


def _rounds() -> Column:
    return F.sequence(F.lit(1), F.greatest(F.ceil(F.log2(F.size("following"))), F.lit(1)).cast("int"))


def _ends() -> Column:
    """For each node the place of the last one that is reached from it."""
    own = F.transform("following", lambda x, i: F.coalesce(x, i))
    return F.reduce(_rounds(), own, lambda to, _: F.transform(to, lambda x: F.get(to, x)))


def _reached(start: Column) -> Column:
    """The places of all nodes that are reached from a start, itself included, in order; none if the start is no place.

    What the first 2^k nodes point to, 2^k nodes further, are the next 2^k.
    """

    def double(state: Column, _: Column) -> Column:
        to, seen = state["to"], state["seen"]
        further = F.filter(F.transform(seen, lambda x: F.get(to, x)), lambda x: x.isNotNull())
        return F.struct(F.transform(to, lambda x: F.get(to, x)).alias("to"), F.concat(seen, further).alias("seen"))

    first = F.filter(F.array(start), lambda x: x < F.size("nodes"))
    return F.reduce(_rounds(), F.struct(F.col("following").alias("to"), first.alias("seen")), double, lambda state: state["seen"])


def _place_of(time: str) -> Column:
    """The place of the first node at or after a time; the number of nodes if there is none."""
    return F.size(F.filter("nodes", lambda x: x["at"] < F.col(time)))


def _exits(days: DataFrame) -> DataFrame:
    """(endpoint, segment, at, due): the time from which the next day goes on if a day is entered at a row.

    Only rows up to the latest due time of earlier days, `reach`, can be the first accepted one, besides the first. Neighbouring entries mostly leave with
    the same due time: of such a run only the last entry is kept.
    """
    leaving = F.transform("ends", lambda x: F.get("nodes", x)["due"])
    found = days.withColumn("ends", _ends()).withColumn("leaving", leaving)
    found = found.withColumn("entries", F.least(_place_of("reach") + 1, F.size("nodes")))
    last = lambda x, i: (i == F.col("entries") - 1) | (F.get("leaving", i) != F.get("leaving", i + 1))
    entry = F.transform("nodes", lambda x, i: F.struct(x["at"].alias("at"), F.get("leaving", i).alias("due")))
    kept = F.filter(F.slice(entry, F.lit(1), F.col("entries")), last)
    return found.select(*KEYS, F.inline(kept))


def _starts(exits: DataFrame, before: DataFrame | None) -> DataFrame:
    """(endpoint, segment, start): the due time with which each day begins that has an accepted row. A way through the exits visits a day once."""
    ways = _pointed(exits, ["endpoint"], "segment")
    if before is None:
        ways = ways.withColumn("left", F.lit(EVER))
    else:
        ways = ways.join(before, "endpoint", "left").withColumn("left", F.coalesce("left", F.lit(EVER)))
    ways = ways.withColumn("way", _reached(_place_of("left")))
    start = lambda i: F.when(i == 0, F.col("left")).otherwise(F.get("nodes", F.get("way", i - 1))["due"])
    visits = F.transform("way", lambda x, i: F.struct(F.get("nodes", x)["segment"].alias("segment"), start(i).alias("start")))
    return ways.select("endpoint", F.inline(visits))


def fresh_responses(responses: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """Accepted rows of (endpoint, updated, ttl, id), in update order; of equal times the smallest id, ttl positive.

    `before` has the due time (endpoint, due) that earlier responses left, one per endpoint, for a batch that goes on from them.
    """
    rows = (
        responses.groupBy("endpoint", "updated")
        .agg(F.min_by("ttl", "id").cast("long").alias("ttl"), F.min("id").alias("id"))
        .select("endpoint", F.floor(F.col("updated") / SEGMENT_SECONDS).alias("segment"), F.col("updated").alias("at"), "ttl", "id")
        .withColumn("due", F.col("at") + F.col("ttl"))
    )
    days = _pointed(rows, KEYS, "ttl", "id")
    # how far the ttls of earlier days reach: one row per (endpoint, day)
    earlier = Window.partitionBy("endpoint").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    reach = rows.groupBy(*KEYS).agg(F.max("due").alias("due")).select(*KEYS, F.max("due").over(earlier).alias("reach"))
    if before is not None:
        before = before.select("endpoint", F.col("due").cast("long").alias("left"))
        reach = reach.join(before, "endpoint", "left").select(*KEYS, F.greatest("reach", "left").alias("reach"))
    exits = _exits(days.join(reach.withColumn("reach", F.coalesce("reach", F.lit(EVER))), KEYS))
    started = days.join(_starts(exits, before), KEYS).withColumn("way", _reached(_place_of("start")))
    accepted = started.select("endpoint", F.inline(F.transform("way", lambda x: F.get("nodes", x))))
    return accepted.select("endpoint", F.col("at").alias("updated"), "ttl", "id")
