"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dockpulse.functions.ranking import ranked
from dockpulse.llm.workspace import WORD, numbered, stored

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
MOST_COPIES = 2
TOLERANCE = 1e-7
MOST_STEPS = 60
# Documents of one source and size that are ranked together.
GROUP = 1 << 16


def words_of(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def _level(sources: DataFrame, budget: float, most: int) -> float:
    """Words per unit of weight at which the budget is spent, if no source takes more than `most` times its size.

    Each round shares what full sources leave among the others by weight; the level rises, and more sources are full, until none is above its limit. A
    round is one sum over the sources, of which three numbers reach the driver.
    """
    sums = (F.count("*").alias("n"), F.coalesce(F.sum("source_size"), F.lit(0)).alias("size"), F.coalesce(F.sum("weight"), F.lit(0)).alias("weight"))
    every = sources.agg(*sums).first()
    n, size, weight = 0, 0, 0
    while weight < every["weight"]:
        level = (budget * every["size"] - most * size) / (every["weight"] - weight)
        full = sources.where(F.col("source_size") * float(most) <= F.col("weight") * F.lit(level)).agg(*sums).first()
        if full["n"] == n:
            return level
        n, size, weight = full
    return math.inf


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, most: int = MOST_COPIES) -> DataFrame:
    """Sources `source, source_size` (one row each) with `target`: the share of `budget` times all words by weight, `most` times the size at most.

    Weights go round over the sources by code point, null last; their places come from ranges, so no task sees all sources, however many there
    are. What a full source cannot take is shared by weight among the others. Repeated sources are sources of their own; no sources give no rows.
    """
    placed = ranked(sources, F.col("source").asc_nulls_last(), name="place")
    weight = F.get(F.array(*map(F.lit, weights)), ((F.col("place") - 1) % len(weights)).cast("int")).cast("bigint")
    placed = placed.select("source", "source_size", weight.alias("weight"))
    share = F.least(F.col("source_size") * float(most), F.col("weight") * F.lit(_level(placed, budget, most)))
    return placed.select("source", "source_size", share.alias("target"))


def _rate(tilt: Column, feature: Column, most: int) -> Column:
    return most / (1 + F.exp(-tilt * feature))


def tilts(sizes: DataFrame, goals: DataFrame, most: int = MOST_COPIES) -> DataFrame:
    """Per open source its `mean` size and `tilt`: the dual solution of the token constraint, by Newton steps over all sizes at once.

    `sizes` has `source, size, n`. Rates between 0 and `most` that stay closest to most/2 copies of every document in (binary) entropy, subject to the
    target, are most / (1 + exp(-tilt * size / mean)). Tokens taken grow with the tilt, bending down above 0 and up below, so the
    steps from 0 never pass the solution. Each step is one aggregation by source; its result is a written table of one row per source.
    """
    mean = goals.where("target > 0 and target < source_size * %d" % most)
    counts = sizes.where("size > 0").groupBy("source").agg(F.sum("n").alias("docs"))
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    open_ = mean.join(counts, same(mean, counts)).select(
        mean["source"], "target", (F.col("source_size") / F.col("docs")).alias("mean"), F.lit(0.0).alias("tilt"), F.lit(1.0).alias("off")
    )
    state = stored(open_, "tilts")
    data = sizes.where("size > 0")
    for _ in range(MOST_STEPS):
        row = state.agg(F.max(F.abs("off")).alias("off")).first()
        if row["off"] is None or row["off"] < TOLERANCE:
            break
        joined = data.join(state, same(data, state)).select(state["source"], "size", "n", "target", "mean", "tilt")
        x = F.col("size") / F.col("mean")
        rate = _rate(F.col("tilt"), x, most)
        sums = joined.groupBy("source", "target", "mean", "tilt").agg(
            F.sum(F.col("n") * F.col("size") * rate).alias("taken"),
            F.sum(F.col("n") * F.col("size") * x * rate * (1 - rate / most)).alias("slope"),
        )
        off = (F.col("target") - F.col("taken")) / F.col("target")
        step = F.when(F.col("slope") > 0, (F.col("target") - F.col("taken")) / F.col("slope")).otherwise(0.0)
        state = stored(
            sums.select("source", "target", "mean", (F.col("tilt") + step).alias("tilt"), F.when(F.col("slope") > 0, off).otherwise(0.0).alias("off")),
            "tilts",
        )
    return state.select("source", "mean", "tilt")


def copies(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, most: int = MOST_COPIES) -> DataFrame:
    """Rows `uid, doc_id, source, size` (stored) with `source_size`, `target` and `copies`.

    The rate of a document depends on its source and size only, so all sums run over counts of (source, size). Rates become whole
    copies by going through a source from long to short documents and handing out a copy whenever the running sum of rates passes a
    half: the taken words miss the target by half the longest document at most. Equal documents take turns by a hash of doc_id. Groups of equal size are split into
    parts of about `GROUP`, so no ranking sees more.
    """
    sizes = stored(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "sizes")
    sources = sizes.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    goals = stored(targets(sources, weights, budget, most), "targets")
    dual = tilts(sizes, goals, most)
    same = lambda a, b, *more: [a[c].eqNullSafe(b[c]) for c in ("source", *more)]
    known = sizes.join(goals, same(sizes, goals)).select(sizes["source"], "size", "n", "source_size", "target")
    known = known.join(dual, same(known, dual), "left").select(known["source"], "size", "n", "source_size", "target", "mean", "tilt")
    rate = F.when(F.col("mean").isNotNull(), _rate(F.col("tilt"), F.col("size") / F.col("mean"), most))
    rate = rate.otherwise(F.when(F.col("target") > 0, float(most)).otherwise(0.0))
    known = known.withColumn("rate", rate).withColumn("parts", F.ceil(F.col("n") / GROUP)).drop("mean", "tilt", "n")
    turn = F.xxhash64("doc_id")
    dealt = rows.join(known, same(rows, known, "size")).select(
        "uid", "doc_id", rows["source"], rows["size"], "source_size", "target", "rate", F.pmod(turn, "parts").alias("part")
    )
    dealt = stored(dealt, "dealt")
    groups = dealt.groupBy("source", "size", "part").agg(F.count("*").alias("n"), F.first("rate").alias("rate"))
    order = Window.partitionBy("source").orderBy(F.desc("size"), "part")
    to = F.sum(F.col("n") * F.col("rate")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    before = F.sum(F.col("n") * F.col("rate")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    given = F.floor(to + 0.5) - F.floor(F.coalesce(before, F.lit(0.0)) + 0.5)
    groups = groups.withColumn("given", F.least(given, F.col("n") * most))
    groups = groups.select(
        "source", "size", "part", F.floor(F.col("given") / F.col("n")).alias("each"), (F.col("given") % F.col("n")).alias("more")
    )
    rank = F.row_number().over(Window.partitionBy("source", "size", "part").orderBy(turn, "doc_id", "uid"))
    turns = dealt.withColumn("rank", rank)
    found = turns.join(groups, same(turns, groups, "size", "part"))
    return found.select(
        "uid",
        "doc_id",
        turns["source"],
        turns["size"],
        "source_size",
        "target",
        (F.col("each") + (F.col("rank") <= F.col("more")).cast("bigint")).alias("copies"),
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """`doc_id, source, size, source_size, target, copies, taken` of every document of columns `doc_id, text, source`.

    A null text has no words and is its source's smallest document; its copies take nothing. Sources without words have target 0. Rows
    that repeat are documents of their own. A null source is a source, the last one. Ties of size go by doc_id, then by row. Texts of any length count whole; an empty
    table gives no rows; other columns are not looked at.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("bigint").alias("doc_id"), "source", words_of().alias("size"))
    found = copies(stored(rows, "sized"), **options)
    return found.select("*", (F.col("copies") * F.col("size")).alias("taken")).drop("uid")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents, each as often as the mix takes it, with their own columns only, whatever their names. Documents without words (null texts too) are left as they are,
    once. Ties, repeats and long texts as in `mix`; an empty table stays empty."""
    rows = numbered(docs, "mixed", size=words_of())
    found = copies(rows.select("uid", F.col("row.doc_id").cast("bigint").alias("doc_id"), "row.source", "size"), **options)
    times = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.col("copies")).cast("int")
    found = found.select("uid", times.alias("times")).where("times > 0")
    return rows.join(found, "uid").select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")
