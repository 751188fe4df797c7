"""Segmented windows against plain windows per station, with one station holding a third of all rows."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from dockpulse.functions.neighbours import STATION, as_of, running_changes, sums_over_neighbours, with_neighbours
from dockpulse.operators import staleness
from dockpulse.params import epoch

VALUE = "num_bikes_available"


@pytest.fixture(scope="module")
def skewed(spark):
    random = np.random.default_rng(7)
    rows = []
    for station, count, span in [(1, 1500, 6 * 86400), (2, 40, 40 * 86400), *[(s, 100, 9 * 86400) for s in range(3, 32)]]:
        seconds = np.sort(random.choice(span, count, replace=False))
        if station == 2:
            seconds = seconds - seconds % 86400  # midnights only: every row is an edge of its segment
            seconds = np.unique(seconds)
        values = random.integers(0, 4, len(seconds))
        start = datetime(2024, 1, 1)
        rows += [
            (station, start, start + timedelta(seconds=int(s)), int(v), int(v) % 2 == 0)
            for s, v in zip(seconds, values, strict=True)
        ]
    schema = f"{STATION} int, info_reported timestamp_ntz, last_reported timestamp_ntz, {VALUE} int, flag boolean"
    return spark.createDataFrame(rows, schema).repartition(6).cache()


def plain():
    return Window.partitionBy(STATION).orderBy("last_reported")


def same(a, b):
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_rows(skewed):
    ours = with_neighbours(skewed, [VALUE, "last_reported"], following=True)
    same(
        ours.select(STATION, "last_reported", f"_prev.{VALUE}", F.col("_next.last_reported").alias("after")),
        skewed.select(
            STATION,
            "last_reported",
            F.lag(VALUE).over(plain()).alias(VALUE),
            F.lead("last_reported").over(plain()).alias("after"),
        ),
    )


@pytest.mark.parametrize("following", [(), ("ts",)])
def test_sums(skewed, following):
    rows = skewed.withColumn("ts", epoch("last_reported"))
    terms = {
        "rises": f"if({VALUE} > prev_{VALUE}, {VALUE} - prev_{VALUE}, null)",
        "first": "if(prev_ts is null, 1, 0)",
        "rows": "1",
    }
    before = F.lag(VALUE).over(plain())
    expected = {
        "rises": F.when(F.col(VALUE) > before, F.col(VALUE) - before),
        "first": F.when(before.isNull(), 1).otherwise(0),
        "rows": F.lit(1),
    }
    if following:
        terms["wait"] = "coalesce(next_ts, 0) - ts"
        expected["wait"] = F.coalesce(F.lead("ts").over(plain()), F.lit(0)) - F.col("ts")
    ours = sums_over_neighbours(rows, terms, [VALUE, "ts"], following=following)
    per_row = rows.select(STATION, *[v.alias(k) for k, v in expected.items()])
    theirs = per_row.groupBy(STATION).agg(*[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in expected])
    same(ours, theirs)


def test_running_changes(skewed):
    ours = running_changes(skewed, {"v": VALUE}).select(STATION, "last_reported", "v_diff", "v_rises", "v_falls")
    diff = F.coalesce(F.col(VALUE) - F.lag(VALUE).over(plain()), F.col(VALUE))
    diffs = skewed.select(STATION, "last_reported", diff.alias("v_diff"))
    theirs = diffs.select(
        "*",
        F.sum(F.expr("if(v_diff > 0, v_diff, 0)")).over(plain()).alias("v_rises"),
        F.sum(F.expr("if(v_diff < 0, -v_diff, 0)")).over(plain()).alias("v_falls"),
    )
    same(ours, theirs)


def test_as_of(skewed):
    versions = skewed.where("flag").select(F.col(STATION).alias("station_id"), F.col("last_reported").alias("reported"))
    ours = as_of(skewed, versions, STATION, "last_reported", "station_id", "reported", "version")
    so_far = F.max(F.when(F.col("flag"), F.col("last_reported"))).over(plain())
    columns = [STATION, "last_reported", "version"]
    same(ours.select(*columns), skewed.withColumn("version", so_far).select(*columns))


def test_as_of_costs_rows_and_not_days(spark):
    """A row of the year 9999 and a version long before the others: nothing is repeated for the days between."""
    rows = [(1, datetime(2024, 1, 5, 12)), (1, datetime(9999, 1, 1)), (1, datetime(1900, 1, 1)), (2, datetime(2024, 1, 1)), (1, None)]
    versions = [(1, datetime(1950, 1, 1)), (1, datetime(2024, 1, 5, 12)), (1, datetime(2024, 1, 5, 13)), (2, datetime(2024, 1, 1, 0, 0, 1))]
    frame = spark.createDataFrame(rows, f"{STATION} int, last_reported timestamp_ntz")
    found = as_of(frame, spark.createDataFrame(versions, "station_id int, reported timestamp_ntz"), STATION, "last_reported", "station_id", "reported", "v")
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
    expected = {(1, rows[0][1]): versions[1][1], (1, rows[1][1]): versions[2][1], (1, rows[2][1]): None, (2, rows[3][1]): None, (1, None): None}
    assert {(r[0], r[1]): r.v for r in found.collect()} == expected


def test_no_window_over_whole_stations(skewed):
    """The rows are exchanged by (station, segment); the exchange by station alone carries edges of segments."""
    frame = sums_over_neighbours(skewed, {"n": f"prev_{VALUE}"}, [VALUE])
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    keys = re.findall(r"Window \[.*\], \[([^\]]*)\], \[[^\]]*\]$", plan, re.MULTILINE)
    assert ["_segment" in k for k in keys] == [False, True]
    between = plan.split("Window [")[1]
    assert "Aggregate [" in between  # reduced to one row per segment before the window by station


def fresh_by_loop(rows, before=None):
    """Accepted (endpoint, updated, ttl, id) of rows in the order of their times; of equal times the first row."""
    due, seen, expected = dict(before or {}), set(), []
    for endpoint, updated, ttl, i in rows:
        if (endpoint, updated) in seen:
            continue
        seen.add((endpoint, updated))
        if updated >= due.get(endpoint, -1):
            expected.append((endpoint, updated, ttl, i))
            due[endpoint] = updated + ttl
    return sorted(expected)


def responses_of(random, gaps, ttls, n=400):
    rows = []
    for endpoint, gap in gaps.items():
        updated = np.cumsum(random.integers(0, gap, n)) + 1_700_000_000
        ttl = ttls(random, gap, n)
        rows += [(endpoint, u, w, i) for i, (u, w) in enumerate(zip(updated.tolist(), ttl.tolist(), strict=True))]
    return rows


RESPONSE = "endpoint string, updated long, ttl long, id long"
TTLS = {
    "mixed": lambda random, gap, n: random.integers(1, 3 * gap, n),
    "longer than a day": lambda random, gap, n: np.where(random.random(n) < 0.05, 200_000, random.integers(1, gap + 1, n)),
    "one forever": lambda random, gap, n: np.where(np.arange(n) == n // 2, 1 << 40, 1),
}


@pytest.mark.parametrize("ttls", TTLS)
def test_fresh_responses_against_a_loop(spark, ttls):
    rows = responses_of(np.random.default_rng(3), {"a": 40, "b": 4000, "c": 90000}, TTLS[ttls])
    frame = spark.createDataFrame(rows, RESPONSE)
    found = [tuple(r) for r in staleness.fresh_responses(frame).collect()]
    assert sorted(found) == fresh_by_loop(rows)


def test_fresh_responses_that_go_on(spark):
    """Due times from before: in the middle, later than all rows, of an endpoint without rows, and none."""
    rows = responses_of(np.random.default_rng(5), {"a": 4000, "b": 4000, "c": 4000}, TTLS["longer than a day"])
    before = {"a": rows[200][1] + 1, "b": 1 << 41, "d": 5}
    frame = spark.createDataFrame(rows, RESPONSE)
    found = staleness.fresh_responses(frame, spark.createDataFrame(list(before.items()), "endpoint string, due long"))
    assert sorted(tuple(r) for r in found.collect()) == fresh_by_loop(rows, before)
    assert staleness.fresh_responses(frame.limit(0)).collect() == []


def test_fresh_responses_of_full_days(spark):
    """A row in every second of two days: the largest groups there are. Each is one exchange by endpoint and day, without Python."""
    first = 1_699_920_000
    times = spark.range(first, first + 2 * 86_400).select(F.lit("a").alias("endpoint"), F.col("id").alias("updated"))
    frame = times.select("*", (F.col("updated") % 7 + 1).alias("ttl"), F.col("updated").alias("id"))
    found = staleness.fresh_responses(frame)
    assert "Pandas" not in (plan := found._jdf.queryExecution().executedPlan().toString()) and "Arrow" not in plan
    rows = [("a", t, t % 7 + 1, t) for t in range(first, first + 2 * 86_400)]
    assert sorted(tuple(r) for r in found.collect()) == fresh_by_loop(rows)
