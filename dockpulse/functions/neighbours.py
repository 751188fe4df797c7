"""Previous and next row per station, without putting one station into one task.

Nearly every operator compares a status row with the row before or after it. A window over
`partitionBy(station)` would send a station that holds a third of all rows to a single task. Here the rows are
split by station *and* time segment (a UTC day), which bounds a group: a station has at most one row per second
and information version, and a day has 86 400 seconds. Only the first and last row of a segment lack a neighbour;
they alone go through a second, small window per station that looks across segments.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATION = "info_station_id"
# Rows of one station in time order; the information version breaks ties.
TIME_ORDER = ("last_reported", "info_reported")


def segment_of(column: str | Column) -> Column:
    """Number of the UTC day."""
    return F.unix_date(F.to_date(column))


def segment_sums(
    rows: DataFrame,
    terms: dict[str, str],
    carried: Sequence[str],
    key: str = STATION,
    order: Sequence[str] = TIME_ORDER,
    following: Sequence[str] = (),
) -> DataFrame:
    """`sums_over_neighbours`, first half: a row per key and segment with its inner sums and the carried columns of its first and last row.

    One exchange of the needed columns on (key, segment). Rows of different segments do not meet, so segments may be made apart, stored and united.
    """
    order = [c for c in order if c in rows.columns]
    time, inside = order[0], f"over (partition by {key}, _segment order by {', '.join(order)})"
    local = rows.select(*dict.fromkeys([key, *order, *carried]), segment_of(time).alias("_segment")).selectExpr(
        "*",
        f"lag({time}) {inside} as _before",
        f"lead({time}) {inside} as _after",
        *[f"lag({c}) {inside} as prev_{c}" for c in carried],
        *[f"lead({c}) {inside} as next_{c}" for c in following],
    )
    complete = "_before is not null and _after is not null" if following else "_before is not null"
    first, last = "_before is null", "_after is null"
    edges = [f"max(case when {first} then {c} end) as first_{c}" for c in carried]
    edges += [f"max(case when {last} then {c} end) as last_{c}" for c in carried]
    if following:
        edges += [f"max(case when {first} then next_{c} end) as first_next_{c}" for c in following]
        edges += [f"max(case when {last} then prev_{c} end) as last_prev_{c}" for c in carried]
        edges.append("count(*) as _rows")
    inner = [f"sum(case when {complete} then {term} end) as _inner_{name}" for name, term in terms.items()]
    return local.groupBy(key, "_segment").agg(*map(F.expr, [*inner, *edges]))


def bridged_sums(
    per_segment: DataFrame, terms: dict[str, str], carried: Sequence[str], key: str = STATION, following: Sequence[str] = ()
) -> DataFrame:
    """`sums_over_neighbours`, second half: per key the inner sums of its segments, and the terms over the first and last rows, whose neighbours are in other segments."""
    across = f"over (partition by {key} order by _segment)"
    inner_once = [f"_inner_{name}" for name in terms]
    if not following:
        filled = per_segment.selectExpr(
            key,
            *inner_once,
            *[f"first_{c} as {c}" for c in carried],
            *[f"lag(last_{c}) {across} as prev_{c}" for c in carried],
        )
    else:
        bridged = per_segment.selectExpr(
            "*",
            *[f"lag(last_{c}) {across} as before_{c}" for c in carried],
            *[f"lead(first_{c}) {across} as after_{c}" for c in following],
        )
        opening = [f"first_{c} as {c}, before_{c} as prev_{c}" for c in carried]
        opening += [f"if(_rows = 1, after_{c}, first_next_{c}) as next_{c}" for c in following]
        closing = [f"last_{c} as {c}, last_prev_{c} as prev_{c}" for c in carried]
        closing += [f"after_{c} as next_{c}" for c in following]
        # the inner sums travel with the first row of the segment only
        nothing = [f"cast(null as bigint) as {name}" for name in inner_once]
        filled = bridged.selectExpr(
            key,
            f"inline(array_compact(array(struct({', '.join([*inner_once, *opening])}), "
            f"if(_rows > 1, struct({', '.join([*nothing, *closing])}), null))))",
        )
    total = "coalesce(sum(_inner_{0}), 0) + coalesce(sum({1}), 0) as {0}"
    return filled.groupBy(key).agg(*[F.expr(total.format(name, term)) for name, term in terms.items()])


def sums_over_neighbours(
    rows: DataFrame,
    terms: dict[str, str],
    carried: Sequence[str],
    key: str = STATION,
    order: Sequence[str] = TIME_ORDER,
    following: Sequence[str] = (),
) -> DataFrame:
    """Per key, the sum of every term over all rows.

    A term is SQL over the carried columns `c` of the row, `prev_c` of the row before it and, for those named in
    `following`, `next_c` of the row after it; these are null where there is no such row.
    One exchange of the needed columns on (key, segment). In the same stage each segment is reduced to its inner sums
    and the values of its first and last row, so that the exchange on key alone carries one row per segment.
    """
    per_segment = segment_sums(rows, terms, carried, key, order, following)
    return bridged_sums(per_segment, terms, carried, key, following)


def with_neighbours(
    rows: DataFrame,
    carried: Sequence[str],
    key: str = STATION,
    order: Sequence[str] = TIME_ORDER,
    following: bool = False,
) -> DataFrame:
    """Every row with `_prev` and, if `following`, `_next`: structs of the carried columns of its neighbours in time.

    Inner rows are finished inside their segment; the first and last row of each take a second window per key. Both
    branches read the same exchange on (key, segment), which Spark writes once.
    """
    order = [c for c in order if c in rows.columns]
    inside = Window.partitionBy(key, "_segment").orderBy(*order)
    across = Window.partitionBy(key).orderBy(*order)
    near = {"_prev": F.lag(F.struct(*carried))} | ({"_next": F.lead(F.struct(*carried))} if following else {})
    local = rows.withColumn("_segment", segment_of(order[0])).select(
        *rows.columns,
        F.lag(order[0]).over(inside).alias("_before"),
        F.lead(order[0]).over(inside).alias("_after"),
        *[value.over(inside).alias(name) for name, value in near.items()],
    )
    is_inner = F.col("_before").isNotNull() & F.col("_after").isNotNull()
    inner = local.where(is_inner).select(*rows.columns, *near)
    edges = local.where(~is_inner).select(
        *rows.columns,
        *[F.coalesce(name, value.over(across)).alias(name) for name, value in near.items()],
    )
    return inner.unionByName(edges)


def running_changes(
    rows: DataFrame, columns: dict[str, str], key: str = STATION, order: Sequence[str] = TIME_ORDER
) -> DataFrame:
    """Rows with, per column, `<name>_diff` to the row before and the running totals of rises and falls per key,
    `<name>_rises` and `<name>_falls`. Before its first row a key counts as holding 0. Rows of equal time count together.

    Differences and totals run inside a segment. What a segment starts from, the last values and the totals of all
    earlier ones, comes from one row per segment and is joined back on (key, segment).
    """
    order = [c for c in order if c in rows.columns]
    inside = Window.partitionBy(key, "_segment").orderBy(*order)
    local = rows.withColumn("_segment", segment_of(order[0])).select(
        "*",
        F.lag(order[0]).over(inside).alias("_before"),
        F.lead(order[0]).over(inside).alias("_after"),
        *[(F.col(c) - F.lag(c).over(inside)).alias(f"_{n}_inner") for n, c in columns.items()],
    )

    def both_ways(diff: str) -> dict[str, str]:
        return {"rises": f"greatest({diff}, 0)", "falls": f"greatest(-({diff}), 0)"}

    parts = [(n, way) for n in columns for way in ("rises", "falls")]
    inner = {(n, way): f"coalesce({both_ways(f'_{n}_inner')[way]}, 0)" for n, way in parts}
    per_segment = local.groupBy(key, "_segment").agg(
        *[F.expr(f"sum({inner[n, way]}) as _sum_{n}_{way}") for n, way in parts],
        *[F.expr(f"max(case when _before is null then {c} end) as _first_{n}") for n, c in columns.items()],
        *[F.expr(f"max(case when _after is null then {c} end) as _last_{n}") for n, c in columns.items()],
    )
    across = Window.partitionBy(key).orderBy("_segment")
    opened = per_segment.select(
        "*",
        *[F.coalesce(F.lag(f"_last_{n}").over(across), F.lit(0)).alias(f"_from_{n}") for n in columns],
    )
    starts = opened.select(
        key,
        "_segment",
        *[f"_from_{n}" for n in columns],
        *[
            # all segments up to this one, less what runs inside this one
            (
                F.sum(F.expr(f"_sum_{n}_{way} + {both_ways(f'_first_{n} - _from_{n}')[way]}")).over(across)
                - F.col(f"_sum_{n}_{way}")
            ).alias(f"_start_{n}_{way}")
            for n, way in parts
        ],
    )
    together = Window.partitionBy(key, "_segment").orderBy(order[0])
    running = local.select(
        *rows.columns,
        "_segment",
        *[f"_{n}_inner" for n in columns],
        *[F.sum(F.expr(inner[n, way])).over(together).alias(f"_running_{n}_{way}") for n, way in parts],
    )
    return running.join(starts, [key, "_segment"]).select(
        *rows.columns,
        *[F.expr(f"coalesce(_{n}_inner, {c} - _from_{n}) as {n}_diff") for n, c in columns.items()],
        *[F.expr(f"_start_{n}_{way} + _running_{n}_{way} as {n}_{way}") for n, way in parts],
    )


def as_of(
    rows: DataFrame,
    versions: DataFrame,
    key: str,
    row_time: str,
    version_key: str,
    version_time: str,
    name: str,
) -> DataFrame:
    """Rows with `name`: the greatest version time of their key that is not after their own time, or null.

    Versions and rows are merged in time order inside each (key, segment). What a segment starts from, the newest version before it, comes from a small merge of
    the versions with the (key, segment) pairs that have rows: as many rows as there are such pairs and versions, however far apart in time they are. No row meets
    more than one version, however many a key has.
    """
    days = rows.select(key, segment_of(row_time).alias("_segment")).where("_segment is not null").distinct()
    known = versions.select(F.col(version_key).alias(key), F.col(version_time).alias("_version")).distinct()
    start = F.date_from_unix_date("_segment").cast("timestamp_ntz")
    both = days.withColumn("_at", start).unionByName(known.withColumn("_at", F.col("_version")), allowMissingColumns=True)
    before = Window.partitionBy(key).orderBy("_at", F.col("_segment").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = both.withColumn("_version", F.max("_version").over(before)).where("_segment is not null and _version is not null")
    own = known.withColumn("_segment", segment_of("_version"))
    marks = carried.select(key, "_version", "_segment", F.col("_at").alias(row_time))
    marks = marks.unionByName(own.withColumn(row_time, F.col("_version"))).withColumn("_is_row", F.lit(False))
    tagged = rows.select("*", F.lit(True).alias("_is_row"), segment_of(row_time).alias("_segment"))
    tagged = tagged.unionByName(marks, allowMissingColumns=True)
    # versions sort before rows of the same second
    inside = Window.partitionBy(key, "_segment").orderBy(row_time, "_is_row")
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    merged = tagged.withColumn(name, F.max("_version").over(so_far))
    return merged.where("_is_row").select(*rows.columns, name)
