"""Rows of a Spark query against rows of the SQL that should give the same."""

from __future__ import annotations

import math
from datetime import datetime
from functools import lru_cache

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
TYPES = {
    "int": "INTEGER",
    "bigint": "BIGINT",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
    "date": "DATE",
}


@lru_cache
def connection(sf_dir: str):
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    return db


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else repr(value)
    if isinstance(value, datetime):
        return value.isoformat()
    return None if value is None else str(value)


def table(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(plain(row[i]) for i in order) for row in rows], key=str)


def differences(frame, sql: str, sf_dir: str) -> list[str]:
    result = connection(sf_dir).execute(sql)
    columns = [d[0] for d in result.description]
    types = {d[0]: str(d[1]) for d in result.description}
    if sorted(columns) != sorted(frame.columns):
        return [f"columns {sorted(frame.columns)} against {sorted(columns)}"]
    found = [
        f"type of {name}: {kind} against {types[name]}"
        for name, kind in frame.dtypes
        if TYPES.get(kind) != types[name]
    ]
    ours, theirs = table(frame.collect(), frame.columns), table(result.fetchall(), columns)
    if ours != theirs:
        only = [row for row in ours if row not in set(theirs)][:3], [row for row in theirs if row not in set(ours)][:3]
        found.append(f"{len(ours)} rows against {len(theirs)}; only one side: {only}")
    return found
