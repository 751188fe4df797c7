"""Range queries by stored summaries of days, over a status table stored by day. The bounds cut the first and the last day."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockpulse import schemas
from dockpulse.adapter import Tables
from dockpulse.operators import rollup
from dockpulse.params import StatusQuery
from dockpulse.registry.base import query
from dockpulse.registry.operators import CHARGING_SQL, DOCKING_SQL, INTEGRAL_SQL, occupancy_sql
from dockpulse.session import shared_dir
from dockpulse.sources import tables

FROM, TO = datetime(2024, 1, 8, 18, 30), datetime(2024, 1, 20, 12)
RANGE = StatusQuery(None, FROM, TO)
_CUT = f"from ss where last_reported between timestamp '{FROM}' and timestamp '{TO}'"


def _cut(sql: str) -> str:
    """The statement over all rows, over those of the range."""
    return sql.replace("from ss", _CUT).replace("timestamp '2024-02-01'", f"timestamp '{TO}'")


def _stored(t: Tables, summary: rollup.Summary) -> tuple[rollup.DaySums, DataFrame]:
    """The status table by day, and the summaries of its days: those of even days first, then those of all."""
    folder = f"{shared_dir(t.spark)}/tables/rollup-{uuid.uuid4().hex}"
    tables.write_status(t.status().select(*schemas.STATION_STATUS.names), f"{folder}/status")
    status = tables.read_table(t.spark, f"{folder}/status", schemas.STORED_STATUS)
    days = rollup.DaySums(t.spark, f"{folder}/days", summary)
    days.refresh(status.where(F.day(schemas.DATE_COLUMN) % 2 == 0), 0)
    days.refresh(status, 1)
    return days, status


@query("a1_docking_by_days", _cut(DOCKING_SQL))
def docking_by_days(t):
    return rollup.docking_events(*_stored(t, rollup.DOCKINGS), t.information(), RANGE)


@query("a2_charging_by_days", _cut(CHARGING_SQL))
def charging_by_days(t):
    return rollup.charging_events(*_stored(t, rollup.CHARGES), t.information(), RANGE)


@query("a3_integrals_by_days", _cut(INTEGRAL_SQL))
def integrals_by_days(t):
    return rollup.integrals(*_stored(t, rollup.INTEGRALS), t.information(), RANGE)


@query("a6_occupancy_by_days", occupancy_sql(f"{FROM}", f"{TO}", 2, 3))
def occupancy_by_days(t):
    days, status = _stored(t, rollup.occupancy_summary(2, 3))
    return rollup.occupancy(days, status, t.information(), FROM, TO, None, 2, 3)
