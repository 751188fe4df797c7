"""Driver-side parameters."""

from __future__ import annotations

from datetime import datetime

import pytest

from dockpulse.operators.stations import like_pattern
from dockpulse.operators.system import bikes_over_days
from dockpulse.params import (
    Grid,
    local_range,
    local_to_utc,
    minutes_per_hourly_step,
    seconds_per_step,
    steps_per_range,
)

START = datetime(2024, 1, 1)


def test_grid_may_pass_the_end(spark):
    grid = Grid.over(START, datetime(2024, 1, 1, 0, 40), 15)
    assert grid.points == 4 and grid.last == datetime(2024, 1, 1, 0, 45)
    assert [r.time for r in grid.times(spark).orderBy("time").collect()][-1] == grid.last


def test_short_range_has_a_step():
    assert Grid.over(START, datetime(2024, 1, 1, 0, 5), 0).step_seconds == 60


def test_steps():
    assert minutes_per_hourly_step(4) == 15 and minutes_per_hourly_step(7) == 9
    assert seconds_per_step(START, datetime(2024, 1, 1, 1), 7) == 514
    assert steps_per_range(START, datetime(2024, 1, 1, 1), 25) == 3


def test_local_times():
    assert local_to_utc(datetime(2024, 7, 1, 8), "America/Toronto") == datetime(2024, 7, 1, 12)
    now = datetime(2024, 1, 2)
    assert local_range(None, None, "America/Toronto", now) == (START, now)


def test_patterns():
    assert [like_pattern(m, "a_b") for m in ("exact", "prefix", "suffix", "wildcard")] == ["a_b", "a_b%", "%a_b", "%a_b%"]


def test_moments_must_not_overlap():
    with pytest.raises(ValueError, match="two hours"):
        bikes_over_days(None, START.date(), START.date(), 1)
