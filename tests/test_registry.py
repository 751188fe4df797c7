"""Every registered query against its SQL on the smallest test set."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from compare import differences
from dockpulse import registry

SF_DIR = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    frame = QUERIES[name](spark, SF_DIR)
    assert name in SQL
    assert differences(frame, SQL[name], SF_DIR) == []


def test_entry(spark):
    assert contract.entry(spark).count() > 0
