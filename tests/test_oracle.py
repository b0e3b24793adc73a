"""Every registered query against its SQL counterpart on the same tables."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as driver
from casefile.plans import catalog, oracle
from tests.compare import TESTDATA, canonical, sql_rows

FOLDER = TESTDATA / os.environ.get("TEST_SF", "sf0.001")


@pytest.mark.parametrize("name", catalog.registered())
def test_matches_sql(spark, name):
    result = catalog.registered()[name](spark, str(FOLDER))
    rows = result.collect()
    assert rows
    sql = oracle.statements()[name]
    columns, expected = sql_rows(sql, FOLDER)
    assert sorted(columns) == sorted(result.columns)
    assert canonical(result.columns, rows) == canonical(columns, expected)


def test_entry_has_rows(spark):
    assert driver.entry(spark).count() > 0
