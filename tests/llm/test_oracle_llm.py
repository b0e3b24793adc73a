"""Queries of the subpackage against their SQL counterparts."""

from __future__ import annotations

import os

import pytest

from casefile.llm import queries
from tests.compare import TESTDATA, canonical, sql_rows

FOLDER = TESTDATA / os.environ.get("TEST_SF", "sf0.001")


@pytest.mark.parametrize("name", queries.ORACLE)
def test_matches_sql(spark, name):
    result = queries.QUERIES[name](spark, str(FOLDER))
    rows = result.collect()
    assert rows
    columns, expected = sql_rows(queries.ORACLE[name], FOLDER)
    assert sorted(columns) == sorted(result.columns)
    assert canonical(result.columns, rows) == canonical(columns, expected)
