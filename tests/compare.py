"""Runs a registered query and its SQL counterpart on the same tables."""

from __future__ import annotations

from pathlib import Path

import duckdb

TESTDATA = Path("/root/testdata")


def sql_rows(sql: str, folder: Path) -> tuple[list[str], list[tuple]]:
    connection = duckdb.connect()
    for table in sorted(folder.glob("*.parquet")):
        connection.execute(
            f"CREATE VIEW {table.stem} AS SELECT * FROM '{table.as_posix()}'"
        )
    cursor = connection.execute(sql)
    return [c[0] for c in cursor.description], cursor.fetchall()


def canonical(columns: list[str], rows: list) -> list[tuple[str, ...]]:
    """Rows as text, with columns in name order, sorted."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(row[i]) for i in order) for row in rows)
