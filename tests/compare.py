"""Compare a Spark result with DuckDB rows: same columns, same rows in any order, same kinds of values."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in sorted(Path(folder).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    return value


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda at: names[at])
    shaped = [tuple(_plain(row[at]) for at in order) for row in rows]
    return [names[at] for at in order], sorted(shaped, key=lambda row: [(v is None, type(v).__name__, str(v)) for v in row])


def difference(frame, connection, sql: str) -> str | None:
    """None when equal, else a short account of the first difference."""
    cursor = connection.execute(sql)
    names, expected = _rows([column[0] for column in cursor.description], cursor.fetchall())
    found_names, found = _rows(frame.columns, [tuple(row) for row in frame.collect()])
    if names != found_names:
        return f"columns {found_names} instead of {names}"
    if len(found) != len(expected):
        missing = [row for row in expected if row not in set(found)][:2]
        return f"{len(found)} rows instead of {len(expected)}; missing {missing}"
    for left, right in zip(found, expected):
        for name, a, b in zip(names, left, right):
            if a != b or type(a) is not type(b):
                return f"{name}: {a!r} instead of {b!r} in {dict(zip(names, right))}"
    return None
