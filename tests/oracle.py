"""Compare a registered query with its reference SQL on one table directory."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

from millrace.tables import SCHEMAS


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in SCHEMAS:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _norm(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (list, tuple)):
        return tuple(_norm(v) for v in value)
    return (type(value).__name__, str(value))


def _multiset(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_norm(r[i]) for i in order) for r in rows)


# Spark's type names in DuckDB's words; results must agree in types, not only in values.
TYPES = {
    "int": "INTEGER",
    "bigint": "BIGINT",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
}


def type_differences(df, con, sql: str) -> dict:
    expected = {row[0]: str(row[1]) for row in con.execute("DESCRIBE " + sql).fetchall()}
    actual = {f.name: TYPES.get(f.dataType.simpleString()) for f in df.schema.fields}
    return {c: (t, expected.get(c)) for c, t in actual.items() if t != expected.get(c)}


def compare(df, con, sql: str) -> tuple[int, str | None]:
    """Row count and a description of the first difference, or None."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    expected = cursor.fetchall()
    if sorted(names) != sorted(df.columns):
        return 0, f"columns {sorted(df.columns)} != {sorted(names)}"
    actual = [tuple(r) for r in df.collect()]
    if len(actual) != len(expected):
        return len(actual), f"{len(actual)} rows != {len(expected)}"
    a, b = _multiset(df.columns, actual), _multiset(names, expected)
    if a != b:
        return len(actual), f"only Spark {list((a - b).items())[:3]}; only SQL {list((b - a).items())[:3]}"
    return len(actual), None
