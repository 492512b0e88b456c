"""Order-insensitive comparison of a Spark result with a DuckDB result."""

from __future__ import annotations

import duckdb
from pyspark.sql import DataFrame

from tallyshop.schema import SCHEMAS

STAR_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")

_TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "date": "DATE",
}


def _sort_key(row: tuple) -> tuple:
    return tuple((v is None, str(v)) for v in row)


def assert_same(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> None:
    rel = con.execute(sql)
    names = [c[0] for c in rel.description]
    kinds = {c[0]: str(c[1]) for c in rel.description}
    expected = rel.fetchall()
    assert df.columns == names
    assert {f.name: _TYPES[f.dataType.simpleString()] for f in df.schema} == kinds
    actual = [tuple(row) for row in df.collect()]
    assert sorted(actual, key=_sort_key) == sorted(expected, key=_sort_key)


def model_db(root: str) -> duckdb.DuckDBPyConnection:
    """The nine tables under ``root`` by the names the oracle uses."""
    con = duckdb.connect()
    for name in SCHEMAS:
        view = "m_items" if name == "order_items" else f"m_{name}"
        con.execute(f"CREATE VIEW {view} AS SELECT * FROM '{root}/{name}/*.parquet'")
    return con
