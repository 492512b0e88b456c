"""Retail analytics on Spark: typed tables, reusable operators and 65 reports."""

from tallyshop.schema import SCHEMAS, RetailTables
from tallyshop.sources import (
    load_retail,
    read_by_year,
    read_table,
    read_tables,
    save_bucketed,
    write_by_year,
    write_tables,
)

__all__ = [
    "SCHEMAS",
    "RetailTables",
    "load_retail",
    "read_by_year",
    "read_table",
    "read_tables",
    "save_bucketed",
    "write_by_year",
    "write_tables",
]
