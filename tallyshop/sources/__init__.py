from tallyshop.sources.files import (
    read_by_year,
    read_table,
    read_tables,
    save_bucketed,
    write_by_year,
    write_folder,
    write_tables,
)
from tallyshop.sources.star import load_retail

__all__ = [
    "load_retail",
    "read_by_year",
    "read_table",
    "read_tables",
    "save_bucketed",
    "write_by_year",
    "write_folder",
    "write_tables",
]
