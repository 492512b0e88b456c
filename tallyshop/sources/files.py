"""Typed readers and writers for the nine tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyshop.schema import FACTS, SCHEMAS, RetailTables
from tallyshop.session import tuned

#: Partition column of the layout by year.
YEAR = "order_year"

# Both sides of the order-to-line join are laid out by this key when bucketed.
BUCKETED_BY_ORDER = ("orders", "order_items")
# Lines of one order, in multiples of an average bucket.
BUCKET_SKEW = 4


def read_table(spark: SparkSession, path: str, name: str, fmt: str = "csv") -> DataFrame:
    """One table from CSV (header row, ``NULL`` literal, doubled quotes) or Parquet.

    A CSV row that does not fit the declared types fails the job instead of
    turning into nulls.
    """
    schema = SCHEMAS[name]
    if fmt == "csv":
        return spark.read.schema(schema).csv(
            path, header=True, nullValue="NULL", escape='"', mode="FAILFAST"
        )
    if fmt == "parquet":
        return spark.read.schema(schema).parquet(path)
    raise ValueError(f"unknown format {fmt!r}")


def read_tables(spark: SparkSession, root: str, fmt: str = "parquet") -> RetailTables:
    """All nine tables below ``root``: ``<root>/<name>`` for Parquet,
    ``<root>/<name>.csv`` for CSV."""
    suffix = ".csv" if fmt == "csv" else ""
    openers = {
        name: (lambda name=name: read_table(spark, f"{root}/{name}{suffix}", name, fmt))
        for name in SCHEMAS
    }
    return RetailTables(spark, tuned(openers, FACTS))


def _replace_folder(spark: SparkSession, new: str, target: str) -> None:
    """Put the folder ``new`` in the place of ``target``. Should that fail, ``target`` is what it
    was before."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    staged, current = hadoop.Path(new), hadoop.Path(target)
    aside = hadoop.Path(f"{target}.replaced-{uuid.uuid4().hex}")
    files = current.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    existed = files.exists(current)
    if existed and not files.rename(current, aside):
        raise OSError(f"cannot replace {target}")
    if not files.rename(staged, current):
        if existed:
            files.rename(aside, current)
        raise OSError(f"cannot move {new} to {target}")
    if existed:
        files.delete(aside, True)


def _remove_folder(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def write_folder(df: DataFrame, target: str, partition_by: Sequence[str] = ()) -> None:
    """Write ``df`` as Parquet and put it in the place of ``target`` when it is complete.

    The rows go to a new folder beside ``target``, so a write that fails, or whose executors are
    lost, leaves the old table as it was, and a frame may replace the table it is read from.
    """
    staged = f"{target}.staged-{uuid.uuid4().hex}"
    try:
        df.write.partitionBy(*partition_by).parquet(staged)
        _replace_folder(df.sparkSession, staged, target)
    except BaseException:
        _remove_folder(df.sparkSession, staged)
        raise


def write_tables(
    tables: RetailTables,
    root: str,
    names: Iterable[str] = tuple(SCHEMAS),
    mode: str = "overwrite",
) -> None:
    """Drop-and-recreate: write tables as Parquet under ``root``. Each table is replaced as a
    whole (``write_folder``); with another ``mode`` its folder is written to as it stands."""
    for name in names:
        if mode == "overwrite":
            write_folder(tables[name], f"{root}/{name}")
        else:
            tables[name].write.mode(mode).parquet(f"{root}/{name}")


def write_by_year(tables: RetailTables, root: str) -> None:
    """Write all tables under ``root``, orders and their lines in one folder per year of the
    order's date. Lines whose order is unknown, and orders without a date, have a folder too.

    Rows of a year are spread over as many tasks and files as their size asks for, so a year
    that holds most of them is no single task.
    """
    year = F.year("order_date").alias(YEAR)
    dated = tables.orders.select("*", year)
    per_order = tables.orders.select("order_id", year)
    laid_out = {"orders": dated, "order_items": tables.order_items.join(per_order, "order_id", "left")}
    for name in SCHEMAS:
        if name in laid_out:
            write_folder(laid_out[name].hint("rebalance", YEAR), f"{root}/{name}", [YEAR])
        else:
            write_folder(tables[name], f"{root}/{name}")


def read_by_year(
    spark: SparkSession, root: str, first: int | None = None, last: int | None = None
) -> RetailTables:
    """The tables that ``write_by_year`` wrote; orders and lines only of the years from ``first``
    to ``last``, whose folders alone are read. Without years, all rows are there, undated too."""

    def dated(name: str) -> DataFrame:
        schema = T.StructType([*SCHEMAS[name].fields, T.StructField(YEAR, T.IntegerType())])
        df = spark.read.schema(schema).parquet(f"{root}/{name}")
        if first is not None:
            df = df.where(F.col(YEAR) >= first)
        if last is not None:
            df = df.where(F.col(YEAR) <= last)
        return df.select(SCHEMAS[name].names)

    def opener(name: str) -> Callable[[], DataFrame]:
        if name in FACTS:
            return lambda: dated(name)
        return lambda: read_table(spark, f"{root}/{name}", name, "parquet")

    return RetailTables(spark, tuned({name: opener(name) for name in SCHEMAS}, FACTS))


def save_bucketed(
    tables: RetailTables,
    database: str,
    buckets: int,
    root: str | None = None,
    max_skew: float = BUCKET_SKEW,
) -> RetailTables:
    """Save orders and order lines as tables bucketed and sorted by ``order_id``.

    Every report that joins the two then reads matching buckets side by side,
    with no exchange of either. Pick ``buckets`` so that one bucket of lines is
    a few hundred MB. Returns the same model reading from the saved tables.

    A bucket is read by one task and cannot be split. If a single order would
    fill ``max_skew`` buckets by itself, the tables are refused: the reports' own
    shuffles add up or split such an order, a bucketed scan would not.
    """
    spark = tables.spark
    per_order = tables.order_items.groupBy("order_id").agg(F.count("*").alias("n"))
    largest, total = per_order.agg(F.max("n"), F.sum("n")).first()
    if total and largest * buckets > max_skew * total:
        raise ValueError(
            f"one order has {largest} of {total} lines: too many for one of {buckets} buckets"
        )
    saved: dict[str, DataFrame] = {}
    for name in BUCKETED_BY_ORDER:
        writer = (
            tables[name]
            .repartition(buckets, F.col("order_id"))
            .write.mode("overwrite")
            .format("parquet")
            .bucketBy(buckets, "order_id")
            .sortBy("order_id")
        )
        if root is not None:
            writer = writer.option("path", f"{root}/{name}")
        writer.saveAsTable(f"{database}.{name}")
        saved[name] = spark.table(f"{database}.{name}")
    return tables.replace(**saved)
