"""The joined facts most reports start from.

A report on orders never needs the single lines, only their totals per order.
Lines are therefore added up by ``order_id`` before they are joined: the partial
sums run before the shuffle, so one order holding a large part of all lines
costs one row per task, and both sides of the join hold one row per order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyshop.functions import net_revenue
from tallyshop.schema import RetailTables

REJECTED = 3
COMPLETED = 4


def line_revenue() -> Column:
    return net_revenue("quantity", "list_price", "discount")


def is_valid() -> Column:
    """Not rejected. An order without a status is not valid either."""
    return F.col("order_status") != REJECTED


def is_shipped() -> Column:
    return (F.col("order_status") == COMPLETED) & F.col("shipped_date").isNotNull()


def item_totals(t: RetailTables) -> DataFrame:
    """One row per order that has lines: ``revenue``, ``units``, ``n_lines``."""
    if t.item_totals is not None:
        return t.item_totals
    return t.order_items.groupBy("order_id").agg(
        F.sum(line_revenue()).alias("revenue"),
        F.sum("quantity").alias("units"),
        F.count("*").alias("n_lines"),
    )


def order_totals(t: RetailTables, keep_empty: bool = False) -> DataFrame:
    """Valid orders with the totals of their lines, one row per order.

    ``order_id`` is the primary key of orders, so counting these rows counts
    distinct orders. ``keep_empty`` keeps orders without lines, with null totals.
    """
    how = "left" if keep_empty else "inner"
    return t.orders.where(is_valid()).join(item_totals(t), "order_id", how)


def save_item_totals(t: RetailTables, path: str) -> RetailTables:
    """Write the totals per order once, for a series of reports.

    About two thirds of the reports start from these totals. With the returned
    tables they read one narrow row per order instead of all lines.
    """
    item_totals(t).write.mode("overwrite").parquet(path)
    return t.with_item_totals(t.spark.read.parquet(path))


def valid_lines(t: RetailTables, lines: DataFrame | None = None) -> DataFrame:
    """Lines of valid orders with the columns of their order. ``lines`` may be
    the order lines with columns added."""
    lines = t.order_items if lines is None else lines
    return lines.join(t.orders.where(is_valid()), "order_id")


def class_totals(
    t: RetailTables, label: Column, labels: Sequence[str], out: str, **sums: Column
) -> DataFrame:
    """``sums`` over the lines of valid orders per class of lines: ``out``, the ``label`` of a
    line, and one column per sum. ``labels`` are all that occur; those without a line are left out.

    The sums of all classes are added up per order, side by side, before the lines are joined:
    the join has one row per order on both sides, and what follows is one row in all.
    """
    places = [(name, i) for i in range(len(labels)) for name in ("_lines", *sums)]
    values = {"_lines": F.lit(1), **sums}
    per_order = (
        t.order_items.withColumn("_label", label)
        .groupBy("order_id")
        .agg(
            *(
                F.sum(F.when(F.col("_label") == labels[i], values[name])).alias(f"{name}{i}")
                for name, i in places
            )
        )
    )
    known = t.orders.where(is_valid()).select("order_id")
    whole = per_order.join(known, "order_id").agg(
        *(F.sum(f"{name}{i}").alias(f"{name}{i}") for name, i in places)
    )
    classes = [
        F.struct(F.lit(text).alias(out), *(F.col(f"{name}{i}").alias(name) for name in values))
        for i, text in enumerate(labels)
    ]
    return whole.select(F.inline(F.array(*classes))).where("_lines > 0").drop("_lines")


def product_totals(t: RetailTables, valid_only: bool = False) -> DataFrame:
    """One row per product on any line, whatever the order's status, or on lines
    of valid orders only."""
    lines = valid_lines(t) if valid_only else t.order_items
    return lines.groupBy("product_id").agg(
        F.sum("quantity").alias("units"),
        F.sum(line_revenue()).alias("revenue"),
        F.count("*").alias("n_lines"),
        F.sum("discount").alias("discount_sum"),
        F.count("discount").alias("discount_n"),
        F.sum("list_price").alias("price_sum"),
        F.count("list_price").alias("price_n"),
    )
