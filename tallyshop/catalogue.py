"""Every query by name, over a folder of the driver's tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyshop import operators as ops
from tallyshop.functions import period, rounded
from tallyshop.oracle import LAID_OUT_YEAR, RECENT, table_columns
from tallyshop.plans import REPORTS, customer, product, staff
from tallyshop.schema import SCHEMAS, RetailTables
from tallyshop.session import ensure_checkpoint_dir
from tallyshop.sources import load_retail, read_by_year, read_table, write_by_year

Query = Callable[[SparkSession, str], DataFrame]

VARIANTS: dict[str, Callable[[RetailTables], DataFrame]] = {
    "category_sales_valid_only": lambda t: product.category_sales(t, valid_only=True),
    "brand_sales_valid_only": lambda t: product.brand_sales(t, valid_only=True),
    "never_sold_since": lambda t: product.never_sold(t, since=RECENT),
    "overstock_ratio_true_totals": lambda t: product.overstock_ratio(t, true_totals=True),
    "overstock_ratio_unsold_first": lambda t: product.overstock_ratio(t, unsold_first=True),
    "store_scorecard_per_order": lambda t: staff.store_scorecard(t, per_order=True),
}


def _table(name: str) -> Callable[[RetailTables], DataFrame]:
    def rows(t: RetailTables) -> DataFrame:
        return t[name].select(
            *(
                F.col(c).cast("double").alias(c) if c in ("list_price", "discount") else c
                for c in table_columns(name)
            )
        )

    return rows


def _orders_outside_active_staff(t: RetailTables) -> DataFrame:
    active = t.staffs.where(F.col("active") == 1)
    return ops.fk_violations(t.orders, "staff_id", active, "staff_id").select(
        "order_id", "staff_id"
    )


def _validate_current(t: RetailTables) -> DataFrame:
    """The constraints, had inactive staff and the oldest products been deleted."""
    return ops.validate(
        t.replace(staffs=t.staffs.where("active = 1"), products=t.products.where("model_year > 2016"))
    )


def _customer_value_deciles(t: RetailTables) -> DataFrame:
    value = customer.clv(t).select("customer_id", "lifetime_value")
    order = [F.col("lifetime_value").desc(), F.col("customer_id").asc()]
    return ops.ntile_global(value, 10, order, "decile").withColumn(
        "lifetime_value", rounded("lifetime_value")
    )


def _median_order_units_by_store(t: RetailTables) -> DataFrame:
    units = ops.order_totals(t).select("store_id", "units")
    return ops.group_median(units, ["store_id"], "units", "m").select(
        "store_id", rounded("m").alias("median_units")
    )


def _cumulative_revenue_by_store(t: RetailTables) -> DataFrame:
    monthly = (
        ops.order_totals(t)
        .groupBy("store_id", period("order_date", "month").alias("order_month"))
        .agg(F.sum("revenue").alias("revenue"))
    )
    return ops.running_total(
        monthly, "order_month", "revenue", partition="store_id", out="running"
    ).select("store_id", "order_month", rounded("running").alias("cumulative_revenue"))


def _store_share_of_revenue(t: RetailTables) -> DataFrame:
    totals = ops.order_totals(t)
    per_store = totals.groupBy("store_id").agg(F.sum("revenue").alias("revenue"))
    whole = totals.agg(F.sum("revenue"))
    return ops.pct_of_total(
        per_store, "revenue", "pct_of_total_revenue", total_df=whole
    ).select("store_id", rounded("revenue").alias("net_revenue"), "pct_of_total_revenue")


def _scratch(t: RetailTables) -> str:
    return f"{ensure_checkpoint_dir(t.spark)}/{uuid.uuid4().hex}"


def _customers_from_csv(t: RetailTables) -> DataFrame:
    """Customers written as CSV files and read again."""
    path = f"{_scratch(t)}/customers.csv"
    t.customers.write.csv(path, header=True, nullValue="NULL", escape='"')
    return read_table(t.spark, path, "customers").select(*table_columns("customers"))


def _orders_of_a_year(t: RetailTables) -> DataFrame:
    """Orders of one year from the layout by year, written for it."""
    root = _scratch(t)
    write_by_year(t, root)
    return read_by_year(t.spark, root, LAID_OUT_YEAR, LAID_OUT_YEAR).orders


def _by_store_month() -> list:
    return ["store_id", period("order_date", "month").alias("order_month")]


OPERATORS: dict[str, Callable[[RetailTables], DataFrame]] = {
    **{f"table_{name}": _table(name) for name in SCHEMAS},
    "validate": ops.validate,
    "validate_current": _validate_current,
    "duplicate_order_lines": lambda t: ops.pk_violations(t.order_items, ["order_id", "item_id"]),
    "missing_order_values": lambda t: ops.null_violations(
        t.orders, ["customer_id", "shipped_date"]
    ),
    "orders_outside_active_staff": _orders_outside_active_staff,
    "customer_value_deciles": _customer_value_deciles,
    "median_order_units_by_store": _median_order_units_by_store,
    "cumulative_revenue_by_store": _cumulative_revenue_by_store,
    "store_share_of_revenue": _store_share_of_revenue,
    "table_customers_from_csv": _customers_from_csv,
    "table_orders_of_a_year": _orders_of_a_year,
    "store_month_status": lambda t: ops.status_pivot(t.orders, _by_store_month()),
    "fulfilment_by_store_month": lambda t: ops.fulfilment(t.orders, _by_store_month()),
}


def queries() -> dict[str, Query]:
    def over_folder(report: Callable[[RetailTables], DataFrame]) -> Query:
        return lambda spark, sf_dir: report(load_retail(spark, sf_dir))

    everything = {**REPORTS, **VARIANTS, **OPERATORS}
    return {name: over_folder(report) for name, report in everything.items()}
