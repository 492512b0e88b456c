"""Order status and fulfilment reports. They read orders, and names after the
orders are aggregated."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyshop.functions import label, period
from tallyshop.operators.facts import is_shipped
from tallyshop.operators.stats import STATUS_COLUMNS, fulfilment, pct_of_total, status_pivot
from tallyshop.schema import RetailTables

# Status labels and shipping-time buckets.
STATUS_LABELS = {1: "Pending", 2: "Processing", 3: "Rejected", 4: "Completed"}
UNKNOWN_STATUS = "Unknown"
SAME_DAY, NEXT_DAY, FEW_DAYS, LONGER = (
    "0. Same day",
    "1. Next day",
    "2. 2-3 days",
    "3. 4+ days",
)


def status_breakdown(t: RetailTables) -> DataFrame:
    """Orders per status and their share of all orders."""
    per_status = t.orders.groupBy("order_status").agg(F.count("*").alias("num_orders"))
    named = per_status.withColumn(
        "status_label", label("order_status", STATUS_LABELS, UNKNOWN_STATUS)
    )
    return (
        pct_of_total(named, "num_orders", "pct_of_all_orders")
        .select("order_status", "status_label", "num_orders", "pct_of_all_orders")
        .orderBy("order_status")
    )


def status_by_store(t: RetailTables) -> DataFrame:
    """Orders per status for each store, highest rejection rate first."""
    return (
        status_pivot(t.orders, ["store_id"])
        .join(t.stores.select("store_id", "store_name"), "store_id")
        .select(
            "store_id", "store_name", *STATUS_COLUMNS, "total_orders", "rejection_rate_pct"
        )
        .orderBy(F.col("rejection_rate_pct").desc(), "store_id")
    )


def status_by_month(t: RetailTables) -> DataFrame:
    return (
        status_pivot(t.orders, [period("order_date", "month").alias("order_month")])
        .select("order_month", *STATUS_COLUMNS, "total_orders")
        .orderBy("order_month")
    )


def fulfilment_overall(t: RetailTables) -> DataFrame:
    return fulfilment(t.orders).select(
        "num_completed_orders",
        "avg_days_to_ship",
        "fastest_fulfillment_days",
        "slowest_fulfillment_days",
    )


def lateness_overall(t: RetailTables) -> DataFrame:
    """Shipping against the promised date; negative days are early."""
    return fulfilment(t.orders).select(
        "num_completed_orders", "avg_days_early_or_late", "num_late_orders", "pct_late"
    )


def fulfilment_by_store(t: RetailTables) -> DataFrame:
    return (
        fulfilment(t.orders, ["store_id"])
        .join(t.stores.select("store_id", "store_name"), "store_id")
        .select(
            "store_id",
            "store_name",
            "num_completed_orders",
            "avg_days_to_ship",
            "avg_days_early_or_late",
            "num_late_orders",
            "pct_late",
        )
        .orderBy(F.col("pct_late").desc(), "store_id")
    )


def fulfilment_by_staff(t: RetailTables) -> DataFrame:
    return (
        fulfilment(t.orders, ["staff_id"])
        .join(t.staffs.select("staff_id", "first_name", "last_name"), "staff_id")
        .select(
            "staff_id",
            "first_name",
            "last_name",
            "num_completed_orders",
            "avg_days_to_ship",
            "num_late_orders",
            "pct_late",
        )
        .orderBy(F.col("pct_late").desc(), "staff_id")
    )


def fulfilment_buckets(t: RetailTables) -> DataFrame:
    """Shipped orders per shipping time. Shipping before the order date falls
    into the last bucket with the slow ones."""
    days = F.datediff("shipped_date", "order_date")
    bucket = (
        F.when(days == 0, SAME_DAY)
        .when(days == 1, NEXT_DAY)
        .when(days.between(2, 3), FEW_DAYS)
        .otherwise(LONGER)
    )
    per_bucket = (
        t.orders.where(is_shipped())
        .groupBy(bucket.alias("fulfillment_bucket"))
        .agg(F.count("*").alias("num_orders"))
    )
    return pct_of_total(per_bucket, "num_orders", "pct_of_completed_orders").orderBy(
        "fulfillment_bucket"
    )


def fulfilment_by_month(t: RetailTables) -> DataFrame:
    return (
        fulfilment(t.orders, [period("order_date", "month").alias("order_month")])
        .select("order_month", "num_completed_orders", "avg_days_to_ship")
        .orderBy("order_month")
    )
