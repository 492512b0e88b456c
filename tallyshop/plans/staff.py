"""Staff and store reports. Staff and stores without orders stay in the result.

Rejected orders are dropped before the outer joins, never after: a filter on the
joined rows would drop the unmatched staff and stores too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyshop.functions import ratio, rounded
from tallyshop.operators.facts import order_totals
from tallyshop.operators.ordering import rank_within
from tallyshop.operators.relations import count_lookup, team_rollup, with_manager
from tallyshop.operators.stats import fulfilment
from tallyshop.plans.dims import staff_with_store
from tallyshop.schema import RetailTables


def _totals_by(t: RetailTables, key: str) -> DataFrame:
    """Valid orders per ``key``, those without lines included."""
    return (
        order_totals(t, keep_empty=True)
        .groupBy(key)
        .agg(
            F.count("*").alias("num_orders"),
            F.sum("revenue").alias("revenue"),
            F.sum("units").alias("units"),
        )
    )


def _revenue_by(t: RetailTables, key: str) -> DataFrame:
    return order_totals(t).groupBy(key).agg(F.sum("revenue").alias("revenue"))


def staff_sales(t: RetailTables) -> DataFrame:
    """Orders, revenue and order value per staff member."""
    return (
        staff_with_store(t)
        .join(_totals_by(t, "staff_id"), "staff_id", "left")
        .select(
            "staff_id",
            "first_name",
            "last_name",
            "store_name",
            F.coalesce("num_orders", F.lit(0)).alias("num_orders"),
            rounded("revenue").alias("total_revenue"),
            ratio("revenue", "num_orders").alias("avg_order_value"),
        )
        .orderBy(F.col("total_revenue").desc(), "staff_id")
    )


def staff_hierarchy(t: RetailTables) -> DataFrame:
    """Staff beside their managers, those without a manager first."""
    return (
        with_manager(t.staffs)
        .select(
            "staff_id",
            "first_name",
            "last_name",
            "manager_id",
            "manager_first_name",
            "manager_last_name",
        )
        .orderBy(F.col("manager_id").isNull().desc(), "manager_id", "staff_id")
    )


def team_revenue(t: RetailTables) -> DataFrame:
    """Revenue of each manager's direct reports, the manager's own left out."""
    earned = (
        t.staffs.select("staff_id", "manager_id")
        .join(_revenue_by(t, "staff_id"), "staff_id", "left")
        .withColumn("revenue", F.coalesce("revenue", F.lit(0)))
    )
    return (
        team_rollup(earned, t.staffs, "revenue")
        .select(
            "manager_id",
            "manager_first_name",
            "manager_last_name",
            "num_direct_reports",
            rounded("team_revenue").alias("team_total_revenue"),
        )
        .orderBy(F.col("team_total_revenue").desc(), "manager_id")
    )


def staff_rank_in_store(t: RetailTables) -> DataFrame:
    """Staff ranked by revenue within their store; equals share a rank."""
    earned = (
        staff_with_store(t)
        .join(_revenue_by(t, "staff_id"), "staff_id", "left")
        .select(
            "store_id",
            "store_name",
            "staff_id",
            "first_name",
            "last_name",
            F.coalesce("revenue", F.lit(0)).alias("revenue"),
        )
    )
    return (
        rank_within(earned, ["store_id"], "revenue", ["staff_id"], "rank_within_store")
        .select(
            "store_name",
            "staff_id",
            "first_name",
            "last_name",
            rounded("revenue").alias("total_revenue"),
            "rank_within_store",
        )
        .orderBy("store_name", "rank_within_store", "staff_id")
    )


def store_comparison(t: RetailTables) -> DataFrame:
    """Orders, revenue, order value and units per order of each store. The order
    count takes every order that is not rejected."""
    return (
        t.stores.select("store_id", "store_name", "city", "state")
        .join(_totals_by(t, "store_id"), "store_id", "left")
        .select(
            "store_id",
            "store_name",
            "city",
            "state",
            F.coalesce("num_orders", F.lit(0)).alias("num_completed_orders"),
            rounded("revenue").alias("total_revenue"),
            ratio("revenue", "num_orders").alias("avg_order_value"),
            ratio("units", "num_orders").alias("avg_items_per_order"),
        )
        .orderBy(F.col("total_revenue").desc(), "store_id")
    )


def store_fulfilment(t: RetailTables) -> DataFrame:
    """Shipping speed per store, fastest first."""
    return (
        fulfilment(t.orders, ["store_id"])
        .join(t.stores.select("store_id", "store_name"), "store_id")
        .select(
            "store_id",
            "store_name",
            "num_completed_orders",
            "avg_days_to_ship",
            "num_late_orders",
            "pct_late",
        )
        .orderBy("avg_days_to_ship", "store_id")
    )


def store_scorecard(t: RetailTables, per_order: bool = False) -> DataFrame:
    """Active staff, revenue, orders and days to ship per store.

    By default the days are averaged over lines, so an order weighs as much as
    it has lines. ``per_order`` gives each order the same weight.
    """
    days = F.datediff("shipped_date", "order_date")
    weight = F.lit(1) if per_order else F.coalesce("n_lines", F.lit(1))
    per_store = (
        order_totals(t, keep_empty=True)
        .groupBy("store_id")
        .agg(
            F.sum("revenue").alias("revenue"),
            F.count("*").alias("num_orders"),
            F.sum(days * weight).alias("days"),
            F.sum(F.when(days.isNotNull(), weight)).alias("weight"),
        )
    )
    stores = t.stores.select("store_id", "store_name").join(per_store, "store_id", "left")
    return (
        count_lookup(stores, t.staffs, "store_id", F.col("active") == 1, "active_staff_count")
        .select(
            "store_id",
            "store_name",
            "active_staff_count",
            rounded("revenue").alias("total_revenue"),
            F.coalesce("num_orders", F.lit(0)).alias("num_orders"),
            ratio("days", "weight").alias("avg_days_to_ship"),
        )
        .orderBy(F.col("total_revenue").desc(), "store_id")
    )


def revenue_per_active_staff(t: RetailTables) -> DataFrame:
    """Store revenue per active staff member; null where there is none."""
    stores = t.stores.select("store_id", "store_name").join(
        _revenue_by(t, "store_id"), "store_id", "left"
    )
    return (
        count_lookup(stores, t.staffs, "store_id", F.col("active") == 1, "active_staff_count")
        .select(
            "store_id",
            "store_name",
            rounded("revenue").alias("total_revenue"),
            "active_staff_count",
            ratio("revenue", "active_staff_count").alias("revenue_per_active_staff"),
        )
        .orderBy(F.col("revenue_per_active_staff").desc(), "store_id")
    )
