"""Revenue, discount and order-value reports over orders that were not rejected."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyshop.functions import mean, period, ratio, rounded, tier_le, tier_lt
from tallyshop.operators.facts import class_totals, line_revenue, order_totals, valid_lines
from tallyshop.operators.lookup import lookup
from tallyshop.operators.ordering import top_n
from tallyshop.operators.periods import growth_pct, running_total
from tallyshop.operators.stats import pct_of_total
from tallyshop.plans.dims import product_brand, product_category, staff_with_store
from tallyshop.schema import RetailTables

# Discount tiers and order-value buckets.
DISCOUNT_BOUNDS = (Decimal("0.05"), Decimal("0.10"), Decimal("0.15"), Decimal("0.20"))
DISCOUNT_TIERS = (
    "1. No discount (0%)",
    "2. 1-5%",
    "3. 6-10%",
    "4. 11-15%",
    "5. 16-20%",
    "6. 20%+",
)
WIDE_DISCOUNT_BOUNDS = (Decimal("0.10"), Decimal("0.20"))
WIDE_DISCOUNT_TIERS = ("1. No discount (0%)", "2. 1-10%", "3. 11-20%", "4. 20%+")
NOT_DISCOUNTED, DISCOUNTED = "1. No discount", "2. Discounted"
AOV_BOUNDS = (1000, 2500, 5000, 10000)
AOV_BUCKETS = (
    "1. Under $1000",
    "2. $1000-$2499",
    "3. $2500-$4999",
    "4. $5000-$9999",
    "5. $10000+",
)


def _orders_and_revenue(t: RetailTables, *keys: str | Column) -> DataFrame:
    """``num_orders`` and exact ``revenue`` per group of valid orders with lines."""
    return (
        order_totals(t)
        .groupBy(*keys)
        .agg(F.count("*").alias("num_orders"), F.sum("revenue").alias("revenue"))
    )


def _month() -> Column:
    return period("order_date", "month").alias("order_month")


def monthly_revenue(t: RetailTables) -> DataFrame:
    return (
        _orders_and_revenue(t, _month())
        .select("order_month", "num_orders", rounded("revenue").alias("net_revenue"))
        .orderBy("order_month")
    )


def yearly_growth(t: RetailTables) -> DataFrame:
    """Revenue per year and its change against the year before."""
    yearly = _orders_and_revenue(t, period("order_date", "year").alias("order_year"))
    return (
        growth_pct(yearly, "order_year", "revenue", "yoy_growth_pct")
        .select("order_year", rounded("revenue").alias("net_revenue"), "yoy_growth_pct")
        .orderBy("order_year")
    )


def quarterly_revenue(t: RetailTables) -> DataFrame:
    return (
        _orders_and_revenue(
            t,
            period("order_date", "year").alias("order_year"),
            period("order_date", "quarter").alias("order_quarter"),
        )
        .select(
            "order_year", "order_quarter", "num_orders", rounded("revenue").alias("net_revenue")
        )
        .orderBy("order_year", "order_quarter")
    )


def seasonality(t: RetailTables) -> DataFrame:
    """Revenue per calendar month over all years."""
    return (
        _orders_and_revenue(
            t,
            period("order_date", "month_of_year").alias("calendar_month"),
            period("order_date", "month_name").alias("month_name"),
        )
        .select(
            "calendar_month", "month_name", "num_orders", rounded("revenue").alias("net_revenue")
        )
        .orderBy("calendar_month")
    )


def cumulative_revenue(t: RetailTables) -> DataFrame:
    monthly = _orders_and_revenue(t, _month())
    return (
        running_total(monthly, "order_month", "revenue", out="running")
        .select(
            "order_month",
            rounded("revenue").alias("net_revenue"),
            rounded("running").alias("cumulative_revenue"),
        )
        .orderBy("order_month")
    )


def revenue_by_store(t: RetailTables) -> DataFrame:
    """Orders, revenue and share of all revenue per store. The total includes
    orders of unknown stores."""
    per_store = _orders_and_revenue(t, "store_id")
    return (
        pct_of_total(per_store, "revenue", "pct_of_total_revenue")
        .join(t.stores.select("store_id", "store_name"), "store_id")
        .select(
            "store_id",
            "store_name",
            "num_orders",
            rounded("revenue").alias("net_revenue"),
            "pct_of_total_revenue",
        )
        .orderBy(F.col("net_revenue").desc(), "store_id")
    )


def revenue_by_staff(t: RetailTables) -> DataFrame:
    """Orders and revenue per staff member, shown with their home store."""
    return (
        _orders_and_revenue(t, "staff_id")
        .join(staff_with_store(t), "staff_id")
        .select(
            "staff_id",
            "first_name",
            "last_name",
            "store_name",
            "num_orders",
            rounded("revenue").alias("net_revenue"),
        )
        .orderBy(F.col("net_revenue").desc(), "staff_id")
    )


def _valid_lines_with(t: RetailTables, products: DataFrame) -> DataFrame:
    """Valid lines with columns of their product.

    Products come first: the join to orders then leaves the lines partitioned by
    order, which a distinct count of orders per group can use as it is.
    """
    return valid_lines(t, lookup(t.order_items, products, "product_id"))


def _revenue_by_product(t: RetailTables, names: DataFrame, key: str) -> DataFrame:
    return (
        _valid_lines_with(t, names)
        .groupBy(key)
        .agg(
            F.countDistinct("order_id").alias("num_orders"),
            F.sum("quantity").alias("units_sold"),
            rounded(F.sum(line_revenue())).alias("net_revenue"),
        )
        .orderBy(F.col("net_revenue").desc(), key)
    )


def revenue_by_category(t: RetailTables) -> DataFrame:
    return _revenue_by_product(t, product_category(t), "category_name")


def revenue_by_brand(t: RetailTables) -> DataFrame:
    return _revenue_by_product(t, product_brand(t), "brand_name")


def store_category(t: RetailTables) -> DataFrame:
    """Units and revenue per store and category. Lines are added up per store and product
    first, so the catalogue is joined to one row of each."""
    sold = (
        valid_lines(t)
        .groupBy("store_id", "product_id")
        .agg(F.sum("quantity").alias("units"), F.sum(line_revenue()).alias("revenue"))
        .join(t.products.select("product_id", "category_id"), "product_id")
        .groupBy("store_id", "category_id")
        .agg(F.sum("units").alias("units"), F.sum("revenue").alias("revenue"))
    )
    return (
        sold.join(t.stores.select("store_id", "store_name"), "store_id")
        .join(t.categories, "category_id")
        .groupBy("store_name", "category_name")
        .agg(
            F.sum("units").alias("units_sold"),
            rounded(F.sum("revenue")).alias("net_revenue"),
        )
        .orderBy("store_name", F.col("net_revenue").desc(), "category_name")
    )


def discount_tiers(
    t: RetailTables, bounds=DISCOUNT_BOUNDS, labels=DISCOUNT_TIERS
) -> DataFrame:
    """Lines, quantity and revenue per discount tier."""
    totals = class_totals(
        t,
        tier_le("discount", bounds, labels),
        labels,
        "discount_tier",
        lines=F.lit(1),
        units=F.col("quantity"),
        counted=F.col("quantity").isNotNull().cast("int"),
        revenue=line_revenue(),
    )
    return totals.select(
        "discount_tier",
        F.col("lines").alias("num_line_items"),
        ratio("units", "counted").alias("avg_quantity_per_line_item"),
        F.col("units").alias("total_units_sold"),
        rounded("revenue").alias("net_revenue"),
    ).orderBy("discount_tier")


def discount_vs_quantity(t: RetailTables, min_lines: int = 5) -> DataFrame:
    """Average discount and quantity of products with enough lines."""
    per_product = (
        valid_lines(t)
        .groupBy("product_id")
        .agg(
            F.count("*").alias("num_line_items"),
            rounded(mean("discount") * 100).alias("avg_discount_pct"),
            rounded(mean("quantity")).alias("avg_quantity_per_line_item"),
            F.sum("quantity").alias("total_units_sold"),
        )
        .where(F.col("num_line_items") >= min_lines)
    )
    return (
        per_product.join(t.products.select("product_id", "product_name"), "product_id")
        .select(
            "product_id",
            "product_name",
            "num_line_items",
            "avg_discount_pct",
            "avg_quantity_per_line_item",
            "total_units_sold",
        )
        .orderBy(F.col("avg_discount_pct").desc(), "product_id")
    )


def discounted_flag(t: RetailTables) -> DataFrame:
    """Lines with a discount against those without."""
    totals = class_totals(
        t,
        F.when(F.col("discount") == 0, NOT_DISCOUNTED).otherwise(DISCOUNTED),
        (NOT_DISCOUNTED, DISCOUNTED),
        "discount_flag",
        lines=F.lit(1),
        units=F.col("quantity"),
        counted=F.col("quantity").isNotNull().cast("int"),
        given=F.col("discount"),
        discounts=F.col("discount").isNotNull().cast("int"),
    )
    average = F.col("given").cast("double") / F.nullif(F.col("discounts").cast("double"), F.lit(0.0))
    return totals.select(
        "discount_flag",
        F.col("lines").alias("num_line_items"),
        F.col("units").alias("total_units_sold"),
        ratio("units", "counted").alias("avg_quantity_per_line_item"),
        rounded(average * 100).alias("avg_discount_pct"),
    )


def discount_tiers_category(
    t: RetailTables, bounds=WIDE_DISCOUNT_BOUNDS, labels=WIDE_DISCOUNT_TIERS
) -> DataFrame:
    """Lines and quantity per category and discount tier. Lines are added up per product and
    tier first, so the catalogue is joined to one row of each."""
    per_product = (
        valid_lines(t)
        .groupBy("product_id", tier_le("discount", bounds, labels).alias("discount_tier"))
        .agg(
            F.count("*").alias("n_lines"),
            F.sum("quantity").alias("units"),
            F.count("quantity").alias("counted"),
        )
    )
    return (
        per_product.join(product_category(t), "product_id")
        .groupBy("category_name", "discount_tier")
        .agg(
            F.sum("n_lines").alias("num_line_items"),
            ratio(F.sum("units"), F.sum("counted")).alias("avg_quantity_per_line_item"),
        )
        .orderBy("category_name", "discount_tier")
    )


def aov_overall(t: RetailTables) -> DataFrame:
    return _orders_and_revenue(t).select(
        "num_orders",
        rounded("revenue").alias("total_revenue"),
        ratio("revenue", "num_orders").alias("avg_order_value"),
    )


def aov_by_store(t: RetailTables) -> DataFrame:
    return (
        _orders_and_revenue(t, "store_id")
        .join(t.stores.select("store_id", "store_name"), "store_id")
        .select(
            "store_id",
            "store_name",
            "num_orders",
            ratio("revenue", "num_orders").alias("avg_order_value"),
        )
        .orderBy(F.col("avg_order_value").desc(), "store_id")
    )


def aov_by_customer(t: RetailTables, n: int = 20, min_orders: int = 2) -> DataFrame:
    """Customers with the highest order value among those with enough orders."""
    rows = (
        _orders_and_revenue(t, "customer_id")
        .where(F.col("num_orders") >= min_orders)
        .join(
            t.customers.select("customer_id", "first_name", "last_name", "state"), "customer_id"
        )
        .select(
            "customer_id",
            "first_name",
            "last_name",
            "state",
            "num_orders",
            ratio("revenue", "num_orders").alias("avg_order_value"),
        )
    )
    return top_n(rows, [F.col("avg_order_value").desc()], n, ["customer_id"])


def aov_buckets(t: RetailTables, bounds=AOV_BOUNDS, labels=AOV_BUCKETS) -> DataFrame:
    """Customers per bucket of their unrounded average order value."""
    aov = F.col("revenue").cast("double") / F.col("num_orders")
    return (
        _orders_and_revenue(t, "customer_id")
        .groupBy(tier_lt(aov, bounds, labels).alias("aov_bucket"))
        .agg(F.count("*").alias("num_customers"))
        .orderBy("aov_bucket")
    )


def aov_by_month(t: RetailTables) -> DataFrame:
    return (
        _orders_and_revenue(t, _month())
        .select(
            "order_month",
            "num_orders",
            ratio("revenue", "num_orders").alias("avg_order_value"),
        )
        .orderBy("order_month")
    )
