"""Customer frequency, geography and lifetime value.

Orders are reduced to one row per customer before customers are joined, so a
customer with a large part of all orders is one row in that join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyshop.functions import ratio, rounded, tier_lt
from tallyshop.operators.facts import is_valid, item_totals, order_totals
from tallyshop.operators.ordering import top_n
from tallyshop.operators.stats import pct_of_total, segment_by_count
from tallyshop.schema import RetailTables

# Customer segments, frequency bands and lifetime-value tiers.
ONE_TIME, REPEAT = "1. One-time customer", "2. Repeat customer"
BAND_ONE, BAND_TWO, BAND_FEW, BAND_MANY = (
    "1. One-time (1 order)",
    "2. Occasional (2 orders)",
    "3. Regular (3-4 orders)",
    "4. Loyal (5+ orders)",
)
CLV_BOUNDS = (500, 1500, 3000, 6000)
CLV_TIERS = (
    "1. Under $500",
    "2. $500-$1499",
    "3. $1500-$2999",
    "4. $3000-$5999",
    "5. $6000+",
)


def _segment(n: str) -> Column:
    return F.when(F.col(n) == 1, ONE_TIME).otherwise(REPEAT)


def order_frequency(t: RetailTables) -> DataFrame:
    """Orders of any status per customer, customers without orders included."""
    counts = t.orders.groupBy("customer_id").agg(F.count("*").alias("num_orders"))
    return (
        t.customers.select("customer_id", "first_name", "last_name")
        .join(counts, "customer_id", "left")
        .withColumn("num_orders", F.coalesce("num_orders", F.lit(0)))
        .orderBy(F.col("num_orders").desc(), "customer_id")
    )


def onetime_vs_repeat(t: RetailTables) -> DataFrame:
    """Customers with one order against those with more. Orders without a
    customer count as one customer, but not in the percentage base."""
    segments = segment_by_count(t.orders, "customer_id", _segment("n_rows"), "customer_segment")
    return pct_of_total(segments, "n_keys", "pct_of_customers", base="n_known").select(
        "customer_segment", F.col("n_keys").alias("num_customers"), "pct_of_customers"
    )


def frequency_bands(t: RetailTables) -> DataFrame:
    n = F.col("n_rows")
    band = (
        F.when(n == 1, BAND_ONE)
        .when(n == 2, BAND_TWO)
        .when(n.between(3, 4), BAND_FEW)
        .otherwise(BAND_MANY)
    )
    return (
        segment_by_count(t.orders, "customer_id", band, "frequency_band")
        .select("frequency_band", F.col("n_keys").alias("num_customers"))
        .orderBy("frequency_band")
    )


def segment_revenue(t: RetailTables) -> DataFrame:
    """Revenue of one-time and repeat customers. The segment counts all orders,
    the revenue only valid ones."""
    spend = F.sum(F.when(is_valid(), F.col("revenue")))
    per_customer = (
        t.orders.join(item_totals(t), "order_id", "left")
        .groupBy("customer_id")
        .agg(F.count("*").alias("num_orders"), spend.alias("spend"))
    )
    # Revenue of orders without a customer belongs to nobody.
    owned = F.when(F.col("customer_id").isNotNull(), F.col("spend"))
    total = F.sum(F.coalesce(owned, F.lit(0)))
    return per_customer.groupBy(_segment("num_orders").alias("customer_segment")).agg(
        F.count("customer_id").alias("num_customers"),
        rounded(total).alias("total_revenue"),
        ratio(total, F.count("customer_id")).alias("avg_revenue_per_customer"),
    )


def customers_by_state(t: RetailTables) -> DataFrame:
    """Customers, orders of any status, and orders per customer by state."""
    counts = t.orders.groupBy("customer_id").agg(F.count("*").alias("n"))
    return (
        t.customers.select("customer_id", "state")
        .join(counts, "customer_id", "left")
        .groupBy("state")
        .agg(
            F.count("*").alias("num_customers"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("num_orders"),
            ratio(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).alias(
                "avg_orders_per_customer"
            ),
        )
        .orderBy(F.col("num_customers").desc(), "state")
    )


def clv(t: RetailTables) -> DataFrame:
    """One row per customer with valid orders that have lines: ``num_orders``,
    ``lifetime_value`` (exact), first and last order date. Orders without a
    customer form one row with a null key."""
    return (
        order_totals(t)
        .groupBy("customer_id")
        .agg(
            F.count("*").alias("num_orders"),
            F.sum("revenue").alias("lifetime_value"),
            F.min("order_date").alias("first_order_date"),
            F.max("order_date").alias("most_recent_order_date"),
        )
    )


def revenue_by_state(t: RetailTables) -> DataFrame:
    """Buying customers, revenue and revenue per customer by state."""
    total = F.sum("lifetime_value")
    return (
        clv(t)
        .join(t.customers.select("customer_id", "state"), "customer_id")
        .groupBy("state")
        .agg(
            F.count("*").alias("num_customers"),
            rounded(total).alias("total_revenue"),
            ratio(total, F.count("*")).alias("revenue_per_customer"),
        )
        .orderBy(F.col("total_revenue").desc(), "state")
    )


def top_cities(t: RetailTables, n: int = 15) -> DataFrame:
    """Cities with most customers, and their revenue."""
    cities = (
        t.customers.select("customer_id", "city", "state")
        .join(clv(t).select("customer_id", "lifetime_value"), "customer_id", "left")
        .groupBy("city", "state")
        .agg(
            F.count("*").alias("num_customers"),
            rounded(F.coalesce(F.sum("lifetime_value"), F.lit(0))).alias("total_revenue"),
        )
    )
    return top_n(cities, [F.col("num_customers").desc()], n, ["city", "state"])


def customer_vs_store_state(t: RetailTables) -> DataFrame:
    """Orders by the customer's state and the store's state.

    Orders meet customers in one shuffle on the customer, hot customers split by adaptive execution;
    stores are joined to the counts.
    """
    homes = t.customers.select("customer_id", F.col("state").alias("customer_state"))
    places = t.stores.select("store_id", F.col("state").alias("store_state"))
    per_store = (
        t.orders.select("customer_id", "store_id").join(homes, "customer_id")
        .groupBy("customer_state", "store_id")
        .agg(F.count("*").alias("n"))
    )
    return (
        per_store.join(places, "store_id")
        .groupBy("customer_state", "store_state")
        .agg(F.sum("n").alias("num_orders"))
        .orderBy("customer_state", F.col("num_orders").desc(), "store_state")
    )


def clv_top(t: RetailTables, n: int = 20) -> DataFrame:
    """Customers with the highest lifetime value."""
    rows = (
        clv(t)
        .join(t.customers, "customer_id")
        .select(
            "customer_id",
            "first_name",
            "last_name",
            "city",
            "state",
            "num_orders",
            rounded("lifetime_value").alias("lifetime_value"),
            ratio("lifetime_value", "num_orders").alias("avg_order_value"),
        )
    )
    return top_n(rows, [F.col("lifetime_value").desc()], n, ["customer_id"])


def clv_tiers(t: RetailTables, bounds=CLV_BOUNDS, labels=CLV_TIERS) -> DataFrame:
    """Customers and revenue per lifetime-value tier."""
    per_tier = (
        clv(t)
        .groupBy(tier_lt("lifetime_value", bounds, labels).alias("clv_tier"))
        .agg(F.count("*").alias("num_customers"), F.sum("lifetime_value").alias("revenue"))
    )
    return (
        pct_of_total(per_tier, "revenue", "pct_of_total_revenue")
        .select(
            "clv_tier",
            "num_customers",
            rounded("revenue").alias("tier_total_revenue"),
            "pct_of_total_revenue",
        )
        .orderBy("clv_tier")
    )


def customer_span(t: RetailTables, n: int = 20, more_than: int = 1) -> DataFrame:
    """Customers with the longest time between first and latest order."""
    span = F.datediff("most_recent_order_date", "first_order_date").cast("bigint")
    rows = (
        clv(t)
        .where(F.col("num_orders") > more_than)
        .join(t.customers.select("customer_id", "first_name", "last_name"), "customer_id")
        .select(
            "customer_id",
            "first_name",
            "last_name",
            "first_order_date",
            "most_recent_order_date",
            span.alias("customer_span_days"),
            "num_orders",
            rounded("lifetime_value").alias("lifetime_value"),
        )
    )
    return top_n(rows, [F.col("customer_span_days").desc()], n, ["customer_id"])


def clv_top_with_state(t: RetailTables, n: int = 10) -> DataFrame:
    return clv_top(t, n).select(
        "customer_id", "first_name", "last_name", "state", "lifetime_value"
    )
