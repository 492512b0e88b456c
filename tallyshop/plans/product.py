"""Product and inventory reports. They count lines of every order status.

Lines are first added up per product, so what is joined to the catalogue is one
row per product however often it was sold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyshop.functions import mean, ratio, rounded, tier_lt
from tallyshop.operators.facts import product_totals
from tallyshop.operators.ordering import ntile_global, top_n
from tallyshop.operators.relations import unmatched
from tallyshop.operators.stats import count_distinct_ids, group_median
from tallyshop.plans.dims import catalog, product_brand, product_category
from tallyshop.schema import RetailTables

# Price tiers.
PRICE_BOUNDS = (500, 1000, 2000, 3000)
PRICE_TIERS = (
    "1. Under $500",
    "2. $500-$999",
    "3. $1000-$1999",
    "4. $2000-$2999",
    "5. $3000+",
)

_NAMES = ("product_id", "product_name", "brand_name", "category_name")


def _price_tier(bounds=PRICE_BOUNDS, labels=PRICE_TIERS) -> Column:
    return tier_lt("list_price", bounds, labels).alias("price_tier")


def _avg_discount_pct(total: str = "discount_sum", n: str = "discount_n") -> Column:
    average = F.sum(total).cast("double") / F.nullif(F.sum(n).cast("double"), F.lit(0.0))
    return rounded(average * 100).alias("avg_discount_pct")


def best_sellers(t: RetailTables, n: int = 10) -> DataFrame:
    """Products with most units sold.

    Distinct orders are counted for the ``n`` listed products only, as bitmaps. Counting
    them for every product would shuffle one row per product and order, about
    as many as there are lines.
    """
    units = F.col("units_sold")
    sold = product_totals(t).select(
        "product_id", F.col("units").alias("units_sold"), rounded("revenue").alias("net_revenue")
    )
    listed = top_n(
        catalog(t).join(sold, "product_id").select(*_NAMES, "units_sold", "net_revenue"),
        [units.desc()],
        n,
        ["product_id"],
    )
    # every listed product has a line, so the list is joined once and its columns are the group;
    # it has ``n`` rows, which a top-n holds in one place anyway
    lines = t.order_items.select("product_id", "order_id").join(F.broadcast(listed), "product_id")
    return count_distinct_ids(lines, listed.columns, "order_id", "num_orders").orderBy(
        units.desc(), "product_id"
    )


def slow_movers(t: RetailTables, n: int = 10) -> DataFrame:
    """Products with fewest units among those sold at least once."""
    sold = product_totals(t).select(
        "product_id", F.col("units").alias("units_sold"), rounded("revenue").alias("net_revenue")
    )
    joined = catalog(t).join(sold, "product_id").select(*_NAMES, "units_sold", "net_revenue")
    return top_n(joined, [F.col("units_sold").asc()], n, ["product_id"])


def never_sold(t: RetailTables, since: str | None = None) -> DataFrame:
    """Products on no line at all, or on no line of an order placed on or after
    ``since`` (``yyyy-MM-dd``)."""
    lines = t.order_items
    if since is not None:
        recent = t.orders.where(F.col("order_date") >= F.lit(since).cast("date"))
        lines = lines.join(recent.select("order_id"), "order_id")
    return (
        unmatched(catalog(t), lines, "product_id")
        .select(*_NAMES, rounded("list_price").alias("list_price"))
        .orderBy(F.col("list_price").desc(), "product_id")
    )


def sales_quartile(t: RetailTables, buckets: int = 4) -> DataFrame:
    """Sold products in equal buckets by units; bucket 1 sells most."""
    sold = product_totals(t).select("product_id", F.col("units").alias("units_sold"))
    joined = catalog(t).join(sold, "product_id").select(*_NAMES, "units_sold")
    order = [F.col("units_sold").desc(), F.col("product_id").asc()]
    return ntile_global(joined, buckets, order, "sales_quartile").orderBy(*order)


def _sales_by(t: RetailTables, names: DataFrame, key: str, valid_only: bool) -> DataFrame:
    return (
        product_totals(t, valid_only)
        .join(names, "product_id")
        .groupBy(key)
        .agg(
            F.sum("units").alias("total_units_sold"),
            rounded(F.sum("revenue")).alias("total_net_revenue"),
            F.count("*").alias("distinct_products_sold"),
        )
        .orderBy(F.col("total_units_sold").desc(), key)
    )


def category_sales(t: RetailTables, valid_only: bool = False) -> DataFrame:
    return _sales_by(t, product_category(t), "category_name", valid_only)


def brand_sales(t: RetailTables, valid_only: bool = False) -> DataFrame:
    return _sales_by(t, product_brand(t), "brand_name", valid_only)


def _at_least_one(n: str) -> Column:
    """Rows a missing side leaves in an outer join: one, not none."""
    return F.greatest(F.coalesce(n, F.lit(0)), F.lit(1))


def overstock_ratio(
    t: RetailTables, n: int = 15, true_totals: bool = False, unsold_first: bool = False
) -> DataFrame:
    """Stock on hand against units sold, highest ratio first.

    By default the sums are those of joining lines and stock rows to the product
    at once, which counts every line once per stock row and the other way round.
    ``true_totals`` counts each once. ``unsold_first`` puts products that never
    sold, whose ratio is null, at the top instead of at the end.

    The multiplied sums follow from the counts, so the joined rows are never made.
    """
    sold = t.order_items.groupBy("product_id").agg(
        F.sum("quantity").alias("units"), F.count("*").alias("n_lines")
    )
    stock = t.stocks.groupBy("product_id").agg(
        F.sum("quantity").alias("stock"), F.count("*").alias("n_stock")
    )
    joined = catalog(t).join(sold, "product_id", "left").join(stock, "product_id", "left")
    units, on_hand = F.col("units"), F.col("stock")
    if not true_totals:
        units, on_hand = units * _at_least_one("n_stock"), on_hand * _at_least_one("n_lines")
    rows = joined.select(
        *_NAMES,
        F.coalesce(units, F.lit(0)).alias("units_sold"),
        on_hand.alias("total_stock_on_hand"),
        ratio(on_hand, units).alias("stock_to_sales_ratio"),
    ).where(F.col("total_stock_on_hand") > 0)
    by = F.col("stock_to_sales_ratio")
    return top_n(rows, [by.desc_nulls_first() if unsold_first else by.desc()], n, ["product_id"])


def price_stats_category(t: RetailTables) -> DataFrame:
    """Count, range, mean and median list price per category, all from the products counted
    by category and price."""
    # the join with categories leaves out the others in any case; said here, both passes of the
    # median read the same counts
    known = t.products.where(F.col("category_id").isNotNull())
    counted = known.groupBy("category_id", "list_price").agg(F.count("*").alias("n"))
    price, n = F.col("list_price"), F.col("n")
    stats = group_median(
        counted,
        ["category_id"],
        "list_price",
        "median",
        weight="n",
        also=[
            F.sum(n).alias("num"),
            F.min(price).alias("lo"),
            F.max(price).alias("hi"),
            F.sum(price * n).alias("total"),
            F.sum(F.when(price.isNotNull(), n)).alias("priced"),
        ],
    )
    # Categories that share a name and a median are one row.
    return (
        stats.join(t.categories, "category_id")
        .groupBy("category_name", "median")
        .agg(
            F.sum("num").alias("num_products"),
            rounded(F.min("lo")).alias("min_price"),
            rounded(F.max("hi")).alias("max_price"),
            ratio(F.sum("total"), F.sum("priced")).alias("avg_price"),
        )
        .select(
            "category_name",
            "num_products",
            "min_price",
            "max_price",
            "avg_price",
            rounded("median").alias("median_price"),
        )
        .orderBy(F.col("avg_price").desc(), "category_name")
    )


def price_stats_brand(t: RetailTables) -> DataFrame:
    """Count, range and mean list price per brand."""
    return (
        t.products.join(t.brands, "brand_id")
        .groupBy("brand_name")
        .agg(
            F.count("product_id").alias("num_products"),
            rounded(F.min("list_price")).alias("min_price"),
            rounded(F.max("list_price")).alias("max_price"),
            rounded(mean("list_price")).alias("avg_price"),
        )
        .orderBy(F.col("avg_price").desc(), "brand_name")
    )


def price_tiers(t: RetailTables, bounds=PRICE_BOUNDS, labels=PRICE_TIERS) -> DataFrame:
    return (
        t.products.groupBy(_price_tier(bounds, labels))
        .agg(
            F.count("*").alias("num_products"),
            rounded(mean("list_price")).alias("avg_price_in_tier"),
        )
        .orderBy("price_tier")
    )


def price_tiers_category(t: RetailTables, bounds=PRICE_BOUNDS, labels=PRICE_TIERS) -> DataFrame:
    return (
        t.products.join(t.categories, "category_id")
        .groupBy("category_name", _price_tier(bounds, labels))
        .agg(F.count("*").alias("num_products"))
        .orderBy("category_name", "price_tier")
    )


def discount_by_price_tier(t: RetailTables, bounds=PRICE_BOUNDS, labels=PRICE_TIERS) -> DataFrame:
    """Discount given per tier of the price on the line."""
    return (
        t.order_items.groupBy(_price_tier(bounds, labels))
        .agg(
            rounded(mean("discount") * 100).alias("avg_discount_pct"),
            F.count("*").alias("num_line_items"),
        )
        .orderBy("price_tier")
    )


def model_year_catalog(t: RetailTables) -> DataFrame:
    return (
        t.products.groupBy("model_year")
        .agg(
            F.count("*").alias("num_products"),
            rounded(mean("list_price")).alias("avg_list_price"),
            rounded(F.min("list_price")).alias("min_price"),
            rounded(F.max("list_price")).alias("max_price"),
        )
        .orderBy("model_year")
    )


def _totals_with_year(t: RetailTables) -> DataFrame:
    return product_totals(t).join(
        t.products.select("product_id", "category_id", "model_year"), "product_id"
    )


def model_year_sales(t: RetailTables) -> DataFrame:
    return (
        _totals_with_year(t)
        .groupBy("model_year")
        .agg(
            F.sum("units").alias("units_sold"),
            rounded(F.sum("revenue")).alias("net_revenue"),
            _avg_discount_pct(),
        )
        .orderBy("model_year")
    )


def model_year_category(t: RetailTables) -> DataFrame:
    return (
        _totals_with_year(t)
        .join(t.categories, "category_id")
        .groupBy("model_year", "category_name")
        .agg(
            F.sum("units").alias("units_sold"),
            rounded(F.sum("revenue")).alias("net_revenue"),
        )
        .orderBy("model_year", F.col("units_sold").desc(), "category_name")
    )


def model_year_discount(t: RetailTables) -> DataFrame:
    return (
        _totals_with_year(t)
        .groupBy("model_year")
        .agg(
            _avg_discount_pct(),
            ratio(F.sum("price_sum"), F.sum("price_n")).alias("avg_list_price"),
            F.sum("units").alias("units_sold"),
        )
        .orderBy("model_year")
    )


def model_year_stock(t: RetailTables) -> DataFrame:
    """Stock left and stocked products per model year."""
    stock = t.stocks.groupBy("product_id").agg(F.sum("quantity").alias("stock"))
    return (
        stock.join(t.products.select("product_id", "model_year"), "product_id")
        .groupBy("model_year")
        .agg(
            F.sum("stock").alias("total_stock_remaining"),
            F.count("*").alias("num_products"),
        )
        .orderBy("model_year")
    )
