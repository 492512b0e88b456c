"""The reports by name. Each takes the tables and returns a lazy DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from tallyshop.plans import customer, operations, product, sales, staff
from tallyshop.schema import RetailTables

PRODUCT_REPORTS = (
    product.best_sellers,
    product.slow_movers,
    product.never_sold,
    product.sales_quartile,
    product.category_sales,
    product.brand_sales,
    product.overstock_ratio,
    product.price_stats_category,
    product.price_stats_brand,
    product.price_tiers,
    product.price_tiers_category,
    product.discount_by_price_tier,
    product.model_year_catalog,
    product.model_year_sales,
    product.model_year_category,
    product.model_year_discount,
    product.model_year_stock,
)
OPERATIONS_REPORTS = (
    operations.status_breakdown,
    operations.status_by_store,
    operations.status_by_month,
    operations.fulfilment_overall,
    operations.lateness_overall,
    operations.fulfilment_by_store,
    operations.fulfilment_by_staff,
    operations.fulfilment_buckets,
    operations.fulfilment_by_month,
)
STAFF_REPORTS = (
    staff.staff_sales,
    staff.staff_hierarchy,
    staff.team_revenue,
    staff.staff_rank_in_store,
    staff.store_comparison,
    staff.store_fulfilment,
    staff.store_scorecard,
    staff.revenue_per_active_staff,
)
CUSTOMER_REPORTS = (
    customer.order_frequency,
    customer.onetime_vs_repeat,
    customer.frequency_bands,
    customer.segment_revenue,
    customer.customers_by_state,
    customer.revenue_by_state,
    customer.top_cities,
    customer.customer_vs_store_state,
    customer.clv_top,
    customer.clv_tiers,
    customer.customer_span,
    customer.clv_top_with_state,
)
SALES_REPORTS = (
    sales.monthly_revenue,
    sales.yearly_growth,
    sales.quarterly_revenue,
    sales.seasonality,
    sales.cumulative_revenue,
    sales.revenue_by_store,
    sales.revenue_by_staff,
    sales.revenue_by_category,
    sales.revenue_by_brand,
    sales.store_category,
    sales.discount_tiers,
    sales.discount_vs_quantity,
    sales.discounted_flag,
    sales.discount_tiers_category,
    sales.aov_overall,
    sales.aov_by_store,
    sales.aov_by_customer,
    sales.aov_buckets,
    sales.aov_by_month,
)

REPORTS: dict[str, Callable[..., DataFrame]] = {
    report.__name__: report
    for report in (
        PRODUCT_REPORTS + OPERATIONS_REPORTS + STAFF_REPORTS + CUSTOMER_REPORTS + SALES_REPORTS
    )
}


def run(name: str, t: RetailTables, **params) -> DataFrame:
    """The report called ``name`` over ``t``."""
    return REPORTS[name](t, **params)
