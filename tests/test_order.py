"""Row order of the reports. The oracle tests sort both sides, so order is checked here."""

import pytest

from tallyshop import read_tables
from tallyshop.plans import REPORTS

# What each report is sorted by; ``-`` is descending. Nulls come first ascending, last descending.
ORDER = {
    "best_sellers": "-units_sold",
    "slow_movers": "units_sold",
    "never_sold": "-list_price",
    "sales_quartile": "-units_sold",
    "category_sales": "-total_units_sold",
    "brand_sales": "-total_units_sold",
    "overstock_ratio": "-stock_to_sales_ratio",
    "price_stats_category": "-avg_price",
    "price_stats_brand": "-avg_price",
    "price_tiers": "price_tier",
    "price_tiers_category": "category_name price_tier",
    "discount_by_price_tier": "price_tier",
    "model_year_catalog": "model_year",
    "model_year_sales": "model_year",
    "model_year_category": "model_year -units_sold",
    "model_year_discount": "model_year",
    "model_year_stock": "model_year",
    "status_breakdown": "order_status",
    "status_by_store": "-rejection_rate_pct",
    "status_by_month": "order_month",
    "fulfilment_by_store": "-pct_late",
    "fulfilment_by_staff": "-pct_late",
    "fulfilment_buckets": "fulfillment_bucket",
    "fulfilment_by_month": "order_month",
    "staff_sales": "-total_revenue",
    "team_revenue": "-team_total_revenue",
    "staff_rank_in_store": "store_name rank_within_store",
    "store_comparison": "-total_revenue",
    "store_fulfilment": "avg_days_to_ship",
    "store_scorecard": "-total_revenue",
    "revenue_per_active_staff": "-revenue_per_active_staff",
    "order_frequency": "-num_orders",
    "frequency_bands": "frequency_band",
    "customers_by_state": "-num_customers",
    "revenue_by_state": "-total_revenue",
    "top_cities": "-num_customers",
    "customer_vs_store_state": "customer_state -num_orders",
    "clv_top": "-lifetime_value",
    "clv_tiers": "clv_tier",
    "customer_span": "-customer_span_days",
    "clv_top_with_state": "-lifetime_value",
    "monthly_revenue": "order_month",
    "yearly_growth": "order_year",
    "quarterly_revenue": "order_year order_quarter",
    "seasonality": "calendar_month",
    "cumulative_revenue": "order_month",
    "revenue_by_store": "-net_revenue",
    "revenue_by_staff": "-net_revenue",
    "revenue_by_category": "-net_revenue",
    "revenue_by_brand": "-net_revenue",
    "store_category": "store_name -net_revenue",
    "discount_tiers": "discount_tier",
    "discount_vs_quantity": "-avg_discount_pct",
    "discount_tiers_category": "category_name discount_tier",
    "aov_by_store": "-avg_order_value",
    "aov_by_customer": "-avg_order_value",
    "aov_buckets": "aov_bucket",
    "aov_by_month": "order_month",
}
# Reports of one row, or whose order is not given.
UNORDERED = {
    "fulfilment_overall", "lateness_overall", "onetime_vs_repeat", "segment_revenue", "discounted_flag", "aov_overall",
}
FEW_ROWS = {"never_sold"}


def before(a, b, columns):
    """Whether row ``a`` may come before row ``b``."""
    for column in columns:
        down, column = column.startswith("-"), column.removeprefix("-")
        x, y = a[column], b[column]
        if x == y:
            continue
        if x is None or y is None:
            return (x is None) != down
        return (x > y) == down
    return True


def test_every_report_is_listed():
    assert set(ORDER) | UNORDERED | {"staff_hierarchy"} == set(REPORTS)


@pytest.mark.parametrize("name", sorted(ORDER))
def test_rows_come_in_order(spark, random_dir, golden_dir, name):
    # in the random tables all customers are of one tier
    folder = golden_dir if name == "clv_tiers" else random_dir
    rows = REPORTS[name](read_tables(spark, folder)).collect()
    assert len(rows) > 1 or name in FEW_ROWS
    for a, b in zip(rows[:-1], rows[1:]):
        assert before(a, b, ORDER[name].split())


def test_staff_without_a_manager_come_first(spark, random_dir):
    rows = REPORTS["staff_hierarchy"](read_tables(spark, random_dir)).collect()
    keys = [(r.manager_id is not None, r.manager_id or 0, r.staff_id) for r in rows]
    assert keys == sorted(keys) and not keys[0][0] and keys[-1][0]


def test_the_check_sees_a_wrong_order():
    rows = [{"a": None, "b": 1}, {"a": 1, "b": 3}, {"a": 1, "b": 2}]
    assert before(rows[0], rows[1], ["a"]) and not before(rows[0], rows[1], ["-a"])
    assert before(rows[1], rows[2], ["a", "-b"]) and not before(rows[1], rows[2], ["a", "b"])
