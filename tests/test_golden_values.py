"""Edges of the hand-written fixture, with values worked out by hand."""

import pytest

from tallyshop.plans import REPORTS, product, staff


def rows(df, *columns):
    return [tuple(r) for r in (df.select(*columns) if columns else df).collect()]


def test_lifetime_value_on_tier_edges(golden):
    # 500, 1500, 3000 and 6000 open a tier; orders without a customer are one row.
    assert rows(REPORTS["clv_tiers"](golden)) == [
        ("1. Under $500", 2, 509.99, 4.2),
        ("2. $500-$1499", 2, 1124.8, 9.27),
        ("3. $1500-$2999", 1, 1500.0, 12.36),
        ("4. $3000-$5999", 1, 3000.0, 24.72),
        ("5. $6000+", 1, 6000.0, 49.44),
    ]


def test_segments_count_a_missing_customer_but_not_in_the_base(golden):
    assert sorted(rows(REPORTS["onetime_vs_repeat"](golden))) == [
        ("1. One-time customer", 3, 42.86),
        ("2. Repeat customer", 5, 71.43),
    ]


def test_segment_revenue_leaves_out_unowned_and_rejected_orders(golden):
    assert sorted(rows(REPORTS["segment_revenue"](golden))) == [
        ("1. One-time customer", 2, 500.0, 250.0),
        ("2. Repeat customer", 5, 11009.99, 2202.0),
    ]


def test_frequency_bands(golden):
    assert [r[1] for r in rows(REPORTS["frequency_bands"](golden))] == [3, 2, 2, 1]


def test_customers_without_orders_are_kept(golden):
    counts = dict(rows(REPORTS["order_frequency"](golden), "customer_id", "num_orders"))
    assert counts == {1: 0, 2: 1, 3: 2, 4: 3, 5: 4, 6: 5, 7: 1, 8: 2, 9: 0}


def test_fulfilment_buckets_put_early_dates_last(golden):
    assert rows(REPORTS["fulfilment_buckets"](golden)) == [
        ("0. Same day", 2, 25.0),
        ("1. Next day", 1, 12.5),
        ("2. 2-3 days", 2, 25.0),
        ("3. 4+ days", 3, 37.5),
    ]


def test_shipping_on_the_promised_day_is_not_late(golden):
    # Late: orders 6 and 17 of the 8 shipped ones.
    assert rows(REPORTS["lateness_overall"](golden), "num_late_orders", "pct_late") == [(2, 25.0)]


def test_unknown_and_missing_status(golden):
    labels = {r[0]: r[1] for r in rows(REPORTS["status_breakdown"](golden))}
    assert labels[9] == labels[None] == "Unknown"


def test_staff_ranks_share_a_place_on_ties(golden):
    north = [
        (r[1], r[4], r[5])
        for r in rows(REPORTS["staff_rank_in_store"](golden))
        if r[0] == "North"
    ]
    assert north == [
        (1, 7699.99, 1),
        (5, 1500.0, 2),
        (6, 1500.0, 2),
        (3, 1434.8, 4),
        (4, 0.0, 5),
    ]


def test_staff_without_orders_have_null_revenue(golden):
    sales = {r[0]: r[4:] for r in rows(REPORTS["staff_sales"](golden))}
    assert sales[4] == (0, None, None)
    # Order 15 has no lines: it counts as an order and lowers the order value.
    assert sales[1][0] == 11


def test_team_revenue_is_that_of_direct_reports(golden):
    assert rows(REPORTS["team_revenue"](golden)) == [
        (1, "Staff1", "Name1", 3, 2934.8),
        (2, "Staff2", "Name2", 2, 1500.0),
    ]


def test_top_of_the_organisation_comes_first(golden):
    hierarchy = rows(REPORTS["staff_hierarchy"](golden), "staff_id", "manager_first_name")
    assert hierarchy[0] == (1, None)
    assert [r[0] for r in hierarchy] == [1, 2, 3, 6, 4, 5]


def test_stores_without_staff_or_orders_are_kept(golden):
    cards = {r[0]: r for r in rows(REPORTS["store_scorecard"](golden))}
    assert cards[2] == (2, "South", 1, None, 0, None)
    assert cards[3] == (3, "West", 0, None, 0, None)
    per_head = {r[0]: r[4] for r in rows(REPORTS["revenue_per_active_staff"](golden))}
    assert per_head[3] is None


def test_scorecard_days_by_line_and_by_order(golden):
    # Days of shipped valid orders: 0, 1, 2, 3, 4, -1, 0 with a line each, and 10 with seven.
    by_line = {r[0]: r[5] for r in rows(staff.store_scorecard(golden))}
    by_order = {r[0]: r[5] for r in rows(staff.store_scorecard(golden, per_order=True))}
    assert by_line[1] == pytest.approx(5.64)  # 79 / 14
    assert by_order[1] == pytest.approx(2.38)  # 19 / 8


def test_medians_of_even_odd_and_null_groups(golden):
    stats = {(r[0], r[1]): r[2:] for r in rows(REPORTS["price_stats_category"](golden))}
    assert stats[("Road", 4)] == (499.99, 1000.0, 750.0, 750.0)
    # A null price ranks first, so the middle of three is the lower real price.
    assert stats[("Town", 3)] == (2000.0, 3000.0, 2500.0, 2000.0)
    # The other Road has another median and stays a row of its own; 1.005 rounds up.
    assert stats[("Road", 2)] == (1.0, 1.01, 1.01, 1.01)


def test_price_tiers_on_edges(golden):
    assert [r[:2] for r in rows(REPORTS["price_tiers"](golden))] == [
        ("1. Under $500", 3),
        ("2. $500-$999", 2),
        ("3. $1000-$1999", 1),
        ("4. $2000-$2999", 1),
        ("5. $3000+", 3),  # 3000, 3000.01 and the missing price
    ]


def test_discount_tiers_on_edges(golden):
    counts = [r[1] for r in rows(REPORTS["discount_tiers"](golden))]
    # 16 undiscounted lines of valid orders, then 0.05 | 0.051, 0.10 | 0.15 | 0.20 | 0.201.
    assert counts == [16, 1, 2, 1, 1, 1]


def test_never_sold(golden):
    assert [r[0] for r in rows(product.never_sold(golden))] == [9, 8, 7]
    # Since 2017 only products 1, 2, 3, 4 and 5 were on an order.
    assert [r[0] for r in rows(product.never_sold(golden, since="2017-01-01"))] == [6, 9, 8, 7]


def test_overstock_multiplies_unless_told_otherwise(golden):
    assert [r[0:1] + r[4:] for r in rows(product.overstock_ratio(golden))] == [
        (1, 10, 48, 4.8),
        (8, 0, 30, None),
    ]
    assert [r[0:1] + r[4:] for r in rows(product.overstock_ratio(golden, true_totals=True))] == [
        (1, 5, 12, 2.4),
        (8, 0, 30, None),
    ]
    first = rows(product.overstock_ratio(golden, n=1, unsold_first=True))
    assert first[0][0] == 8


def test_best_sellers_count_rejected_orders(golden):
    top = rows(product.best_sellers(golden, n=3))
    # Product 6 has 7 lines of one order; product 5 sold 2 units and 4 on the rejected
    # order; 1 and 2 tie on 5 units, and the lower key is listed.
    assert [(r[0], r[4], r[6]) for r in top] == [(6, 7, 1), (5, 6, 2), (1, 5, 4)]


def test_yearly_growth(golden):
    growth = rows(REPORTS["yearly_growth"](golden))
    # 2016: 500 + 700 + 800 + 750 + 499.99 + 624.8 + 10; 2017: 750 + 1500 + 6000.
    assert growth == [(2016, 3884.79, None), (2017, 8250.0, 112.37)]
