"""What the plans of the reports do at scale: shuffles, scans, pushdown, skew."""

import re

import pytest
from pyspark.sql import functions as F

from tallyshop import catalogue, read_tables
from tallyshop.plans import REPORTS

# With broadcasting off, small test tables are planned the way large ones are.
AS_IF_LARGE = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
}
REPORTS_AND_OPERATORS = {**REPORTS, **catalogue.VARIANTS, **catalogue.OPERATORS}


@pytest.fixture
def conf(spark):
    changed = {}

    def set_all(settings):
        for key, value in settings.items():
            changed.setdefault(key, spark.conf.get(key, None))
            spark.conf.set(key, value)

    yield set_all
    for key, value in changed.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def as_run(plan):
    """The final part of an adaptive plan, and of those of its subqueries."""
    lines, skipped = [], None
    for line in plan.split("\n"):
        depth = len(line) - len(line.lstrip(" :+-|"))
        if skipped is not None and (depth >= skipped or not line.strip(" :+-|")):
            continue
        skipped = depth if "== Initial Plan ==" in line else None
        if skipped is None:
            lines.append(line)
    return "\n".join(lines)


def executed(df):
    """The plan as it ran, subqueries included."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.sub(r"#\d+L?", "", as_run(plan))


def scans(plan, column):
    """Scans of the table whose columns begin with ``column``."""
    return count(rf"FileScan parquet \[{column}", plan)


def count(pattern, plan):
    return len(re.findall(pattern, plan))


def above_scan(plan, column):
    """What is done to the rows of the one scan that reads ``column``, nearest first."""
    lines = plan.split("\n")
    [at] = [i for i, x in enumerate(lines) if re.search(rf"FileScan parquet \[[^\]]*\b{column}\b", x)]
    depth, above = len(lines[at]), []
    for line in reversed(lines[: at + 1]):
        own = len(line) - len(line.lstrip(" :+-|"))
        if own < depth:
            depth = own
            above.append(line)
    return above


@pytest.mark.parametrize("name", sorted(REPORTS_AND_OPERATORS))
def test_no_cross_joins_and_no_python(golden, conf, name):
    conf(AS_IF_LARGE)
    plan = executed(REPORTS_AND_OPERATORS[name](golden))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Pandas"):
        assert operator not in plan


PER_ORDER = (
    "monthly_revenue",
    "yearly_growth",
    "quarterly_revenue",
    "seasonality",
    "cumulative_revenue",
    "revenue_by_store",
    "revenue_by_staff",
    "aov_overall",
    "aov_by_store",
    "aov_by_month",
    "aov_by_customer",
    "aov_buckets",
    "clv_top",
    "clv_tiers",
    "customer_span",
    "revenue_by_state",
    "top_cities",
    "segment_revenue",
    "staff_sales",
    "team_revenue",
    "store_comparison",
    "store_scorecard",
    "revenue_per_active_staff",
)


@pytest.mark.parametrize("name", PER_ORDER)
def test_order_reports_scan_lines_once_and_add_them_up_before_the_shuffle(golden, conf, name):
    conf(AS_IF_LARGE)
    plan = executed(REPORTS[name](golden))
    assert count(r"FileScan parquet [^\n]*order_items", plan) == 1
    assert count(r"FileScan parquet [^\n]*/orders", plan) == 1
    # Orders and line totals meet on the order: two exchanges, and no third one of lines.
    assert count(r"Exchange hashpartitioning\(order_id", plan) == 2
    lines = plan[: plan.index("order_items")]
    shuffle = lines.rindex("Exchange hashpartitioning(order_id")
    assert "partial_sum" in lines[shuffle:]


@pytest.mark.parametrize(
    "name", ["category_sales", "brand_sales", "model_year_sales", "slow_movers", "overstock_ratio"]
)
def test_product_reports_shuffle_one_row_per_product(golden, conf, name):
    conf(AS_IF_LARGE)
    plan = executed(REPORTS[name](golden))
    lines = plan[: plan.index("order_items")]
    shuffle = lines.rindex("Exchange hashpartitioning(product_id")
    assert "HashAggregate(keys=[product_id], functions=[partial" in lines[shuffle:]
    assert "order_id" not in lines


def test_best_sellers_do_not_shuffle_all_products_and_orders(golden, conf):
    conf(AS_IF_LARGE)
    plan = executed(REPORTS["best_sellers"](golden))
    # The second scan keeps the lines of listed products and fills bitmaps of their orders, all
    # before its only shuffle; no pair of product and order is shuffled.
    above = [x for x in above_scan(plan, "order_id,product_id") if re.search("Exchange|Join|bitmap_construct", x)]
    assert "BroadcastHashJoin [product_id]" in above[0] and "partial_bitmap_construct_agg" in above[1]
    assert "TakeOrderedAndProject" in plan
    assert not re.search(r"Exchange hashpartitioning\([^)]*order_id", plan)


def test_distinct_orders_per_category_use_the_partitioning_by_order(golden, conf):
    conf({**AS_IF_LARGE, "spark.sql.adaptive.enabled": "false"})
    df = REPORTS["revenue_by_category"](golden)
    plan = re.sub(r"#\d+L?", "", df._jdf.queryExecution().executedPlan().toString())
    assert "Exchange hashpartitioning(category_name, order_id" not in plan


def test_line_level_lookup_is_broadcast_only_within_the_limit(golden, conf):
    small = executed(REPORTS["revenue_by_category"](golden))
    assert "BroadcastHashJoin [product_id]" in small
    conf(AS_IF_LARGE)
    assert "SortMergeJoin [product_id]" in executed(REPORTS["revenue_by_category"](golden))


def test_filters_and_columns_reach_the_scan(golden):
    plan = executed(REPORTS["monthly_revenue"](golden))
    orders = next(x for x in plan.split("\n") if "FileScan" in x and "/orders" in x)
    assert "Not(EqualTo(order_status,3))" in orders
    assert re.search(r"FileScan parquet \[order_id,order_status,order_date\]", orders)
    lines = next(x for x in plan.split("\n") if "FileScan" in x and "order_items" in x)
    assert re.search(r"FileScan parquet \[order_id,quantity,list_price,discount\]", lines)


@pytest.mark.parametrize("name", ["best_sellers", "slow_movers", "clv_top", "top_cities"])
def test_top_n_is_not_a_full_sort(golden, name):
    plan = executed(REPORTS[name](golden))
    assert "TakeOrderedAndProject" in plan


def test_never_sold_makes_keys_distinct_before_the_anti_join(golden, conf):
    conf(AS_IF_LARGE)
    plan = executed(REPORTS["never_sold"](golden))
    lines = plan[: plan.index("order_items")]
    assert "HashAggregate(keys=[product_id]" in lines[lines.rindex("Exchange hashpartitioning") :]


@pytest.mark.parametrize("name", ["sales_quartile", "customer_value_deciles", "staff_rank_in_store"])
def test_buckets_and_ranks_do_not_gather_rows(golden, conf, name):
    conf(AS_IF_LARGE)
    df = REPORTS_AND_OPERATORS[name](golden)
    plan = executed(df)
    # What reaches a single task is one row per partition, counted before.
    for single in re.finditer("Exchange SinglePartition", plan):
        assert "HashAggregate(keys=[_part]" in plan[single.start() : single.start() + 600]
    # Windows over rows stay inside a range partition, even for the rank in a store.
    for exchange in re.findall(r"Exchange hashpartitioning\(store_id[^)]*\)", plan):
        assert "HashAggregate(keys=[store_id" in plan[plan.index(exchange) :][:400]


def test_a_rank_reads_its_checkpoint_twice_and_shuffles_it_once(spark, conf):
    conf(AS_IF_LARGE)
    from tallyshop.operators import rank_within

    df = spark.range(500).selectExpr("id", "id % 3 AS g", "id % 7 AS v")
    plan = executed(rank_within(df, ["g"], "v", ["id"]))
    assert count("Scan ExistingRDD", plan) <= 2
    assert count("Exchange hashpartitioning", plan) <= 2
    # Windows without a partition see one row per range partition.
    for single in re.finditer("Exchange SinglePartition", plan):
        assert "keys=[_part]" in plan[single.start() : single.start() + 900]


def test_a_median_needs_no_sort_and_no_checkpoint(spark, star_dir, golden, conf):
    from tallyshop import load_retail
    from tallyshop.operators import group_median

    plan = executed(group_median(golden.products, ["category_id"], "list_price"))
    assert "ExistingRDD" not in plan and "rangepartitioning" not in plan and "Window" not in plan
    # one shuffle per pass, of counts that were added up before it
    assert count("Exchange hashpartitioning", plan) == 2
    assert count(r"partial_percentile", plan) == 2
    plan = executed(catalogue.OPERATORS["median_order_units_by_store"](load_retail(spark, star_dir)))
    # lines by order, suppliers by key, and the two passes
    assert count("Exchange hashpartitioning", plan) <= 4
    assert "ExistingRDD" not in plan
    assert scans(plan, "l_") == 1


def test_price_stats_count_products_once(golden):
    plan = executed(REPORTS["price_stats_category"](golden))
    assert scans(plan, "category_id,list_price") == 1


def test_constraints_read_each_fact_table_once(spark, star_dir, golden, conf):
    from tallyshop import load_retail

    plan = executed(catalogue.OPERATORS["validate"](load_retail(spark, star_dir)))
    assert scans(plan, "l_") == 1 and scans(plan, "o_") == 1 and scans(plan, "c_") == 1
    # products, their kinds, brands and stock; staff, sellers and the number of sellers
    assert scans(plan, "p_") <= 4 and scans(plan, "s_") <= 3
    plan = executed(catalogue.OPERATORS["validate"](golden))
    assert count("FileScan parquet", plan) == 9
    assert count(r"Exchange hashpartitioning\(domain, key0, key1", plan) == 1


def test_child_rows_are_picked_before_any_shuffle_on_the_reference(golden, conf):
    from tallyshop.operators import fk_violations

    conf(AS_IF_LARGE)
    df = fk_violations(golden.orders, "staff_id", golden.staffs.where("active = 1"), "staff_id")
    plan = executed(df)
    assert df.count() > 0
    above = above_scan(plan, "order_date")
    met = [x for x in above if "Exchange hashpartitioning" in x or "BroadcastHashJoin [_bucket]" in x]
    assert "BroadcastHashJoin" in met[0]


@pytest.mark.parametrize("name", ["lateness_overall", "status_by_month", "aov_by_month"])
def test_sellers_are_joined_only_where_they_are_wanted(spark, star_dir, name):
    from tallyshop import load_retail

    plan = executed(REPORTS[name](load_retail(spark, star_dir)))
    assert scans(plan, "o_") == 1 and scans(plan, "s_") == 0


@pytest.mark.parametrize("name", ["discount_tiers", "discounted_flag"])
def test_discount_classes_shuffle_one_row_per_order(golden, conf, name):
    conf(AS_IF_LARGE)
    plan = executed(REPORTS[name](golden))
    assert scans(plan, "order_id,quantity") == 1
    assert count(r"Exchange hashpartitioning\(order_id", plan) == 2
    above = above_scan(plan, "discount")
    met = [x for x in above if "Exchange" in x or "HashAggregate(keys=[order_id]" in x]
    assert "functions=[partial_sum" in met[0]


@pytest.mark.parametrize("name", ["store_category", "discount_tiers_category"])
def test_the_catalogue_is_joined_to_sums_of_products(golden, conf, name):
    conf(AS_IF_LARGE)
    plan = executed(REPORTS[name](golden))
    above = above_scan(plan, "discount")
    met = [x for x in above if "Join [product_id]" in x or "product_id" in x and "functions=[partial" in x]
    assert "HashAggregate" in met[0] and any("Join [product_id]" in x for x in met)


def test_hot_partitions_of_line_joins_are_split(spark, conf, tmp_path):
    # Half of all lines belong to one order.
    from tests.fixtures import _save, random_tables

    tables = random_tables(3, n_orders=3000)
    tables["order_items"] = [
        (1 if i % 2 else row[0], *row[1:]) for i, row in enumerate(tables["order_items"])
    ]
    t = read_tables(spark, _save(str(tmp_path), tables))
    t = t.replace(order_items=t.order_items.repartition(8))
    expected = REPORTS["revenue_by_category"](t).collect()
    conf(
        {
            **AS_IF_LARGE,
            "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
            "spark.sql.adaptive.coalescePartitions.enabled": "false",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        }
    )
    for name in ("revenue_by_category", "store_category"):
        df = REPORTS[name](t)
        plan = executed(df)
        assert "SortMergeJoin(skew=true) [order_id]" in plan
    assert REPORTS["revenue_by_category"](t).collect() == expected


def test_line_joins_scan_each_fact_table_once(golden, conf):
    conf(AS_IF_LARGE)
    for name in ("revenue_by_category", "revenue_by_brand", "store_category"):
        plan = executed(REPORTS[name](golden))
        for table in ("order_items", "orders"):
            scans = [x for x in plan.split("\n") if "FileScan" in x and f"/{table}]" in x]
            assert len(scans) <= 1


def test_best_sellers_use_their_list_once(golden, conf):
    conf(AS_IF_LARGE)
    plan = executed(REPORTS["best_sellers"](golden))
    assert sum("FileScan" in x and "order_items" in x for x in plan.split("\n")) <= 2


def test_a_hot_order_is_one_row_per_task_before_the_join(spark, conf, tmp_path):
    from tests.fixtures import _save, random_tables

    tables = random_tables(5, hot=True)
    t = read_tables(spark, _save(str(tmp_path), tables))
    conf(AS_IF_LARGE)
    from tallyshop.operators import item_totals

    totals = item_totals(t)
    assert totals.where(F.col("order_id") == 1).count() == 1
    assert totals.agg(F.sum("n_lines")).collect()[0][0] == t.order_items.count()
