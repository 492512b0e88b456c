"""DuckDB SQL that computes every registered query from the driver's tables.

Each text states a report's meaning directly (joined rows, distinct counts,
plain windows), without the rewrites the Spark side uses, so that agreement
says something about those rewrites. Column names and types match the reports.
"""

from __future__ import annotations

from collections.abc import Sequence

from tallyshop.schema import PRIMARY_KEYS, REFERENCES, REQUIRED, SCHEMAS

# Codes, bounds and labels of the reports, stated here apart from the reports.
STATUSES = {"pending": 1, "processing": 2, "rejected": 3, "completed": 4}
PRICE_BOUNDS = (500, 1000, 2000, 3000)
PRICE_TIERS = ("1. Under $500", "2. $500-$999", "3. $1000-$1999", "4. $2000-$2999", "5. $3000+")
CLV_BOUNDS = (500, 1500, 3000, 6000)
CLV_TIERS = ("1. Under $500", "2. $500-$1499", "3. $1500-$2999", "4. $3000-$5999", "5. $6000+")
AOV_BOUNDS = (1000, 2500, 5000, 10000)
AOV_BUCKETS = (
    "1. Under $1000", "2. $1000-$2499", "3. $2500-$4999", "4. $5000-$9999", "5. $10000+",
)
DISCOUNT_BOUNDS = ("0.05", "0.10", "0.15", "0.20")
DISCOUNT_TIERS = (
    "1. No discount (0%)", "2. 1-5%", "3. 6-10%", "4. 11-15%", "5. 16-20%", "6. 20%+",
)
WIDE_DISCOUNT_BOUNDS = ("0.10", "0.20")
WIDE_DISCOUNT_TIERS = ("1. No discount (0%)", "2. 1-10%", "3. 11-20%", "4. 20%+")

# The retail model over the driver's star: one ``m_`` relation per table.
STAR = """
geo AS (
  SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey
), kinds AS (
  SELECT p_type, CAST(row_number() OVER (ORDER BY p_type) AS INTEGER) AS kind_id
  FROM (SELECT DISTINCT p_type FROM part)
), m_brands AS (
  SELECT DISTINCT CAST(substr(p_brand, 7) AS INTEGER) AS brand_id, p_brand AS brand_name FROM part
), m_categories AS (
  SELECT kind_id AS category_id, p_type AS category_name FROM kinds
), m_stores AS (
  SELECT n_nationkey AS store_id, n_name AS store_name, n_name AS city, r_name AS state FROM geo
), m_customers AS (
  SELECT c_custkey AS customer_id, 'Customer' AS first_name, substr(c_name, 10) AS last_name,
    n_name AS city, r_name AS state
  FROM customer JOIN geo ON c_nationkey = n_nationkey
), m_staffs AS (
  SELECT s_suppkey AS staff_id, 'Supplier' AS first_name, substr(s_name, 10) AS last_name,
    CAST(s_acctbal >= 0 AS INTEGER) AS active, s_nationkey AS store_id,
    CASE WHEN s_suppkey <> 0 THEN (s_suppkey - 1) // 4 END AS manager_id
  FROM supplier
), m_products AS (
  SELECT p_partkey AS product_id, p_name AS product_name,
    CAST(substr(p_brand, 7) AS INTEGER) AS brand_id, kind_id AS category_id,
    CAST(2016 + p_size % 4 AS INTEGER) AS model_year,
    CAST(CAST(p_retailprice AS DECIMAL(12,2)) * p_size * 0.1 AS DECIMAL(12,2)) AS list_price
  FROM part JOIN kinds USING (p_type)
), m_stocks AS (
  SELECT n_nationkey AS store_id, p_partkey AS product_id,
    CAST((p_partkey * 7 + n_nationkey * 13) % 31 AS INTEGER) AS quantity
  FROM part, nation WHERE (p_partkey + n_nationkey) % 5 = 0 AND p_partkey % 40 <> 0
), placed AS (
  SELECT o_orderkey AS order_id, o_custkey AS customer_id,
    CASE WHEN o_orderkey % 20 = 0 THEN 3 WHEN o_orderstatus = 'P' THEN 1
      WHEN o_orderstatus = 'O' THEN 2 WHEN o_orderstatus = 'F' THEN 4 END AS order_status,
    CAST(o_orderdate AS DATE) AS order_date,
    CAST(o_orderdate AS DATE) + CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS required_date,
    s_nationkey AS store_id, o_orderkey % (SELECT max(s_suppkey) + 1 FROM supplier) AS staff_id
  FROM orders LEFT JOIN supplier ON s_suppkey = o_orderkey % (SELECT max(s_suppkey) + 1 FROM supplier)
), m_orders AS (
  SELECT *, CASE WHEN order_status = 4
    THEN order_date + CAST(order_id % 7 AS INTEGER) END AS shipped_date
  FROM placed
), m_items AS (
  SELECT l_orderkey AS order_id, l_linenumber AS item_id, l_partkey AS product_id,
    CAST(1 + CAST(l_quantity AS INTEGER) % 3 AS INTEGER) AS quantity,
    CAST((CAST(round(l_extendedprice * 100) AS BIGINT) // CAST(l_quantity AS BIGINT)) // 10 * 0.01
      AS DECIMAL(12,2)) AS list_price,
    CAST(CAST(l_discount AS DECIMAL(4,2)) * 2.5 AS DECIMAL(5,3)) AS discount
  FROM lineitem
)"""

# Joined relations the reports read; they need only the ``m_`` relations.
JOINED = """
line AS (
  SELECT *, quantity * list_price * (1 - discount) AS nr FROM m_items
), ok AS (
  SELECT * FROM m_orders WHERE order_status <> 3
), sold AS (
  SELECT ok.*, product_id, quantity, list_price, discount, nr FROM ok JOIN line USING (order_id)
), shipped AS (
  SELECT *, date_diff('day', order_date, shipped_date) AS took,
    date_diff('day', required_date, shipped_date) AS over
  FROM m_orders WHERE order_status = 4 AND shipped_date IS NOT NULL
), branded AS (
  SELECT product_id, brand_name FROM m_products JOIN m_brands USING (brand_id)
), typed AS (
  SELECT product_id, category_name FROM m_products JOIN m_categories USING (category_id)
), named AS (
  SELECT * FROM m_products JOIN m_brands USING (brand_id) JOIN m_categories USING (category_id)
)
"""

MODEL = f"WITH {STAR}, {JOINED}"


def _r2(x: str) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(38,10)), 2) AS DOUBLE)"


def _div(num: str, den: str) -> str:
    return f"CAST({num} AS DOUBLE) / nullif(CAST({den} AS DOUBLE), 0)"


def _avg(x: str) -> str:
    return _div(f"sum({x})", f"count({x})")


def _pct(part: str, whole: str) -> str:
    return _r2(f"CAST({part} AS DOUBLE) * 100.0 / nullif(CAST({whole} AS DOUBLE), 0)")


def _n(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


def _lt(x: str, bounds: Sequence, labels: Sequence[str]) -> str:
    arms = " ".join(f"WHEN {x} < {b} THEN '{name}'" for b, name in zip(bounds, labels))
    return f"CASE {arms} ELSE '{labels[-1]}' END"


def _le(x: str, bounds: Sequence, labels: Sequence[str]) -> str:
    arms, lower = f"WHEN {x} = 0 THEN '{labels[0]}'", 0
    for b, name in zip(bounds, labels[1:]):
        arms += f" WHEN {x} > {lower} AND {x} <= {b} THEN '{name}'"
        lower = b
    return f"CASE {arms} ELSE '{labels[-1]}' END"


_ORDERS = "count(DISTINCT order_id) AS num_orders"
_UNITS = f"{_n('sum(quantity)')} AS units_sold"
_NET = f"{_r2('sum(nr)')} AS net_revenue"
_TOTAL = f"{_r2('sum(nr)')} AS total_revenue"
_AOV = f"{_r2(_div('sum(nr)', 'count(DISTINCT order_id)'))} AS avg_order_value"
_DISC = f"{_r2('(' + _avg('discount') + ') * 100')} AS avg_discount_pct"
_AVG_QTY = f"{_r2(_avg('quantity'))} AS avg_quantity_per_line_item"
_MONTH = "strftime(order_date, '%Y-%m') AS order_month"
_NAMES = "product_id, product_name, brand_name, category_name"
_PRICE_TIER = _lt("list_price", PRICE_BOUNDS, PRICE_TIERS) + " AS price_tier"
_DAYS = f"{_r2(_avg('took'))} AS avg_days_to_ship"
_EARLY = f"{_r2(_avg('over'))} AS avg_days_early_or_late"
# A sum, unlike a count, is null over no rows at all.
_NUM_LATE = "sum(if(shipped_date > required_date, 1, 0))"
_LATE = f"{_n(_NUM_LATE)} AS num_late_orders, {_pct(_NUM_LATE, 'count(*)')} AS pct_late"
_DONE = "count(*) AS num_completed_orders"
_PIVOT = ", ".join(
    f"count(*) FILTER (order_status = {code}) AS {name}"
    for name, code in STATUSES.items()
)
_REJECTION = _pct("count(*) FILTER (order_status = 3)", "count(*)") + " AS rejection_rate_pct"
_ACTIVE = "(SELECT count(*) FROM m_staffs f WHERE f.store_id = s.store_id AND f.active = 1)"
_ALL_LINES = "line JOIN named USING (product_id)"


def _overstock(units: str, stock: str, source: str, nulls: str = "LAST") -> str:
    return f"""
SELECT {_NAMES}, {_n(f"coalesce({units}, 0)")} AS units_sold,
  {_n(stock)} AS total_stock_on_hand, {_r2(_div(stock, units))} AS stock_to_sales_ratio
FROM {source} HAVING {stock} > 0
ORDER BY stock_to_sales_ratio DESC NULLS {nulls}, product_id LIMIT 15"""


_FAN_OUT = (
    "named LEFT JOIN (SELECT product_id, quantity AS sold_qty FROM line) USING (product_id) "
    "LEFT JOIN (SELECT product_id, quantity AS held_qty FROM m_stocks) USING (product_id) "
    f"GROUP BY {_NAMES}"
)
_NO_FAN_OUT = (
    "named LEFT JOIN (SELECT product_id, sum(quantity) AS u FROM line GROUP BY 1) "
    "USING (product_id) LEFT JOIN (SELECT product_id, sum(quantity) AS h FROM m_stocks GROUP BY 1) "
    f"USING (product_id) GROUP BY {_NAMES}"
)


def _median(table: str, key: str, value: str) -> str:
    """Median of ``value`` per ``key``: the mean of what has a value at the two middle places of
    the sorted list of all values, nulls first (one place, twice, if their number is odd)."""
    middle = "[v[len(v) // 2 + len(v) % 2], v[len(v) // 2 + 1]]"
    return f"""(
  SELECT {key}, list_avg({middle}) AS median
  FROM (SELECT {key}, list({value} ORDER BY {value} NULLS FIRST) AS v FROM {table} GROUP BY {key})
)"""


REPORT_SQL: dict[str, str] = {
    # --- product and inventory ---
    "best_sellers": f"""
SELECT {_NAMES}, {_UNITS}, {_NET}, {_ORDERS} FROM {_ALL_LINES}
GROUP BY {_NAMES} ORDER BY units_sold DESC, product_id LIMIT 10""",
    "slow_movers": f"""
SELECT {_NAMES}, {_UNITS}, {_NET} FROM {_ALL_LINES}
GROUP BY {_NAMES} ORDER BY units_sold NULLS FIRST, product_id LIMIT 10""",
    "never_sold": f"""
SELECT {_NAMES}, {_r2("named.list_price")} AS list_price
FROM named WHERE NOT EXISTS (SELECT 1 FROM line WHERE line.product_id = named.product_id)""",
    "sales_quartile": f"""
SELECT *, {_n("ntile(4) OVER (ORDER BY units_sold DESC, product_id)")} AS sales_quartile
FROM (SELECT {_NAMES}, {_UNITS} FROM {_ALL_LINES} GROUP BY {_NAMES})""",
    "category_sales": f"""
SELECT category_name, {_n("sum(quantity)")} AS total_units_sold,
  {_r2("sum(nr)")} AS total_net_revenue, count(DISTINCT product_id) AS distinct_products_sold
FROM line JOIN typed USING (product_id) GROUP BY category_name""",
    "brand_sales": f"""
SELECT brand_name, {_n("sum(quantity)")} AS total_units_sold,
  {_r2("sum(nr)")} AS total_net_revenue, count(DISTINCT product_id) AS distinct_products_sold
FROM line JOIN branded USING (product_id) GROUP BY brand_name""",
    "overstock_ratio": _overstock("sum(sold_qty)", "sum(held_qty)", _FAN_OUT),
    "price_stats_category": f"""
SELECT category_name, count(product_id) AS num_products,
  {_r2("min(list_price)")} AS min_price, {_r2("max(list_price)")} AS max_price,
  {_r2(_avg("list_price"))} AS avg_price, {_r2("median")} AS median_price
FROM m_products JOIN m_categories USING (category_id)
JOIN {_median("m_products", "category_id", "list_price")} USING (category_id)
GROUP BY category_name, median""",
    "price_stats_brand": f"""
SELECT brand_name, count(product_id) AS num_products, {_r2("min(list_price)")} AS min_price,
  {_r2("max(list_price)")} AS max_price, {_r2(_avg("list_price"))} AS avg_price
FROM m_products JOIN m_brands USING (brand_id) GROUP BY brand_name""",
    "price_tiers": f"""
SELECT {_PRICE_TIER}, count(*) AS num_products,
  {_r2(_avg("list_price"))} AS avg_price_in_tier
FROM m_products GROUP BY price_tier""",
    "price_tiers_category": f"""
SELECT category_name, {_PRICE_TIER}, count(*) AS num_products
FROM m_products JOIN m_categories USING (category_id) GROUP BY ALL""",
    "discount_by_price_tier": f"""
SELECT {_PRICE_TIER}, {_DISC}, count(*) AS num_line_items FROM m_items GROUP BY price_tier""",
    "model_year_catalog": f"""
SELECT model_year, count(*) AS num_products, {_r2(_avg("list_price"))} AS avg_list_price,
  {_r2("min(list_price)")} AS min_price, {_r2("max(list_price)")} AS max_price
FROM m_products GROUP BY model_year""",
    "model_year_sales": f"""
SELECT model_year, {_UNITS}, {_NET}, {_DISC}
FROM line JOIN (SELECT product_id, model_year FROM m_products) USING (product_id)
GROUP BY model_year""",
    "model_year_category": f"""
SELECT model_year, category_name, {_UNITS}, {_NET} FROM line
JOIN (SELECT product_id, category_id, model_year FROM m_products) USING (product_id)
JOIN m_categories USING (category_id) GROUP BY ALL""",
    "model_year_discount": f"""
SELECT model_year, {_DISC}, {_r2(_avg("line.list_price"))} AS avg_list_price, {_UNITS}
FROM line JOIN (SELECT product_id, model_year FROM m_products) USING (product_id)
GROUP BY model_year""",
    "model_year_stock": f"""
SELECT model_year, {_n("sum(quantity)")} AS total_stock_remaining,
  count(DISTINCT product_id) AS num_products
FROM m_stocks JOIN m_products USING (product_id) GROUP BY model_year""",
    # --- operations ---
    "status_breakdown": f"""
SELECT order_status, CASE {" ".join(f"WHEN order_status = {c} THEN '{s.capitalize()}'"
    for s, c in STATUSES.items())} ELSE 'Unknown' END
  AS status_label, count(*) AS num_orders,
  {_pct("count(*)", "(SELECT count(*) FROM m_orders)")} AS pct_of_all_orders
FROM m_orders GROUP BY order_status""",
    "status_by_store": f"""
SELECT store_id, store_name, {_PIVOT}, count(*) AS total_orders, {_REJECTION}
FROM m_orders JOIN m_stores USING (store_id) GROUP BY store_id, store_name""",
    "status_by_month": f"""
SELECT {_MONTH}, {_PIVOT}, count(*) AS total_orders FROM m_orders GROUP BY order_month""",
    "fulfilment_overall": f"""
SELECT {_DONE}, {_DAYS}, min(took) AS fastest_fulfillment_days,
  max(took) AS slowest_fulfillment_days FROM shipped""",
    "lateness_overall": f"SELECT {_DONE}, {_EARLY}, {_LATE} FROM shipped",
    "fulfilment_by_store": f"""
SELECT store_id, store_name, {_DONE}, {_DAYS}, {_EARLY}, {_LATE}
FROM shipped JOIN m_stores USING (store_id) GROUP BY store_id, store_name""",
    "fulfilment_by_staff": f"""
SELECT staff_id, first_name, last_name, {_DONE}, {_DAYS}, {_LATE}
FROM shipped JOIN m_staffs USING (staff_id) GROUP BY staff_id, first_name, last_name""",
    "fulfilment_buckets": f"""
SELECT CASE WHEN took = 0 THEN '0. Same day' WHEN took = 1 THEN '1. Next day'
  WHEN took IN (2, 3) THEN '2. 2-3 days' ELSE '3. 4+ days' END
  AS fulfillment_bucket, count(*) AS num_orders,
  {_pct("count(*)", "(SELECT count(*) FROM shipped)")} AS pct_of_completed_orders
FROM shipped GROUP BY fulfillment_bucket""",
    "fulfilment_by_month": f"SELECT {_MONTH}, {_DONE}, {_DAYS} FROM shipped GROUP BY order_month",
    # --- staff and stores ---
    "staff_sales": f"""
SELECT s.staff_id, s.first_name, s.last_name, store_name, count(DISTINCT ok.order_id)
  AS num_orders, {_TOTAL}, {_r2(_div("sum(nr)", "count(DISTINCT ok.order_id)"))} AS avg_order_value
FROM m_staffs s JOIN m_stores t ON t.store_id = s.store_id
LEFT JOIN ok ON ok.staff_id = s.staff_id LEFT JOIN line ON line.order_id = ok.order_id
GROUP BY s.staff_id, s.first_name, s.last_name, store_name""",
    "staff_hierarchy": """
SELECT s.staff_id, s.first_name, s.last_name, s.manager_id, b.first_name AS manager_first_name,
  b.last_name AS manager_last_name
FROM m_staffs s LEFT JOIN m_staffs b ON b.staff_id = s.manager_id""",
    "team_revenue": f"""
SELECT b.staff_id AS manager_id, b.first_name AS manager_first_name,
  b.last_name AS manager_last_name, count(e.staff_id) AS num_direct_reports,
  {_r2("sum(e.earned)")} AS team_total_revenue
FROM (
  SELECT s.staff_id, s.manager_id, coalesce(sum(nr), 0) AS earned
  FROM m_staffs s LEFT JOIN sold USING (staff_id) GROUP BY s.staff_id, s.manager_id
) e JOIN m_staffs b ON b.staff_id = e.manager_id
GROUP BY b.staff_id, b.first_name, b.last_name""",
    "staff_rank_in_store": f"""
SELECT store_name, staff_id, first_name, last_name, {_r2("earned")} AS total_revenue,
  rank() OVER (PARTITION BY store_id ORDER BY earned DESC) AS rank_within_store
FROM (
  SELECT s.store_id, s.staff_id, first_name, last_name, coalesce(sum(nr), 0) AS earned
  FROM m_staffs s LEFT JOIN sold ON sold.staff_id = s.staff_id GROUP BY ALL
) JOIN m_stores USING (store_id)""",
    "store_comparison": f"""
SELECT s.store_id, store_name, city, state, count(DISTINCT ok.order_id) AS num_completed_orders,
  {_TOTAL}, {_r2(_div("sum(nr)", "count(DISTINCT ok.order_id)"))} AS avg_order_value,
  {_r2(_div("sum(quantity)", "count(DISTINCT ok.order_id)"))} AS avg_items_per_order
FROM m_stores s LEFT JOIN ok ON ok.store_id = s.store_id
LEFT JOIN line ON line.order_id = ok.order_id GROUP BY s.store_id, store_name, city, state""",
    "store_fulfilment": f"""
SELECT store_id, store_name, {_DONE}, {_DAYS}, {_LATE}
FROM shipped JOIN m_stores USING (store_id) GROUP BY store_id, store_name""",
    "store_scorecard": f"""
SELECT s.store_id, store_name, {_ACTIVE} AS active_staff_count, {_TOTAL},
  count(DISTINCT ok.order_id) AS num_orders,
  {_r2(_avg("date_diff('day', order_date, shipped_date)"))} AS avg_days_to_ship
FROM m_stores s LEFT JOIN ok ON ok.store_id = s.store_id
LEFT JOIN line ON line.order_id = ok.order_id GROUP BY s.store_id, store_name""",
    "revenue_per_active_staff": f"""
SELECT s.store_id, store_name, {_TOTAL}, {_ACTIVE} AS active_staff_count,
  {_r2(_div("sum(nr)", _ACTIVE))} AS revenue_per_active_staff
FROM m_stores s LEFT JOIN sold ON sold.store_id = s.store_id GROUP BY s.store_id, store_name""",
    # --- customers ---
    "order_frequency": """
SELECT c.customer_id, first_name, last_name, count(order_id) AS num_orders
FROM m_customers c LEFT JOIN m_orders o ON o.customer_id = c.customer_id
GROUP BY c.customer_id, first_name, last_name""",
    "onetime_vs_repeat": f"""
SELECT if(n = 1, '1. One-time customer', '2. Repeat customer') AS customer_segment,
  count(*) AS num_customers,
  {_pct("count(*)", "(SELECT count(DISTINCT customer_id) FROM m_orders)")} AS pct_of_customers
FROM (SELECT customer_id, count(*) AS n FROM m_orders GROUP BY 1) GROUP BY 1""",
    "frequency_bands": f"""
SELECT CASE WHEN n = 1 THEN '1. One-time (1 order)' WHEN n = 2 THEN '2. Occasional (2 orders)'
  WHEN n IN (3, 4) THEN '3. Regular (3-4 orders)' ELSE '4. Loyal (5+ orders)' END AS frequency_band,
  count(*) AS num_customers
FROM (SELECT customer_id, count(*) AS n FROM m_orders GROUP BY 1) GROUP BY 1""",
    "segment_revenue": f"""
SELECT if(n = 1, '1. One-time customer', '2. Repeat customer') AS customer_segment,
  count(DISTINCT a.customer_id) AS num_customers,
  {_r2("sum(coalesce(spend, 0))")} AS total_revenue,
  {_r2(_div("sum(coalesce(spend, 0))", "count(DISTINCT a.customer_id)"))}
    AS avg_revenue_per_customer
FROM (SELECT customer_id, count(*) AS n FROM m_orders GROUP BY 1) a
LEFT JOIN (SELECT customer_id, sum(nr) AS spend FROM sold GROUP BY 1) b
  ON b.customer_id = a.customer_id
GROUP BY 1""",
    "customers_by_state": f"""
SELECT state, count(DISTINCT c.customer_id) AS num_customers, count(order_id) AS num_orders,
  {_r2(_div("count(order_id)", "count(DISTINCT c.customer_id)"))} AS avg_orders_per_customer
FROM m_customers c LEFT JOIN m_orders o ON o.customer_id = c.customer_id GROUP BY state""",
    "revenue_by_state": f"""
SELECT state, count(DISTINCT customer_id) AS num_customers, {_TOTAL},
  {_r2(_div("sum(nr)", "count(DISTINCT customer_id)"))} AS revenue_per_customer
FROM sold JOIN m_customers USING (customer_id) GROUP BY state""",
    "top_cities": f"""
SELECT city, state, count(DISTINCT c.customer_id) AS num_customers,
  {_r2("coalesce(sum(nr), 0)")} AS total_revenue
FROM m_customers c LEFT JOIN sold ON sold.customer_id = c.customer_id GROUP BY city, state
ORDER BY num_customers DESC, city NULLS FIRST, state NULLS FIRST LIMIT 15""",
    "customer_vs_store_state": """
SELECT c.state AS customer_state, s.state AS store_state, count(*) AS num_orders
FROM m_orders JOIN m_customers c USING (customer_id) JOIN m_stores s USING (store_id)
GROUP BY 1, 2""",
    "clv_top": f"""
SELECT customer_id, first_name, last_name, city, state, {_ORDERS},
  {_r2("sum(nr)")} AS lifetime_value, {_AOV}
FROM sold JOIN m_customers USING (customer_id)
GROUP BY customer_id, first_name, last_name, city, state
ORDER BY lifetime_value DESC, customer_id LIMIT 20""",
    "clv_tiers": f"""
SELECT {_lt("v", CLV_BOUNDS, CLV_TIERS)} AS clv_tier,
  count(*) AS num_customers, {_r2("sum(v)")} AS tier_total_revenue,
  {_pct("sum(v)", "(SELECT sum(nr) FROM sold)")} AS pct_of_total_revenue
FROM (SELECT customer_id, sum(nr) AS v FROM sold GROUP BY customer_id) GROUP BY 1""",
    "customer_span": f"""
SELECT customer_id, first_name, last_name, min(order_date) AS first_order_date,
  max(order_date) AS most_recent_order_date,
  date_diff('day', min(order_date), max(order_date)) AS customer_span_days,
  {_ORDERS}, {_r2("sum(nr)")} AS lifetime_value
FROM sold JOIN m_customers USING (customer_id) GROUP BY customer_id, first_name, last_name
HAVING count(DISTINCT order_id) > 1
ORDER BY customer_span_days DESC, customer_id LIMIT 20""",
    "clv_top_with_state": f"""
SELECT customer_id, first_name, last_name, state, {_r2("sum(nr)")} AS lifetime_value
FROM sold JOIN m_customers USING (customer_id) GROUP BY customer_id, first_name, last_name, state
ORDER BY lifetime_value DESC, customer_id LIMIT 10""",
    # --- sales ---
    "monthly_revenue": f"SELECT {_MONTH}, {_ORDERS}, {_NET} FROM sold GROUP BY order_month",
    "yearly_growth": f"""
SELECT y AS order_year, {_r2("v")} AS net_revenue, {_r2(
    "(CAST(v AS DOUBLE) - CAST(prev AS DOUBLE)) / nullif(CAST(prev AS DOUBLE), 0) * 100"
)} AS yoy_growth_pct
FROM (
  SELECT y, v, lag(v) OVER (ORDER BY y NULLS FIRST) AS prev
  FROM (SELECT {_n("year(order_date)")} AS y, sum(nr) AS v FROM sold GROUP BY 1)
)""",
    "quarterly_revenue": f"""
SELECT {_n("year(order_date)")} AS order_year, {_n("quarter(order_date)")} AS order_quarter,
  {_ORDERS}, {_NET} FROM sold GROUP BY 1, 2""",
    "seasonality": f"""
SELECT {_n("month(order_date)")} AS calendar_month, monthname(order_date) AS month_name,
  {_ORDERS}, {_NET} FROM sold GROUP BY 1, 2""",
    "cumulative_revenue": f"""
SELECT order_month, {_r2("v")} AS net_revenue,
  {_r2("sum(v) OVER (ORDER BY order_month NULLS FIRST)")} AS cumulative_revenue
FROM (SELECT {_MONTH}, sum(nr) AS v FROM sold GROUP BY order_month)""",
    "revenue_by_store": f"""
SELECT store_id, store_name, {_ORDERS}, {_NET},
  {_pct("sum(nr)", "(SELECT sum(nr) FROM sold)")} AS pct_of_total_revenue
FROM sold JOIN m_stores USING (store_id) GROUP BY store_id, store_name""",
    "revenue_by_staff": f"""
SELECT s.staff_id, first_name, last_name, store_name, {_ORDERS}, {_NET}
FROM sold JOIN m_staffs s ON s.staff_id = sold.staff_id
JOIN m_stores t ON t.store_id = s.store_id GROUP BY s.staff_id, first_name, last_name, store_name""",
    "revenue_by_category": f"""
SELECT category_name, {_ORDERS}, {_UNITS}, {_NET}
FROM sold JOIN typed USING (product_id) GROUP BY category_name""",
    "revenue_by_brand": f"""
SELECT brand_name, {_ORDERS}, {_UNITS}, {_NET}
FROM sold JOIN branded USING (product_id) GROUP BY brand_name""",
    "store_category": f"""
SELECT store_name, category_name, {_UNITS}, {_NET}
FROM sold JOIN typed USING (product_id) JOIN m_stores USING (store_id)
GROUP BY store_name, category_name""",
    "discount_tiers": f"""
SELECT {_le("discount", DISCOUNT_BOUNDS, DISCOUNT_TIERS)} AS discount_tier,
  count(*) AS num_line_items, {_AVG_QTY}, {_n("sum(quantity)")} AS total_units_sold, {_NET}
FROM sold GROUP BY discount_tier""",
    "discount_vs_quantity": f"""
SELECT product_id, product_name, count(*) AS num_line_items, {_DISC}, {_AVG_QTY},
  {_n("sum(quantity)")} AS total_units_sold
FROM sold JOIN m_products USING (product_id) GROUP BY product_id, product_name
HAVING count(*) >= 5""",
    "discounted_flag": f"""
SELECT if(discount = 0, '1. No discount', '2. Discounted') AS discount_flag,
  count(*) AS num_line_items, {_n("sum(quantity)")} AS total_units_sold, {_AVG_QTY}, {_DISC}
FROM sold GROUP BY 1""",
    "discount_tiers_category": f"""
SELECT category_name,
  {_le("discount", WIDE_DISCOUNT_BOUNDS, WIDE_DISCOUNT_TIERS)} AS discount_tier,
  count(*) AS num_line_items, {_AVG_QTY}
FROM sold JOIN typed USING (product_id) GROUP BY 1, 2""",
    "aov_overall": f"SELECT {_ORDERS}, {_TOTAL}, {_AOV} FROM sold",
    "aov_by_store": f"""
SELECT store_id, store_name, {_ORDERS}, {_AOV}
FROM sold JOIN m_stores USING (store_id) GROUP BY store_id, store_name""",
    "aov_by_customer": f"""
SELECT customer_id, first_name, last_name, state, {_ORDERS}, {_AOV}
FROM sold JOIN m_customers USING (customer_id) GROUP BY customer_id, first_name, last_name, state
HAVING count(DISTINCT order_id) >= 2
ORDER BY avg_order_value DESC, customer_id LIMIT 20""",
    "aov_buckets": f"""
SELECT {_lt("v", AOV_BOUNDS, AOV_BUCKETS)} AS aov_bucket, count(*) AS num_customers
FROM (
  SELECT {_div("sum(nr)", "count(DISTINCT order_id)")} AS v FROM sold GROUP BY customer_id
) GROUP BY 1""",
    "aov_by_month": f"SELECT {_MONTH}, {_ORDERS}, {_AOV} FROM sold GROUP BY order_month",
}

RECENT = "2001-06-01"

VARIANT_SQL: dict[str, str] = {
    "category_sales_valid_only": f"""
SELECT category_name, {_n("sum(quantity)")} AS total_units_sold,
  {_r2("sum(nr)")} AS total_net_revenue, count(DISTINCT product_id) AS distinct_products_sold
FROM sold JOIN typed USING (product_id) GROUP BY category_name""",
    "brand_sales_valid_only": f"""
SELECT brand_name, {_n("sum(quantity)")} AS total_units_sold,
  {_r2("sum(nr)")} AS total_net_revenue, count(DISTINCT product_id) AS distinct_products_sold
FROM sold JOIN branded USING (product_id) GROUP BY brand_name""",
    "never_sold_since": f"""
SELECT {_NAMES}, {_r2("named.list_price")} AS list_price FROM named
WHERE NOT EXISTS (
  SELECT 1 FROM line JOIN m_orders USING (order_id)
  WHERE line.product_id = named.product_id AND order_date >= DATE '{RECENT}'
)""",
    "overstock_ratio_true_totals": _overstock("sum(u)", "sum(h)", _NO_FAN_OUT),
    "overstock_ratio_unsold_first": _overstock(
        "sum(sold_qty)", "sum(held_qty)", _FAN_OUT, "FIRST"
    ),
    "store_scorecard_per_order": f"""
SELECT s.store_id, store_name, {_ACTIVE} AS active_staff_count, {_TOTAL},
  count(DISTINCT ok.order_id) AS num_orders,
  (SELECT {_r2(_avg("date_diff('day', order_date, shipped_date)"))} FROM ok q
   WHERE q.store_id = s.store_id) AS avg_days_to_ship
FROM m_stores s LEFT JOIN ok ON ok.store_id = s.store_id
LEFT JOIN line ON line.order_id = ok.order_id GROUP BY s.store_id, store_name""",
}


def _table_name(name: str) -> str:
    return "m_items" if name == "order_items" else f"m_{name}"


_DERIVED_COLUMNS = {
    "stores": ("store_id", "store_name", "city", "state"),
    "customers": ("customer_id", "first_name", "last_name", "city", "state"),
    "staffs": ("staff_id", "first_name", "last_name", "active", "store_id", "manager_id"),
}


def table_columns(name: str) -> tuple[str, ...]:
    """Columns of a table the driver's star has a value for."""
    return _DERIVED_COLUMNS.get(name, tuple(SCHEMAS[name].names))


def _table_sql(name: str) -> str:
    columns = ", ".join(
        f"CAST({c} AS DOUBLE) AS {c}" if c in ("list_price", "discount") else c
        for c in table_columns(name)
    )
    return f"SELECT {columns} FROM {_table_name(name)}"


def _check(table: str, constraint: str, counted: str) -> str:
    return (
        f"SELECT '{table}' AS table_name, '{constraint}' AS constraint_name, "
        f"CAST(({counted}) AS BIGINT) AS violations"
    )


def _validate_sql(**kept: str) -> str:
    """All constraints; ``kept`` leaves only some rows of a table."""

    def rows(name: str) -> str:
        table = _table_name(name)
        return f"(SELECT * FROM {table} WHERE {kept[name]})" if name in kept else table

    checks = []
    for name, keys in PRIMARY_KEYS.items():
        key, nulls = ", ".join(keys), " OR ".join(f"{k} IS NULL" for k in keys)
        checks.append(
            _check(
                name,
                f"primary key ({key})",
                f"SELECT count(*) FROM (SELECT {key} FROM {rows(name)} GROUP BY {key} "
                f"HAVING count(*) > 1 OR {nulls})",
            )
        )
    for name, cols in REQUIRED.items():
        for c in cols:
            checks.append(
                _check(name, f"not null ({c})", f"SELECT count(*) FROM {rows(name)} WHERE {c} IS NULL")
            )
    for r in REFERENCES:
        checks.append(
            _check(
                r.child,
                f"foreign key ({r.column})",
                f"SELECT count(*) FROM {rows(r.child)} x WHERE x.{r.column} IS NOT NULL "
                f"AND NOT EXISTS (SELECT 1 FROM {rows(r.parent)} y WHERE y.{r.key} = x.{r.column})",
            )
        )
    return "\nUNION ALL\n".join(checks)


#: The year that is read back from the layout by year.
LAID_OUT_YEAR = 1996

OPERATOR_SQL: dict[str, str] = {
    **{f"table_{name}": _table_sql(name) for name in SCHEMAS},
    "validate": _validate_sql(),
    "validate_current": _validate_sql(staffs="active = 1", products="model_year > 2016"),
    "duplicate_order_lines": """
SELECT order_id, item_id, count(*) AS n_rows FROM m_items GROUP BY order_id, item_id
HAVING count(*) > 1 OR order_id IS NULL OR item_id IS NULL""",
    "missing_order_values": """
SELECT 'customer_id' AS column_name, count(*) FILTER (customer_id IS NULL) AS violations
FROM m_orders UNION ALL
SELECT 'shipped_date', count(*) FILTER (shipped_date IS NULL) FROM m_orders""",
    "orders_outside_active_staff": """
SELECT order_id, staff_id FROM m_orders o WHERE staff_id IS NOT NULL AND NOT EXISTS (
  SELECT 1 FROM m_staffs s WHERE s.staff_id = o.staff_id AND active = 1
)""",
    "customer_value_deciles": f"""
SELECT customer_id, {_r2("v")} AS lifetime_value,
  {_n("ntile(10) OVER (ORDER BY v DESC, customer_id NULLS FIRST)")} AS decile
FROM (SELECT customer_id, sum(nr) AS v FROM sold GROUP BY customer_id)""",
    "median_order_units_by_store": f"""
SELECT store_id, {_r2("median")} AS median_units
FROM {_median(
    "(SELECT store_id, order_id, sum(quantity) AS units FROM sold GROUP BY ALL)",
    "store_id", "units")}""",
    "cumulative_revenue_by_store": f"""
SELECT store_id, order_month, {_r2(
    "sum(v) OVER (PARTITION BY store_id ORDER BY order_month NULLS FIRST)"
)} AS cumulative_revenue
FROM (SELECT store_id, {_MONTH}, sum(nr) AS v FROM sold GROUP BY ALL)""",
    "store_share_of_revenue": f"""
SELECT store_id, {_NET}, {_pct("sum(nr)", "(SELECT sum(nr) FROM sold)")} AS pct_of_total_revenue
FROM sold GROUP BY store_id""",
    "table_customers_from_csv": _table_sql("customers"),
    "table_orders_of_a_year": _table_sql("orders") + f" WHERE year(order_date) = {LAID_OUT_YEAR}",
    "store_month_status": f"""
SELECT store_id, {_MONTH}, {_PIVOT}, count(*) AS total_orders, {_REJECTION}
FROM m_orders GROUP BY store_id, order_month""",
    "fulfilment_by_store_month": f"""
SELECT store_id, {_MONTH}, {_DONE}, {_DAYS}, min(took) AS fastest_fulfillment_days,
  max(took) AS slowest_fulfillment_days, {_EARLY}, {_LATE}
FROM shipped GROUP BY store_id, order_month""",
}


def oracle_sql() -> dict[str, str]:
    return {
        name: MODEL + body
        for name, body in {**REPORT_SQL, **VARIANT_SQL, **OPERATOR_SQL}.items()
    }
