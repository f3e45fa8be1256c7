"""DuckDB SQL for each query, over the same order tables.

Every statement starts from the raw tables, so it checks the silver transform
along with the query. Averages are an exact decimal sum by a count.
"""

from __future__ import annotations

# --- shared CTEs ----------------------------------------------------------

_LINES = """
lines AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS order_id,
         CAST(o_orderdate AS DATE) AS sale_date,
         CAST(l_shipdate AS DATE) AS ship_date,
         CAST(o_custkey AS VARCHAR) AS customer_id,
         CAST(l_partkey AS VARCHAR) AS product_id,
         CAST(l_suppkey AS VARCHAR) AS warehouse_id,
         r_name AS region,
         'N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS state_code,
         n_name AS state_name,
         CAST(l_quantity AS BIGINT) AS quantity,
         l_extendedprice / l_quantity AS raw_price,
         CAST(l_discount AS DECIMAL(9,6)) AS discount_pct,
         CAST(0.6 * p_retailprice AS DECIMAL(18,2)) AS unit_cost,
         o_orderpriority AS ship_mode
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
  JOIN part ON l_partkey = p_partkey
),
gross AS (
  SELECT *, CAST(round(quantity * raw_price, 4) AS DECIMAL(18,4)) AS gross_revenue FROM lines
),
discounted AS (
  SELECT *, CAST(round(gross_revenue * discount_pct, 4) AS DECIMAL(18,4)) AS discount_amount FROM gross
),
netted AS (
  SELECT *, CAST(gross_revenue - discount_amount AS DECIMAL(18,4)) AS net_revenue FROM discounted
),
fact AS (
  SELECT order_id, sale_date, ship_date, customer_id, product_id, warehouse_id, region, state_code, state_name,
         quantity, CAST(raw_price AS DECIMAL(18,8)) AS unit_price, discount_pct,
         gross_revenue, discount_amount, net_revenue,
         CAST(net_revenue - quantity * unit_cost AS DECIMAL(18,4)) AS profit,
         ship_mode,
         CAST(date_diff('day', sale_date, ship_date) AS INT) AS days_to_ship,
         CAST(year(sale_date) AS INT) AS sale_year,
         CAST(month(sale_date) AS INT) AS sale_month,
         CAST(quarter(sale_date) AS INT) AS sale_quarter
  FROM netted
)"""

_PRODUCTS = """
products AS (
  SELECT CAST(p_partkey AS VARCHAR) AS product_id, p_name AS product_name, p_type AS product_category,
         p_brand AS product_subcategory, p_brand AS brand, CAST(NULL AS VARCHAR) AS supplier,
         CAST(CAST(0.6 * p_retailprice AS DECIMAL(18,2)) AS DECIMAL(18,4)) AS unit_cost,
         CAST(p_retailprice AS DECIMAL(18,4)) AS list_price
  FROM part
)"""

_WAREHOUSES = """
warehouses AS (
  SELECT CAST(s_suppkey AS VARCHAR) AS warehouse_id, s_name AS warehouse_name, r_name AS region, n_name AS state
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
)"""

_CUSTOMERS = """
raw_customers AS (
  SELECT CAST(c_custkey AS VARCHAR) AS customer_id, c_name AS customer_name, c_mktsegment AS segment,
         r_name AS region, n_name AS state, CAST(NULL AS VARCHAR) AS city,
         CAST(first_order AS DATE) AS signup_date,
         CASE WHEN c_acctbal < 0 THEN 'Bronze' WHEN c_acctbal < 5000 THEN 'Silver' ELSE 'Gold' END AS loyalty_tier
  FROM customer
  JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS first_order FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey
),
customer_totals AS (
  SELECT customer_id, sum(net_revenue) AS lifetime_value FROM fact GROUP BY customer_id
),
customer_tiles AS (
  SELECT customer_id, lifetime_value,
         CAST(ntile(5) OVER (ORDER BY lifetime_value DESC, customer_id) AS INT) AS value_quintile
  FROM customer_totals
),
customers AS (
  SELECT c.*, CASE value_quintile WHEN 1 THEN 'Champion' WHEN 2 THEN 'Loyal' WHEN 3 THEN 'Core'
                                  WHEN 4 THEN 'Occasional' WHEN 5 THEN 'Low' ELSE 'Inactive' END AS customer_segment
  FROM raw_customers c LEFT JOIN customer_tiles USING (customer_id)
)"""

_DAILY = """
daily AS (
  SELECT sale_date, region, product_category,
         count(DISTINCT order_id) AS order_count,
         CAST(sum(quantity) AS BIGINT) AS units_sold,
         sum(net_revenue) AS total_revenue,
         CAST(sum(net_revenue) AS DOUBLE) / count(net_revenue) AS avg_order_value,
         sum(discount_amount) AS total_discounts,
         sum(profit) AS total_profit
  FROM fact JOIN products USING (product_id)
  GROUP BY sale_date, region, product_category
),
summary AS (
  SELECT *,
         sum(total_revenue) OVER week AS rolling_7d_revenue,
         CAST(sum(total_revenue) OVER month AS DOUBLE) / count(total_revenue) OVER month AS rolling_30d_avg,
         lag(total_revenue, 7) OVER series AS revenue_7d_ago
  FROM daily
  WINDOW week AS (PARTITION BY region ORDER BY sale_date, product_category ROWS BETWEEN 6 PRECEDING AND CURRENT ROW),
         month AS (PARTITION BY region ORDER BY sale_date, product_category ROWS BETWEEN 29 PRECEDING AND CURRENT ROW),
         series AS (PARTITION BY region, product_category ORDER BY sale_date)
)"""

_PERFORMANCE = """
per_product AS (
  SELECT product_category, product_subcategory, product_name,
         count(DISTINCT order_id) AS total_orders,
         CAST(sum(quantity) AS BIGINT) AS total_units_sold,
         sum(net_revenue) AS revenue,
         sum(profit) AS profit,
         CAST(sum(unit_price) AS DOUBLE) / count(unit_price) AS avg_selling_price,
         CAST(sum(discount_pct) AS DOUBLE) / count(discount_pct) AS avg_discount
  FROM fact JOIN products USING (product_id)
  GROUP BY product_category, product_subcategory, product_name
),
performance AS (
  SELECT *, round(CAST(profit AS DOUBLE) / nullif(CAST(revenue AS DOUBLE), 0) * 100, 2) AS profit_margin_pct,
         rank() OVER (PARTITION BY product_category ORDER BY revenue DESC) AS category_revenue_rank
  FROM per_product
)"""

_MONTHLY = """
monthly AS (
  SELECT warehouse_name, CAST(month(sale_date) AS INT) AS month_num, strftime(sale_date, '%b') AS month_name,
         count(DISTINCT order_id) AS total_orders,
         CAST(sum(quantity) AS BIGINT) AS units_fulfilled,
         CAST(sum(net_revenue) AS DOUBLE) AS revenue,
         CAST(sum(days_to_ship) AS DOUBLE) / count(days_to_ship) AS avg_days_to_ship,
         round(CAST(sum(CASE WHEN days_to_ship <= 3 THEN 1 ELSE 0 END) AS DOUBLE) / nullif(count(*), 0) * 100, 1)
           AS fulfillment_rate
  FROM fact JOIN warehouses USING (warehouse_id)
  GROUP BY 1, 2, 3
)"""

_REGIONAL = """
regional AS (
  SELECT state_code, state_name, region,
         count(DISTINCT order_id) AS total_orders,
         count(DISTINCT customer_id) AS unique_customers,
         sum(net_revenue) AS total_revenue,
         sum(profit) AS total_profit,
         CAST(sum(net_revenue) AS DOUBLE) / count(net_revenue) AS avg_order_value,
         CAST(sum(quantity) AS BIGINT) AS total_units
  FROM fact GROUP BY state_code, state_name, region
)"""

_ANALYTICS = """
per_customer AS (
  SELECT c.customer_id, c.customer_name, c.segment, c.region, c.loyalty_tier,
         count(DISTINCT order_id) AS total_orders,
         sum(net_revenue) AS lifetime_value,
         CAST(sum(net_revenue) AS DOUBLE) / count(net_revenue) AS avg_order_value,
         min(sale_date) AS first_purchase,
         max(sale_date) AS last_purchase,
         CAST(date_diff('day', min(sale_date), max(sale_date)) AS INT) AS customer_tenure_days,
         count(DISTINCT product_category) AS categories_purchased
  FROM fact f JOIN customers c USING (customer_id) JOIN products USING (product_id)
  GROUP BY c.customer_id, c.customer_name, c.segment, c.region, c.loyalty_tier
),
analytics AS (
  SELECT *, CAST(ntile(5) OVER (ORDER BY lifetime_value DESC, customer_id) AS INT) AS value_quintile
  FROM per_customer
)"""


def _with(*ctes: str, select: str) -> str:
    return "WITH " + ",".join(ctes) + "\n" + select


def _growth(current: str, previous: str) -> str:
    return (
        f"round(CAST({current} - {previous} AS DOUBLE) / nullif(CAST({previous} AS DOUBLE), 0) * 100, 2)"
    )


_SUMMARY = (_LINES, _PRODUCTS, _DAILY)
_CHOSEN = (
    "region IN ('ASIA', 'EUROPE') AND product_category IN ('ECONOMY', 'PROMO') "
    "AND sale_date BETWEEN DATE '1997-01-01' AND DATE '1997-12-31'"
)
_AVG_AOV = "CAST(sum(CAST(avg_order_value AS DECIMAL(28,10))) AS DOUBLE) / count(avg_order_value)"
_MONTH_LABELS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")

ORACLES: dict[str, str] = {}

# --- silver ---------------------------------------------------------------

ORACLES["silver_sales"] = _with(
    _LINES,
    select="""
SELECT * REPLACE (CAST(unit_price AS DOUBLE) AS unit_price, CAST(discount_pct AS DOUBLE) AS discount_pct,
                  CAST(gross_revenue AS DOUBLE) AS gross_revenue, CAST(discount_amount AS DOUBLE) AS discount_amount,
                  CAST(net_revenue AS DOUBLE) AS net_revenue, CAST(profit AS DOUBLE) AS profit)
FROM fact""",
)

ORACLES["silver_sales_assigned_warehouse"] = _with(
    _LINES,
    _WAREHOUSES,
    """
by_state AS (SELECT state, min(warehouse_id) AS state_warehouse FROM warehouses GROUP BY state),
by_region AS (SELECT region, min(warehouse_id) AS region_warehouse FROM warehouses GROUP BY region)""",
    select="""
SELECT f.state_name, coalesce(state_warehouse, region_warehouse) AS warehouse_id, count(*) AS sales_lines
FROM fact f LEFT JOIN by_state s ON f.state_name = s.state LEFT JOIN by_region r ON f.region = r.region
GROUP BY 1, 2""",
)

ORACLES["compat_quarters"] = _with(
    _LINES,
    select="""
SELECT sale_month, CAST(round(CAST(sale_month - 1 AS DOUBLE) / 3 + 1, 0) AS INT) AS sale_quarter,
       count(*) AS sales_lines
FROM fact GROUP BY 1, 2""",
)

ORACLES["dim_customers"] = _with(_LINES, _CUSTOMERS, select="SELECT * FROM customers")

ORACLES["dim_products"] = _with(
    _PRODUCTS,
    select="""
SELECT * REPLACE (CAST(unit_cost AS DOUBLE) AS unit_cost, CAST(list_price AS DOUBLE) AS list_price),
       round(CAST(list_price - unit_cost AS DOUBLE) / nullif(CAST(list_price AS DOUBLE), 0) * 100, 2) AS margin_pct
FROM products""",
)

ORACLES["customer_value_quintiles"] = _with(
    _LINES,
    _CUSTOMERS,
    select="SELECT customer_id, CAST(lifetime_value AS DOUBLE) AS lifetime_value, value_quintile FROM customer_tiles",
)

# --- gold views -----------------------------------------------------------

ORACLES["daily_sales_summary"] = _with(
    *_SUMMARY,
    select=f"""
SELECT sale_date, region, product_category, order_count, units_sold,
       CAST(total_revenue AS DOUBLE) AS total_revenue, avg_order_value,
       CAST(total_discounts AS DOUBLE) AS total_discounts, CAST(total_profit AS DOUBLE) AS total_profit,
       CAST(rolling_7d_revenue AS DOUBLE) AS rolling_7d_revenue, rolling_30d_avg,
       CAST(revenue_7d_ago AS DOUBLE) AS revenue_7d_ago,
       {_growth("total_revenue", "revenue_7d_ago")} AS wow_growth_pct
FROM summary""",
)

ORACLES["daily_sales_summary_fact_only"] = _with(
    *_SUMMARY,
    select=f"""
SELECT sale_date, region, product_category, order_count, units_sold,
       CAST(total_revenue AS DOUBLE) AS total_revenue, avg_order_value,
       CAST(total_discounts AS DOUBLE) AS total_discounts,
       CAST(rolling_7d_revenue AS DOUBLE) AS rolling_7d_revenue,
       CAST(revenue_7d_ago AS DOUBLE) AS revenue_7d_ago,
       {_growth("total_revenue", "revenue_7d_ago")} AS wow_growth_pct
FROM summary""",
)

ORACLES["rolling_7d_calendar"] = _with(
    _LINES,
    "by_day AS (SELECT region, sale_date, sum(net_revenue) AS revenue FROM fact GROUP BY region, sale_date)",
    select="""
SELECT sale_date, region, CAST(revenue AS DOUBLE) AS revenue,
       CAST(sum(revenue) OVER (PARTITION BY region ORDER BY sale_date
            RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW) AS DOUBLE) AS rolling_7d_calendar
FROM by_day""",
)

ORACLES["product_performance"] = _with(
    _LINES,
    _PRODUCTS,
    _PERFORMANCE,
    select="SELECT * REPLACE (CAST(revenue AS DOUBLE) AS revenue, CAST(profit AS DOUBLE) AS profit) FROM performance",
)

ORACLES["warehouse_monthly_performance"] = _with(_LINES, _WAREHOUSES, _MONTHLY, select="SELECT * FROM monthly")

ORACLES["regional_sales"] = _with(
    _LINES,
    _REGIONAL,
    select="""
SELECT * REPLACE (CAST(total_revenue AS DOUBLE) AS total_revenue, CAST(total_profit AS DOUBLE) AS total_profit)
FROM regional""",
)

ORACLES["customer_analytics"] = _with(
    _LINES,
    _PRODUCTS,
    _CUSTOMERS,
    _ANALYTICS,
    select="SELECT * REPLACE (CAST(lifetime_value AS DOUBLE) AS lifetime_value) FROM analytics",
)

ORACLES["kpi_summary"] = _with(
    _LINES,
    select="""
SELECT count(DISTINCT order_id) AS total_orders, CAST(sum(net_revenue) AS DOUBLE) AS total_revenue,
       CAST(sum(net_revenue) AS DOUBLE) / count(net_revenue) AS avg_order_value,
       CAST(sum(profit) AS DOUBLE) AS total_profit,
       count(DISTINCT customer_id) AS unique_customers, count(DISTINCT product_id) AS products_sold,
       round(CAST(sum(profit) AS DOUBLE) / nullif(CAST(sum(net_revenue) AS DOUBLE), 0) * 100, 2) AS overall_margin_pct
FROM fact""",
)

# --- feature tables -------------------------------------------------------

ORACLES["customer_features"] = _with(
    _LINES,
    _CUSTOMERS,
    """
sums AS (
  SELECT customer_id, count(order_id) AS total_orders, CAST(sum(net_revenue) AS DOUBLE) AS lifetime_value,
         CAST(sum(net_revenue) AS DOUBLE) / count(net_revenue) AS avg_order_value,
         CAST(sum(quantity) AS BIGINT) AS total_units,
         min(sale_date) AS first_purchase, max(sale_date) AS last_purchase,
         CAST(date_diff('day', min(sale_date), max(sale_date)) AS INT) AS tenure_days
  FROM fact GROUP BY customer_id
)""",
    select="""
SELECT customer_id, customer_name, segment, region, loyalty_tier, total_orders, lifetime_value, avg_order_value,
       total_units, first_purchase, last_purchase, tenure_days,
       CASE WHEN tenure_days > 0 THEN CAST(total_orders AS DOUBLE) / tenure_days * 30 ELSE 0.0 END AS purchase_frequency
FROM sums JOIN customers USING (customer_id)""",
)

ORACLES["customer_features_ext"] = _with(
    _LINES,
    _CUSTOMERS,
    """
sums AS (
  SELECT customer_id, count(order_id) AS total_orders, CAST(sum(net_revenue) AS DOUBLE) AS lifetime_value,
         CAST(sum(net_revenue) AS DOUBLE) / count(net_revenue) AS avg_order_value,
         CAST(sum(quantity) AS BIGINT) AS total_units, count(DISTINCT product_id) AS unique_products
  FROM fact GROUP BY customer_id
)""",
    select="""
SELECT customer_id, total_orders, lifetime_value, avg_order_value, total_units, unique_products,
       customer_segment, signup_date
FROM sums JOIN customers USING (customer_id)""",
)

ORACLES["product_features"] = _with(
    _LINES,
    _PRODUCTS,
    """
sums AS (
  SELECT product_id, count(order_id) AS total_orders, CAST(sum(quantity) AS BIGINT) AS total_units_sold,
         CAST(sum(net_revenue) AS DOUBLE) AS total_revenue, CAST(sum(profit) AS DOUBLE) AS total_profit,
         CAST(sum(unit_price) AS DOUBLE) / count(unit_price) AS avg_selling_price,
         CAST(sum(discount_pct) AS DOUBLE) / count(discount_pct) AS avg_discount_rate
  FROM fact GROUP BY product_id
)""",
    select="""
SELECT product_id, product_name, product_category, product_subcategory, total_orders, total_units_sold,
       total_revenue, total_profit,
       CASE WHEN total_revenue > 0 THEN round(total_profit / total_revenue * 100, 2) ELSE 0.0 END AS profit_margin,
       avg_selling_price, avg_discount_rate
FROM sums JOIN products USING (product_id)""",
)

for _name in ("customer_features", "product_features"):
    ORACLES[f"{_name}_colocated"] = ORACLES[_name]

# --- dashboard feeds ------------------------------------------------------

ORACLES["region_domain"] = _with(*_SUMMARY, select="SELECT DISTINCT region FROM daily ORDER BY region")
ORACLES["category_domain"] = _with(
    *_SUMMARY, select="SELECT DISTINCT product_category FROM daily ORDER BY product_category"
)

ORACLES["dashboard_kpis"] = _with(
    *_SUMMARY,
    select=f"""
SELECT CAST(sum(total_revenue) AS DOUBLE) AS total_revenue, CAST(sum(order_count) AS BIGINT) AS total_orders,
       {_AVG_AOV} AS avg_aov, CAST(sum(total_profit) AS DOUBLE) AS total_profit,
       CAST(sum(units_sold) AS BIGINT) AS total_units, count(DISTINCT sale_date) AS active_days
FROM summary WHERE {_CHOSEN}""",
)

ORACLES["kpis_last_month"] = _with(
    *_SUMMARY,
    select=f"""
SELECT CAST(sum(total_revenue) AS DOUBLE) AS total_revenue, CAST(sum(order_count) AS BIGINT) AS total_orders,
       {_AVG_AOV} AS avg_aov, count(DISTINCT sale_date) AS active_days
FROM summary WHERE sale_date >= DATE '2001-08-01' - INTERVAL 1 MONTH""",
)

ORACLES["revenue_trend"] = _with(
    *_SUMMARY,
    select=f"""
SELECT sale_date, region, CAST(sum(total_revenue) AS DOUBLE) AS revenue,
       CAST(sum(rolling_7d_revenue) AS DOUBLE) AS rolling_7d
FROM summary WHERE {_CHOSEN} GROUP BY sale_date, region ORDER BY sale_date, region""",
)

ORACLES["revenue_trend_full_grain"] = _with(
    *_SUMMARY,
    select="""
SELECT sale_date, region, CAST(total_revenue AS DOUBLE) AS total_revenue,
       CAST(rolling_7d_revenue AS DOUBLE) AS rolling_7d_revenue
FROM summary
WHERE region IN ('ASIA', 'EUROPE') AND sale_date BETWEEN DATE '1997-01-01' AND DATE '1997-12-31'
ORDER BY sale_date, region""",
)

ORACLES["kpis_from_sketches"] = _with(
    _LINES,
    _PRODUCTS,
    select="""
SELECT region, CAST(sum(net_revenue) AS DOUBLE) AS total_revenue, CAST(sum(profit) AS DOUBLE) AS total_profit,
       CAST(sum(quantity) AS BIGINT) AS units_sold, CAST(sum(net_revenue) AS DOUBLE) / count(net_revenue) AS avg_line_value,
       count(DISTINCT order_id) AS exact_orders, count(DISTINCT customer_id) AS exact_customers, 1 AS within_bound
FROM fact JOIN products USING (product_id)
WHERE sale_date BETWEEN DATE '1997-01-01' AND DATE '1997-12-31' GROUP BY region""",
)

ORACLES["category_hierarchy_revenue"] = _with(
    _LINES,
    _PRODUCTS,
    _PERFORMANCE,
    select="""
SELECT product_category, product_subcategory, CAST(sum(revenue) AS DOUBLE) AS total_revenue
FROM performance GROUP BY product_category, product_subcategory""",
)

ORACLES["top_products"] = _with(
    _LINES,
    _PRODUCTS,
    _PERFORMANCE,
    select="""
SELECT product_name, product_category, CAST(revenue AS DOUBLE) AS revenue, profit_margin_pct
FROM performance ORDER BY performance.revenue DESC, product_name, product_category, product_subcategory LIMIT 15""",
)

ORACLES["fulfillment_long"] = _with(
    _LINES,
    _WAREHOUSES,
    _MONTHLY,
    select="""
SELECT warehouse_name, month_name, month_num, fulfillment_rate FROM monthly ORDER BY warehouse_name, month_num""",
)

ORACLES["fulfillment_heatmap"] = _with(
    _LINES,
    _WAREHOUSES,
    _MONTHLY,
    select="SELECT warehouse_name, "
    + ", ".join(f"max(CASE WHEN month_name = '{m}' THEN fulfillment_rate END) AS \"{m}\"" for m in _MONTH_LABELS)
    + " FROM monthly GROUP BY warehouse_name",
)

ORACLES["state_map_feed"] = _with(
    _LINES,
    _REGIONAL,
    select="""
SELECT state_code, state_name, CAST(total_revenue AS DOUBLE) AS total_revenue, total_orders, unique_customers
FROM regional""",
)

ORACLES["state_rollup"] = _with(
    _LINES,
    _REGIONAL,
    select="""
SELECT state_code, state_name, CAST(sum(total_revenue) AS DOUBLE) AS revenue
FROM regional GROUP BY state_code, state_name""",
)

ORACLES["sql_state_revenue"] = _with(
    _LINES,
    _REGIONAL,
    select="""
SELECT state_code, CAST(sum(total_revenue) AS DOUBLE) AS revenue, CAST(sum(total_units) AS BIGINT) AS units
FROM regional WHERE region = 'ASIA' GROUP BY state_code""",
)

# --- trends ---------------------------------------------------------------

ORACLES["mom_growth"] = _with(
    _LINES,
    """
by_month AS (
  SELECT CAST(date_trunc('month', sale_date) AS DATE) AS month, sum(net_revenue) AS revenue,
         count(DISTINCT order_id) AS orders,
         CAST(sum(net_revenue) AS DOUBLE) / count(net_revenue) AS aov
  FROM fact GROUP BY 1
)""",
    select=f"""
SELECT c.month, CAST(c.revenue AS DOUBLE) AS revenue, c.orders, c.aov, CAST(p.revenue AS DOUBLE) AS prev_revenue,
       {_growth("c.revenue", "p.revenue")} AS mom_revenue_pct,
       {_growth("c.orders", "p.orders")} AS mom_orders_pct,
       {_growth("c.aov", "p.aov")} AS mom_aov_pct
FROM by_month c LEFT JOIN by_month p ON c.month = p.month + INTERVAL 1 MONTH""",
)

ORACLES["state_growth"] = _with(
    _LINES,
    """
by_month AS (
  SELECT state_name, CAST(date_trunc('month', sale_date) AS DATE) AS month, sum(net_revenue) AS revenue
  FROM fact GROUP BY 1, 2
)""",
    select=f"""
SELECT c.state_name, c.month, CAST(c.revenue AS DOUBLE) AS revenue, CAST(p.revenue AS DOUBLE) AS prev_revenue,
       {_growth("c.revenue", "p.revenue")} AS growth_pct
FROM by_month c
LEFT JOIN by_month p ON c.state_name = p.state_name AND c.month = p.month + INTERVAL 1 MONTH""",
)

ORACLES["yoy_seasonal"] = _with(
    _LINES,
    "by_month AS (SELECT sale_year, sale_month, sum(net_revenue) AS revenue FROM fact GROUP BY 1, 2)",
    select=f"""
SELECT c.sale_year, c.sale_month, CAST(c.revenue AS DOUBLE) AS revenue,
       CAST(p.revenue AS DOUBLE) AS prev_year_revenue, {_growth("c.revenue", "p.revenue")} AS yoy_pct
FROM by_month c LEFT JOIN by_month p ON c.sale_year = p.sale_year + 1 AND c.sale_month = p.sale_month""",
)

ORACLES["bottlenecks"] = _with(
    _LINES,
    _WAREHOUSES,
    _MONTHLY,
    """
ranked AS (
  SELECT warehouse_name, month_num, fulfillment_rate,
         rank() OVER (PARTITION BY month_num ORDER BY fulfillment_rate) AS month_rank
  FROM monthly
)""",
    select="SELECT * FROM ranked WHERE fulfillment_rate < 45.0",
)

ORACLES["cohort_retention"] = _with(
    _LINES,
    """
active AS (SELECT DISTINCT customer_id, CAST(date_trunc('month', sale_date) AS DATE) AS month FROM fact),
cohorts AS (SELECT customer_id, min(month) AS cohort_month FROM active GROUP BY customer_id),
offsets AS (
  SELECT cohort_month,
         CAST(12 * (year(month) - year(cohort_month)) + month(month) - month(cohort_month) AS INT) AS month_offset,
         count(DISTINCT customer_id) AS active_customers
  FROM active JOIN cohorts USING (customer_id) GROUP BY 1, 2
),
sizes AS (SELECT cohort_month, active_customers AS cohort_size FROM offsets WHERE month_offset = 0)""",
    select="""
SELECT cohort_month, month_offset, active_customers, cohort_size,
       round(active_customers * CAST(100 AS DOUBLE) / cohort_size, 2) AS retention_pct
FROM offsets JOIN sizes USING (cohort_month)""",
)

ORACLES["cohort_retention_bitmaps"] = ORACLES["cohort_retention"]

ORACLES["cohort_retention_by_segment"] = _with(
    _LINES,
    _CUSTOMERS,
    """
active AS (
  SELECT DISTINCT customers.segment, customer_id, CAST(date_trunc('month', sale_date) AS DATE) AS month
  FROM fact JOIN customers USING (customer_id)
),
cohorts AS (SELECT customer_id, min(month) AS cohort_month FROM active GROUP BY customer_id),
offsets AS (
  SELECT segment, cohort_month,
         CAST(12 * (year(month) - year(cohort_month)) + month(month) - month(cohort_month) AS INT) AS month_offset,
         count(DISTINCT customer_id) AS active_customers
  FROM active JOIN cohorts USING (customer_id) GROUP BY 1, 2, 3
),
sizes AS (SELECT segment, cohort_month, active_customers AS cohort_size FROM offsets WHERE month_offset = 0)""",
    select="""
SELECT segment, cohort_month, month_offset, active_customers, cohort_size,
       round(active_customers * CAST(100 AS DOUBLE) / cohort_size, 2) AS retention_pct
FROM offsets JOIN sizes USING (segment, cohort_month)""",
)

ORACLES["ltv_distribution"] = _with(
    _LINES,
    _PRODUCTS,
    _CUSTOMERS,
    _ANALYTICS,
    select="""
SELECT value_quintile, count(*) AS customers, CAST(min(lifetime_value) AS DOUBLE) AS min_ltv,
       CAST(max(lifetime_value) AS DOUBLE) AS max_ltv,
       CAST(sum(lifetime_value) AS DOUBLE) / count(lifetime_value) AS avg_ltv,
       CAST(sum(lifetime_value) AS DOUBLE) AS total_ltv
FROM analytics GROUP BY value_quintile""",
)

# --- quality, catalog, pipeline -------------------------------------------


def _rule(rule: str, table: str, failed: str, source: str) -> str:
    return f"SELECT '{rule}' AS rule, '{table}' AS table_name, {failed} AS failed_rows, count(*) AS total_rows FROM {source}"


def _repeated(rule: str, table: str, keys: str, source: str) -> str:
    return (
        f"SELECT '{rule}', '{table}', CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT), CAST(sum(n) AS BIGINT) "
        f"FROM (SELECT count(*) AS n FROM {source} GROUP BY {keys})"
    )


def _orphans(key: str, parent: str, source: str) -> str:
    return _rule(
        f"orphan:{parent}",
        "fact_sales",
        f"count(*) FILTER ({key} IS NOT NULL AND {key} NOT IN (SELECT {key} FROM {source}))",
        "fact",
    )


_FACT_NOT_NULL = ("order_id", "sale_date", "customer_id", "product_id", "quantity", "unit_price")
_FACT_LENGTHS = {
    "order_id": 50,
    "customer_id": 50,
    "product_id": 50,
    "warehouse_id": 20,
    "region": 50,
    "state_code": 10,
    "state_name": 100,
    "ship_mode": 50,
}
_DQ_RULES = [
    _rule("date:order_date", "raw_transactions", "count(*) FILTER (sale_date IS NULL)", "lines"),
    _rule("date:ship_date", "raw_transactions", "count(*) FILTER (ship_date IS NULL)", "lines"),
    *[_rule(f"not_null:{c}", "fact_sales", f"count(*) FILTER ({c} IS NULL)", "fact") for c in _FACT_NOT_NULL],
    *[
        _rule(f"length:{column}", "fact_sales", f"count(*) FILTER (length({column}) > {limit})", "fact")
        for column, limit in _FACT_LENGTHS.items()
    ],
    _rule("range:quantity", "fact_sales", "count(*) FILTER (quantity <= 0)", "fact"),
    _rule("range:discount_pct", "fact_sales", "count(*) FILTER (discount_pct < 0 OR discount_pct > 1)", "fact"),
    _rule("range:net_revenue", "fact_sales", "count(*) FILTER (net_revenue IS NULL)", "fact"),
    _rule("range:discount_amount", "fact_sales", "count(*) FILTER (discount_amount IS NULL)", "fact"),
    _rule("unique:row_id", "raw_transactions", "0", "lines"),
    _rule("unique:sale_id", "fact_sales", "0", "fact"),
    _rule("order:ship_date", "fact_sales", "count(*) FILTER (ship_date < sale_date)", "fact"),
    _rule("reconcile:bronze", "fact_sales", "count(*) FILTER (sale_date IS NULL)", "lines"),
    _rule("not_null:customer_id", "dim_customers", "count(*) FILTER (customer_id IS NULL)", "customers"),
    _repeated("unique:customer_id", "dim_customers", "customer_id", "customers"),
    _orphans("customer_id", "dim_customers", "customers"),
    _rule("not_null:product_id", "dim_products", "count(*) FILTER (product_id IS NULL)", "products"),
    _repeated("unique:product_id", "dim_products", "product_id", "products"),
    _orphans("product_id", "dim_products", "products"),
    _repeated("unique:warehouse_id", "raw_warehouses", "warehouse_id", "warehouses"),
    _orphans("warehouse_id", "raw_warehouses", "warehouses"),
    _repeated("unique:l_orderkey,l_linenumber", "lineitem", "l_orderkey, l_linenumber", "lineitem"),
]
ORACLES["dq_report"] = _with(
    _LINES,
    _PRODUCTS,
    _WAREHOUSES,
    _CUSTOMERS,
    "results AS (" + "\nUNION ALL ".join(_DQ_RULES) + ")",
    select="SELECT *, CAST(failed_rows = 0 AS INT) AS passed FROM results",
)

ORACLES["table_inventory"] = "\nUNION ALL ".join(
    f"SELECT 'main' AS table_schema, '{t}' AS table_name, count(*) AS row_count FROM {t}"
    for t in (
        *("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"),
        *("documents", "embeddings", "pages", "benchmark", "labels", "conversations"),
    )
)

_STORED = {
    ("bronze", "raw_customers"): "raw_customers",
    ("bronze", "raw_products"): "products",
    ("bronze", "raw_transactions"): "lines",
    ("bronze", "raw_warehouses"): "warehouses",
    ("silver", "dim_customers"): "customers",
    ("silver", "dim_products"): "products",
    ("silver", "fact_sales"): "fact",
    ("silver", "quarantined_sales"): "(SELECT * FROM lines WHERE sale_date IS NULL)",
    ("gold", "customer_features"): "customer_totals",
    ("gold", "product_features"): "(SELECT DISTINCT product_id FROM fact)",
}
ORACLES["medallion_run"] = _with(
    _LINES,
    _PRODUCTS,
    _WAREHOUSES,
    _CUSTOMERS,
    select="\nUNION ALL ".join(
        f"SELECT '{schema}' AS table_schema, '{table}' AS table_name, count(*) AS row_count FROM {source}"
        for (schema, table), source in _STORED.items()
    ),
)

# --- files and streams ----------------------------------------------------

ORACLES["csv_products"] = """
SELECT CAST(p_partkey AS VARCHAR) AS product_id, p_name AS product_name, p_type AS category, p_brand AS sub_category,
       p_brand AS brand, CAST(NULL AS VARCHAR) AS supplier,
       CAST(CAST(0.6 * p_retailprice AS DECIMAL(18,2)) AS DOUBLE) AS unit_cost,
       p_retailprice AS list_price, CAST(p_size AS DOUBLE) AS weight_kg
FROM part"""

ORACLES["stream_csv_customers"] = _with(
    _LINES, _CUSTOMERS, select="SELECT * REPLACE (CAST(signup_date AS VARCHAR) AS signup_date) FROM raw_customers"
)

ORACLES["bronze_loads"] = """
WITH loads AS (SELECT CAST(l_orderkey % 2 AS INT) AS load, count(*) AS n FROM lineitem GROUP BY 1)
SELECT load, n AS sales_lines, n AS row_ids, CAST(coalesce(sum(n) OVER before, 0) AS BIGINT) AS first_id,
       CAST(coalesce(sum(n) OVER before, 0) + n - 1 AS BIGINT) AS last_id
FROM loads WINDOW before AS (ORDER BY load ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""

ORACLES["stream_csv_transactions"] = _with(
    _LINES,
    select="""
SELECT region, count(*) AS sales_lines, count(*) AS row_ids, CASE WHEN grouping(region) = 1 THEN count(*) ELSE 0 END AS id_span
FROM lines GROUP BY ROLLUP (region)""",
)

ORACLES["stream_ingest_counts"] = "SELECT event_type, count(*) AS events FROM events GROUP BY event_type"

ORACLES["stream_daily_revenue"] = """
SELECT CAST(ts AS DATE) AS day, event_type, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS total_value,
       count(value) AS value_count
FROM events GROUP BY 1, 2"""

ORACLES["stream_daily_users"] = """
SELECT CAST(ts AS DATE) AS day, event_type, count(DISTINCT user_id) AS distinct_values FROM events GROUP BY 1, 2"""

ORACLES["csv_ragged_lines"] = """
SELECT CASE WHEN l_orderkey % 71 = 0 THEN 21 WHEN l_orderkey % 73 = 0 THEN 2 ELSE 19 END AS fields, count(*) AS sales_lines,
       count(*) FILTER (l_orderkey % 71 = 0 OR l_orderkey % 73 <> 0) AS with_customer
FROM lineitem GROUP BY 1"""

ORACLES["csv_unreadable_values"] = """
SELECT CASE
    WHEN l_orderkey % 79 = 0 THEN 'unreadable order_date'
    WHEN l_orderkey % 97 = 0 OR l_orderkey % 89 = 0 OR l_orderkey % 83 = 0 THEN 'unreadable ' || array_to_string(list_filter([
      CASE WHEN l_orderkey % 83 = 0 THEN 'quantity' END, CASE WHEN l_orderkey % 97 = 0 THEN 'discount_pct' END,
      CASE WHEN l_orderkey % 89 = 0 THEN 'profit' END], lambda x: x IS NOT NULL), ',')
    ELSE 'kept' END AS outcome, count(*) AS sales_lines
FROM lineitem GROUP BY 1"""

for _stored, _view in (
    ("catalog_fact_sales", "silver_sales"),
    ("silver_sales_other_dates", "silver_sales"),
    ("catalog_customer_features", "customer_features"),
    ("catalog_state_map_feed", "state_map_feed"),
):
    ORACLES[_stored] = ORACLES[_view]

ORACLES["incremental_daily_summary"] = ORACLES["daily_sales_summary"]
