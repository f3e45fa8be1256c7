"""The gold views: each a function of silver DataFrames, evaluated when used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfline.functions.dates import month_label
from shelfline.functions.money import exact_avg, exact_sum, growth_percent, percent, ratio
from shelfline.operators.ordered import over_last_rows, with_rank, with_tiles

# Shipped within this many days counts as fulfilled in time.
ON_TIME_DAYS = 3
VALUE_TILES = 5
# Rows before its own that the longest rolling measure looks at.
ROLLING_REACH = 29
# Rows back in its series that a day's growth is measured against.
LAG_ROWS = 7


def _distinct(name: str, approx: bool) -> Column:
    return F.approx_count_distinct(name) if approx else F.count_distinct(F.col(name))


def _distinct_apart(name: str, approx: bool) -> Column:
    """`_distinct` for groups with many sums: by its filter, which every counted
    value passes, Spark counts in rows of their own that hold key and value. The
    sums are not carried with every value and merge within a task."""
    if approx:
        return _distinct(name, approx)
    return F.expr(f"count(DISTINCT `{name}`) FILTER (WHERE `{name}` IS NOT NULL)")


def daily_sales(fact: DataFrame, products: DataFrame | None = None, approx: bool = False) -> DataFrame:
    """Sales per day, region and product category.

    With `products` the category is looked up and lines of unknown products
    drop out; without, `fact` must carry `product_category`.
    """
    lines = fact if products is None else _with_category(fact, products)
    return lines.groupBy("sale_date", "region", "product_category").agg(
        _distinct("order_id", approx).alias("order_count"),
        F.sum("quantity").alias("units_sold"),
        exact_sum("net_revenue").alias("total_revenue"),
        exact_avg("net_revenue").alias("avg_order_value"),
        exact_sum("discount_amount").alias("total_discounts"),
        *([] if products is None else [exact_sum("profit").alias("total_profit")]),
    )


def daily_sales_summary(
    fact: DataFrame, products: DataFrame | None = None, approx: bool = False
) -> DataFrame:
    """`daily_sales` with rolling, look-back and week-over-week measures.

    The rolling measures run over the last 7 or 30 *rows* of a region in
    (date, category) order; `rolling_7d_calendar` is the one over days.
    """
    rolled = with_rolling(daily_sales(fact, products, approx), month=products is not None)
    # At most one row per day in this window's groups.
    series = Window.partitionBy("region", "product_category").orderBy("sale_date")
    return rolled.withColumn("revenue_7d_ago", F.lag("total_revenue", LAG_ROWS).over(series)).withColumn(
        "wow_growth_pct", growth_percent(F.col("total_revenue"), F.col("revenue_7d_ago"))
    )


def with_rolling(daily: DataFrame, month: bool, days: DataFrame | None = None) -> DataFrame:
    """`daily` with its rolling measures; `days` are its rows per region and
    day where these are stored already (`lookback.region_days`)."""

    def rolling(window) -> dict[str, Column]:
        last_week, last_month = window.rowsBetween(-6, 0), window.rowsBetween(-ROLLING_REACH, 0)
        added = {"rolling_7d_revenue": F.sum("total_revenue").over(last_week)}
        if month:
            added["rolling_30d_avg"] = exact_avg("total_revenue", lambda column: column.over(last_month))
        return added

    return over_last_rows(daily, ["region"], ["sale_date", "product_category"], ROLLING_REACH, rolling, days=days)


def rolling_7d_calendar(fact: DataFrame) -> DataFrame:
    """Revenue per region and day with the sum over the last seven calendar days."""
    daily = fact.groupBy("region", "sale_date").agg(exact_sum("net_revenue").alias("revenue"))
    last_week = Window.partitionBy("region").orderBy(F.unix_date("sale_date")).rangeBetween(-6, 0)
    return daily.select(
        "sale_date", "region", "revenue", F.sum("revenue").over(last_week).alias("rolling_7d_calendar")
    )


def product_sales(fact: DataFrame, products: DataFrame, approx: bool = False) -> DataFrame:
    """Sales and margin per product name; products of one name are one row."""
    named = products.select("product_id", "product_category", "product_subcategory", "product_name")
    return (
        fact.join(named, "product_id")
        .groupBy("product_category", "product_subcategory", "product_name")
        .agg(
            _distinct_apart("order_id", approx).alias("total_orders"),
            F.sum("quantity").alias("total_units_sold"),
            exact_sum("net_revenue").alias("revenue"),
            exact_sum("profit").alias("profit"),
            exact_avg("unit_price").alias("avg_selling_price"),
            exact_avg("discount_pct").alias("avg_discount"),
        )
        .withColumn("profit_margin_pct", percent(F.col("profit"), F.col("revenue")))
    )


def product_performance(fact: DataFrame, products: DataFrame, approx: bool = False) -> DataFrame:
    """`product_sales` ranked by revenue within the category."""
    sales = product_sales(fact, products, approx)
    return with_rank(sales, ["product_category"], "revenue", "category_revenue_rank", once=True)


def warehouse_monthly_performance(fact: DataFrame, warehouses: DataFrame, approx: bool = False) -> DataFrame:
    """Orders, units and on-time share per warehouse and month of the year."""
    named = warehouses.select("warehouse_id", "warehouse_name")
    on_time = F.when(F.col("days_to_ship") <= ON_TIME_DAYS, 1).otherwise(0)
    return (
        fact.join(named, "warehouse_id")
        .groupBy(
            "warehouse_name",
            F.month("sale_date").alias("month_num"),
            month_label("sale_date").alias("month_name"),
        )
        .agg(
            _distinct("order_id", approx).alias("total_orders"),
            F.sum("quantity").alias("units_fulfilled"),
            exact_sum("net_revenue").alias("revenue"),
            exact_avg("days_to_ship").alias("avg_days_to_ship"),
            percent(F.sum(on_time), F.count(F.lit(1)), 1).alias("fulfillment_rate"),
        )
    )


def regional_sales(fact: DataFrame, approx: bool = False) -> DataFrame:
    """Sales per state; every fact line counts, known product or not."""
    return fact.groupBy("state_code", "state_name", "region").agg(
        _distinct("order_id", approx).alias("total_orders"),
        _distinct("customer_id", approx).alias("unique_customers"),
        exact_sum("net_revenue").alias("total_revenue"),
        exact_sum("profit").alias("total_profit"),
        exact_avg("net_revenue").alias("avg_order_value"),
        F.sum("quantity").alias("total_units"),
    )


def customer_analytics(
    fact: DataFrame,
    customers: DataFrame,
    products: DataFrame,
    approx: bool = False,
) -> DataFrame:
    """Value, tenure and value quintile per customer (1 = highest value).

    Lines are summed per order, then per customer id, before customers are
    joined, so no hot customer reaches the join; the last grouping stays on the
    same partitioning and only merges customers listed twice.
    """
    lines = _with_category(fact, products)
    per_order = lines.groupBy("customer_id", "order_id").agg(
        exact_sum("net_revenue").alias("net"),
        F.count("net_revenue").alias("net_lines"),
        F.min("sale_date").alias("first_date"),
        F.max("sale_date").alias("last_date"),
    )
    per_id = per_order.groupBy("customer_id").agg(
        (F.approx_count_distinct("order_id") if approx else F.count("order_id")).alias("orders"),
        exact_sum("net").alias("net"),
        F.sum("net_lines").alias("net_lines"),
        F.min("first_date").alias("first_date"),
        F.max("last_date").alias("last_date"),
    )
    bought = lines.select("customer_id", "product_category").distinct()
    categories = bought.groupBy("customer_id").agg(F.count("product_category").alias("categories"))
    per_id = per_id.join(categories, "customer_id")
    identity = ["customer_id", "customer_name", "segment", "region", "loyalty_tier"]
    listed = customers.select(*identity)
    per_customer = (
        per_id.join(listed, "customer_id")
        .groupBy(*identity)
        .agg(
            F.max("orders").alias("total_orders"),
            exact_sum("net").alias("lifetime_value"),
            ratio(F.sum("net"), F.sum("net_lines")).alias("avg_order_value"),
            F.min("first_date").alias("first_purchase"),
            F.max("last_date").alias("last_purchase"),
            F.max("categories").alias("categories_purchased"),
        )
        .select(
            *identity,
            "total_orders",
            "lifetime_value",
            "avg_order_value",
            "first_purchase",
            "last_purchase",
            F.datediff("last_purchase", "first_purchase").alias("customer_tenure_days"),
            "categories_purchased",
        )
    )
    net = lines.groupBy("customer_id").agg(exact_sum("net_revenue").alias("net"))
    worth = net.join(listed, "customer_id").groupBy(*identity).agg(exact_sum("net").alias("lifetime_value"))
    return with_value_tiles(per_customer, worth)


def with_value_tiles(customers: DataFrame, worth: DataFrame | None = None) -> DataFrame:
    """Quintile of the lifetime value, 1 the highest; equal values by id.
    `worth` may give id and value of the same rows from a narrower plan."""
    return with_tiles(customers, VALUE_TILES, "lifetime_value", "customer_id", "value_quintile", narrow=worth)


def kpi_summary(fact: DataFrame, approx: bool = False) -> DataFrame:
    """Headline totals over all sales, one row.

    Each distinct count reads its own column, so no line is multiplied; the
    four one-row results are put side by side by an aggregate.
    """
    totals = fact.agg(
        exact_sum("net_revenue").alias("total_revenue"),
        exact_avg("net_revenue").alias("avg_order_value"),
        exact_sum("profit").alias("total_profit"),
        percent(F.sum("profit"), F.sum("net_revenue")).alias("overall_margin_pct"),
    )
    counts = {"total_orders": "order_id", "unique_customers": "customer_id", "products_sold": "product_id"}
    rows = totals
    for name, column in counts.items():
        rows = rows.unionByName(fact.agg(_distinct(column, approx).alias(name)), allowMissingColumns=True)
    order = ["total_orders", "total_revenue", "avg_order_value", "total_profit", "unique_customers", "products_sold", "overall_margin_pct"]
    return rows.agg(*(F.max(name).alias(name) for name in order))


def _with_category(fact: DataFrame, products: DataFrame) -> DataFrame:
    return fact.join(products.select("product_id", "product_category"), "product_id")
