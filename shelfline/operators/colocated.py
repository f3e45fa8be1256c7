"""Feature tables from sums that lie where they are needed.

A load's lines are summed once per id and month and appended to a table
bucketed by the id; the dimension is bucketed alike. Spark then groups the sums
by id and joins the dimension bucket by bucket, without moving a row, however
often the feature tables are read. Lines are summed before they are dealt to
buckets, so an id that a third of all lines have is a row per month in its
bucket, not a third of the fact. A load adds its own sums and leaves the others
as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.functions.dates import month_start
from shelfline.functions.money import ratio
from shelfline.operators.features import customer_profiles, product_profiles
from shelfline.sources.catalog import append_bucketed, overwrite_bucketed

BUCKETS = 64

# Column of the sums: how a line adds to it.
CUSTOMER_SUMS = {
    "lines": F.count,
    "net_revenue": F.sum,
    "priced_lines": F.count,
    "quantity": F.sum,
    "first_purchase": F.min,
    "last_purchase": F.max,
}
CUSTOMER_SOURCES = {"lines": "order_id", "priced_lines": "net_revenue", "first_purchase": "sale_date", "last_purchase": "sale_date"}
PRODUCT_SUMS = {
    "lines": F.count,
    "quantity": F.sum,
    "net_revenue": F.sum,
    "profit": F.sum,
    "unit_price": F.sum,
    "priced_lines": F.count,
    "discount_pct": F.sum,
    "discounted_lines": F.count,
}
PRODUCT_SOURCES = {"lines": "order_id", "priced_lines": "unit_price", "discounted_lines": "discount_pct"}


def _per_month(fact: DataFrame, key: str, sums: dict, sources: dict[str, str]) -> DataFrame:
    added = [how(sources.get(name, name)).alias(name) for name, how in sums.items()]
    return fact.groupBy(key, month_start("sale_date").alias("month")).agg(*added)


def customer_months(fact: DataFrame) -> DataFrame:
    """Sums per customer and month that add up over months and loads."""
    return _per_month(fact, "customer_id", CUSTOMER_SUMS, CUSTOMER_SOURCES)


def product_months(fact: DataFrame) -> DataFrame:
    """Sums per product and month that add up over months and loads."""
    return _per_month(fact, "product_id", PRODUCT_SUMS, PRODUCT_SOURCES)


def _added(sums: dict) -> list[Column]:
    return [(F.sum if how is F.count else how)(name).alias(name) for name, how in sums.items()]


def create(database: str, customers: DataFrame, products: DataFrame, buckets: int = BUCKETS) -> None:
    """Both dimensions, bucketed by their ids; sums added earlier go.

    Every later load must use as many buckets.
    """
    spark = customers.sparkSession
    overwrite_bucketed(customers, f"{database}.customers_by_id", "customer_id", buckets)
    overwrite_bucketed(products, f"{database}.products_by_id", "product_id", buckets)
    for name in ("customer_months", "product_months"):
        spark.sql(f"DROP TABLE IF EXISTS {database}.{name}")


def add_lines(database: str, fact: DataFrame, buckets: int = BUCKETS) -> None:
    """Add the sums of the lines of one load."""
    append_bucketed(customer_months(fact), f"{database}.customer_months", "customer_id", buckets)
    append_bucketed(product_months(fact), f"{database}.product_months", "product_id", buckets)


def customer_features(months: DataFrame, customers: DataFrame) -> DataFrame:
    """`features.customer_features` of all lines added to `months`."""
    added = months.groupBy("customer_id").agg(*_added(CUSTOMER_SUMS))
    per_customer = added.select(
        "customer_id",
        F.col("lines").alias("total_orders"),
        F.col("net_revenue").alias("lifetime_value"),
        ratio(F.col("net_revenue"), F.col("priced_lines")).alias("avg_order_value"),
        F.col("quantity").alias("total_units"),
        "first_purchase",
        "last_purchase",
    )
    return customer_profiles(per_customer, customers)


def product_features(months: DataFrame, products: DataFrame) -> DataFrame:
    """`features.product_features` of all lines added to `months`."""
    added = months.groupBy("product_id").agg(*_added(PRODUCT_SUMS))
    per_product = added.select(
        "product_id",
        F.col("lines").alias("total_orders"),
        F.col("quantity").alias("total_units_sold"),
        F.col("net_revenue").alias("total_revenue"),
        F.col("profit").alias("total_profit"),
        ratio(F.col("unit_price"), F.col("priced_lines")).alias("avg_selling_price"),
        ratio(F.col("discount_pct"), F.col("discounted_lines")).alias("avg_discount_rate"),
    )
    return product_profiles(per_product, products)
