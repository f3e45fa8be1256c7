"""Silver customer and product dimensions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.functions.dates import ISO_DATE, parsed_date
from shelfline.functions.money import exact_sum, percent
from shelfline.operators.gold import with_value_tiles
from shelfline.schemas import DIM_CUSTOMERS, DIM_PRODUCTS, MONEY, conform

# Customer segment per value quintile, then for no sales at all.
SEGMENTS = {1: "Champion", 2: "Loyal", 3: "Core", 4: "Occasional", 5: "Low"}
NO_SALES = "Inactive"


def customer_value(fact: DataFrame, customers: DataFrame) -> DataFrame:
    """Lifetime value and value quintile of every listed customer with sales."""
    totals = fact.groupBy("customer_id").agg(exact_sum("net_revenue").alias("lifetime_value"))
    listed = totals.join(customers.select("customer_id"), "customer_id", "left_semi")
    return with_value_tiles(listed)


def dim_customers(customers: DataFrame, fact: DataFrame, date_formats: Sequence[str] = (ISO_DATE,)) -> DataFrame:
    """Customers with a typed signup date and a segment from their sales so far."""
    tiles = customer_value(fact, customers).select("customer_id", "value_quintile")
    segment = F.lit(NO_SALES)
    for tile, label in SEGMENTS.items():
        segment = F.when(F.col("value_quintile") == tile, label).otherwise(segment)
    typed = (
        customers.join(tiles, "customer_id", "left")
        .withColumn("signup_date", parsed_date("signup_date", date_formats))
        .withColumn("customer_segment", segment)
    )
    return conform(typed, DIM_CUSTOMERS)


def dim_products(products: DataFrame) -> DataFrame:
    """Products under their silver names with the list-price margin."""
    renamed = products.withColumnsRenamed(
        {"category": "product_category", "sub_category": "product_subcategory"}
    ).withColumns({"unit_cost": F.col("unit_cost").try_cast(MONEY), "list_price": F.col("list_price").try_cast(MONEY)})
    margin = percent(F.col("list_price") - F.col("unit_cost"), F.col("list_price"))
    return conform(renamed.withColumn("margin_pct", margin), DIM_PRODUCTS)
