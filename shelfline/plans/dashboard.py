"""The frames a dashboard asks for: filter domains, cards, trend, map and heatmap."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.functions.dates import MONTHS
from shelfline.functions.money import exact_sum, mean_of_averages

Day = dt.date | str

# The date range shown before one is chosen.
DEFAULT_START, DEFAULT_END = "2024-01-01", "2024-12-31"


def query(spark: SparkSession, text: str, **named: object) -> DataFrame:
    """A SQL string with `:name` parameters bound by Spark, never pasted in."""
    return spark.sql(text, args=named or None)


def region_domain(daily: DataFrame) -> DataFrame:
    return _domain(daily, "region")


def category_domain(daily: DataFrame) -> DataFrame:
    return _domain(daily, "product_category")


def _domain(daily: DataFrame, name: str) -> DataFrame:
    return daily.select(name).distinct().orderBy(F.col(name).asc_nulls_last())


def _chosen(
    regions: Sequence[str], start: Day, end: Day, categories: Sequence[str] | None = None
) -> Column:
    """Rows in the selection; an empty selection matches none, as do NULLs."""
    in_time = F.col("sale_date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    chosen = F.col("region").isin(list(regions)) & in_time
    return chosen if categories is None else chosen & F.col("product_category").isin(list(categories))


def _cards(daily: DataFrame) -> DataFrame:
    return daily.agg(
        exact_sum("total_revenue").alias("total_revenue"),
        F.sum("order_count").alias("total_orders"),
        mean_of_averages("avg_order_value").alias("avg_aov"),
        exact_sum("total_profit").alias("total_profit"),
        F.sum("units_sold").alias("total_units"),
        F.count_distinct("sale_date").alias("active_days"),
    )


def dashboard_kpis(
    daily: DataFrame,
    regions: Sequence[str],
    categories: Sequence[str],
    start: Day = DEFAULT_START,
    end: Day = DEFAULT_END,
) -> DataFrame:
    """Card totals of the selection, from `daily_sales` or its summary.

    `total_orders` adds up daily category counts, so an order over two
    categories counts twice; `avg_aov` is the plain mean of group averages.
    """
    return _cards(daily.where(_chosen(regions, start, end, categories)))


def kpis_last_month(daily: DataFrame, as_of: Day | None = None) -> DataFrame:
    """Revenue, orders, mean order value and active days since a month before
    `as_of`, which is today unless given."""
    today = F.current_date() if as_of is None else F.lit(as_of).cast("date")
    since = F.add_months(today, -1)
    return _cards(daily.where(F.col("sale_date") >= since)).select(
        "total_revenue", "total_orders", "avg_aov", "active_days"
    )


def revenue_trend(
    summary: DataFrame,
    regions: Sequence[str],
    categories: Sequence[str],
    start: Day = DEFAULT_START,
    end: Day = DEFAULT_END,
) -> DataFrame:
    """Revenue and rolling revenue per day and region of the selection.

    Dates and categories are cut after the rolling sums, so the first days
    still look back in full.
    """
    return (
        summary.where(_chosen(regions, start, end, categories))
        .groupBy("sale_date", "region")
        .agg(exact_sum("total_revenue").alias("revenue"), exact_sum("rolling_7d_revenue").alias("rolling_7d"))
        .orderBy(F.col("sale_date").asc_nulls_last(), F.col("region").asc_nulls_last())
    )


def revenue_trend_full_grain(
    summary: DataFrame, regions: Sequence[str], start: Day = DEFAULT_START, end: Day = DEFAULT_END
) -> DataFrame:
    """The trend with a row per day, region and category."""
    return (
        summary.where(_chosen(regions, start, end))
        .select("sale_date", "region", "total_revenue", "rolling_7d_revenue")
        .orderBy(F.col("sale_date").asc_nulls_last(), F.col("region").asc_nulls_last())
    )


def category_hierarchy_revenue(performance: DataFrame) -> DataFrame:
    """Revenue per category and subcategory, from `product_sales` or its ranked form."""
    return performance.groupBy("product_category", "product_subcategory").agg(
        exact_sum("revenue").alias("total_revenue")
    )


def top_products(performance: DataFrame, n: int = 15) -> DataFrame:
    """The `n` products with the most revenue; equal revenue goes by name."""
    names = ("product_name", "product_category", "product_subcategory")
    order = [F.col("revenue").desc_nulls_last(), *[F.col(name).asc_nulls_last() for name in names]]
    return performance.orderBy(*order).limit(n).select("product_name", "product_category", "revenue", "profit_margin_pct")


def fulfillment_long(monthly: DataFrame) -> DataFrame:
    return monthly.select("warehouse_name", "month_name", "month_num", "fulfillment_rate").orderBy(
        F.col("warehouse_name").asc_nulls_last(), "month_num"
    )


def fulfillment_heatmap(monthly: DataFrame, present_only: bool = False) -> DataFrame:
    """On-time share with a column per month; `present_only` drops empty months."""
    months = list(MONTHS)
    if present_only:  # at most twelve rows come back
        found = {row.month_num for row in monthly.select("month_num").distinct().collect()}
        months = [label for number, label in enumerate(MONTHS, 1) if number in found]
    return monthly.groupBy("warehouse_name").pivot("month_name", months).agg(F.first("fulfillment_rate"))


def state_map_feed(regional: DataFrame) -> DataFrame:
    return regional.select("state_code", "state_name", "total_revenue", "total_orders", "unique_customers")


def state_rollup(regional: DataFrame) -> DataFrame:
    return regional.groupBy("state_code", "state_name").agg(exact_sum("total_revenue").alias("revenue"))
