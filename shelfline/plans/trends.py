"""Growth, bottleneck, cohort and season reports over the fact and gold views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfline.functions.dates import month_index, month_start
from shelfline.functions.money import exact_avg, exact_sum, growth_percent, ratio
from shelfline.operators.ordered import with_rank


def _months_back(value: str, months: int, keys: tuple[str, ...] = ()) -> Column:
    """`value` of the calendar month `months` earlier, NULL when it had none.

    Runs over rows already summed to one per month and key, so a window group
    holds no more rows than the calendar has months.
    """
    window = Window.partitionBy(*keys).orderBy("_month_index").rangeBetween(-months, -months)
    return F.first(value).over(window)


def mom_growth(fact: DataFrame) -> DataFrame:
    """Revenue, orders and average order value per month against the month before."""
    monthly = (
        fact.groupBy(month_start("sale_date").alias("month"))
        .agg(
            exact_sum("net_revenue").alias("revenue"),
            F.count_distinct("order_id").alias("orders"),
            exact_avg("net_revenue").alias("aov"),
        )
        .withColumn("_month_index", month_index("month"))
    )
    return monthly.withColumns(
        {
            "prev_revenue": _months_back("revenue", 1),
            "_prev_orders": _months_back("orders", 1),
            "_prev_aov": _months_back("aov", 1),
        }
    ).select(
        "month",
        "revenue",
        "orders",
        "aov",
        "prev_revenue",
        growth_percent(F.col("revenue"), F.col("prev_revenue")).alias("mom_revenue_pct"),
        growth_percent(F.col("orders"), F.col("_prev_orders")).alias("mom_orders_pct"),
        growth_percent(F.col("aov"), F.col("_prev_aov")).alias("mom_aov_pct"),
    )


def state_growth(fact: DataFrame) -> DataFrame:
    """Revenue per state and month against the month before."""
    monthly = (
        fact.groupBy("state_name", month_start("sale_date").alias("month"))
        .agg(exact_sum("net_revenue").alias("revenue"))
        .withColumn("_month_index", month_index("month"))
    )
    return monthly.withColumn("prev_revenue", _months_back("revenue", 1, ("state_name",))).select(
        "state_name",
        "month",
        "revenue",
        "prev_revenue",
        growth_percent(F.col("revenue"), F.col("prev_revenue")).alias("growth_pct"),
    )


def yoy_seasonal(fact: DataFrame) -> DataFrame:
    """Revenue per year and month next to the same month a year before."""
    monthly = (
        fact.groupBy("sale_year", "sale_month")
        .agg(exact_sum("net_revenue").alias("revenue"))
        .withColumn("_month_index", F.col("sale_year") * 12 + F.col("sale_month"))
    )
    return monthly.withColumn("prev_year_revenue", _months_back("revenue", 12)).select(
        "sale_year",
        "sale_month",
        "revenue",
        "prev_year_revenue",
        growth_percent(F.col("revenue"), F.col("prev_year_revenue")).alias("yoy_pct"),
    )


def bottlenecks(monthly: DataFrame, threshold: float = 80.0) -> DataFrame:
    """Warehouse months below the on-time threshold, with their rank from the
    lowest among all warehouses of the month."""
    rates = monthly.select("warehouse_name", "month_num", "fulfillment_rate")
    ranked = with_rank(rates, ["month_num"], "fulfillment_rate", "month_rank", descending=False)
    return ranked.where(F.col("fulfillment_rate") < threshold)


def cohort_retention(fact: DataFrame) -> DataFrame:
    """Customers active per month after the month of their first purchase.

    Lines are first reduced to one row per customer and month.
    """
    active = (
        fact.where(F.col("customer_id").isNotNull())
        .select("customer_id", month_start("sale_date").alias("month"))
        .distinct()
        .withColumn("cohort_month", F.min("month").over(Window.partitionBy("customer_id")))
    )
    per_offset = active.groupBy(
        "cohort_month", (month_index("month") - month_index("cohort_month")).alias("month_offset")
    ).agg(F.count(F.lit(1)).alias("active_customers"))
    size = F.max(F.when(F.col("month_offset") == 0, F.col("active_customers")))
    return per_offset.withColumn("cohort_size", size.over(Window.partitionBy("cohort_month"))).withColumn(
        "retention_pct", F.round(ratio(F.col("active_customers") * 100, F.col("cohort_size")), 2)
    )


def ltv_distribution(analytics: DataFrame) -> DataFrame:
    """Spread of customer lifetime value within each value quintile."""
    return analytics.groupBy("value_quintile").agg(
        F.count(F.lit(1)).alias("customers"),
        F.min("lifetime_value").alias("min_ltv"),
        F.max("lifetime_value").alias("max_ltv"),
        ratio(F.sum("lifetime_value"), F.count("lifetime_value")).alias("avg_ltv"),
        exact_sum("lifetime_value").alias("total_ltv"),
    )
