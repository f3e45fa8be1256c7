"""Rolling measures over a date range that read only what their frames reach.

Rows of a region stand in (date, category) order, so how far back 29 rows lie
depends on how many categories sold on which days. `region_days` holds that
number per region and day with its running sum, a row per region and day; it
is stored beside the fact. From it comes the day at which reading may begin,
as a date bound that reaches the files, and the place of every row, so the
counts are not taken from the sales again.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfline.operators.gold import ROLLING_REACH, daily_sales, with_rolling

Day = dt.date | str


def region_days(fact: DataFrame, products: DataFrame) -> DataFrame:
    """region, sale_date, `_rows` (categories sold that day) and `_days_ahead`
    (rows of the region before that day)."""
    category = products.select("product_id", "product_category")
    sold = fact.select("product_id", "region", "sale_date").join(category, "product_id")
    per_day = sold.select("region", "sale_date", "product_category").distinct().groupBy("region", "sale_date").agg(F.count(F.lit(1)).alias("_rows"))
    # One row per day in this window's groups.
    earlier = Window.partitionBy("region").orderBy(F.col("sale_date").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    return per_day.withColumn("_days_ahead", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))


def first_day(days: DataFrame, regions: Sequence[str], start: Day, reach: int) -> dt.date | None:
    """The latest day from which every region in `regions` has `reach` rows
    before `start`, or all the rows it has. NULL if none has any.

    A small job over `region_days`; one row comes back.
    """
    before = days.where(F.col("region").isin(list(regions)) & (F.col("sale_date") < F.lit(start).cast("date")))
    ends = before.groupBy("region").agg(F.max(F.col("_days_ahead") + F.col("_rows")).alias("_end"))
    behind = F.col("_end") - F.col("_days_ahead")
    needed = before.join(ends, "region").groupBy("region").agg(
        F.coalesce(F.max(F.when(behind >= reach, F.col("sale_date"))), F.min("sale_date")).alias("_day")
    )
    return needed.agg(F.min("_day")).first()[0]


def summary_in_range(
    fact: DataFrame, products: DataFrame, days: DataFrame, regions: Sequence[str], start: Day, end: Day
) -> DataFrame:
    """The rows of `daily_sales_summary` of `regions` between `start` and `end`
    without its week-over-week columns; equal to cutting the whole view.

    `days` must be `region_days` of the same tables.
    """
    since = first_day(days, regions, start, ROLLING_REACH)
    first = F.lit(start if since is None else since).cast("date")
    reached = fact.where(F.col("region").isin(list(regions)) & F.col("sale_date").between(first, F.lit(end).cast("date")))
    near = days.where(F.col("sale_date").between(first, F.lit(end).cast("date")))
    rolled = with_rolling(daily_sales(reached, products), month=True, days=near)
    return rolled.where(F.col("sale_date") >= F.lit(start).cast("date"))
