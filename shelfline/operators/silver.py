"""Bronze order lines to the silver sales fact, and the lines it cannot take."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.functions.dates import ISO_DATE, parsed_date, quarter_number
from shelfline.schemas import FACT_SALES, MONEY, PRICE, RATE, UNREADABLE, conform

# Numbers a sales line is priced by; text in them that is no number is kept by
# name in `UNREADABLE` at load.
PRICED_BY = ("quantity", "unit_price", "discount_pct", "profit")

BUSINESS_COLUMNS = [name for name in FACT_SALES.names if name not in ("sale_id", "_processed_at")]


def silver_sales(
    transactions: DataFrame,
    warehouses: DataFrame | None = None,
    state_codes: DataFrame | None = None,
    compat_quarter: bool = False,
    date_formats: Sequence[str] = (ISO_DATE,),
    arranged: Callable[[DataFrame], DataFrame] = lambda typed: typed,
) -> DataFrame:
    """Typed, enriched sales lines with the declared fact columns.

    Narrow but for the lookups, which hold a row per state or region; Spark
    broadcasts them by their measured size. A cast to money rounds half up at
    its scale. Lines with a reason in `rejection` are left to
    `quarantined_sales`. `sale_id` is the line's `row_id`, given at load, so a
    task that is run again gives the same ids; only lines that never had one
    are numbered here, before any shuffle of this function. `arranged` may deal
    and sort the typed lines by their dates and ids, behind the lookups: what
    follows from a line's own values is added last and need not be moved.
    """
    typed = with_row_id(transactions).where(rejection(transactions, date_formats).isNull()).select(
        F.col("row_id").alias("sale_id"),
        "order_id",
        parsed_date("order_date", date_formats).alias("sale_date"),
        parsed_date("ship_date", date_formats).alias("ship_date"),
        "customer_id",
        "product_id",
        _warehouse_column(transactions),
        "region",
        "state",
        F.col("quantity").cast("long").alias("quantity"),
        F.col("unit_price").alias("raw_price"),
        F.coalesce(F.col("discount_pct"), F.lit(0.0)).try_cast(RATE).alias("discount_pct"),
        F.col("profit").try_cast(MONEY).alias("profit"),
        "ship_mode",
    )

    placed = _with_state_code(_with_warehouse(typed, warehouses), state_codes)
    priced = (
        arranged(placed).withColumn("gross_revenue", (F.col("quantity") * F.col("raw_price")).try_cast(MONEY))
        .withColumn("discount_amount", (F.col("gross_revenue") * F.col("discount_pct")).try_cast(MONEY))
        .withColumns(
            {
                "net_revenue": (F.col("gross_revenue") - F.col("discount_amount")).try_cast(MONEY),
                "unit_price": F.col("raw_price").try_cast(PRICE),
                "days_to_ship": F.datediff("ship_date", "sale_date"),
                "sale_year": F.year("sale_date"),
                "sale_month": F.month("sale_date"),
                "sale_quarter": quarter_number("sale_date", compat_quarter),
            }
        )
    )
    return conform(priced, FACT_SALES)


def with_row_id(transactions: DataFrame) -> DataFrame:
    """Lines with a number each; those that have none get a negative one."""
    number = -1 - F.monotonically_increasing_id()
    given = F.coalesce("row_id", number) if "row_id" in transactions.columns else number
    return transactions.withColumn("row_id", given)


def rejection(transactions: DataFrame, date_formats: Sequence[str] = (ISO_DATE,)) -> Column:
    """Why a bronze line cannot become a sale: no readable order date, or a
    number it is priced by that could not be read. NULL if it can."""
    date = F.when(F.col("order_date").isNull(), "missing order_date").when(
        parsed_date("order_date", date_formats).isNull(), "unreadable order_date"
    )
    if UNREADABLE not in transactions.columns:
        return date
    bad = F.array_intersect(F.coalesce(F.col(UNREADABLE), F.array().cast("array<string>")), F.array(*map(F.lit, PRICED_BY)))
    return F.coalesce(date, F.when(F.size(bad) > 0, F.concat(F.lit("unreadable "), F.array_join(bad, ","))))


def quarantined_sales(transactions: DataFrame, date_formats: Sequence[str] = (ISO_DATE,)) -> DataFrame:
    """Bronze lines with a `rejection`, kept as they came."""
    return transactions.withColumn("_reason", rejection(transactions, date_formats)).where("_reason IS NOT NULL")


def _warehouse_column(transactions: DataFrame) -> Column:
    named = F.col("warehouse_id") if "warehouse_id" in transactions.columns else F.lit(None)
    return named.cast("string").alias("warehouse_id")


def _with_warehouse(sales: DataFrame, warehouses: DataFrame | None) -> DataFrame:
    """Fill a missing warehouse: lowest id in the state, else in the region."""
    if warehouses is None:
        return sales
    lowest = F.min("warehouse_id")
    by_state = warehouses.groupBy("state").agg(lowest.alias("state_warehouse"))
    by_region = warehouses.groupBy("region").agg(lowest.alias("region_warehouse"))
    return (
        sales.join(by_state, "state", "left")
        .join(by_region, "region", "left")
        .withColumn("warehouse_id", F.coalesce("warehouse_id", "state_warehouse", "region_warehouse"))
    )


def _with_state_code(sales: DataFrame, state_codes: DataFrame | None) -> DataFrame:
    named = sales.withColumnRenamed("state", "state_name")
    if state_codes is None:
        return named.withColumn("state_code", F.lit(None).cast("string"))
    one_each = state_codes.groupBy("state_name").agg(F.min("state_code").alias("state_code"))
    return named.join(one_each, "state_name", "left")
