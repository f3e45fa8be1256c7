"""The batch run over catalog tables: bronze to silver to gold."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.operators import gold as views
from shelfline.operators.dimensions import dim_customers, dim_products
from shelfline.operators.features import customer_features, product_features
from shelfline.operators.silver import quarantined_sales, silver_sales
from shelfline.functions.dates import ISO_DATE
from shelfline.schemas import BRONZE, RAW_LINE, UNREADABLE, conform
from shelfline.sources.catalog import append_table, clustered_by_date, database_folder, overwrite_table
from shelfline.sources.keys import completed, is_staged, numbered

KEY = "row_id"


def _as_bronze(df: DataFrame, name: str) -> DataFrame:
    """`df` in the table's schema; sales lines may name their warehouse."""
    extra = ("warehouse_id",) if name == "raw_transactions" else ()
    return conform(df, BRONZE[name], (*extra, UNREADABLE, RAW_LINE))


def _ledger(spark: SparkSession, database: str, name: str) -> str:
    return f"{database_folder(spark, database)}/_keys/{name}"


def load_bronze(spark: SparkSession, database: str = "bronze", load: str | None = None, **tables: DataFrame) -> dict[str, int]:
    """Overwrite bronze tables with `tables`, each conformed to its schema.

    Rows without a `row_id` get one that no earlier load of the table had. A
    load that is repeated under its name gives its rows the same ids again.
    Tables that bring the column are written before their ids are looked at,
    and once more only if some row has none.
    """
    counts = {}
    for name, df in tables.items():
        table, rows = f"{database}.{name}", _as_bronze(df, name)
        if KEY not in rows.columns:
            counts[name] = overwrite_table(rows, table)
            continue
        ledger, attempt = _ledger(spark, database, name), load or uuid.uuid4().hex
        if KEY in df.columns and not is_staged(spark, ledger, attempt):
            counts[name] = overwrite_table(rows, table, lambda written: completed(written, ledger, attempt, KEY))
        else:
            counts[name] = overwrite_table(numbered(rows, ledger, attempt, KEY)[0], table)
    return counts


def append_bronze(spark: SparkSession, load: str, database: str = "bronze", **tables: DataFrame) -> dict[str, int]:
    """Add the rows of load `load` to bronze tables that number their rows.

    A load whose ids the table holds already is not added again, so a run that
    failed after its write may be repeated. Returns the rows added.
    """
    added = {}
    for name, df in tables.items():
        if KEY not in BRONZE[name].names:
            raise ValueError(f"{name} has no {KEY}; overwrite it")
        rows, (first, end) = numbered(_as_bronze(df, name), _ledger(spark, database, name), load)
        table = f"{database}.{name}"
        there = spark.table(table).where((F.col(KEY) >= first) & (F.col(KEY) < end)).limit(1).count()
        added[name] = 0 if there else end - first
        if not there and end > first:
            known = spark.table(table).columns
            append_table(rows.select(*(F.col(c) if c in rows.columns else F.lit(None).alias(c) for c in known)), table)
    return added


def run_all(
    spark: SparkSession,
    bronze: str = "bronze",
    silver: str = "silver",
    gold: str = "gold",
    state_codes: DataFrame | None = None,
    compat_quarter: bool = False,
    date_formats: Sequence[str] = (ISO_DATE,),
) -> DataFrame:
    """Build the sales fact, the dimensions and both feature tables.

    `date_formats` are tried in their order on every date of the source. Each
    step reads the tables written before it; the first failure stops the
    run. Returns a row (table_name, row_count) per table written.
    """
    counts: dict[str, int] = {}

    def publish(table: str, df: DataFrame) -> DataFrame:
        counts[table] = overwrite_table(df, table)
        return spark.table(table)

    raw = spark.table(f"{bronze}.raw_transactions")
    warehouses = spark.table(f"{bronze}.raw_warehouses")
    sales = silver_sales(raw, warehouses, state_codes, compat_quarter, date_formats, arranged=clustered_by_date)
    fact = publish(f"{silver}.fact_sales", sales)
    publish(f"{silver}.quarantined_sales", quarantined_sales(raw, date_formats))
    products = publish(f"{silver}.dim_products", dim_products(spark.table(f"{bronze}.raw_products")))
    customers = publish(f"{silver}.dim_customers", dim_customers(spark.table(f"{bronze}.raw_customers"), fact, date_formats))
    publish(f"{gold}.customer_features", customer_features(fact, customers))
    publish(f"{gold}.product_features", product_features(fact, products))
    return spark.createDataFrame(list(counts.items()), "table_name string, row_count long")


def gold_views(
    fact: DataFrame, customers: DataFrame, products: DataFrame, warehouses: DataFrame
) -> dict[str, Callable[[], DataFrame]]:
    """The six gold views by name, each planned when called."""
    return {
        "daily_sales_summary": lambda: views.daily_sales_summary(fact, products),
        "product_performance": lambda: views.product_performance(fact, products),
        "warehouse_monthly_performance": lambda: views.warehouse_monthly_performance(fact, warehouses),
        "regional_sales": lambda: views.regional_sales(fact),
        "customer_analytics": lambda: views.customer_analytics(fact, customers, products),
        "kpi_summary": lambda: views.kpi_summary(fact),
    }


def register_views(
    fact: DataFrame,
    customers: DataFrame,
    products: DataFrame,
    warehouses: DataFrame,
    names: Sequence[str] | None = None,
) -> list[str]:
    """The gold views, or those in `names`, as temporary views for SQL strings."""
    known = gold_views(fact, customers, products, warehouses)
    chosen = list(known) if names is None else list(names)
    for name in chosen:
        known[name]().createOrReplaceTempView(name)
    return chosen


def publish_gold(
    spark: SparkSession, bronze: str = "bronze", silver: str = "silver", gold: str = "gold"
) -> dict[str, int]:
    """The gold views stored as tables, for readers that name them by database."""
    stored = gold_views(
        spark.table(f"{silver}.fact_sales"),
        spark.table(f"{silver}.dim_customers"),
        spark.table(f"{silver}.dim_products"),
        spark.table(f"{bronze}.raw_warehouses"),
    )
    return {name: overwrite_table(view(), f"{gold}.{name}") for name, view in stored.items()}
