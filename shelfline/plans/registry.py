"""Every query by name, over a folder of order tables.

Parameters are fixed here so that a result can be checked against SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.functions.money import as_report
from shelfline.operators import cohorts, colocated, dimensions, features, gold, lookback, quality, silver, sketches
from shelfline.plans import dashboard, trends
from shelfline.plans.layers import Layers, layers
from shelfline.plans.batch import append_bronze, load_bronze, publish_gold, register_views, run_all
from shelfline.schemas import DIM_CUSTOMERS, DIM_PRODUCTS, FACT_SALES, RAW_CUSTOMERS, RAW_PRODUCTS, RAW_TRANSACTIONS
from shelfline.sources import catalog
from shelfline.sources.csv_files import file_columns, ragged, read_csv
from shelfline.streaming.daily import add_available, current
from shelfline.streaming import gold_parts
from shelfline.streaming.ingest import append_available, append_numbered, stream_csv

REGIONS = ["ASIA", "EUROPE"]
CATEGORIES = ["ECONOMY", "PROMO"]
START, END = "1997-01-01", "1997-12-31"
AS_OF = "2001-08-01"
SLOW_BELOW = 45.0
COUNTED_TABLES = (
    *("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"),
    *("documents", "embeddings", "pages", "benchmark", "labels", "conversations"),
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def _query(build: Callable[[Layers], DataFrame]) -> Callable[[Layers], DataFrame]:
    """Register `build` under its name, decimals turned to doubles at the edge."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return as_report(build(layers(spark, folder)))

    QUERIES[build.__name__] = run
    return build


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return QUERIES["daily_sales_summary"](spark, folder)


def _chosen_range(at: Layers) -> DataFrame:
    """The daily summary of the chosen regions and dates, from the files that
    its frames reach."""
    return lookback.summary_in_range(at.fact, at.products, at.region_days, REGIONS, START, END)


def _without_stamp(df: DataFrame) -> DataFrame:
    return df.drop("_processed_at", "_loaded_at", "_source_file", "_unreadable", "_raw_line")


def _dashboard_choice() -> dict[str, object]:
    return {"regions": REGIONS, "categories": CATEGORIES, "start": START, "end": END}


# --- silver ---------------------------------------------------------------


@_query
def silver_sales(at: Layers) -> DataFrame:
    return at.sales().select(*silver.BUSINESS_COLUMNS)


@_query
def silver_sales_assigned_warehouse(at: Layers) -> DataFrame:
    """No line names its warehouse, so each is resolved by state or region."""
    unassigned = at.bronze.transactions().drop("warehouse_id")
    assigned = silver.silver_sales(unassigned, at.bronze.warehouses(), at.bronze.state_codes())
    return assigned.groupBy("state_name", "warehouse_id").agg(F.count(F.lit(1)).alias("sales_lines"))


@_query
def silver_sales_other_dates(at: Layers) -> DataFrame:
    """The fact from lines whose dates stand in two other formats."""
    lines, order = at.bronze.transactions(), F.col("order_id").cast("long")
    written = lambda name: F.when(
        order % 2 == 0, F.date_format(F.col(name).cast("date"), "dd/MM/yyyy")
    ).otherwise(F.date_format(F.col(name).cast("date"), "yyyyMMdd"))
    other = lines.withColumns({name: written(name) for name in ("order_date", "ship_date")})
    sales = silver.silver_sales(other, at.bronze.warehouses(), at.bronze.state_codes(), date_formats=["dd/MM/yyyy", "yyyyMMdd"])
    return sales.select(*silver.BUSINESS_COLUMNS)


@_query
def compat_quarters(at: Layers) -> DataFrame:
    """Sales lines per month and rounded-form quarter."""
    lines = silver.silver_sales(at.bronze.transactions(), compat_quarter=True)
    return lines.groupBy("sale_month", "sale_quarter").agg(F.count(F.lit(1)).alias("sales_lines"))


@_query
def dim_customers(at: Layers) -> DataFrame:
    return _without_stamp(dimensions.dim_customers(at.bronze.customers(), at.fact))


@_query
def dim_products(at: Layers) -> DataFrame:
    return _without_stamp(dimensions.dim_products(at.bronze.products()))


@_query
def customer_value_quintiles(at: Layers) -> DataFrame:
    """Quintiles with no bound on the number of customers."""
    return dimensions.customer_value(at.fact, at.customers)


# --- gold views -----------------------------------------------------------


@_query
def daily_sales_summary(at: Layers) -> DataFrame:
    return gold.daily_sales_summary(at.fact, at.products)


@_query
def daily_sales_summary_fact_only(at: Layers) -> DataFrame:
    category = at.products.select("product_id", "product_category")
    return gold.daily_sales_summary(at.fact.join(category, "product_id"))


@_query
def rolling_7d_calendar(at: Layers) -> DataFrame:
    return gold.rolling_7d_calendar(at.fact)


@_query
def product_performance(at: Layers) -> DataFrame:
    return gold.product_performance(at.fact, at.products)


@_query
def warehouse_monthly_performance(at: Layers) -> DataFrame:
    return gold.warehouse_monthly_performance(at.fact, at.warehouses)


@_query
def regional_sales(at: Layers) -> DataFrame:
    return gold.regional_sales(at.fact)


@_query
def customer_analytics(at: Layers) -> DataFrame:
    return gold.customer_analytics(at.fact, at.customers, at.products)


@_query
def kpi_summary(at: Layers) -> DataFrame:
    return gold.kpi_summary(at.fact)


# --- feature tables -------------------------------------------------------


@_query
def customer_features(at: Layers) -> DataFrame:
    return features.customer_features(at.fact, at.customers)


@_query
def customer_features_ext(at: Layers) -> DataFrame:
    return features.customer_features_extended(at.fact, at.customers)


@_query
def product_features(at: Layers) -> DataFrame:
    return features.product_features(at.fact, at.products)


# --- dashboard feeds ------------------------------------------------------


@_query
def region_domain(at: Layers) -> DataFrame:
    return dashboard.region_domain(gold.daily_sales(at.fact, at.products))


@_query
def category_domain(at: Layers) -> DataFrame:
    return dashboard.category_domain(gold.daily_sales(at.fact, at.products))


@_query
def dashboard_kpis(at: Layers) -> DataFrame:
    return dashboard.dashboard_kpis(gold.daily_sales(at.fact, at.products), **_dashboard_choice())


@_query
def kpis_last_month(at: Layers) -> DataFrame:
    return dashboard.kpis_last_month(gold.daily_sales(at.fact, at.products), AS_OF)


@_query
def revenue_trend(at: Layers) -> DataFrame:
    return dashboard.revenue_trend(_chosen_range(at), **_dashboard_choice())


@_query
def revenue_trend_full_grain(at: Layers) -> DataFrame:
    return dashboard.revenue_trend_full_grain(_chosen_range(at), REGIONS, START, END)


@_query
def kpis_from_sketches(at: Layers) -> DataFrame:
    """Cards per region out of sketched days, next to the exact order counts."""
    start, end = F.lit(START).cast("date"), F.lit(END).cast("date")
    year = F.col("sale_date").between(start, end)
    known = at.products.select("product_id")
    exact = at.fact.where(year).join(known, "product_id").groupBy("region").agg(
        F.count_distinct("order_id").alias("exact_orders"), F.count_distinct("customer_id").alias("exact_customers")
    )
    # Loads united afterwards stand for sketches kept from one load to the next.
    halves = [sketches.daily_sketches(at.fact.where(F.pmod(F.xxhash64("order_id"), F.lit(2)) == n), at.products) for n in (0, 1)]
    cards = sketches.totals(sketches.merged(*halves).where(year), "region").join(exact, "region")
    off = lambda name: F.abs(F.col(name) - F.col(f"exact_{name}")) / F.col(f"exact_{name}")
    near = (off("orders") < 4 * sketches.standard_error()) & (off("customers") < 4 * sketches.standard_error())
    return cards.select("region", "total_revenue", "total_profit", "units_sold", "avg_line_value", "exact_orders", "exact_customers", near.cast("int").alias("within_bound"))


@_query
def category_hierarchy_revenue(at: Layers) -> DataFrame:
    return dashboard.category_hierarchy_revenue(gold.product_sales(at.fact, at.products))


@_query
def top_products(at: Layers) -> DataFrame:
    return dashboard.top_products(gold.product_sales(at.fact, at.products), 15)


@_query
def fulfillment_long(at: Layers) -> DataFrame:
    return dashboard.fulfillment_long(gold.warehouse_monthly_performance(at.fact, at.warehouses))


@_query
def fulfillment_heatmap(at: Layers) -> DataFrame:
    return dashboard.fulfillment_heatmap(gold.warehouse_monthly_performance(at.fact, at.warehouses))


@_query
def state_map_feed(at: Layers) -> DataFrame:
    return dashboard.state_map_feed(gold.regional_sales(at.fact))


@_query
def state_rollup(at: Layers) -> DataFrame:
    return dashboard.state_rollup(gold.regional_sales(at.fact))


@_query
def sql_state_revenue(at: Layers) -> DataFrame:
    """A SQL string with bound parameters over the registered gold views."""
    register_views(at.fact, at.customers, at.products, at.warehouses, names=["regional_sales"])
    return dashboard.query(
        at.spark,
        "SELECT state_code, sum(total_revenue) AS revenue, sum(total_units) AS units "
        "FROM regional_sales WHERE region = :region GROUP BY state_code",
        region=REGIONS[0],
    )


# --- trends ---------------------------------------------------------------


@_query
def mom_growth(at: Layers) -> DataFrame:
    return trends.mom_growth(at.fact)


@_query
def state_growth(at: Layers) -> DataFrame:
    return trends.state_growth(at.fact)


@_query
def yoy_seasonal(at: Layers) -> DataFrame:
    return trends.yoy_seasonal(at.fact)


@_query
def bottlenecks(at: Layers) -> DataFrame:
    monthly = gold.warehouse_monthly_performance(at.fact, at.warehouses)
    return trends.bottlenecks(monthly, SLOW_BELOW)


@_query
def cohort_retention(at: Layers) -> DataFrame:
    return trends.cohort_retention(at.fact)


@_query
def ltv_distribution(at: Layers) -> DataFrame:
    return trends.ltv_distribution(gold.customer_analytics(at.fact, at.customers, at.products))


# --- quality, catalog, pipeline -------------------------------------------


@_query
def dq_report(at: Layers) -> DataFrame:
    report = quality.sales_quality(
        at.lines,
        at.fact,
        silver.quarantined_sales(at.lines),
        {
            "dim_customers": (at.customers, DIM_CUSTOMERS, "customer_id"),
            "dim_products": (at.products, DIM_PRODUCTS, "product_id"),
            "raw_warehouses": (at.warehouses, None, "warehouse_id"),
        },
        FACT_SALES,
        others=[quality.Checks("lineitem", at.bronze.table("lineitem"), unique=[["l_orderkey", "l_linenumber"]])],
    )
    return report.withColumn("passed", F.col("passed").cast("int"))


@_query
def table_inventory(at: Layers) -> DataFrame:
    return catalog.inventory({("main", name): at.bronze.table(name) for name in COUNTED_TABLES})


_RUNS: dict[str, dict[str, str]] = {}


def _medallion(at: Layers) -> dict[str, str]:
    """Bronze tables loaded into a catalog of their own and the whole pipeline
    run on them, once per source; the database of each layer."""
    if at.home not in _RUNS:
        _RUNS[at.home] = _whole_run(at)
    return _RUNS[at.home]


def _databases(at: Layers) -> dict[str, str]:
    home = at.scratch("medallion")
    prefix = home.rsplit("-", 1)[1]
    names = {layer: f"{layer}_{prefix}" for layer in ("bronze", "silver", "gold")}
    catalog.create_layers(at.spark, names.values(), home)
    catalog.create_tables(at.spark, bronze=names["bronze"], silver=names["silver"])
    return names


def _whole_run(at: Layers) -> dict[str, str]:
    names = _databases(at)
    load_bronze(
        at.spark,
        names["bronze"],
        raw_transactions=at.bronze.transactions(),
        raw_products=at.bronze.products(),
        raw_warehouses=at.bronze.warehouses(),
        raw_customers=at.bronze.customers(),
    )
    run_all(at.spark, **names, state_codes=at.bronze.state_codes())
    return names


@_query
def medallion_run(at: Layers) -> DataFrame:
    """Every table that a whole run left, counted."""
    counts = catalog.table_inventory(at.spark, _medallion(at).values())
    return counts.withColumn("table_schema", F.split_part("table_schema", F.lit("_"), F.lit(1)))


@_query
def catalog_fact_sales(at: Layers) -> DataFrame:
    """The fact read back by name after a whole run."""
    return at.spark.table(f"{_medallion(at)['silver']}.fact_sales").select(*silver.BUSINESS_COLUMNS)


@_query
def catalog_customer_features(at: Layers) -> DataFrame:
    return at.spark.table(f"{_medallion(at)['gold']}.customer_features")


@_query
def catalog_state_map_feed(at: Layers) -> DataFrame:
    """A dashboard feed over a gold view that was published and read by name,
    in a database beside the one whose tables `medallion_run` counts."""
    names = {**_medallion(at), "gold": f"{_medallion(at)['gold']}_views"}
    catalog.create_layers(at.spark, [names["gold"]], at.scratch("views"))
    publish_gold(at.spark, **names)
    return dashboard.state_map_feed(at.spark.table(f"{names['gold']}.regional_sales"))


_BITMAPS: dict[str, str] = {}


def _bitmaps(at: Layers) -> str:
    """The folder of the bitmaps of customers per month, the lines of each
    source added in two loads, the second of them twice."""
    if at.home not in _BITMAPS:
        home = at.scratch("cohorts")
        late = F.col("order_id").cast("long") % 3 == 0
        cohorts.add_lines(home, at.fact.where(~late), "first")
        for _ in range(2):
            cohorts.add_lines(home, at.fact.where(late), "second")
        _BITMAPS[at.home] = home
    return _BITMAPS[at.home]


@_query
def cohort_retention_bitmaps(at: Layers) -> DataFrame:
    return cohorts.retention(cohorts.active_customers(at.spark, _bitmaps(at)))


@_query
def cohort_retention_by_segment(at: Layers) -> DataFrame:
    """A cut by a customer attribute that reads no line."""
    home = _bitmaps(at)
    chosen = cohorts.members(at.customers, cohorts.customer_numbers(at.spark, home), "segment")
    return cohorts.retention(cohorts.among(cohorts.active_customers(at.spark, home), chosen, "segment"), ["segment"])


_COLOCATED: dict[str, str] = {}


def _colocated(at: Layers) -> str:
    """The database of the bucketed dimensions and sums, the lines of each
    source added in two loads."""
    if at.home not in _COLOCATED:
        home = at.scratch("colocated")
        name = f"colocated_{home.rsplit('-', 1)[1]}"
        catalog.create_layers(at.spark, [name], home)
        colocated.create(name, at.customers, at.products)
        late = F.col("order_id").cast("long") % 3 == 0
        for load in (at.fact.where(~late), at.fact.where(late)):
            colocated.add_lines(name, load)
        _COLOCATED[at.home] = name
    return _COLOCATED[at.home]


@_query
def customer_features_colocated(at: Layers) -> DataFrame:
    name = _colocated(at)
    return colocated.customer_features(at.spark.table(f"{name}.customer_months"), at.spark.table(f"{name}.customers_by_id"))


@_query
def product_features_colocated(at: Layers) -> DataFrame:
    name = _colocated(at)
    return colocated.product_features(at.spark.table(f"{name}.product_months"), at.spark.table(f"{name}.products_by_id"))


@_query
def bronze_loads(at: Layers) -> DataFrame:
    """Lines loaded in two loads, the second tried twice, and the ids each got."""
    names, lines = _databases(at), at.bronze.transactions().drop("row_id")
    odd = F.col("order_id").cast("long") % 2 == 1
    load_bronze(at.spark, names["bronze"], "first", raw_transactions=lines.where(~odd))
    for _ in range(2):
        append_bronze(at.spark, "second", names["bronze"], raw_transactions=lines.where(odd))
    loaded = at.spark.table(f"{names['bronze']}.raw_transactions")
    return loaded.groupBy(odd.cast("int").alias("load")).agg(
        F.count(F.lit(1)).alias("sales_lines"),
        F.count_distinct("row_id").alias("row_ids"),
        F.min("row_id").alias("first_id"),
        F.max("row_id").alias("last_id"),
    )


# --- files and streams ----------------------------------------------------


def _as_csv(at: Layers, name: str, rows: DataFrame, schema) -> str:
    path = at.scratch(name)
    _write_csv(rows, schema, path)
    return path


def _write_csv(rows: DataFrame, schema, path: str) -> None:
    # A compressed file is read whole by one task, as it was written by one.
    chosen = rows.select(*file_columns(schema))
    chosen.write.mode("append").option("header", True).option("escape", '"').option("compression", "gzip").csv(path)


@_query
def csv_products(at: Layers) -> DataFrame:
    """The product table written as CSV and read under the staging format."""
    path = _as_csv(at, "products-csv", at.bronze.products(), RAW_PRODUCTS)
    return _without_stamp(read_csv(at.spark, path, RAW_PRODUCTS))


@_query
def csv_unreadable_values(at: Layers) -> DataFrame:
    """Sales lines written as CSV with some values spoiled, and what became of
    them: kept, or quarantined for a reason."""
    order = F.col("order_id").cast("long")
    lines = at.bronze.transactions().drop("row_id")
    spoiled = lines.withColumns(
        {
            "discount_pct": F.when(order % 97 == 0, "abc").otherwise(F.col("discount_pct").cast("string")),
            "profit": F.when(order % 89 == 0, "oops").otherwise(F.col("profit").cast("string")),
            "quantity": F.when(order % 83 == 0, "2.7").otherwise(F.col("quantity").cast("string")),
            "order_date": F.when(order % 79 == 0, F.concat("order_date", F.lit(" garbage"))).otherwise(F.col("order_date")),
        }
    )
    read = read_csv(at.spark, _as_csv(at, "spoiled-csv", spoiled, RAW_TRANSACTIONS), RAW_TRANSACTIONS)
    outcome = F.coalesce(silver.rejection(read), F.lit("kept")).alias("outcome")
    return read.groupBy(outcome).agg(F.count(F.lit(1)).alias("sales_lines"))


@_query
def csv_ragged_lines(at: Layers) -> DataFrame:
    """Sales lines written with fields too many or too few, and what the load
    kept of them."""
    names = file_columns(RAW_TRANSACTIONS)
    order = F.col("order_id").cast("long")
    fields = [F.coalesce(F.col(name).cast("string"), F.lit("NULL")) for name in names]
    line = F.when(order % 71 == 0, F.concat_ws(",", *fields, F.lit('"extra, quoted"'), F.lit("more")))
    line = line.when(order % 73 == 0, F.concat_ws(",", *fields[:2])).otherwise(F.concat_ws(",", *fields))
    path = at.scratch("ragged-lines")
    at.bronze.transactions().select(line.alias("value")).write.option("compression", "gzip").text(path)
    read = read_csv(at.spark, path, RAW_TRANSACTIONS, header="false")
    lacking = ragged(read, RAW_TRANSACTIONS).groupBy("_fields").agg(F.count(F.lit(1)).alias("sales_lines"), F.count("customer_id").alias("with_customer"))
    whole = read.where("_raw_line IS NULL").agg(F.count(F.lit(1)).alias("sales_lines"), F.count("customer_id").alias("with_customer"))
    return lacking.union(whole.select(F.lit(len(names)), "*")).withColumnRenamed("_fields", "fields")


@_query
def stream_csv_customers(at: Layers) -> DataFrame:
    """Customer CSV files taken in by the file stream, which is run twice."""
    path = _as_csv(at, "customers-csv", at.bronze.customers(), RAW_CUSTOMERS)
    target, state = at.scratch("customers-bronze"), at.scratch("customers-state")
    for _ in range(2):
        append_available(stream_csv(at.spark, path, RAW_CUSTOMERS), target, state).awaitTermination()
    return _without_stamp(at.spark.read.parquet(target))


@_query
def stream_csv_transactions(at: Layers) -> DataFrame:
    """Sales lines that arrive in four deliveries of whole orders, each taken in
    as a batch by the file stream, which is run once more at the end, and
    whether each line has an id of its own. A delivery has as many files as its
    size asks for."""
    inbox, target, state = at.scratch("lines-csv"), at.scratch("lines-bronze"), at.scratch("lines-state")
    delivery = F.pmod(F.hash("order_id"), F.lit(4))
    for n in range(5):
        if n < 4:
            _write_csv(at.lines.where(delivery == n), RAW_TRANSACTIONS, inbox)
        append_numbered(stream_csv(at.spark, inbox, RAW_TRANSACTIONS), target, state).awaitTermination()
    taken = at.spark.read.parquet(target)
    return taken.rollup("region").agg(
        F.count(F.lit(1)).alias("sales_lines"),
        F.count_distinct("row_id").alias("row_ids"),
        F.when(F.grouping("region") == 1, F.max("row_id") - F.min("row_id") + 1).otherwise(0).alias("id_span"),
    )


def _event_stream(at: Layers) -> DataFrame:
    schema = at.bronze.table("events").schema
    return at.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(at.folder)


@_query
def stream_ingest_counts(at: Layers) -> DataFrame:
    """Events taken in by the file stream, which is run twice."""
    target, state = at.scratch("events-bronze"), at.scratch("events-state")
    for _ in range(2):
        append_available(_event_stream(at), target, state).awaitTermination()
    return at.spark.read.parquet(target).groupBy("event_type").agg(F.count(F.lit(1)).alias("events"))


def _daily_from_stream(at: Layers, distinct_col: str | None) -> DataFrame:
    """Events written as several files in no order of time, taken in one file
    per batch."""
    inbox, target, state = (at.scratch(name) for name in ("events-inbox", "daily", "daily-state"))
    events = at.bronze.table("events")
    events.repartition(5, F.pmod("event_id", F.lit(5))).write.parquet(inbox)
    stream = at.spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(inbox)
    add_available(stream, target, state, "ts", "value", ["event_type"], distinct_col).awaitTermination()
    return current(at.spark, target, ["event_type"], distinct_col is not None)


@_query
def stream_daily_revenue(at: Layers) -> DataFrame:
    return _daily_from_stream(at, None)


@_query
def stream_daily_users(at: Layers) -> DataFrame:
    return _daily_from_stream(at, "user_id").select("day", "event_type", "distinct_values")


@_query
def incremental_daily_summary(at: Layers) -> DataFrame:
    """The daily summary kept up over three batches, each with lines of the
    same days and orders, in no order of time."""
    inbox, target, state = (at.scratch(name) for name in ("sales-inbox", "sales-parts", "sales-state"))
    third = F.pmod(F.xxhash64("sale_id"), F.lit(3))
    for n in range(3):
        # A batch has as many files as its size asks for.
        at.fact.where(third == n).write.mode("append").parquet(inbox)
        stream = at.spark.readStream.schema(at.fact.schema).parquet(inbox)
        gold_parts.keep_up(stream, at.products, target, state).awaitTermination()
    return gold_parts.summary(at.spark, target)
