"""The daily sales view kept up batch by batch, equal to its full rebuild.

A batch of fact lines changes a few groups (day, region, category). It reads
its own lines, the order ids met before in the months it touches, and the
stored daily rows, never the earlier lines:

* `met` holds every order id of a group once; a batch adds those not met before.
* `daily` holds exact sums and counts per group; a batch writes the groups it
  changed anew, as what stood before plus what it brings.
* `summary` holds the rolling and look-back measures; a batch writes the rows
  anew that a changed group can reach: those within `ROLLING_REACH` rows behind
  it in its region, or within `LAG_ROWS` rows behind it in its series.

Each is a folder per batch, so a batch that is retried replaces what it wrote,
and events may come in any order and any late. Of a group the newest row holds.
Categories are those of `products` at the time of the batch; lines of unknown
products drop out, as in `gold.daily_sales`. A batch without lines writes
empty parts. Read between batches, or name the batch to read up to.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import DateType, DecimalType, LongType, StringType, StructField, StructType

from shelfline.functions.money import growth_percent, ratio
from shelfline.operators.gold import LAG_ROWS, ROLLING_REACH, with_rolling
from shelfline.operators.ordered import matched
from shelfline.session import file_system

BATCH = "batch_id"
GRAIN = ("sale_date", "region", "product_category")
TOTAL = DecimalType(38, 4)
_KEYS = [StructField("sale_date", DateType()), StructField("region", StringType()), StructField("product_category", StringType())]
_SUMMED = {
    "order_count": LongType(),
    "units_sold": LongType(),
    "total_revenue": TOTAL,
    "priced_lines": LongType(),
    "total_discounts": TOTAL,
    "total_profit": TOTAL,
}
DAILY = StructType([*_KEYS, *(StructField(name, kind) for name, kind in _SUMMED.items())])
MONTH = "month"
MET = StructType([*_KEYS, StructField("order_id", StringType()), StructField(MONTH, StringType())])
MEASURES = ("avg_order_value", "rolling_7d_revenue", "rolling_30d_avg", "revenue_7d_ago", "wow_growth_pct")


def _parts(spark: SparkSession, path: str, schema: StructType, before: int | None) -> DataFrame:
    """The rows of all parts older than batch `before`, with their batch."""
    place, files = file_system(spark, path)
    numbered = StructType([*schema.fields, StructField(BATCH, LongType())])
    if not files.exists(place):
        return spark.createDataFrame([], numbered)
    rows = spark.read.schema(numbered).parquet(path)
    return rows if before is None else rows.where(F.col(BATCH) < before)


def _newest(rows: DataFrame) -> DataFrame:
    """Of each group the row of its newest batch, and that batch."""
    values = [name for name in rows.columns if name not in (*GRAIN, BATCH)]
    newest = rows.groupBy(*GRAIN).agg(F.max_by(F.struct(*values), BATCH).alias("_row"), F.max(BATCH).alias(BATCH))
    return newest.select(*GRAIN, "_row.*", BATCH)


def _write(rows: DataFrame, target: str, name: str, batch: int, *by: str) -> None:
    rows.write.mode("overwrite").partitionBy(*by).parquet(f"{target}/{name}/{BATCH}={batch}")


def _month() -> Column:
    return F.coalesce(F.date_format("sale_date", "yyyy-MM"), F.lit("none"))


def _add_orders(orders: DataFrame, target: str, batch: int) -> None:
    """Write the order ids that a group has not met before.

    The months of the batch, no more than the calendar has, choose the folders
    of `met` that are read.
    """
    arrived = orders.where(F.col("order_id").isNotNull()).select(*MET.names)
    months = [row[0] for row in orders.select(MONTH).distinct().collect()]
    known = _parts(orders.sparkSession, f"{target}/met", MET, batch).where(F.col(MONTH).isin(months))
    fresh = matched(arrived, known, [*GRAIN, "order_id"], "left_anti")
    # A month's rows go to as many files as their size asks for.
    _write(fresh.hint("rebalance", MONTH), target, "met", batch, MONTH)


def _add_sums(orders: DataFrame, target: str, batch: int) -> None:
    """Write the groups of the batch: what stood before plus what it brings."""
    spark = orders.sparkSession
    sums = [name for name in _SUMMED if name != "order_count"]
    added = orders.groupBy(*GRAIN).agg(*(F.sum(name).alias(name) for name in sums))
    fresh = _parts(spark, f"{target}/met", MET, None).where(F.col(BATCH) == batch)
    counts = fresh.groupBy(*GRAIN).agg(F.count("order_id").alias("order_count"))
    before = matched(_newest(_parts(spark, f"{target}/daily", DAILY, batch)).drop(BATCH), added, GRAIN, "left_semi")
    rows = added.unionByName(counts, allowMissingColumns=True).unionByName(before, allowMissingColumns=True)
    merged = rows.groupBy(*GRAIN).agg(*(F.sum(name).cast(kind).alias(name) for name, kind in _SUMMED.items()))
    _write(merged.fillna(0, ["order_count"]), target, "daily", batch)


def reached_days(series: DataFrame) -> DataFrame:
    """region, sale_date, `_rows`, `_days_ahead` of `series`, and whether a
    change reaches the day (`_reached`) or a reached day looks at it (`_seen`).

    A row per region and day, so these windows hold no more rows than the
    calendar has days. Distances are those between a day's last and another
    day's first row, so a day is counted in as a whole.
    """
    per_day = series.groupBy("region", "sale_date").agg(
        F.count(F.lit(1)).alias("_rows"), F.max("_changed").alias("_changed"), F.max("_lagged").alias("_lagged")
    )
    by_day = Window.partitionBy("region").orderBy(F.col("sale_date").asc_nulls_last())
    so_far = by_day.rowsBetween(Window.unboundedPreceding, 0)
    from_here = by_day.rowsBetween(0, Window.unboundedFollowing)
    placed = per_day.withColumn("_end", F.sum("_rows").over(so_far)).withColumn("_days_ahead", F.col("_end") - F.col("_rows"))
    changed_end = F.max(F.when(F.col("_changed"), F.col("_end"))).over(so_far)
    reached = F.coalesce(F.col("_days_ahead") - changed_end < ROLLING_REACH, F.lit(False)) | F.col("_lagged")
    marked = placed.withColumn("_reached", reached)
    next_start = F.min(F.when(F.col("_reached"), F.col("_days_ahead"))).over(from_here)
    seen = F.coalesce(next_start - F.col("_end") < ROLLING_REACH, F.lit(False))
    return marked.withColumn("_seen", seen).select("region", "sale_date", "_rows", "_days_ahead", "_reached", "_seen")


def _add_measures(spark: SparkSession, target: str, batch: int) -> None:
    """Write the rows whose measures the batch can have changed."""
    daily = _newest(_parts(spark, f"{target}/daily", DAILY, batch + 1))
    # At most one row per day in this window's groups.
    line = Window.partitionBy("region", "product_category").orderBy("sale_date")
    series = daily.withColumn("_changed", F.col(BATCH) == batch).withColumns(
        {
            "revenue_7d_ago": F.lag("total_revenue", LAG_ROWS).over(line),
            "_lagged": F.max("_changed").over(line.rowsBetween(-LAG_ROWS, 0)),
        }
    )
    days = reached_days(series).where("_seen OR _reached")
    near = matched(series, days.select("region", "sale_date", "_reached"), ["region", "sale_date"])
    rolled = with_rolling(near, month=True, days=days.drop("_reached", "_seen")).where("_reached")
    rows = rolled.withColumns(
        {
            "avg_order_value": ratio(F.col("total_revenue"), F.col("priced_lines")),
            "rolling_7d_revenue": F.col("rolling_7d_revenue").cast(TOTAL),
            "wow_growth_pct": growth_percent(F.col("total_revenue"), F.col("revenue_7d_ago")),
        }
    )
    _write(rows.select(*DAILY.names, *MEASURES), target, "summary", batch)


def add_lines(lines: DataFrame, products: DataFrame, target: str, batch: int) -> None:
    """Add fact lines to the view in `target` as batch `batch`."""
    category = products.select("product_id", "product_category")
    # The lines are read once: what follows needs their sums per order.
    orders = (
        lines.join(category, "product_id")
        .groupBy(*GRAIN, "order_id")
        .agg(
            F.sum("quantity").alias("units_sold"),
            F.sum("net_revenue").alias("total_revenue"),
            F.count("net_revenue").alias("priced_lines"),
            F.sum("discount_amount").alias("total_discounts"),
            F.sum("profit").alias("total_profit"),
        )
        .withColumn(MONTH, _month())
        .persist()
    )
    try:
        _add_orders(orders, target, batch)
        _add_sums(orders, target, batch)
    finally:
        orders.unpersist()
    _add_measures(lines.sparkSession, target, batch)


def keep_up(
    stream: DataFrame,
    products: DataFrame,
    target: str,
    checkpoint: str,
    to_fact: Callable[[DataFrame], DataFrame] = lambda lines: lines,
) -> StreamingQuery:
    """Add the lines that have arrived to the view in `target`; `to_fact` makes
    fact lines of them."""

    def write_batch(rows: DataFrame, batch: int) -> None:
        add_lines(to_fact(rows), products, target, batch)

    return (
        stream.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(write_batch)
        .trigger(availableNow=True)
        .start()
    )


def summary(spark: SparkSession, target: str, batch: int | None = None) -> DataFrame:
    """The rows of `gold.daily_sales_summary` after the newest batch, or after
    `batch`."""
    rows = spark.read.parquet(f"{target}/summary")
    kept = rows if batch is None else rows.where(F.col(BATCH) <= batch)
    return _newest(kept).drop(BATCH, "priced_lines")


def compact(spark: SparkSession, target: str, into: str) -> None:
    """Fold the parts of `target` into one part in `into`, under the newest
    batch id. Between two runs of the stream: later batches then go to `into`,
    over the same checkpoint."""
    newest = spark.read.parquet(f"{target}/summary").agg(F.max(BATCH)).first()[0]
    for name in ("daily", "summary"):
        _write(_newest(spark.read.parquet(f"{target}/{name}")).drop(BATCH), into, name, newest)
    met = _parts(spark, f"{target}/met", MET, None).drop(BATCH)
    _write(met.hint("rebalance", MONTH), into, "met", newest, MONTH)
