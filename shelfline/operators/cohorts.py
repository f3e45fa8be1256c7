"""Cohort retention from bitmaps of customers per month.

Customers get dense numbers once; a load's lines become one bit per customer
and month, 32,768 customers to a bitmap of 4 KB, beside those of earlier loads.
Bitmaps of loads are united, so a line seen twice changes nothing, and every
retention report reads bitmaps, not lines: months times customers by eight
bytes. A report cut by a customer attribute needs the attribute's bitmaps only.

The customers of a cohort are those active up to its month less those active up
to the month before, so with U(m) the union of all months up to m, those of
cohort m seen in month k are |U(m) & A(k)| - |U(m - 1) & A(k)|. Months meet
within their bitmap's bucket, where there are as many rows as calendar months;
rows are dealt by bucket once.

Lines without customer or date belong to no cohort.
"""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfline.functions.dates import month_index, month_start
from shelfline.functions.money import ratio
from shelfline.session import file_system
from shelfline.sources.keys import numbered

NUMBER = "customer_no"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    place, files = file_system(spark, path)
    return spark.read.schema(schema).parquet(path) if files.exists(place) else spark.createDataFrame([], schema)


def customer_numbers(spark: SparkSession, home: str) -> DataFrame:
    """customer_id and number of every customer met so far."""
    return _read(spark, f"{home}/numbers", f"{NUMBER} long, customer_id string")


def _bits(rows: DataFrame, keys: Sequence[str | Column], name: str) -> DataFrame:
    number = F.col(NUMBER) + 1  # the first bucket counts from 1
    bucket = F.bitmap_bucket_number(number).alias("bucket")
    return rows.groupBy(*keys, bucket).agg(F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias(name))


def add_lines(home: str, fact: DataFrame, load: str) -> None:
    """Add the lines of one load; the same load again replaces itself. One load
    at a time."""
    spark, key = fact.sparkSession, quote(load, safe="")
    seen = fact.where("customer_id IS NOT NULL AND sale_date IS NOT NULL")
    seen = seen.select(F.col("customer_id").cast("string").alias("customer_id"), month_start("sale_date").alias("month")).distinct()
    known = customer_numbers(spark, home)
    new = seen.select("customer_id").distinct().join(known, "customer_id", "left_anti")
    # Named by the state it starts from: ended before its numbers are written, a
    # load gets the same ones again; after that it finds its customers known.
    given, _ = numbered(new, f"{home}/ledger", f"{load} on {known.count()}", NUMBER)
    given.write.mode("append").parquet(f"{home}/numbers")
    active = _bits(seen.join(customer_numbers(spark, home), "customer_id"), ["month"], "active")
    active.write.mode("overwrite").parquet(f"{home}/active/load={key}")


def active_customers(spark: SparkSession, home: str) -> DataFrame:
    """month, bucket, active: the loads united."""
    loads = _read(spark, f"{home}/active", "month date, bucket long, active binary, load string")
    return loads.groupBy("month", "bucket").agg(F.bitmap_or_agg("active").alias("active"))


def members(customers: DataFrame, numbers: DataFrame, attribute: str) -> DataFrame:
    """attribute, bucket, members: the customers of every value."""
    chosen = customers.select(F.col("customer_id").cast("string").alias("customer_id"), attribute)
    return _bits(chosen.join(numbers, "customer_id"), [attribute], "members")


def _both(rows: DataFrame, keys: Sequence[str], one: str, other: str) -> DataFrame:
    """keys and `both`, the bits set in two bitmaps of a row. `keys` tell rows apart."""
    each = rows.select(*keys, F.explode(F.array(one, other)).alias("bits"))
    return each.groupBy(*keys).agg(F.bitmap_and_agg("bits").alias("both"))


def among(active: DataFrame, chosen: DataFrame, attribute: str) -> DataFrame:
    """`active_customers` by the values of an attribute."""
    joined = active.join(chosen, "bucket")
    return _both(joined, ["bucket", attribute, "month"], "active", "members").withColumnRenamed("both", "active")


def retention(active: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """`trends.cohort_retention` from bitmaps, per `keys`."""
    keys = list(keys)
    dealt = active.repartition("bucket")
    so_far = Window.partitionBy("bucket", *keys).orderBy("month")
    unions = dealt.withColumn("upto", F.bitmap_or_agg("active").over(so_far))
    # One entry per calendar month so far.
    earlier = F.collect_list(F.struct(F.col("month").alias("cohort_month"), "upto")).over(so_far)
    months = unions.withColumn("earlier", earlier).select("bucket", *keys, "month", "active", F.inline("earlier"))
    met = _both(months, ["bucket", *keys, "cohort_month", "month"], "upto", "active")
    # Within a bucket: months in which none of its customers bought have no cohort there.
    step = Window.partitionBy("bucket", *keys, "month").orderBy("cohort_month")
    count = F.bitmap_count("both")
    own = met.select(*keys, "cohort_month", "month", (count - F.lag(count, 1, 0).over(step)).alias("own")).where("own > 0")
    offset = (month_index("month") - month_index("cohort_month")).alias("month_offset")
    per_offset = own.groupBy(*keys, "cohort_month", offset).agg(F.sum("own").alias("active_customers"))
    size = F.max(F.when(F.col("month_offset") == 0, F.col("active_customers")))
    return per_offset.withColumn("cohort_size", size.over(Window.partitionBy(*keys, "cohort_month"))).withColumn(
        "retention_pct", F.round(ratio(F.col("active_customers") * 100, F.col("cohort_size")), 2)
    )
