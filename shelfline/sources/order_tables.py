"""Order, line-item, part, customer and supplier tables as the bronze inputs.

Gives the same DataFrames a CSV load would, so that everything behind bronze
runs unchanged on either source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.schemas import MONEY


def _key(name: str) -> Column:
    return F.col(name).cast("string")


def _day_text(name: str) -> Column:
    return F.col(name).cast("date").cast("string")


def _unit_cost() -> Column:
    return (F.lit(0.6).cast("double") * F.col("p_retailprice")).cast("decimal(18,2)")


class OrderTables:
    """Bronze DataFrames over a folder of `<table>.parquet` files."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark = spark
        self._folder = folder
        self._read: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._read:  # footers are read once per table
            self._read[name] = self._spark.read.parquet(f"{self._folder}/{name}.parquet")
        return self._read[name]

    def _places(self) -> DataFrame:
        nation, region = self.table("nation"), self.table("region")
        return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
            "n_nationkey", F.col("n_name").alias("state"), F.col("r_name").alias("region")
        )

    def transactions(self) -> DataFrame:
        # Customers and places meet the orders, which are fewer and narrower
        # than the lines, so that lines move for parts and orders only, with
        # days and costs instead of the longer values that these come from.
        placed = (
            self.table("orders")
            .join(self.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
            .join(self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        )
        joined = (
            self.table("lineitem")
            .withColumn("row_id", F.monotonically_increasing_id())  # over the scan: the same whenever a task runs
            .withColumn("l_shipdate", F.col("l_shipdate").cast("date"))
            .join(self.table("part").withColumn("unit_cost", _unit_cost()), F.col("l_partkey") == F.col("p_partkey"))
            .join(placed, F.col("l_orderkey") == F.col("o_orderkey"))
        )
        quantity = F.col("l_quantity").cast("long")
        unit_price = F.col("l_extendedprice") / F.col("l_quantity")
        gross = (quantity * unit_price).cast(MONEY)
        amount = (gross * F.col("l_discount").cast("decimal(9,6)")).cast(MONEY)
        return joined.select(
            "row_id",
            _key("l_orderkey").alias("order_id"),
            _day_text("o_orderdate").alias("order_date"),
            _key("o_custkey").alias("customer_id"),
            F.col("c_name").alias("customer_name"),
            F.col("c_mktsegment").alias("segment"),
            F.col("r_name").alias("region"),
            F.col("n_name").alias("state"),
            F.lit(None).cast("string").alias("city"),
            _key("l_partkey").alias("product_id"),
            F.col("p_name").alias("product_name"),
            F.col("p_type").alias("category"),
            F.col("p_brand").alias("sub_category"),
            quantity.alias("quantity"),
            unit_price.alias("unit_price"),
            F.col("l_discount").alias("discount_pct"),
            (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("sales_amount"),
            ((gross - amount).cast(MONEY) - quantity * F.col("unit_cost")).cast(MONEY).alias("profit"),
            F.col("o_orderpriority").alias("ship_mode"),
            _day_text("l_shipdate").alias("ship_date"),
            _key("l_suppkey").alias("warehouse_id"),
        )

    def products(self) -> DataFrame:
        return self.table("part").select(
            _key("p_partkey").alias("product_id"),
            F.col("p_name").alias("product_name"),
            F.col("p_type").alias("category"),
            F.col("p_brand").alias("sub_category"),
            F.col("p_brand").alias("brand"),
            F.lit(None).cast("string").alias("supplier"),
            _unit_cost().alias("unit_cost"),
            F.col("p_retailprice").alias("list_price"),
            F.col("p_size").cast("double").alias("weight_kg"),
        )

    def warehouses(self) -> DataFrame:
        return (
            self.table("supplier")
            .join(self._places(), F.col("s_nationkey") == F.col("n_nationkey"))
            .select(
                _key("s_suppkey").alias("warehouse_id"),
                F.col("s_name").alias("warehouse_name"),
                "region",
                "state",
                F.lit(None).cast("string").alias("city"),
                F.lit(None).cast("long").alias("capacity_units"),
                F.lit(None).cast("string").alias("manager_name"),
            )
        )

    def customers(self) -> DataFrame:
        first_order = self.table("orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("first_order"))
        balance = F.col("c_acctbal")
        return (
            self.table("customer")
            .join(self._places(), F.col("c_nationkey") == F.col("n_nationkey"))
            .join(first_order, F.col("c_custkey") == F.col("o_custkey"), "left")
            .select(
                _key("c_custkey").alias("customer_id"),
                F.col("c_name").alias("customer_name"),
                F.col("c_mktsegment").alias("segment"),
                "region",
                "state",
                F.lit(None).cast("string").alias("city"),
                _day_text("first_order").alias("signup_date"),
                F.when(balance < 0, "Bronze").when(balance < 5000, "Silver").otherwise("Gold").alias("loyalty_tier"),
            )
        )

    def state_codes(self) -> DataFrame:
        return self.table("nation").select(
            F.col("n_name").alias("state_name"),
            F.concat(F.lit("N"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("state_code"),
        )
