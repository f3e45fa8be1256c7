"""Distinct counts that add up: sketches per day, region and category.

A distinct count cannot be summed: an order over two categories is one order,
and daily counts make it two. Here every day keeps a HyperLogLog sketch of its
order and customer ids beside exact sums. Sketches of any selection are united
into one estimate, so a dashboard reads days, not lines, and a later batch is
united with what is stored. The faithful counts of the gold views stay as they
are; this is beside them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.functions.money import exact_sum, ratio

# 2^LG_K registers: 8 KB at most, and 0.8 % standard error.
LG_K = 14
GRAIN = ("sale_date", "region", "product_category")
SKETCHED = {"orders": "order_id", "customers": "customer_id"}


def standard_error(lg_k: int = LG_K) -> float:
    return 1.04 / 2 ** (lg_k / 2)


def daily_sketches(fact: DataFrame, products: DataFrame, lg_k: int = LG_K) -> DataFrame:
    """Exact sums and sketched ids per day, region and category."""
    lines = fact.join(products.select("product_id", "product_category"), "product_id")
    return lines.groupBy(*GRAIN).agg(
        exact_sum("net_revenue").alias("total_revenue"),
        exact_sum("profit").alias("total_profit"),
        F.sum("quantity").alias("units_sold"),
        F.count("net_revenue").alias("lines"),
        *(F.hll_sketch_agg(column, lg_k).alias(name) for name, column in SKETCHED.items()),
    )


def _united() -> list[Column]:
    sums = [F.sum(name).alias(name) for name in ("total_revenue", "total_profit", "units_sold", "lines")]
    return [*sums, *(F.hll_union_agg(name).alias(name) for name in SKETCHED)]


def merged(*parts: DataFrame) -> DataFrame:
    """Sketched days of several loads as those of all their lines."""
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows.groupBy(*GRAIN).agg(*_united())


def totals(sketched: DataFrame, *keys: str) -> DataFrame:
    """Exact sums and estimated distinct counts of the rows, per `keys`."""
    joined = sketched.groupBy(*keys).agg(*_united())
    return joined.select(
        *keys,
        "total_revenue",
        "total_profit",
        "units_sold",
        ratio(F.col("total_revenue"), F.col("lines")).alias("avg_line_value"),
        *(F.hll_sketch_estimate(name).alias(name) for name in SKETCHED),
    )
