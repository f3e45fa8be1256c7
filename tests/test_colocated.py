"""Feature tables over bucketed sums: equal to those of the lines, with no exchange."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from shelfline.operators import colocated, features
from shelfline.plans.layers import layers
from shelfline.session import discard_at_exit, fresh_path
from shelfline.sources import catalog
import conftest


@pytest.fixture(scope="module")
def at(spark):
    return layers(spark, conftest.DATA)


@pytest.fixture(scope="module")
def database(spark, at):
    home = fresh_path(spark, "colocated")
    discard_at_exit(spark, home)
    name = f"buckets_{home.rsplit('-', 1)[1]}"
    catalog.create_layers(spark, [name], home)
    colocated.create(name, at.customers, at.products, 5)
    return name


def loads(fact):
    third = F.col("order_id").cast("long") % 3
    return [fact.where(third == n) for n in (2, 0, 1)] + [fact.limit(0)]


def test_loads_add_up_to_the_features_of_all_lines(spark, at, database, rows):
    # A third of the lines have one customer and one product.
    hot = F.col("order_id").cast("long") % 3 == 0
    one = {"customer_id": at.customers.first().customer_id, "product_id": at.products.first().product_id}
    fact = at.fact.withColumns({name: F.when(hot, F.lit(value)).otherwise(F.col(name)) for name, value in one.items()})
    for load in loads(fact):
        colocated.add_lines(database, load, 5)
    customer_months, product_months = spark.table(f"{database}.customer_months"), spark.table(f"{database}.product_months")
    found = colocated.customer_features(customer_months, spark.table(f"{database}.customers_by_id"))
    assert rows(found) == rows(features.customer_features(fact, at.customers))
    found = colocated.product_features(product_months, spark.table(f"{database}.products_by_id"))
    assert rows(found) == rows(features.product_features(fact, at.products))
    # The hot id is a few rows per load, not a third of the lines.
    months = fact.select(F.trunc("sale_date", "month")).distinct().count()
    assert customer_months.where(F.col("customer_id") == one["customer_id"]).count() <= 3 * months


def test_no_row_moves(spark, at, database):
    colocated.add_lines(database, at.fact, 5)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for build, months, dimension in (
            (colocated.customer_features, "customer_months", "customers_by_id"),
            (colocated.product_features, "product_months", "products_by_id"),
        ):
            found = build(spark.table(f"{database}.{months}"), spark.table(f"{database}.{dimension}"))
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan and "Join" in plan, plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_missing_ids_and_values_add_up(spark, at, rows):
    lines = at.fact.withColumns(
        {
            "net_revenue": F.when(F.col("quantity") % 2 == 0, F.col("net_revenue")),
            "customer_id": F.when(F.col("quantity") % 5 != 0, F.col("customer_id")),
            "sale_date": F.when(F.col("quantity") % 7 != 0, F.col("sale_date")),
        }
    )
    months = colocated.customer_months(lines).unionByName(colocated.customer_months(lines.limit(0)))
    assert rows(colocated.customer_features(months, at.customers)) == rows(features.customer_features(lines, at.customers))
