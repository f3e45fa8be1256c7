"""Retention from bitmaps against retention from lines."""

from __future__ import annotations

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from shelfline.operators import cohorts
from shelfline.plans.trends import cohort_retention
from shelfline.session import discard_at_exit, fresh_path

LINE = "customer_id string, sale_date date"


@pytest.fixture
def home(spark):
    path = fresh_path(spark, "cohorts")
    discard_at_exit(spark, path)
    return path


def lines(spark, seed=1, customers=60, count=500):
    rng = random.Random(seed)
    # Months are sparse, and one customer has a third of the lines.
    who = lambda: "C0" if rng.random() < 1 / 3 else f"C{rng.randrange(customers)}"
    made = [(who(), date(1996 + rng.randrange(2), rng.choice([1, 2, 5, 6, 11]), rng.randrange(1, 28))) for _ in range(count)]
    return spark.createDataFrame(made, LINE)


def test_loads_in_any_order_and_again(spark, home, rows):
    fact = lines(spark)
    for load, months in (("b", [5, 6]), ("a/1", [1, 2]), ("b", [5, 6]), ("c", [11]), ("a/1", [1, 2])):
        cohorts.add_lines(home, fact.where(F.month("sale_date").isin(months)), load)
    assert rows(cohorts.retention(cohorts.active_customers(spark, home))) == rows(cohort_retention(fact))
    numbers = cohorts.customer_numbers(spark, home)
    ids = fact.select("customer_id").distinct().count()
    assert numbers.count() == numbers.select("customer_id").distinct().count() == numbers.select("customer_no").distinct().count() == ids


def test_more_customers_than_a_bitmap_holds(spark, home, rows):
    ids = spark.range(40_000).selectExpr("CONCAT('C', id) AS customer_id", "id")
    first = ids.select("customer_id", F.expr("make_date(1996, CAST(1 + id % 4 AS INT), 3)").alias("sale_date"))
    again = ids.where("id % 3 = 0").select("customer_id", F.expr("make_date(1997, CAST(1 + id % 5 AS INT), 9)").alias("sale_date"))
    fact = first.union(again)
    cohorts.add_lines(home, fact, "all")
    active = cohorts.active_customers(spark, home)
    assert active.select("bucket").distinct().count() == 2
    assert rows(cohorts.retention(active)) == rows(cohort_retention(fact))


def test_cut_by_an_attribute_reads_bitmaps_only(spark, home, rows):
    fact = lines(spark, 5)
    tier = F.when(F.col("customer_id") != "C7", F.substring("customer_id", -1, 1))  # one customer without
    customers = fact.select("customer_id").distinct().withColumn("tier", tier)
    cohorts.add_lines(home, fact, "all")
    chosen = cohorts.members(customers, cohorts.customer_numbers(spark, home), "tier")
    found = rows(cohorts.retention(cohorts.among(cohorts.active_customers(spark, home), chosen, "tier"), ["tier"]))
    expected = []
    for value in [row.tier for row in customers.select("tier").distinct().collect()]:
        mine = customers.where(F.col("tier").eqNullSafe(F.lit(value))).select("customer_id")
        expected += [(value, *row) for row in rows(cohort_retention(fact.join(mine, "customer_id")))]
    key = lambda row: tuple(map(str, row))
    assert sorted(found, key=key) == sorted(expected, key=key)


def test_missing_values_and_no_lines(spark, home, rows):
    assert cohorts.retention(cohorts.active_customers(spark, home)).count() == 0
    fact = spark.createDataFrame([(None, date(1996, 1, 1)), ("a", None), ("a", date(1996, 2, 1)), ("a", date(1996, 2, 9))], LINE)
    cohorts.add_lines(home, fact.limit(0), "none")
    cohorts.add_lines(home, fact, "some")
    assert rows(cohorts.retention(cohorts.active_customers(spark, home))) == [(date(1996, 2, 1), 0, 1, 1, 100.0)]


@pytest.mark.parametrize("keys", [[], ["tier"]])
def test_rows_are_dealt_by_bucket_once(spark, home, keys):
    cohorts.add_lines(home, lines(spark), "all")
    active = cohorts.active_customers(spark, home).withColumn("tier", F.lit("a"))
    plan = cohorts.retention(active.select("month", "bucket", "active", *keys), keys)._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
    # Loads united, dealt by bucket, counts added up, sizes of the cohorts.
    assert len(moved) == 4 and sum("hashpartitioning(bucket#" in line for line in moved) == 1 and "Join" not in plan, plan
