from __future__ import annotations

import datetime as dt
from decimal import Decimal

import builders as b
from pyspark.sql import Window
from pyspark.sql import functions as F

from shelfline.operators import gold
from shelfline.operators.features import customer_features, customer_features_extended, product_features

JAN = dt.date(2024, 1, 1)


def day(n):
    return JAN + dt.timedelta(days=n)


def one_product(spark):
    return b.products(spark, {"product_id": "p1"})


def test_week_over_week(spark):
    fact = b.sales(spark, *[{"sale_date": day(n), "net_revenue": 10 * n} for n in range(9)])
    found = gold.daily_sales_summary(fact, one_product(spark)).orderBy("sale_date").collect()
    assert [row.wow_growth_pct for row in found] == [None] * 8 + [700.0]
    assert [row.revenue_7d_ago for row in found] == [None] * 7 + [Decimal("0.0000"), Decimal("10.0000")]


def test_rolling_rows_differ_from_rolling_days(spark):
    goods = b.products(spark, {"product_id": "a", "product_category": "A"}, {"product_id": "b", "product_category": "B"})
    fact = b.sales(spark, *[{"sale_date": day(n), "product_id": p} for n in range(4) for p in "ab"])
    summary = gold.daily_sales_summary(fact, goods).orderBy("sale_date", "product_category").collect()
    assert [int(row.rolling_7d_revenue) for row in summary] == [1, 2, 3, 4, 5, 6, 7, 7]
    assert [row.rolling_30d_avg for row in summary] == [1.0] * 8
    calendar = gold.rolling_7d_calendar(fact).orderBy("sale_date").collect()
    assert [int(row.rolling_7d_calendar) for row in calendar] == [2, 4, 6, 8]


def test_rolling_measures_equal_window_frames(spark, rows):
    """Rows with no revenue at all included: a frame of those alone has no sum."""
    goods = b.products(spark, {"product_id": "a", "product_category": "A"}, {"product_id": "b", "product_category": "B"})
    fact = b.sales(
        spark,
        *[
            {"sale_date": day(n), "product_id": p, "net_revenue": None if n % 20 < 9 else n * 1.25}
            for n in range(60)
            for p in "ab"
        ],
    )
    window = Window.partitionBy("region").orderBy("sale_date", "product_category")
    month = window.rowsBetween(-29, 0)
    plain = gold.daily_sales(fact, goods).select(
        "sale_date",
        "product_category",
        F.sum("total_revenue").over(window.rowsBetween(-6, 0)).cast("double").alias("week"),
        (F.sum("total_revenue").over(month).cast("double") / F.nullif(F.count("total_revenue").over(month), F.lit(0))).alias("month"),
    )
    found = gold.daily_sales_summary(fact, goods).select(
        "sale_date", "product_category", F.col("rolling_7d_revenue").cast("double"), "rolling_30d_avg"
    )
    assert rows(found) == rows(plain)


def test_calendar_window_leaves_gaps_out(spark):
    fact = b.sales(spark, {"sale_date": day(0)}, {"sale_date": day(6)}, {"sale_date": day(13)})
    found = gold.rolling_7d_calendar(fact).orderBy("sale_date").collect()
    assert [int(row.rolling_7d_calendar) for row in found] == [1, 2, 1]


def test_fact_only_summary(spark):
    fact = b.sales(spark, {"net_revenue": 5}).withColumn("product_category", F.lit("Toys"))
    found = gold.daily_sales_summary(fact)
    assert "total_profit" not in found.columns and "rolling_30d_avg" not in found.columns
    assert found.first().rolling_7d_revenue == Decimal("5.0000")


def test_on_time_share_counts_early_and_not_missing(spark):
    fact = b.sales(spark, *[{"days_to_ship": d} for d in (3, 4, -2, None)])
    row = gold.warehouse_monthly_performance(fact, b.warehouses(spark, {"warehouse_id": "w1"})).first()
    assert row.fulfillment_rate == 50.0
    assert row.avg_days_to_ship == 5 / 3
    assert (row.month_num, row.month_name) == (1, "Jan")


def test_months_of_different_years_merge(spark):
    fact = b.sales(spark, {"sale_date": JAN}, {"sale_date": dt.date(2023, 1, 9), "order_id": "o2"})
    assert gold.warehouse_monthly_performance(fact, b.warehouses(spark, {"warehouse_id": "w1"})).first().total_orders == 2


def test_rank_leaves_gaps(spark, rows):
    goods = b.products(spark, *[{"product_id": p} for p in "abc"])
    fact = b.sales(spark, *[{"product_id": p, "net_revenue": v} for p, v in (("a", 5), ("b", 5), ("c", 3))])
    found = gold.product_performance(fact, goods)
    assert rows(found, "product_name", "category_revenue_rank") == [("Name a", 1), ("Name b", 1), ("Name c", 3)]


def test_equal_product_names_merge(spark):
    goods = b.products(spark, {"product_id": "a", "product_name": "Same"}, {"product_id": "b", "product_name": "Same"})
    fact = b.sales(spark, {"product_id": "a"}, {"product_id": "b"})
    row = gold.product_performance(fact, goods).first()
    assert (row.total_orders, row.total_units_sold) == (1, 2)


def test_orders_counted_apart_equal_a_plain_count(spark, rows):
    goods = b.products(
        spark,
        *[{"product_id": p, "product_name": n} for p, n in (("a", "Same"), ("b", "Same"), ("b", "Same"), ("c", None), ("d", "No orders"))],
        {"product_id": "e", "product_category": None},
    )
    ids = [None, "o1", "o1", "o2", "o3"]
    fact = b.sales(
        spark,
        *[{"product_id": "abce"[n % 4], "order_id": ids[n % 5], "net_revenue": None if n % 7 == 0 else n % 3} for n in range(60)],
        *[{"product_id": "d", "order_id": None}] * 3,
    )
    names = ["product_category", "product_subcategory", "product_name"]
    plain = fact.join(goods, "product_id").groupBy(*names).agg(F.countDistinct("order_id"), F.sum("quantity"), F.sum("net_revenue"))
    expected = rows(plain)
    assert len(expected) == 4 and (("Toys", "Games", "No orders", 0, 3) in [row[:5] for row in expected])
    found = gold.product_performance(fact, goods)
    assert rows(found, *names, "total_orders", "total_units_sold", "revenue") == expected
    assert rows(gold.product_sales(fact, goods), *names, "total_orders", "total_units_sold", "revenue") == expected


def test_zero_revenue_margin(spark):
    fact = b.sales(spark, {"net_revenue": 0, "profit": -3})
    assert gold.product_performance(fact, one_product(spark)).first().profit_margin_pct is None
    assert product_features(fact, one_product(spark)).first().profit_margin == 0.0
    assert gold.kpi_summary(fact).first().overall_margin_pct is None


def test_averages_of_nothing_are_null(spark):
    fact = b.sales(spark, {"net_revenue": None, "unit_price": None, "discount_pct": None})
    row = gold.product_performance(fact, one_product(spark)).first()
    assert (row.avg_selling_price, row.avg_discount, row.revenue) == (None, None, None)


def test_lines_orders_and_summed_orders(spark):
    goods = b.products(spark, {"product_id": "a", "product_category": "A"}, {"product_id": "b", "product_category": "B"})
    fact = b.sales(spark, {"product_id": "a"}, {"product_id": "a"}, {"product_id": "b"})
    people = b.customers(spark, {"customer_id": "c1"})
    assert customer_features(fact, people).first().total_orders == 3
    assert gold.kpi_summary(fact).first().total_orders == 1
    assert gold.daily_sales(fact, goods).agg(F.sum("order_count")).first()[0] == 2


def test_unknown_products_drop_out_of_joins_only(spark):
    fact = b.sales(spark, {"product_id": "p1"}, {"product_id": "unknown"})
    assert gold.daily_sales(fact, one_product(spark)).agg(F.sum("units_sold")).first()[0] == 1
    assert gold.kpi_summary(fact).first().products_sold == 2
    assert gold.regional_sales(fact).first().total_units == 2


def test_customer_analytics(spark):
    goods = b.products(spark, {"product_id": "a", "product_category": "A"}, {"product_id": "b", "product_category": "B"})
    people = b.customers(spark, {"customer_id": "c1", "region": "Home region"}, {"customer_id": "c2"}, {"customer_id": "idle"})
    fact = b.sales(
        spark,
        {"product_id": "a", "net_revenue": 10, "sale_date": day(0)},
        {"product_id": "b", "net_revenue": 20, "sale_date": day(9), "order_id": "o2"},
        {"customer_id": "c2", "product_id": "a", "net_revenue": 99},
        {"customer_id": "c1", "product_id": "gone", "net_revenue": 500},
    )
    first, second = gold.customer_analytics(fact, people, goods).orderBy("value_quintile").collect()
    assert (first.customer_id, second.customer_id) == ("c2", "c1")
    assert (second.region, second.total_orders, second.lifetime_value) == ("Home region", 2, Decimal("30.0000"))
    assert (second.avg_order_value, second.customer_tenure_days, second.categories_purchased) == (15.0, 9, 2)


def test_customer_listed_twice_counts_as_the_plain_join_would(spark, rows):
    people = b.customers(spark, {"customer_id": "c1"}, {"customer_id": "c1"}, {"customer_id": "c1", "segment": "Office"})
    fact = b.sales(spark, {"net_revenue": 4}, {"net_revenue": 6, "order_id": "o2"})
    goods = one_product(spark)
    joined = fact.drop("region").join(people, "customer_id").join(goods, "product_id")
    plain = joined.groupBy("customer_id", "segment").agg(
        F.count_distinct("order_id").alias("total_orders"), F.sum("net_revenue").alias("lifetime_value")
    )
    found = gold.customer_analytics(fact, people, goods)
    assert rows(found, "customer_id", "segment", "total_orders", "lifetime_value") == rows(plain)


def test_features(spark):
    people = b.customers(spark, {"customer_id": "c1", "customer_segment": "Core"})
    one_day = b.sales(spark, {}, {"product_id": "p2"})
    row = customer_features(one_day, people).first()
    assert (row.tenure_days, row.purchase_frequency) == (0, 0.0)
    longer = b.sales(spark, {}, {"sale_date": day(15)})
    assert customer_features(longer, people).first().purchase_frequency == 4.0
    extended = customer_features_extended(one_day, people).first()
    assert (extended.unique_products, extended.customer_segment) == (2, "Core")


def test_daily_revenue_adds_up_to_the_joined_fact(spark):
    fact = b.sales(spark, *[{"sale_date": day(n % 5), "net_revenue": n, "region": f"R{n % 3}"} for n in range(40)])
    total = gold.daily_sales_summary(fact, one_product(spark)).agg(F.sum("total_revenue")).first()[0]
    assert total == sum(range(40))


def test_approximate_distinct_is_optional(spark):
    fact = b.sales(spark, *[{"order_id": f"o{n}"} for n in range(50)])
    exact, rough = gold.kpi_summary(fact).first(), gold.kpi_summary(fact, approx=True).first()
    assert exact.total_orders == 50
    assert abs(rough.total_orders - 50) <= 5


def plans(spark):
    goods = b.products(spark, {"product_id": "p1"})
    people = b.customers(spark, {"customer_id": "c1"})
    return {
        "daily_sales_summary": lambda fact: gold.daily_sales_summary(fact, goods),
        "product_performance": lambda fact: gold.product_performance(fact, goods),
        "customer_analytics": lambda fact: gold.customer_analytics(fact, people, goods),
    }


def test_no_job_runs_while_a_view_is_planned(spark):
    fact = b.sales(spark, {})
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup())
    for build in plans(spark).values():
        build(fact)
    assert len(tracker.getJobIdsForGroup()) == before


def test_views_follow_their_table(spark):
    b.sales(spark, {}).write.mode("overwrite").saveAsTable("followed_fact")
    fact = spark.table("followed_fact")
    found = {name: build(fact) for name, build in plans(spark).items()}
    for name, view in found.items():
        view.createOrReplaceTempView(f"follow_{name}")
    b.sales(spark, {"order_id": "o2"}).write.mode("append").saveAsTable("followed_fact")
    assert spark.sql("SELECT sum(units_sold) FROM follow_daily_sales_summary").first()[0] == 2
    assert spark.sql("SELECT sum(total_units_sold) FROM follow_product_performance").first()[0] == 2
    assert spark.sql("SELECT sum(lifetime_value) FROM follow_customer_analytics").first()[0] == 2
    spark.sql("DROP TABLE followed_fact")
