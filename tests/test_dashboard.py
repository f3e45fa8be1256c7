from __future__ import annotations

import datetime as dt

import builders as b
from pyspark.sql import functions as F

from shelfline.functions.dates import MONTHS
from shelfline.operators import gold
from shelfline.plans import dashboard
from shelfline.plans.batch import register_views

JAN, DEC = "2024-01-01", "2024-12-31"


def daily(spark, *records):
    return gold.daily_sales(b.sales(spark, *records), b.products(spark, {"product_id": "p1"}, {"product_id": "p2", "product_category": "Tools"}))


def test_filters(spark):
    frame = daily(spark, {"region": "It's north"}, {"region": None, "order_id": "o2"}, {"region": "South", "order_id": "o3"})

    def orders(regions, categories=("Toys",), start=JAN, end=DEC):
        return dashboard.dashboard_kpis(frame, list(regions), list(categories), start, end).first().total_orders

    assert orders(["It's north"]) == 1
    assert orders(["It's north", "South"]) == 2
    assert orders([]) is None
    assert orders(["South"], []) is None
    assert orders(["South"], end="2024-01-01") == 1
    assert orders(["South"], start="2024-01-02") is None


def test_mean_of_group_averages_is_unweighted(spark):
    frame = daily(
        spark,
        {"net_revenue": 10},
        {"product_id": "p2", "net_revenue": 1},
        {"product_id": "p2", "net_revenue": 3},
    )
    card = dashboard.dashboard_kpis(frame, ["North"], ["Toys", "Tools"], JAN, DEC).first()
    assert (card.avg_aov, card.total_orders, card.active_days) == (6.0, 2, 1)


def test_last_month_of_a_long_month(spark):
    frame = daily(spark, *[{"sale_date": dt.date(2024, 2, d), "order_id": f"o{d}"} for d in (28, 29)])
    card = dashboard.kpis_last_month(frame, "2024-03-31").first()
    assert (card.total_orders, card.active_days) == (1, 1)


def test_trend_looks_back_past_its_start(spark):
    goods = b.products(spark, {"product_id": "p1"})
    fact = b.sales(spark, *[{"sale_date": dt.date(2024, 1, d)} for d in range(1, 11)])
    summary = gold.daily_sales_summary(fact, goods)
    first = dashboard.revenue_trend(summary, ["North"], ["Toys"], "2024-01-08", DEC).first()
    assert (int(first.revenue), int(first.rolling_7d)) == (1, 7)
    assert dashboard.revenue_trend_full_grain(summary, ["North"], "2024-01-08", DEC).count() == 3


def test_top_products_break_ties_by_name(spark):
    goods = b.products(spark, *[{"product_id": p} for p in "dbca"])
    fact = b.sales(spark, *[{"product_id": p, "net_revenue": 9 if p == "d" else 5} for p in "abcd"])
    found = dashboard.top_products(gold.product_performance(fact, goods), 3).collect()
    assert [row.product_name for row in found] == ["Name d", "Name a", "Name b"]


def test_heatmap_unpivots_to_the_long_form(spark, rows):
    depots = b.warehouses(spark, {"warehouse_id": "w1"}, {"warehouse_id": "w2"})
    fact = b.sales(
        spark,
        {"sale_date": dt.date(2024, 3, 1), "days_to_ship": 1},
        {"sale_date": dt.date(2024, 5, 1), "days_to_ship": 9},
        {"sale_date": dt.date(2024, 5, 1), "days_to_ship": 2, "warehouse_id": "w2"},
    )
    monthly = gold.warehouse_monthly_performance(fact, depots)
    wide = dashboard.fulfillment_heatmap(monthly)
    assert wide.columns == ["warehouse_name", *MONTHS]
    back = wide.unpivot("warehouse_name", list(MONTHS), "month_name", "fulfillment_rate").where("fulfillment_rate IS NOT NULL")
    assert rows(back) == rows(monthly, "warehouse_name", "month_name", "fulfillment_rate")
    assert dashboard.fulfillment_heatmap(monthly, present_only=True).columns == ["warehouse_name", "Mar", "May"]
    assert [row.month_num for row in dashboard.fulfillment_long(monthly).collect()] == [3, 5, 5]


def test_state_feeds(spark, rows):
    fact = b.sales(spark, {"region": "North"}, {"region": "South", "order_id": "o2", "net_revenue": 2})
    regional = gold.regional_sales(fact)
    assert dashboard.state_map_feed(regional).count() == 2
    assert [int(row.revenue) for row in dashboard.state_rollup(regional).collect()] == [3]


def test_domains(spark):
    frame = daily(spark, {"region": "b"}, {"region": "a"}, {"region": None}, {"region": "a", "product_id": "p2"})
    assert [row.region for row in dashboard.region_domain(frame).collect()] == ["a", "b", None]
    assert [row.product_category for row in dashboard.category_domain(frame).collect()] == ["Tools", "Toys"]


def test_sql_strings_bind_values(spark):
    fact = b.sales(spark, {"region": "O'Hara"}, {"region": "South"})
    goods, people, depots = (
        b.products(spark, {"product_id": "p1"}),
        b.customers(spark, {"customer_id": "c1"}),
        b.warehouses(spark, {"warehouse_id": "w1"}),
    )
    names = register_views(fact, people, goods, depots)
    assert len(names) == 6
    found = dashboard.query(spark, "SELECT sum(units_sold) AS units FROM daily_sales_summary WHERE region = :r", r="O'Hara")
    assert found.first().units == 1
    assert dashboard.query(spark, "SELECT total_orders FROM kpi_summary").first().total_orders == 1
    for name in names:
        spark.catalog.dropTempView(name)


def test_card_filters_reach_the_scan(spark, tmp_path):
    stored = str(tmp_path / "fact")
    b.sales(spark, {}).write.parquet(stored)
    frame = gold.daily_sales(spark.read.parquet(stored), b.products(spark, {"product_id": "p1"}))
    cards = dashboard.dashboard_kpis(frame, ["North", "South"], ["Toys"], JAN, DEC)
    formatted = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    plan = cards._jdf.queryExecution().explainString(formatted)
    pushed = next(line for line in plan.splitlines() if line.startswith("PushedFilters"))
    assert "In(region, [North,South])" in pushed
    assert "GreaterThanOrEqual(sale_date,2024-01-01)" in pushed
    read = next(line for line in plan.splitlines() if line.startswith("ReadSchema"))
    assert "ship_mode" not in read and "discount_amount" not in read


def test_cards_over_daily_sales_need_no_window(spark):
    daily = gold.daily_sales(b.sales(spark, {}), b.products(spark, {"product_id": "p1"}))
    kpis = dashboard.dashboard_kpis(daily, ["North"], ["Toys"], JAN, DEC)
    assert "Window" not in kpis._jdf.queryExecution().optimizedPlan().toString()
