from __future__ import annotations

import datetime as dt

import builders as b

from shelfline.operators import gold
from shelfline.plans import trends


def month(year, number, **more):
    return {"sale_date": dt.date(year, number, 15), **more}


def test_month_over_month_skips_missing_months(spark):
    fact = b.sales(
        spark,
        month(2023, 12, net_revenue=10),
        month(2024, 1, net_revenue=15),
        month(2024, 1, net_revenue=15, order_id="o2"),
        month(2024, 3, net_revenue=8),
    )
    december, january, march = trends.mom_growth(fact).orderBy("month").collect()
    assert (december.prev_revenue, december.mom_revenue_pct) == (None, None)
    assert (january.mom_revenue_pct, january.mom_orders_pct, january.mom_aov_pct) == (200.0, 100.0, 50.0)
    assert (march.prev_revenue, march.mom_revenue_pct) == (None, None)


def test_growth_from_zero_is_null(spark):
    fact = b.sales(spark, month(2024, 1, net_revenue=0), month(2024, 2, net_revenue=5))
    assert trends.mom_growth(fact).orderBy("month").collect()[1].mom_revenue_pct is None


def test_state_growth_stays_within_the_state(spark):
    fact = b.sales(spark, month(2024, 1, state_name="A"), month(2024, 2, state_name="B"), month(2024, 2, state_name="A", net_revenue=3))
    found = {(row.state_name, row.month.month): row.growth_pct for row in trends.state_growth(fact).collect()}
    assert found == {("A", 1): None, ("A", 2): 200.0, ("B", 2): None}


def test_same_month_last_year(spark):
    fact = b.sales(spark, month(2023, 4, net_revenue=4), month(2024, 4, net_revenue=5), month(2024, 5))
    found = {(row.sale_year, row.sale_month): row.yoy_pct for row in trends.yoy_seasonal(fact).collect()}
    assert found == {(2023, 4): None, (2024, 4): 25.0, (2024, 5): None}


def test_bottlenecks_rank_before_the_cut(spark, rows):
    depots = b.warehouses(spark, *[{"warehouse_id": w} for w in ("w1", "w2", "w3")])
    late, fine = {"days_to_ship": 9}, {"days_to_ship": 1}
    fact = b.sales(spark, {"warehouse_id": "w1", **late}, {"warehouse_id": "w2", **late}, {"warehouse_id": "w3", **fine})
    monthly = gold.warehouse_monthly_performance(fact, depots)
    found = trends.bottlenecks(monthly)
    assert rows(found, "warehouse_name", "month_rank") == [("Depot w1", 1), ("Depot w2", 1)]


def test_cohorts(spark, rows):
    fact = b.sales(
        spark,
        month(2023, 12, customer_id="a"),
        month(2023, 12, customer_id="a"),
        month(2024, 2, customer_id="a"),
        month(2023, 12, customer_id="b"),
        month(2024, 1, customer_id="c"),
    )
    found = trends.cohort_retention(fact)
    assert rows(found, "cohort_month", "month_offset", "active_customers", "cohort_size", "retention_pct") == [
        (dt.date(2023, 12, 1), 0, 2, 2, 100.0),
        (dt.date(2023, 12, 1), 2, 1, 2, 50.0),
        (dt.date(2024, 1, 1), 0, 1, 1, 100.0),
    ]


def test_value_spread(spark):
    goods = b.products(spark, {"product_id": "p1"})
    people = b.customers(spark, *[{"customer_id": f"c{n}"} for n in range(10)])
    fact = b.sales(spark, *[{"customer_id": f"c{n}", "net_revenue": n} for n in range(10)])
    top = trends.ltv_distribution(gold.customer_analytics(fact, people, goods)).orderBy("value_quintile").first()
    assert (top.customers, int(top.min_ltv), int(top.max_ltv), top.avg_ltv, int(top.total_ltv)) == (2, 8, 9, 8.5, 17)
