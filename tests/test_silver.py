from __future__ import annotations

import datetime as dt
from decimal import Decimal

import builders as b
from pyspark.sql import functions as F

from shelfline.operators.dimensions import dim_customers, dim_products
from shelfline.operators.silver import quarantined_sales, silver_sales
from shelfline.schemas import FACT_SALES, RAW_PRODUCTS, conform


def test_quarters_calendar_and_compat(spark):
    raw = b.transactions(spark, *[{"order_date": f"2024-{m:02d}-01"} for m in range(1, 13)])
    for compat, expected in ((False, [1, 1, 1, 2, 2, 2, 3, 3, 3, 4, 4, 4]), (True, [1, 1, 2, 2, 2, 3, 3, 3, 4, 4, 4, 5])):
        found = silver_sales(raw, compat_quarter=compat).orderBy("sale_month").collect()
        assert [row.sale_quarter for row in found] == expected
        assert [row.sale_month for row in found] == list(range(1, 13))


def test_missing_discount_is_none_given(spark, rows):
    raw = b.transactions(spark, {"discount_pct": None}, {"discount_pct": 0.25})
    found = rows(silver_sales(raw), "gross_revenue", "discount_amount", "net_revenue")
    assert found == [
        (Decimal("20.0000"), Decimal("0.0000"), Decimal("20.0000")),
        (Decimal("20.0000"), Decimal("5.0000"), Decimal("15.0000")),
    ]


def test_unreadable_dates_are_quarantined(spark, rows):
    raw = b.transactions(spark, {"order_date": "2024-02-30"}, {"order_date": None}, {"order_date": "2024-02-29"})
    assert rows(silver_sales(raw), "sale_date") == [(dt.date(2024, 2, 29),)]
    assert rows(quarantined_sales(raw), "order_date", "_reason") == [
        (None, "missing order_date"),
        ("2024-02-30", "unreadable order_date"),
    ]


def test_other_nulls_stay(spark, rows):
    raw = b.transactions(spark, {"quantity": None, "ship_date": "soon", "profit": None})
    assert rows(silver_sales(raw), "quantity", "net_revenue", "ship_date", "days_to_ship", "profit") == [(None,) * 5]


def test_money_rounds_half_up_and_never_fails(spark, rows):
    raw = b.transactions(
        spark, {"quantity": 1, "unit_price": 0.00005}, {"quantity": 1, "unit_price": 1e300}, {"unit_price": float("nan")}
    )
    assert rows(silver_sales(raw), "gross_revenue") == [(None,), (None,), (Decimal("0.0001"),)]


def test_declared_columns_and_unique_ids(spark):
    sales = silver_sales(b.transactions(spark, *[{}] * 20))
    assert sales.columns == FACT_SALES.names
    assert [f.dataType for f in sales.schema] == [f.dataType for f in FACT_SALES]
    assert sales.select("sale_id").distinct().count() == 20


def test_warehouse_passes_through_or_is_resolved(spark, rows):
    depots = b.warehouses(
        spark,
        {"warehouse_id": "w2"},
        {"warehouse_id": "w1"},
        {"warehouse_id": "w9", "region": "South", "state": "State 9"},
    )
    raw = b.transactions(
        spark,
        {"order_id": "given", "warehouse_id": "w7"},
        {"order_id": "by state"},
        {"order_id": "by region", "region": "South", "state": "State 5"},
        {"order_id": "none", "region": "East", "state": None},
        warehouse=True,
    )
    assert rows(silver_sales(raw, depots), "order_id", "warehouse_id") == [
        ("by region", "w9"),
        ("by state", "w1"),
        ("given", "w7"),
        ("none", None),
    ]


def test_state_code_lookup(spark, rows):
    codes = spark.createDataFrame([("State 1", "S1"), ("State 1", "S1"), (None, "XX")], "state_name string, state_code string")
    raw = b.transactions(spark, {}, {"state": "Elsewhere"}, {"state": None})
    assert rows(silver_sales(raw, state_codes=codes), "state_name", "state_code") == [
        (None, None),
        ("Elsewhere", None),
        ("State 1", "S1"),
    ]


def test_conform_fills_casts_and_orders(spark):
    loose = spark.createDataFrame([("x", "p1", "oops", "2.5")], "ignored string, product_id string, unit_cost string, list_price string")
    row = conform(loose, RAW_PRODUCTS).first()
    assert row.__fields__ == RAW_PRODUCTS.names
    assert (row.product_id, row.unit_cost, row.list_price, row.brand) == ("p1", None, 2.5, None)
    assert row._loaded_at is not None


def test_product_margin(spark, rows):
    raw = spark.createDataFrame(
        [("a", 6.0, 10.0), ("b", 6.0, 0.0), ("c", None, 10.0)], "product_id string, unit_cost double, list_price double"
    )
    assert rows(dim_products(raw), "product_id", "margin_pct") == [("a", 40.0), ("b", None), ("c", None)]


def test_customer_segments_follow_value(spark, rows):
    raw = spark.createDataFrame(
        [(f"c{n}", "2024-01-05") for n in range(1, 6)] + [("idle", "bad")], "customer_id string, signup_date string"
    )
    fact = b.sales(spark, *[{"customer_id": f"c{n}", "net_revenue": 100 - n} for n in range(1, 6)], {"customer_id": "unlisted", "net_revenue": 999})
    expected = [
        ("c1", "Champion", dt.date(2024, 1, 5)),
        ("c2", "Loyal", dt.date(2024, 1, 5)),
        ("c3", "Core", dt.date(2024, 1, 5)),
        ("c4", "Occasional", dt.date(2024, 1, 5)),
        ("c5", "Low", dt.date(2024, 1, 5)),
        ("idle", "Inactive", None),
    ]
    assert rows(dim_customers(raw, fact), "customer_id", "customer_segment", "signup_date") == expected


def test_dates_must_fit_a_format_whole(spark, rows):
    raw = b.transactions(spark, *[{"order_date": d} for d in ("2024-01-05 garbage", "2024", "05/01/2024", "2024-01-05")])
    assert silver_sales(raw).count() == 1
    assert silver_sales(raw, date_formats=("yyyy-MM-dd", "dd/MM/yyyy")).count() == 2
    assert quarantined_sales(raw, ("yyyy-MM-dd", "dd/MM/yyyy")).count() == 2


def test_unreadable_numbers_are_quarantined(spark, rows):
    raw = b.transactions(spark, {}, {"order_id": "o2", "discount_pct": None}, {"order_id": "o3", "discount_pct": None})
    marked = raw.withColumn("_unreadable", F.when(F.col("order_id") == "o3", F.array(F.lit("discount_pct"))).otherwise(F.array().cast("array<string>")))
    assert rows(silver_sales(marked), "order_id") == [("o1",), ("o2",)]
    assert rows(quarantined_sales(marked), "order_id", "_reason") == [("o3", "unreadable discount_pct")]


def test_sale_id_is_the_row_id(spark, rows):
    raw = b.transactions(spark, {}, {"order_id": "o2"}).withColumn("row_id", F.monotonically_increasing_id())
    ids = {(row.order_id, row.row_id) for row in raw.collect()}
    for _ in range(2):
        assert {(row.order_id, row.sale_id) for row in silver_sales(raw.repartition(3)).collect()} == ids
