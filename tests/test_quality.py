from __future__ import annotations

import datetime as dt

import builders as b

from shelfline.operators import quality
from shelfline.operators.silver import quarantined_sales, silver_sales
from shelfline.schemas import DIM_CUSTOMERS, DIM_PRODUCTS, FACT_SALES


def by_rule(report):
    return {(row.table_name, row.rule): (row.failed_rows, row.total_rows, row.passed) for row in report.collect()}


def test_the_whole_report(spark):
    raw = b.transactions(
        spark,
        {},
        {"order_date": "2024-02-30"},
        {"order_date": None},
        {"ship_date": "2023-12-31"},
        {"ship_date": "later"},
        {"quantity": 0},
        {"discount_pct": 1.5},
        {"customer_id": None},
        {"product_id": "unknown"},
    )
    fact = silver_sales(raw)
    dims = {
        "dim_customers": (b.customers(spark, {"customer_id": "c1"}, {"customer_id": "c1"}), DIM_CUSTOMERS, "customer_id"),
        "dim_products": (b.products(spark, {"product_id": "p1"}, {"product_id": None}), DIM_PRODUCTS, "product_id"),
        "raw_warehouses": (b.warehouses(spark, {"warehouse_id": "w1"}), None, "warehouse_id"),
    }
    found = by_rule(quality.sales_quality(raw, fact, quarantined_sales(raw), dims, FACT_SALES))
    failed = {key: value[:2] for key, value in found.items() if not value[2]}
    assert failed == {
        ("raw_transactions", "date:order_date"): (1, 9),
        ("raw_transactions", "date:ship_date"): (1, 9),
        ("fact_sales", "not_null:customer_id"): (1, 7),
        ("fact_sales", "range:quantity"): (1, 7),
        ("fact_sales", "range:discount_pct"): (1, 7),
        ("fact_sales", "order:ship_date"): (1, 7),
        ("fact_sales", "orphan:dim_products"): (1, 7),
        ("dim_customers", "unique:customer_id"): (2, 2),
        ("dim_products", "not_null:product_id"): (1, 2),
    }
    assert found[("fact_sales", "reconcile:bronze")] == (0, 9, True)
    assert found[("fact_sales", "orphan:raw_warehouses")] == (0, 7, True)


def test_lost_rows_do_not_reconcile(spark):
    raw = b.transactions(spark, {}, {}, {"order_date": "never"})
    lost = silver_sales(raw).limit(1)
    found = by_rule(quality.reconcile_rule(raw, lost, quarantined_sales(raw), "fact_sales"))
    assert found == {("fact_sales", "reconcile:bronze"): (1, 3, False)}


def test_empty_tables_pass(spark):
    fact = b.sales(spark, {}).where("false")
    assert by_rule(quality.unique_rule(fact, "f", ["order_id"])) == {("f", "unique:order_id"): (0, 0, True)}
    rules = by_rule(quality.row_rules(fact, "f", quality.fact_rules(FACT_SALES)))
    assert all(value == (0, 0, True) for value in rules.values())
    assert by_rule(quality.orphan_rule(fact, "f", "product_id", b.products(spark, {"product_id": "p1"}), "p"))[
        ("f", "orphan:p")
    ] == (0, 0, True)


def test_money_too_large_for_its_type_is_reported(spark):
    fact = silver_sales(b.transactions(spark, {"unit_price": 9e8, "quantity": 10**9}))
    found = by_rule(quality.row_rules(fact, "f", quality.fact_rules(FACT_SALES)))
    assert found[("f", "range:net_revenue")] == (1, 1, False)


def test_early_shipping_is_reported_once_per_line(spark):
    fact = b.sales(spark, {"ship_date": dt.date(2023, 12, 31)}, {"ship_date": None}, {"ship_date": dt.date(2024, 1, 1)})
    found = by_rule(quality.row_rules(fact, "f", quality.fact_rules(FACT_SALES)))
    assert found[("f", "order:ship_date")] == (1, 3, False)


def test_overlong_text_is_reported(spark):
    fact = b.sales(spark, {"state_code": "x" * 10}, {"state_code": "x" * 11}, {"state_code": None})
    found = by_rule(quality.row_rules(fact, "f", quality.length_rules(FACT_SALES)))
    assert {rule for (_, rule), value in found.items() if not value[2]} == {"length:state_code"}
    assert found[("f", "length:state_code")] == (1, 3, False)


def test_one_pass_equals_a_pass_per_rule(spark):
    """Nulls, repeated and composite keys, keys with no parent, more rules than
    one number holds, an empty table."""
    lines = spark.createDataFrame(
        [(1, "a", "x"), (1, "b", "x"), (2, None, "y"), (3, "c,d", None), (3, "c,d", None), (4, "null", "z")], "id int, kind string, parent string"
    )
    parents = spark.createDataFrame([("x",), ("x",), (None,), ("w",)], "parent string")
    rules = {f"rule{n}": (lines.id * 7 + n) % 5 == 0 for n in range(130)}
    empty = lines.where("false")
    together = quality.one_pass(
        [
            quality.Checks("lines", lines, rules, [["id"], ["kind"], ["id", "kind"]], {"parent": "parents"}),
            quality.Checks("parents", parents, unique=[["parent"]]),
            quality.Checks("empty", empty, {"bad": empty.id > 0}, [["id"]], {"parent": "parents2"}),
            quality.Checks("parents2", parents.where("false"), unique=[["parent"]]),
        ],
        ("lines", "parents", "parents2"),
    )
    apart = quality.report(
        quality.row_rules(lines, "lines", rules),
        *(quality.unique_rule(lines, "lines", keys) for keys in (["id"], ["kind"], ["id", "kind"])),
        quality.orphan_rule(lines, "lines", "parent", parents, "parents"),
        quality.unique_rule(parents, "parents", ["parent"]),
        quality.row_rules(empty, "empty", {"bad": empty.id > 0}),
        quality.unique_rule(empty, "empty", ["id"]),
        quality.orphan_rule(empty, "empty", "parent", parents, "parents2"),
        quality.unique_rule(parents.where("false"), "parents2", ["parent"]),
        quality.reconcile_rule(lines, parents, empty, "parents"),
    )
    assert by_rule(together) == by_rule(apart)
