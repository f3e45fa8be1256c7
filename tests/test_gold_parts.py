"""The daily view kept up batch by batch, against its rebuild."""

from __future__ import annotations

import datetime as dt
import random

import builders as b
import pytest

from shelfline.operators import gold
from shelfline.streaming import gold_parts

DAY = dt.date(2024, 1, 1)
COLUMNS = [
    *("sale_date", "region", "product_category", "order_count", "units_sold", "total_revenue", "avg_order_value"),
    *("total_discounts", "total_profit", "rolling_7d_revenue", "rolling_30d_avg", "revenue_7d_ago", "wow_growth_pct"),
]


def lines(rng, count, days):
    """Lines of a busy region, a sparse one and none, with orders that recur."""
    made = []
    for n in range(count):
        region = rng.choice(["busy", "busy", "sparse", None])
        day = rng.choice(days)
        made.append(
            {
                "sale_id": n,
                "order_id": rng.choice([None, f"o{rng.randrange(60)}"]),
                "sale_date": DAY + dt.timedelta(day // 9 * 9 if region == "sparse" else day),
                "region": region,
                "product_id": f"p{rng.randrange(8)}",
                "net_revenue": rng.choice([None, rng.randrange(1, 90), 0.25]),
            }
        )
    return made


@pytest.fixture(scope="module")
def products(spark):
    return spark.createDataFrame(
        [(f"p{n}", f"cat{n % 4}" if n % 4 else None) for n in range(7)], "product_id string, product_category string"
    ).cache()


def rebuilt(spark, rows, products, batches):
    return rows(gold.daily_sales_summary(b.sales(spark, *(line for batch in batches for line in batch)), products), *COLUMNS)


def plain(found):
    return [tuple(float(v) if v is not None and not isinstance(v, (str, dt.date)) else v for v in row) for row in found]


def test_batches_in_any_order_equal_the_rebuild(spark, rows, products, tmp_path):
    rng, target = random.Random(5), str(tmp_path / "parts")
    spans = [range(60, 120), range(0, 150), range(10, 12), [75], range(140, 145)]
    batches = [lines(rng, 150 if len(days) > 20 else 6, list(days)) for days in spans]
    for n, batch in enumerate(batches):
        gold_parts.add_lines(b.sales(spark, *batch), products, target, n)
        assert plain(rows(gold_parts.summary(spark, target), *COLUMNS)) == plain(rebuilt(spark, rows, products, batches[: n + 1]))


def test_a_small_change_rewrites_only_what_it_reaches(spark, rows, products, tmp_path):
    target = str(tmp_path / "parts")
    first = [{"order_id": f"o{day}", "sale_date": DAY + dt.timedelta(day), "product_id": "p1"} for day in range(200)]
    other = [{**line, "region": "South"} for line in first]
    gold_parts.add_lines(b.sales(spark, *first, *other), products, target, 0)
    gold_parts.add_lines(b.sales(spark, {"order_id": "late", "sale_date": DAY + dt.timedelta(50), "product_id": "p1"}), products, target, 1)
    written = spark.read.parquet(f"{target}/summary").where("batch_id = 1")
    days = sorted((row.sale_date - DAY).days for row in written.where("region = 'North'").collect())
    assert days == list(range(50, 80))
    assert written.where("region = 'South'").count() == 0
    assert spark.read.parquet(f"{target}/daily").where("batch_id = 1").count() == 1


def test_a_new_group_moves_the_look_back_of_its_series(spark, rows, products, tmp_path):
    """A series that sells rarely: its rows seven behind stand far beyond 29
    rows of the region."""
    rare = [{"order_id": f"r{n}", "sale_date": DAY + dt.timedelta(40 * n), "product_id": "p2", "net_revenue": n + 1} for n in range(12)]
    often = [{"order_id": f"o{day}", "sale_date": DAY + dt.timedelta(day), "product_id": "p1"} for day in range(480)]
    batches, target = [rare + often, [{**rare[3], "order_id": "new", "sale_date": DAY + dt.timedelta(130)}]], str(tmp_path / "parts")
    for n, batch in enumerate(batches):
        gold_parts.add_lines(b.sales(spark, *batch), products, target, n)
    assert plain(rows(gold_parts.summary(spark, target), *COLUMNS)) == plain(rebuilt(spark, rows, products, batches))


def test_retried_empty_and_folded_batches(spark, rows, products, tmp_path):
    rng, target, folded = random.Random(9), str(tmp_path / "parts"), str(tmp_path / "folded")
    batches = [lines(rng, 40, list(range(30))), [], lines(rng, 40, list(range(20, 50)))]
    frames = [b.sales(spark, *batch) for batch in batches]
    for n in (0, 1, 1, 0):
        if n == 0 or n == 1:
            gold_parts.add_lines(frames[n], products, target, n)
    whole = plain(rebuilt(spark, rows, products, batches[:1]))
    assert plain(rows(gold_parts.summary(spark, target), *COLUMNS)) == whole
    gold_parts.compact(spark, target, folded)
    for _ in range(2):
        gold_parts.add_lines(frames[2], products, folded, 2)
    assert plain(rows(gold_parts.summary(spark, folded), *COLUMNS)) == plain(rebuilt(spark, rows, products, batches))
    assert plain(rows(gold_parts.summary(spark, folded, 1), *COLUMNS)) == whole
