from __future__ import annotations

import builders as b
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from shelfline.operators.quality import row_rules
from shelfline.plans.batch import load_bronze, publish_gold, run_all
from shelfline.schemas import BRONZE, FACT_SALES, RAW_PRODUCTS, SILVER
from shelfline.sources.catalog import (
    append_table,
    clustered_by_date,
    create_layers,
    create_tables,
    overwrite_table,
    table_inventory,
)
from shelfline.sources.csv_files import file_columns, ragged, read_csv

SMALL = StructType([StructField("id", LongType()), StructField("name", StringType()), StructField("amount", DoubleType())])


def test_csv_format(spark, rows, tmp_path):
    (tmp_path / "one.csv").write_text('id,name,amount\n1, "a ""q"" b" ,2.5\n2,NULL,\n3,null,3.0,extra\n4,x\n5, padded ,oops\n')
    found = read_csv(spark, str(tmp_path), SMALL)
    assert rows(found, "id", "name", "amount") == [(1, 'a "q" b', 2.5), (2, None, None), (3, None, 3.0), (4, "x", None), (5, "padded", None)]
    assert rows(found.where("size(_unreadable) > 0"), "id", "_unreadable") == [(5, ["amount"])]


def test_csv_folder_gives_lineage(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.csv").write_text("h1,h2,h3,h4,h5,h6,h7,h8,h9\np1,Name,Toys,Games,Brand,,1.5,2.5,NULL\n")
    schema = StructType([*RAW_PRODUCTS.fields, StructField("_source_file", StringType())])
    found = read_csv(spark, str(tmp_path), schema).collect()
    assert sorted(row._source_file.rsplit("/", 1)[1] for row in found) == ["a.csv", "b.csv"]
    assert all(row._loaded_at is not None and row.supplier is None and row.weight_kg is None for row in found)


@pytest.fixture
def databases(spark):
    names = ["bronze", "silver", "gold", "staging"]
    create_layers(spark)
    yield names
    for name in names:
        spark.sql(f"DROP DATABASE {name} CASCADE")


def test_tables_are_created_once(spark, databases):
    assert len(create_tables(spark)) == len(BRONZE) + len(SILVER) == 7
    append_table(b.warehouses(spark, {"warehouse_id": "w1"}), "bronze.raw_warehouses")
    assert create_tables(spark) == []
    assert spark.table("bronze.raw_warehouses").count() == 1
    assert len(create_tables(spark, replace=True)) == 7
    assert spark.table("bronze.raw_warehouses").count() == 0
    stored = spark.table("silver.fact_sales").schema
    assert [(f.name, f.dataType) for f in stored] == [(f.name, f.dataType) for f in FACT_SALES]


def test_overwrite_counts_and_replaces(spark, databases):
    assert overwrite_table(spark.range(5), "gold.t") == 5
    assert overwrite_table(spark.range(2), "gold.t") == 2


def test_a_failed_overwrite_leaves_the_old_table(spark, databases):
    overwrite_table(spark.range(5), "gold.t")
    with pytest.raises(Exception, match="no such value"):
        overwrite_table(spark.range(9).selectExpr("raise_error('no such value') AS id"), "gold.t")
    assert spark.table("gold.t").count() == 5


def test_the_fact_is_stored_in_disjoint_date_ranges(spark, tmp_path):
    import datetime as dt

    fact = b.sales(spark, *[{"order_id": f"o{n}", "sale_date": dt.date(2024, 1, 1) + dt.timedelta(n % 40)} for n in range(400)])
    at = str(tmp_path / "fact")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        clustered_by_date(fact).write.parquet(at)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    found = spark.read.parquet(at).selectExpr("sale_date", "_metadata.file_path AS file").groupBy("file").agg({"sale_date": "min"}).collect()
    ends = spark.read.parquet(at).selectExpr("sale_date", "_metadata.file_path AS file").groupBy("file").agg({"sale_date": "max"}).collect()
    ranges = sorted((row["min(sale_date)"], {e.file: e["max(sale_date)"] for e in ends}[row.file]) for row in found)
    assert len(ranges) > 1 and all(left[1] <= right[0] for left, right in zip(ranges, ranges[1:]))


def test_pipeline_end_to_end(spark, databases, rows):
    create_tables(spark)
    load_bronze(
        spark,
        raw_transactions=b.transactions(
            spark,
            {"warehouse_id": "w1"},
            {"order_id": "o2", "customer_id": "c2", "warehouse_id": None},
            {"order_date": "not a date"},
            warehouse=True,
        ),
        raw_products=spark.createDataFrame([("p1", "Name", "Toys", 4.0, 10.0)], "product_id string, product_name string, category string, unit_cost double, list_price double"),
        raw_warehouses=b.warehouses(spark, {"warehouse_id": "w1"}),
        raw_customers=spark.createDataFrame([("c1", "2024-01-01"), ("c2", None)], "customer_id string, signup_date string"),
    )
    report = run_all(spark)
    assert rows(report) == [
        ("gold.customer_features", 2),
        ("gold.product_features", 1),
        ("silver.dim_customers", 2),
        ("silver.dim_products", 1),
        ("silver.fact_sales", 2),
        ("silver.quarantined_sales", 1),
    ]
    assert spark.table("silver.fact_sales").columns == FACT_SALES.names
    assert rows(spark.table("silver.fact_sales"), "order_id", "warehouse_id") == [("o1", "w1"), ("o2", "w1")]
    assert set(publish_gold(spark).values()) == {1, 2}
    assert spark.sql("SELECT total_orders FROM gold.kpi_summary").first().total_orders == 2
    listed = rows(table_inventory(spark))
    assert ("silver", "fact_sales", 2) in listed and len(listed) == 16


def test_csv_landing_to_gold(spark, databases, tmp_path):
    landing = {
        "raw_transactions": "o1,2024-01-05,c1,Ann,Home,North,State 1,City,p1,Lamp,Light,Desk,2,10.0,0.25,15.0,3.0,Air,2024-01-07\n"
        "o2,2024-01-06,c1,Ann,Home,North,State 1,City,p1,Lamp,Light,Desk,1,10.0,NULL,10.0,2.0,Air,2024-01-16\n",
        "raw_products": "p1,Lamp,Light,Desk,Brand,Supplier,4.0,10.0,1.5\n",
        "raw_warehouses": "w1,Depot,North,State 1,City,100,Bo\n",
        "raw_customers": "c1,Ann,Home,North,State 1,City,2023-12-01,Gold\n",
    }
    create_tables(spark)
    frames = {}
    for name, lines in landing.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "part.csv").write_text(",".join(file_columns(BRONZE[name])) + "\n" + lines)
        frames[name] = read_csv(spark, str(tmp_path / name), BRONZE[name])
    assert load_bronze(spark, **frames) == {name: len(lines.splitlines()) for name, lines in landing.items()}
    run_all(spark)
    publish_gold(spark)
    card = spark.table("gold.kpi_summary").first()
    assert (card.total_orders, card.total_revenue, card.overall_margin_pct) == (2, 25, 20.0)
    depot = spark.table("gold.warehouse_monthly_performance").first()
    assert (depot.warehouse_name, depot.fulfillment_rate, depot.avg_days_to_ship) == ("Depot", 50.0, 6.0)
    assert spark.table("gold.customer_features").first().loyalty_tier == "Gold"
    assert spark.table("gold.product_features").first().avg_discount_rate == 0.125


def test_run_stops_at_the_first_failure(spark, databases):
    with pytest.raises(Exception, match="raw_transactions"):
        run_all(spark)
    assert rows_of(table_inventory(spark)) == []


def rows_of(df):
    return [tuple(row) for row in df.collect()]


def test_date_clustering_keeps_every_row(spark):
    fact = b.sales(spark, *[{"order_id": f"o{n}"} for n in range(30)])
    assert clustered_by_date(fact).count() == 30


def test_ragged_lines_are_kept_as_they_stood(spark, rows, tmp_path):
    lines = ["id,name,amount", "1,a,2.5", '2,"b, c",1,more,"x, y"', "3", "4,d,oops,more", ",,", '5,"e ""q"" f",1.5']
    (tmp_path / "one.csv").write_text("\n".join(lines) + "\n")
    found = read_csv(spark, str(tmp_path), SMALL)
    assert rows(found, "id", "name", "amount") == [(None, None, None), (1, "a", 2.5), (2, "b, c", 1.0), (3, None, None), (4, "d", None), (5, 'e "q" f', 1.5)]
    assert rows(ragged(found, SMALL), "id", "_fields", "_columns", "_raw_line") == [(2, 5, 3, lines[2]), (3, 1, 3, "3"), (4, 4, 3, lines[4])]
    assert rows(found.where("size(_unreadable) > 0"), "id") == [(4,)]
    counted = row_rules(found, "t", {"ragged:line": F.col("_raw_line").isNotNull()}).first()
    assert (counted.failed_rows, counted.total_rows) == (3, 6)
    assert found.select("id").count() == 6 and found.where("_raw_line IS NOT NULL").count() == 3


def test_other_dates_reach_every_table(spark, databases):
    create_tables(spark)
    lines = b.transactions(spark, {"order_date": "31/01/2024", "ship_date": "20240203", "warehouse_id": "w1"}, {"order_date": "2024-01-31"}, warehouse=True)
    load_bronze(
        spark,
        raw_transactions=lines,
        raw_products=spark.createDataFrame([("p1", "Toys")], "product_id string, category string"),
        raw_warehouses=b.warehouses(spark, {"warehouse_id": "w1"}),
        raw_customers=spark.createDataFrame([("c1", "01/12/2023")], "customer_id string, signup_date string"),
    )
    run_all(spark, date_formats=["dd/MM/yyyy", "yyyyMMdd"])
    sale = spark.table("silver.fact_sales").first()
    assert (str(sale.sale_date), sale.days_to_ship) == ("2024-01-31", 3)
    assert spark.table("silver.quarantined_sales").first()._reason == "unreadable order_date"
    assert str(spark.table("silver.dim_customers").first().signup_date) == "2023-12-01"
