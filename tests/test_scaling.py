"""What moves and what is written, on plans and folders."""

from __future__ import annotations

import os
import time

import conftest
import pytest

from shelfline.operators import gold
from shelfline.operators.silver import silver_sales
from shelfline.plans import registry
from shelfline.plans.batch import load_bronze
from shelfline.plans.layers import Layers
from shelfline.sources import catalog
from shelfline.sources.order_tables import OrderTables


@pytest.fixture
def setting(spark):
    before = {}

    def put(name, value):
        before.setdefault(name, spark.conf.get(name, None))
        spark.conf.set(name, value)

    yield put
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def _exchanges(df, by=""):
    """Output columns of the exchanges of the plan as first made."""

    def nodes(plan):
        yield plan
        children = plan.children()
        for n in range(children.length()):
            yield from nodes(children.apply(n))

    plan = df._jdf.queryExecution().executedPlan()
    start = plan.initialPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan
    return [node.output().mkString(",") for node in nodes(start) if "Exchange" in node.nodeName() and by in node.simpleString(1000)]


def _batches(target):
    return sorted(name for name in os.listdir(target.removeprefix("file:")) if name.startswith("batch_id="))


def test_a_batch_of_the_kept_up_summary_may_hold_many_files(spark, monkeypatch, setting):
    setting("spark.sql.files.maxRecordsPerFile", "500")
    targets, summary = [], registry.gold_parts.summary
    monkeypatch.setattr(registry.gold_parts, "summary", lambda spark, target: targets.append(target) or summary(spark, target))
    registry.QUERIES["incremental_daily_summary"](spark, conftest.DATA)
    assert len(_batches(f"{targets[0]}/summary")) == 3


def test_a_batch_of_streamed_lines_may_hold_many_files(spark, monkeypatch, setting):
    setting("spark.sql.files.maxRecordsPerFile", "500")
    targets, append = [], registry.append_numbered
    monkeypatch.setattr(registry, "append_numbered", lambda rows, target, state: targets.append(target) or append(rows, target, state))
    registry.QUERIES["stream_csv_transactions"](spark, conftest.DATA)
    assert len(_batches(targets[0])) == 4


def test_lines_move_for_parts_and_orders_only(spark, setting):
    setting("spark.sql.autoBroadcastJoinThreshold", "-1")
    moved = _exchanges(OrderTables(spark, conftest.DATA).transactions())
    assert sum("row_id" in output for output in moved) == 2


def test_lines_move_with_costs_and_days(spark, setting):
    setting("spark.sql.autoBroadcastJoinThreshold", "-1")
    orders = OrderTables(spark, conftest.DATA)
    moved = [output for output in _exchanges(orders.transactions()) if "row_id" in output]
    assert moved and not any("p_retailprice" in output for output in moved)
    kept = orders.transactions().where("order_date IS NULL OR ship_date IS NULL OR length(ship_date) <> 10")
    assert kept.count() == 0


def test_product_performance_moves_lines_once_and_counts_orders_apart(spark, setting):
    setting("spark.sql.autoBroadcastJoinThreshold", "-1")
    setting("spark.sql.adaptive.enabled", "false")
    at = Layers(spark, conftest.DATA)
    ranked = gold.product_performance(at.fact, at.products)
    moved = _exchanges(ranked, "hashpartitioning(product_id")
    assert sum("net_revenue" in output for output in moved) == 1
    assert any("gid" in output for output in _exchanges(ranked))


def _shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = (path.rsplit("/", 1)[-1] for path in files.mkString("\n").split("\n"))
    return {name for name in names if name.startswith("shuffle_")}


def test_a_stored_table_leaves_no_shuffle_files(spark, setting):
    setting("spark.sql.autoBroadcastJoinThreshold", "-1")
    before, conf = _shuffle_files(spark), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    fact = Layers(spark, conftest.DATA).fact
    until = time.monotonic() + 20  # they are deleted in the background
    while _shuffle_files(spark) - before and time.monotonic() < until:
        time.sleep(0.2)
    assert not _shuffle_files(spark) - before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == conf
    assert fact.count() > 0


def test_derived_columns_of_the_fact_are_not_moved(spark, rows):
    at = Layers(spark, conftest.DATA)
    sources = at.bronze.transactions(), at.bronze.warehouses(), at.bronze.state_codes()
    dealt = silver_sales(*sources, arranged=catalog.clustered_by_date)
    moved = _exchanges(at._sales(catalog.clustered_by_date), "rangepartitioning")
    assert len(moved) == 1 and "net_revenue" not in moved[0]
    names = [name for name in dealt.columns if name != "_processed_at"]
    assert rows(dealt, *names) == rows(silver_sales(*sources), *names)


def test_stored_lines_are_not_joined_again(spark):
    at = Layers(spark, conftest.DATA)
    at.lines
    assert not any("lineitem" in path for path in at.sales().inputFiles())


def test_lines_of_a_csv_query_are_written_compressed(spark):
    at = Layers(spark, conftest.DATA)
    path = registry._as_csv(at, "products", at.bronze.products(), registry.RAW_PRODUCTS)
    parts = [name for name in os.listdir(path.removeprefix("file:")) if name.startswith("part-")]
    assert parts and all(name.endswith(".csv.gz") for name in parts)


@pytest.fixture
def bronze(spark, tmp_path):
    catalog.create_layers(spark, ["scaling_b", "scaling_s"], str(tmp_path))
    catalog.create_tables(spark, "scaling_b", "scaling_s")
    yield "scaling_b"
    for name in ("scaling_b", "scaling_s"):
        spark.sql(f"DROP DATABASE {name} CASCADE")


def _loaded(spark, bronze, load, *ids):
    lines = spark.createDataFrame([(number, f"o{n}") for n, number in enumerate(ids)], "row_id long, order_id string")
    load_bronze(spark, bronze, load, raw_transactions=lines)
    return sorted(row.row_id for row in spark.table(f"{bronze}.raw_transactions").collect())


def test_lines_that_bring_their_ids_are_written_once(spark, bronze, tmp_path):
    assert _loaded(spark, bronze, "a", 7, 3, 3) == [3, 3, 7]
    assert not (tmp_path / bronze / "_keys" / "raw_transactions" / "staged").exists()
    assert len(list((tmp_path / bronze / "raw_transactions__versions").iterdir())) == 2


def test_lines_that_lack_an_id_get_one_above_all(spark, bronze):
    _loaded(spark, bronze, "a", 7, 3)
    first = _loaded(spark, bronze, "b", 20, None)
    assert first[0] == 20 and first[1] > 20
    assert _loaded(spark, bronze, "b", 20, None) == first
