"""Row ids over loads and streams, and the exchange of a table in one step."""

from __future__ import annotations

import builders as b
import pytest
from pyspark.sql import functions as F

from shelfline.plans.batch import append_bronze, load_bronze
from shelfline.schemas import BRONZE, RAW_TRANSACTIONS
from shelfline.sources import catalog
from shelfline.sources.catalog import create_layers, create_tables, location, overwrite_table
from shelfline.sources.csv_files import file_columns, read_csv
from shelfline.sources.keys import numbered
from shelfline.streaming.ingest import append_available, append_numbered, stream_csv


@pytest.fixture
def databases(spark, tmp_path):
    create_layers(spark, location=str(tmp_path / "layers"))
    create_tables(spark)
    yield
    for name in catalog.LAYERS:
        spark.sql(f"DROP DATABASE {name} CASCADE")


def ids(df):
    return {(row.order_id, row.row_id) for row in df.select("order_id", "row_id").collect()}


def lines(spark, *orders):
    return b.transactions(spark, *({"order_id": order} for order in orders)).drop("row_id").repartition(3)


def test_ids_are_dense_and_go_on(spark, tmp_path):
    ledger = str(tmp_path / "ledger")
    first, span = numbered(spark.range(100).repartition(7), ledger, "a")
    assert span == (0, 100) and sorted(row.row_id for row in first.collect()) == list(range(100))
    second, span = numbered(spark.range(30).repartition(4), ledger, "b")
    assert span == (100, 130) and sorted(row.row_id for row in second.collect()) == list(range(100, 130))
    none, span = numbered(spark.range(0), ledger, "c")
    assert span == (130, 130) and none.count() == 0


def test_a_repeated_load_gives_the_same_ids(spark, tmp_path):
    ledger = str(tmp_path / "ledger")
    rows = spark.range(50).repartition(5)
    first = {tuple(row) for row in numbered(rows, ledger, "x/1")[0].collect()}
    again, span = numbered(rows.repartition(2), ledger, "x/1")
    assert {tuple(row) for row in again.collect()} == first and span == (0, 50)


def test_a_retry_after_a_lost_stage_keeps_its_range(spark, tmp_path):
    ledger = str(tmp_path / "ledger")
    numbered(spark.range(50), ledger, "one")
    numbered(spark.range(10), ledger, "two")
    assert numbered(spark.range(50), ledger, "one")[1] == (0, 50)
    numbered(spark.range(10), ledger, "two")
    assert numbered(spark.range(51), ledger, "one")[1] == (60, 111)


def test_given_ids_are_kept_and_passed_over(spark, tmp_path):
    rows = spark.createDataFrame([(7, "a"), (None, "b"), (40, "c"), (None, "d")], "row_id long, order_id string")
    found = ids(numbered(rows, str(tmp_path / "ledger"), "l")[0])
    assert {("a", 7), ("c", 40)} <= found and len({n for _, n in found}) == 4 and all(n > 40 for o, n in found if o in "bd")
    assert numbered(spark.range(1), str(tmp_path / "ledger"), "m")[1] == (45, 46)


def test_loads_of_a_table_never_share_ids(spark, databases):
    assert load_bronze(spark, raw_transactions=lines(spark, "a", "b", "c")) == {"raw_transactions": 3}
    before = ids(spark.table("bronze.raw_transactions"))
    assert append_bronze(spark, "monday", raw_transactions=lines(spark, "d", "e")) == {"raw_transactions": 2}
    after = ids(spark.table("bronze.raw_transactions"))
    assert before < after and sorted(n for _, n in after) == [0, 1, 2, 3, 4]
    assert append_bronze(spark, "monday", raw_transactions=lines(spark, "d", "e")) == {"raw_transactions": 0}
    assert ids(spark.table("bronze.raw_transactions")) == after
    load_bronze(spark, raw_transactions=lines(spark, "z"))
    assert ids(spark.table("bronze.raw_transactions")) == {("z", 5)}
    with pytest.raises(ValueError):
        append_bronze(spark, "x", raw_products=spark.range(1))


@pytest.mark.parametrize("name", sorted(BRONZE))
def test_every_bronze_table_streams(spark, tmp_path, name):
    inbox, schema = tmp_path / "inbox", BRONZE[name]
    inbox.mkdir()
    columns = file_columns(schema)
    (inbox / "a.csv").write_text(",".join(columns) + "\n" + ",".join("1" for _ in columns) + "\n")
    target = str(tmp_path / "out")
    append_available(stream_csv(spark, str(inbox), schema), target, str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(target).count() == 1


def test_streamed_lines_are_numbered_once(spark, tmp_path):
    inbox, target, state = tmp_path / "inbox", str(tmp_path / "out"), str(tmp_path / "state")
    inbox.mkdir()
    columns = file_columns(RAW_TRANSACTIONS)

    def arrive(file, *orders):
        body = "\n".join(",".join(order if c == "order_id" else "1" for c in columns) for order in orders)
        (inbox / file).write_text(",".join(columns) + "\n" + body + "\n")

    def run():
        stream = stream_csv(spark, str(inbox), RAW_TRANSACTIONS, maxFilesPerTrigger="1")
        append_numbered(stream, target, state).awaitTermination()
        return ids(spark.read.parquet(target))

    arrive("a.csv", "o1", "o2")
    arrive("b.csv", "o3")
    first = run()
    assert sorted(n for _, n in first) == [0, 1, 2] and run() == first
    arrive("c.csv", "o4", "o5")
    second = run()
    assert first < second and sorted(n for _, n in second) == [0, 1, 2, 3, 4]
    # The last batch is run again, as after a failure before its commit.
    (tmp_path / "state" / "commits" / "2").unlink()
    (tmp_path / "state" / "commits" / ".2.crc").unlink(missing_ok=True)
    assert run() == second


class Killed(Exception):
    pass


def killed(*_, **__):
    raise Killed


@pytest.mark.parametrize("step", ["_point", "_set_location", "_sweep"])
def test_a_run_ended_at_any_step_leaves_a_whole_table(spark, databases, monkeypatch, step):
    overwrite_table(spark.range(5), "gold.t")
    reader = spark.table("gold.t")
    with monkeypatch.context() as patch:
        patch.setattr(catalog, step, killed)
        with pytest.raises(Killed):
            overwrite_table(spark.range(9).withColumn("more", F.lit(1)), "gold.t")
    assert spark.table("gold.t").count() == (9 if step == "_sweep" else 5)
    assert reader.count() == 5
    assert overwrite_table(spark.range(3).withColumn("more", F.lit(2)), "gold.t") == 3
    assert spark.table("gold.t").agg(F.sum("more")).first()[0] == 6


def test_leftovers_are_swept_and_readers_end_undisturbed(spark, databases, tmp_path):
    import os

    overwrite_table(spark.range(5), "gold.t")
    old = spark.table("gold.t")
    overwrite_table(spark.table("gold.t").where("id < 2"), "gold.t")
    assert old.count() == 5 and spark.table("gold.t").count() == 2
    folder = location(spark, "gold.t").removeprefix("file:").rsplit("/", 1)[0]
    os.makedirs(f"{folder}/left-behind")
    overwrite_table(spark.range(1), "gold.t")
    assert len(os.listdir(folder)) == 2 and spark.table("gold.t").count() == 1


def test_a_table_may_change_its_columns(spark, databases):
    overwrite_table(spark.range(5).withColumn("a", F.lit("x")), "gold.t")
    assert overwrite_table(spark.range(2).withColumn("a", F.lit(1.5)), "gold.t") == 2
    assert spark.table("gold.t").dtypes == [("id", "bigint"), ("a", "double")]
    assert overwrite_table(spark.range(4), "gold.t") == 4 and spark.table("gold.t").columns == ["id"]
