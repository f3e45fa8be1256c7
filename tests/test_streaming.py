from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from shelfline.streaming.daily import add_available, compact, current, daily_parts
from shelfline.streaming.ingest import append_available, stream_csv

SCHEMA = StructType(
    [
        StructField("id", LongType()),
        StructField("name", StringType()),
        StructField("amount", DoubleType()),
        StructField("_source_file", StringType()),
    ]
)
EVENTS = "ts timestamp, kind string, value double, user long"


def test_files_are_taken_in_once(spark, rows, tmp_path):
    inbox, target, state = (tmp_path / name for name in ("inbox", "target", "state"))
    inbox.mkdir()

    def run():
        append_available(stream_csv(spark, str(inbox), SCHEMA), str(target), str(state)).awaitTermination()
        return rows(spark.read.parquet(str(target)), "id", "name", "amount")

    (inbox / "a.csv").write_text("id,name,amount\n1,x,1.5\n2,NULL,oops\n")
    first = [(1, "x", 1.5), (2, None, None)]
    assert run() == first
    assert run() == first
    (inbox / "b.csv").write_text("id,name,amount\n3,y\n")
    assert run() == [*first, (3, "y", None)]


def at(day, hour=0):
    return dt.datetime(2024, 1, day, hour, tzinfo=dt.timezone.utc)


def run(spark, wave, inbox, target, state):
    spark.createDataFrame(wave, EVENTS).coalesce(1).write.mode("append").parquet(inbox)
    stream = spark.readStream.schema(EVENTS).parquet(inbox)
    add_available(stream, target, state, "ts", "value", ["kind"], "user").awaitTermination()


def places(tmp_path):
    return tuple(str(tmp_path / name) for name in ("inbox", "target", "state"))


def test_parts_add_up_to_the_batch_result(spark, rows, tmp_path):
    inbox, target, state = places(tmp_path)
    waves = [
        [(at(1), "view", 1.25, 1), (at(1, 5), "view", 2.5, 2), (at(2), "buy", 10.0, 1)],
        [(at(1, 9), "view", 0.1, 2), (at(3), "buy", 0.2, 1), (at(2), None, 1.0, None)],
    ]
    for wave in waves:
        run(spark, wave, inbox, target, state)
    whole = daily_parts(spark.read.parquet(inbox), "ts", "value", ["kind"])
    columns = ["day", "kind", "total_value", "value_count"]
    found = current(spark, target, ["kind"], distinct=True)
    assert rows(found, *columns) == rows(whole, *columns)
    assert rows(found, "kind", "distinct_values") == [(None, 0), ("buy", 1), ("buy", 1), ("view", 2)]


def test_late_rows_are_not_lost(spark, rows, tmp_path):
    inbox, target, state = places(tmp_path)
    for wave in ([(at(1), "v", 1.0, 1), (at(28), "v", 1.0, 1)], [(at(29), "v", 1.0, 1)], [(at(1), "v", 5.0, 1)]):
        run(spark, wave, inbox, target, state)
    first_day = current(spark, target, ["kind"]).where("day = '2024-01-01'")
    assert rows(first_day, "total_value") == [(Decimal("6.0000"),)]


def test_a_compacted_log_goes_on(spark, rows, tmp_path):
    inbox, first, state = places(tmp_path)
    second = str(tmp_path / "second")
    run(spark, [(at(1), "v", 1.0, 1), (at(2), "v", 4.0, 1)], inbox, first, state)
    run(spark, [(at(1), "v", 2.0, 1)], inbox, first, state)
    compact(spark, first, second, ["kind"], distinct=True)
    before = rows(current(spark, first, ["kind"], distinct=True))
    assert rows(current(spark, second, ["kind"], distinct=True)) == before
    run(spark, [(at(2), "v", 5.0, 2)], inbox, second, state)
    found = rows(current(spark, second, ["kind"], distinct=True), "total_value", "distinct_values")
    assert found == [(Decimal("3.0000"), 1), (Decimal("9.0000"), 2)]
