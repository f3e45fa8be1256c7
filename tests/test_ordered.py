"""The lazy forms give what Spark's own window functions give."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from shelfline.operators.ordered import order_bin, over_last_rows, tie_bins, tie_levels, with_rank, with_tiles


def frame(spark, n, seed=7):
    """A third of all rows in one group, a third sharing one value, some NULLs."""
    draw = random.Random(seed)
    data = [
        (
            i,
            None if i % 11 == 0 else ("hot" if draw.random() < 0.34 else f"k{draw.randrange(5)}"),
            None if i % 13 == 0 else (0 if draw.random() < 0.34 else draw.randrange(50)),
        )
        for i in range(n)
    ]
    return spark.createDataFrame(data, "id long, grp string, value long").repartition(4)


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 7, 1003])
@pytest.mark.parametrize("descending", [True, False])
def test_tiles_equal_ntile(spark, rows, n, descending):
    df = frame(spark, n)
    value = F.col("value").desc_nulls_last() if descending else F.col("value").asc_nulls_last()
    plain = df.withColumn("tile", F.ntile(5).over(Window.orderBy(value, F.col("id").asc_nulls_last())))
    assert rows(with_tiles(df, 5, "value", "id", "tile", descending)) == rows(plain)
    text = df.withColumn("id", F.col("id").cast("string"))
    plain = text.withColumn("tile", F.ntile(5).over(Window.orderBy(value, F.col("id").asc_nulls_last())))
    assert rows(with_tiles(text, 5, "value", "id", "tile", descending)) == rows(plain)


def test_equal_values_only(spark):
    same = spark.range(1000).withColumn("value", F.lit(7))
    sizes = with_tiles(same, 3, "value", "id", "tile").groupBy("tile").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top"))
    assert [tuple(row) for row in sizes.orderBy("tile").collect()] == [(1, 334, 333), (2, 333, 666), (3, 333, 999)]
    assert with_rank(same, [], "value", "rank").where("rank <> 1").count() == 0


def test_bins_follow_the_value(spark):
    values = [-1e12, -3.5, -3.4999, -1e-9, 0.0, 1e-9, 0.5, 1.0, 1.0001, 2.0, 3e5, 1e15]
    bins = [row.bin for row in spark.createDataFrame([(v,) for v in values], "v double").select(order_bin("v").alias("bin")).collect()]
    assert bins == sorted(bins)


@pytest.mark.parametrize("descending", [True, False])
def test_rank_equals_window_rank(spark, rows, descending):
    df = frame(spark, 800)
    order = F.col("value").desc_nulls_last() if descending else F.col("value").asc_nulls_last()
    plain = df.withColumn("rank", F.rank().over(Window.partitionBy("grp").orderBy(order)).cast("long"))
    assert rows(with_rank(df, ["grp"], "value", "rank", descending)) == rows(plain)


@pytest.mark.parametrize("descending", [True, False])
def test_rank_over_one_exchange_equals_window_rank(spark, rows, descending):
    df = frame(spark, 800)
    order = F.col("value").desc_nulls_last() if descending else F.col("value").asc_nulls_last()
    plain = df.withColumn("rank", F.rank().over(Window.partitionBy("grp").orderBy(order)).cast("long"))
    assert rows(with_rank(df, ["grp"], "value", "rank", descending, once=True)) == rows(plain)


@pytest.mark.parametrize("chunk_rows", [29, 40, 1000])
def test_rolling_frames_equal_window(spark, rows, chunk_rows):
    df = frame(spark, 600).withColumn("day", F.floor(F.col("id") / 7))

    def columns(window):
        return {
            "week": F.sum("value").over(window.rowsBetween(-6, 0)),
            "month": F.count("value").over(window.rowsBetween(-29, 0)),
        }

    plain = df.withColumns(columns(Window.partitionBy("grp").orderBy("day", "id")))
    assert rows(over_last_rows(df, ["grp"], ["day", "id"], 29, columns, chunk_rows)) == rows(plain)


def test_chunk_must_cover_the_frame(spark):
    with pytest.raises(ValueError):
        over_last_rows(spark.range(3), [], ["id"], 29, lambda window: {}, chunk_rows=28)


@pytest.mark.parametrize("repeats", [1, 2, 7])
def test_repeated_rows_fill_tiles_evenly(spark, repeats):
    rows = spark.range(12).selectExpr("id", "id % 2 AS value", f"explode(sequence(1, {repeats})) AS copy")
    sizes = [r.n for r in with_tiles(rows, 5, "value", "id", "tile").groupBy("tile").agg(F.count(F.lit(1)).alias("n")).orderBy("tile").collect()]
    assert sizes == [12 * repeats // 5 + (i < 12 * repeats % 5) for i in range(5)]


def test_a_third_in_one_tie_meets_no_large_window(spark, rows):
    """Ids with a long common beginning, a third of the values 0."""
    df = spark.range(20_000).selectExpr("concat('CUSTOMER-', lpad(id, 9, '0')) AS id", "IF(id % 3 = 0, 0, id % 977 + 1) AS value").repartition(4)
    tiled = with_tiles(df, 5, "value", "id", "tile")
    plain = df.withColumn("tile", F.ntile(5).over(Window.orderBy(F.col("value").desc(), "id")))
    assert rows(tiled) == rows(plain)
    keys = df.selectExpr("value AS _v", "concat('0', id) AS _t")
    groups = tie_bins(keys, tie_levels(keys))
    most, whole = groups.agg(F.max("_bin_rows"), F.sum("_bin_rows")).first()
    assert most <= 1000 and whole == 20_000
    low = with_tiles(df, 5, "value", "id", "tile", descending=False)
    assert rows(low) == rows(df.withColumn("tile", F.ntile(5).over(Window.orderBy("value", "id"))))


def test_ties_of_many_shapes(spark, rows):
    texts = ["", "a", "ab", "abc" * 20, "abc" * 20 + "d", "é", "zz", None, "Z", "a b"]
    data = [(n % 3, texts[n % len(texts)] if n % 4 else f"{texts[n % 9]}{n}") for n in range(90)]
    df = spark.createDataFrame(sorted(set(data), key=str), "value long, tie string")
    for tiles in (2, 200):
        plain = df.withColumn("tile", F.ntile(tiles).over(Window.orderBy(F.col("value").desc_nulls_last(), F.col("tie").asc_nulls_last())))
        assert rows(with_tiles(df, tiles, "value", "tie", "tile")) == rows(plain)
    with pytest.raises(ValueError):
        with_tiles(df.withColumn("tie", F.lit(0.5)), 5, "value", "tie", "tile")
