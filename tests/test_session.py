from __future__ import annotations

from types import SimpleNamespace

import builders as b
import pytest
from pyspark.sql import functions as F

from shelfline.operators import gold
from shelfline.plans.layers import layers
from shelfline.session import fresh_path, shared_folder


def test_shared_folder_comes_from_the_session(spark):
    assert spark.conf.get("spark.checkpoint.dir") in shared_folder(spark)
    assert fresh_path(spark, "x") != fresh_path(spark, "x")


def test_a_cluster_must_name_its_shared_folder():
    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://head:7077")
    session = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: default))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(session)


def test_a_hot_product_is_split_at_the_join(spark):
    """With broadcasts off and a third of the lines on one product."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {key: spark.conf.get(key, None) for key in settings}
    line = b.sales(spark, {}).drop("product_id", "order_id")
    fact = (
        spark.range(0, 60_000, 1, 8)
        .select(
            F.concat(F.lit("o"), F.col("id").cast("string")).alias("order_id"),
            F.when(F.col("id") % 3 == 0, "p0").otherwise(F.concat(F.lit("p"), (F.col("id") % 997).cast("string"))).alias("product_id"),
        )
        .withColumns({name: F.lit(value) for name, value in line.first().asDict().items() if value is not None})
    )
    goods = spark.range(997).select(
        F.concat(F.lit("p"), F.col("id").cast("string")).alias("product_id"),
        F.lit("Toys").alias("product_category"),
        F.lit("Games").alias("product_subcategory"),
        F.concat(F.lit("n"), F.col("id").cast("string")).alias("product_name"),
    )
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        found = gold.product_sales(fact, goods)
        assert found.agg(F.sum("total_units_sold")).first()[0] == 60_000
        found.collect()
        assert "skew=true" in found._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_changed_files_are_seen(spark, tmp_path):
    at = str(tmp_path)
    spark.range(3).write.parquet(f"{at}/region.parquet")
    first = layers(spark, at)
    assert layers(spark, at) is first and first.bronze.table("region").count() == 3
    spark.range(5).write.mode("append").parquet(f"{at}/region.parquet")
    assert layers(spark, at) is not first and layers(spark, at).bronze.table("region").count() == 8
