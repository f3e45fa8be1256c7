"""Incremental daily aggregates over an event stream.

Every batch writes what it adds to each day and key as its own partition:
exact sums and counts, and the distinct values met. Reading adds the parts
together. So events may come in any order and any late, nothing waits for a
watermark, no state is kept, and a batch that is retried replaces its part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import DecimalType

BATCH = "batch_id"
AMOUNT = DecimalType(18, 4)
TOTAL = DecimalType(28, 4)


def daily_parts(rows: DataFrame, ts_col: str, value_col: str, keys: Sequence[str]) -> DataFrame:
    """Sum and count per day and key of some rows; decimal, so that parts add
    up to the same total in any order."""
    return rows.groupBy(F.col(ts_col).cast("date").alias("day"), *keys).agg(
        F.sum(F.col(value_col).cast(AMOUNT)).cast(TOTAL).alias("total_value"), F.count(value_col).alias("value_count")
    )


def add_available(
    stream: DataFrame,
    target: str,
    checkpoint: str,
    ts_col: str,
    value_col: str,
    keys: Sequence[str],
    distinct_col: str | None = None,
) -> StreamingQuery:
    """Add the events that have arrived to the parts in `target`."""

    def write_batch(rows: DataFrame, batch_id: int) -> None:
        parts = daily_parts(rows, ts_col, value_col, keys)
        parts.write.mode("overwrite").parquet(f"{target}/sums/{BATCH}={batch_id}")
        if distinct_col:
            met = rows.select(F.col(ts_col).cast("date").alias("day"), *keys, F.col(distinct_col).alias("_value"))
            met.distinct().write.mode("overwrite").parquet(f"{target}/met/{BATCH}={batch_id}")

    return (
        stream.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(write_batch)
        .trigger(availableNow=True)
        .start()
    )


def current(spark: SparkSession, target: str, keys: Sequence[str], distinct: bool = False) -> DataFrame:
    """The aggregate per day and key; with `distinct` also the exact number of
    distinct values."""
    identity = ["day", *keys]
    sums = spark.read.parquet(f"{target}/sums").groupBy(*identity).agg(
        F.sum("total_value").cast(TOTAL).alias("total_value"), F.sum("value_count").alias("value_count")
    )
    if not distinct:
        return sums
    met = spark.read.parquet(f"{target}/met").select(*identity, "_value").distinct()
    counted = met.groupBy(*[F.col(name).alias(f"_of_{name}") for name in identity]).agg(F.count("_value").alias("distinct_values"))
    same = F.lit(True)
    for name in identity:
        same = same & F.col(name).eqNullSafe(F.col(f"_of_{name}"))
    return sums.join(counted, same, "left").drop(*(f"_of_{name}" for name in identity))


def compact(spark: SparkSession, target: str, into: str, keys: Sequence[str], distinct: bool = False) -> None:
    """Fold the parts of `target` into one part in `into`, under the newest
    batch id. Between two runs of the stream: later batches then go to `into`,
    over the same checkpoint."""
    newest = spark.read.parquet(f"{target}/sums").agg(F.max(BATCH)).first()[0]
    current(spark, target, keys).write.mode("overwrite").parquet(f"{into}/sums/{BATCH}={newest}")
    if distinct:
        met = spark.read.parquet(f"{target}/met").drop(BATCH).distinct()
        met.write.mode("overwrite").parquet(f"{into}/met/{BATCH}={newest}")
