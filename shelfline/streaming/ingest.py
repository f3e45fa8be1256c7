"""Continuous ingestion of dropped files into bronze."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from shelfline.sources.csv_files import read_options, tidy, with_source
from shelfline.sources.keys import numbered


def stream_csv(spark: SparkSession, folder: str, schema: StructType, **options: str) -> DataFrame:
    """New CSV files of `folder` as a stream of rows in `schema`."""
    text, settings = read_options(schema)
    files = spark.readStream.schema(text).options(**{**settings, **options}).csv(folder)
    return tidy(with_source(files), schema)


def append_available(rows: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append what has arrived since the last run to the parquet at `target`.

    Files are remembered in `checkpoint`: a second run adds only new ones.
    """
    return (
        rows.writeStream.format("parquet")
        .outputMode("append")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def append_numbered(rows: DataFrame, target: str, checkpoint: str, column: str = "row_id") -> StreamingQuery:
    """As `append_available`, with an id in `column` for every row without one.

    Each batch takes its range of ids from a ledger under `target` by its batch
    id and replaces its own part of `target`, so a batch that is run again
    leaves the same rows under the same ids. A target belongs to one checkpoint.
    """

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        part, _ = numbered(batch, f"{target}/_keys", f"batch-{batch_id}", column)
        part.write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")

    return (
        rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write_batch).trigger(availableNow=True).start()
    )
