"""Row ids that hold over loads, streams and retries.

A ledger beside the table hands out ranges of ids above its high-water mark,
one range per load. A load's rows are written once, each with the task that
wrote it and its place there; counts per task and their running sum then turn
that into dense ids. A load that is repeated under its name finds its rows and
its range again and gives the same ids, whatever became of the first attempt.
"""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfline.session import file_system

_AT = "_at"
# `monotonically_increasing_id` keeps the task above these bits.
PLACE_BITS = 33


def _exists(spark: SparkSession, path: str) -> bool:
    place, files = file_system(spark, path)
    return files.exists(place)


def _others_deleted(spark: SparkSession, folder: str, keep: str) -> None:
    place, files = file_system(spark, folder)
    for entry in files.listStatus(place):
        if entry.getPath().getName() != keep:
            files.delete(entry.getPath(), True)


def _reserved(spark: SparkSession, ledger: str, load: str, rows: int, highest_given: int | None) -> int:
    """The first id of the load's range: the one it has, or a new one. A range
    that no longer fits the load's rows is given up; its ids are not reused."""
    ranges = f"{ledger}/ranges"
    known = spark.read.schema("load string, first_id long, rows long, next_id long").parquet(ranges).collect() if _exists(spark, ranges) else []
    own = [row for row in known if row.load == load and row.rows == rows]
    if own:
        return own[0].first_id
    first = max([0, *(row.next_id for row in known), *([] if highest_given is None else [highest_given + 1])])
    entry = spark.createDataFrame([(load, first, rows, first + rows)], "load string, first_id long, rows long, next_id long")
    entry.coalesce(1).write.mode("append").parquet(ranges)
    return first


def _task() -> Column:
    return F.shiftrightunsigned(_AT, PLACE_BITS)


def _staged(ledger: str, load: str) -> str:
    return f"{ledger}/staged/{quote(load, safe='')}"


def is_staged(spark: SparkSession, ledger: str, load: str) -> bool:
    """Whether an attempt at the load has left its rows."""
    return _exists(spark, f"{_staged(ledger, load)}/_SUCCESS")


def completed(written: DataFrame, ledger: str, load: str, column: str = "row_id") -> DataFrame | None:
    """None if every row of a load brought an id, else the rows `numbered`.

    `written` must be stored, so that ids read twice are the same. Ids that rows
    brought count in the ledger, whose next range starts above them.
    """
    given = F.col(column).cast("long")
    rows, with_id, highest = written.agg(F.count(F.lit(1)), F.count(given), F.max(given)).first()
    if with_id < rows:
        return numbered(written, ledger, load, column)[0]
    _reserved(written.sparkSession, ledger, load, rows, highest)
    return None


def numbered(rows: DataFrame, ledger: str, load: str, column: str = "row_id") -> tuple[DataFrame, tuple[int, int]]:
    """`rows` with an id where `column` has none, and the load's range of ids
    (first, and the one after the last).

    Ids that rows bring along are kept, and the range starts above them. Only
    one load at a time may use a ledger; its rows stay readable until the next.
    The ledger holds a row per load; of its tasks, one count each is collected
    by Spark into a broadcast of 16 bytes a task.
    """
    spark, staged = rows.sparkSession, _staged(ledger, load)
    if not is_staged(spark, ledger, load):
        rows.withColumn(_AT, F.monotonically_increasing_id()).write.mode("overwrite").option("compression", "zstd").parquet(staged)
    _others_deleted(spark, *staged.rsplit("/", 1))
    held = spark.read.parquet(staged)
    given = F.col(column).cast("long") if column in rows.columns else F.lit(None).cast("long")
    counts = held.groupBy(_task().alias("_task")).agg(F.count(F.lit(1)).alias("_rows"), F.max(given).alias("_given"))
    total = counts.agg(F.sum("_rows"), F.max("_given")).first()
    count = total[0] or 0
    first = _reserved(spark, ledger, load, count, total[1])
    # One row per task of the load in this window.
    earlier = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_task", (F.lit(first) + F.coalesce(F.sum("_rows").over(earlier), F.lit(0))).alias("_start"))
    place = F.col(_AT).bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    joined = held.withColumn("_task", _task()).join(F.broadcast(starts), "_task")
    filled = F.coalesce(given, F.col("_start") + place).alias(column)
    names = rows.columns if column in rows.columns else [column, *rows.columns]
    return joined.select(*(filled if name == column else name for name in names)), (first, first + count)
