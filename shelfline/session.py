"""Session settings, and where intermediate results may be written."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

_DISCARD_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# AQE picks join strategies from measured sizes, merges small shuffle
# partitions and splits hot ones. The first broadcast threshold is held against
# sizes estimated from files, the second against sizes measured at run time.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128MB",
    "spark.sql.autoBroadcastJoinThreshold": "64MB",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "128MB",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.filterPushdown": "true",
}


def spark_session(app_name: str, master: str | None = None, **conf: str) -> SparkSession:
    """A session with the library's settings; keyword names use `__` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, from `spark.checkpoint.dir`.

    A machine-local folder stands in only for a single-machine session.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            named = tempfile.mkdtemp(prefix="shelfline-")
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def file_system(spark: SparkSession, path: str):
    """The Hadoop path of `path` and the file system it is in."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def discard_at_exit(spark: SparkSession, path: str) -> None:
    """Delete a written folder when the application's JVM ends."""
    place, files = file_system(spark, path)
    files.deleteOnExit(place)


@contextmanager
def shuffles_discarded(spark: SparkSession) -> Iterator[None]:
    """Writes within delete their shuffle files when they end, not when the
    driver's memory is next collected: later steps do not add to that disk."""
    before = spark.conf.get(_DISCARD_SHUFFLES, None)
    spark.conf.set(_DISCARD_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.unset(_DISCARD_SHUFFLES) if before is None else spark.conf.set(_DISCARD_SHUFFLES, before)
