"""Layer databases, typed tables, overwrite sinks and the table inventory."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Mapping
from functools import reduce

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shelfline.schemas import BRONZE, SILVER
from shelfline.session import file_system

LAYERS = ("bronze", "silver", "gold", "staging")
# Codec of the tables written here.
STORED_AS = "zstd"


def create_layers(spark: SparkSession, names: Iterable[str] = LAYERS, location: str | None = None) -> None:
    for name in names:
        place = f" LOCATION '{location}/{name}'" if location else ""
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {name}{place}")


def create_tables(
    spark: SparkSession, bronze: str = "bronze", silver: str = "silver", replace: bool = False
) -> list[str]:
    """Empty bronze and silver tables with their declared types.

    An existing table is kept, with its rows, unless `replace` is set.
    """
    created = []
    for database, tables in ((bronze, BRONZE), (silver, SILVER)):
        for table, schema in tables.items():
            name = f"{database}.{table}"
            if spark.catalog.tableExists(name):
                if not replace:
                    continue
                spark.sql(f"DROP TABLE {name}")
            place = _fresh_version(spark, name)
            _create(spark, name, place, schema)
            _sweep(spark, name, place)
            created.append(name)
    return created


def _as_stored(schema: StructType) -> StructType:
    # Parquet tables read back as nullable; quality rules check what is required.
    stored = StructType()
    for field in schema.fields:
        stored.add(field.name, field.dataType, True)
    return stored


def clustered_by_date(fact: DataFrame) -> DataFrame:
    """Rows by ranges of date, then order: files hold disjoint stretches, so a
    date filter opens few of them, and a hot day is cut between orders."""
    return fact.repartitionByRange("sale_date", "order_id").sortWithinPartitions("sale_date", "order_id")


def database_folder(spark: SparkSession, database: str) -> str:
    return spark.catalog.getDatabase(database).locationUri.rstrip("/")


def _split(spark: SparkSession, name: str) -> tuple[str, str]:
    database, _, table = name.rpartition(".")
    return database or spark.catalog.currentDatabase(), table


def _versions(spark: SparkSession, name: str) -> str:
    database, table = _split(spark, name)
    return f"{database_folder(spark, database)}/{table}__versions"


def _fresh_version(spark: SparkSession, name: str) -> str:
    return f"{_versions(spark, name)}/{uuid.uuid4().hex}"


def _create(spark: SparkSession, name: str, place: str, schema: StructType) -> None:
    _, files = file_system(spark, place)
    files.mkdirs(spark._jvm.org.apache.hadoop.fs.Path(place))
    spark.catalog.createTable(name, path=place, source="parquet", schema=_as_stored(schema))


def location(spark: SparkSession, name: str) -> str:
    """The folder that table `name` reads now."""
    described = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").where("col_name = 'Location'")
    return described.first().data_type


def _point(spark: SparkSession, name: str, place: str, schema: StructType) -> None:
    """Let table `name` read the files at `place`, in one step of the catalog.

    New columns are declared first, which earlier files answer with NULL. Only
    a table that lost a column or changed a type is declared anew.
    """
    if not spark.catalog.tableExists(name):
        _create(spark, name, place, schema)
        return
    declared = {field.name: field.dataType for field in spark.table(name).schema}
    arriving = {field.name: field.dataType for field in schema}
    if any(arriving.get(column) != kind for column, kind in declared.items()):
        spark.sql(f"DROP TABLE {name}")
        _create(spark, name, place, schema)
        return
    added = [f"`{column}` {kind.simpleString()}" for column, kind in arriving.items() if column not in declared]
    if added:
        spark.sql(f"ALTER TABLE {name} ADD COLUMNS ({', '.join(added)})")
    _set_location(spark, name, place)


def _set_location(spark: SparkSession, name: str, place: str) -> None:
    quoted = place.replace("'", "\\'")
    spark.sql(f"ALTER TABLE {name} SET LOCATION '{quoted}'")
    spark.catalog.refreshTable(name)


def _sweep(spark: SparkSession, name: str, *keep: str) -> None:
    """Delete versions of a table that are not in `keep`: what earlier runs
    replaced, or left behind when they were ended."""
    place, files = file_system(spark, _versions(spark, name))
    kept = {version.rsplit("/", 1)[1] for version in keep}
    for entry in files.listStatus(place):
        if entry.getPath().getName() not in kept:
            files.delete(entry.getPath(), True)


def _written(df: DataFrame, name: str) -> tuple[str, DataFrame]:
    place = _fresh_version(df.sparkSession, name)
    df.write.option("compression", STORED_AS).parquet(place)
    return place, df.sparkSession.read.parquet(place)


def overwrite_table(df: DataFrame, name: str, completed: Callable[[DataFrame], DataFrame | None] = lambda rows: None) -> int:
    """Replace table `name` with `df` and count what was written.

    Every write goes to a folder of its own, and the table is turned to it when
    it is complete: until then, and if the run is ended at any point, the table
    keeps its rows. The version before stays until the next write, so readers
    that began on it end on it. One writer at a time. `completed` is shown the
    rows as written and may give others to be written in their stead.
    """
    spark = df.sparkSession
    place, written = _written(df, name)
    instead = completed(written)
    if instead is not None:
        place, written = _written(instead, name)
    count = written.count()
    before = [location(spark, name)] if spark.catalog.tableExists(name) else []
    _point(spark, name, place, written.schema)
    _sweep(spark, name, place, *before)
    return count


def append_table(df: DataFrame, name: str) -> None:
    df.write.mode("append").format("parquet").option("compression", STORED_AS).saveAsTable(name)


def _bucketed(df: DataFrame, key: str, buckets: int) -> DataFrameWriter:
    # Dealt as the buckets are, so that a write makes one file per bucket.
    return df.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key).sortBy(key)


def append_bucketed(df: DataFrame, name: str, key: str, buckets: int) -> None:
    """Add `df` to a table whose rows lie in `buckets` by the hash of `key`."""
    _bucketed(df, key, buckets).mode("append").saveAsTable(name)


def overwrite_bucketed(df: DataFrame, name: str, key: str, buckets: int) -> None:
    """Replace a bucketed table; not for tables that are read meanwhile."""
    _bucketed(df, key, buckets).mode("overwrite").saveAsTable(name)


def inventory(tables: Mapping[tuple[str, str], DataFrame]) -> DataFrame:
    """Row count per (schema, table); parquet answers from its footers."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(schema).alias("table_schema"), F.lit(table).alias("table_name"), "row_count"
        )
        for (schema, table), df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts).orderBy("table_schema", "table_name")


def table_inventory(spark: SparkSession, databases: Iterable[str] = LAYERS) -> DataFrame:
    """`inventory` of every table in the layer databases."""
    found = {
        (database, table.name): spark.table(f"{database}.{table.name}")
        for database in databases
        if spark.catalog.databaseExists(database)
        for table in spark.catalog.listTables(database)
        if not table.isTemporary
    }
    if not found:
        return spark.createDataFrame([], "table_schema string, table_name string, row_count long")
    return inventory(found)
