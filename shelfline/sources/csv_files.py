"""CSV files under the staging format: optional double quotes, one header line,
NULL tokens, trimmed values, ragged rows allowed.

A row with too few fields has NULL in the rest and one with too many loses
them. Either way the line is kept as it stood, so that rows which lost or
lacked something can be counted and looked at (`ragged`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from shelfline.schemas import RAW_LINE, UNREADABLE, conform

# Fixed values of the staging format.
NULL_TOKENS = ("NULL", "null", "")
FORMAT = {
    "header": "true",
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": "true",
    "ignoreTrailingWhiteSpace": "true",
    "enforceSchema": "true",
    "mode": "PERMISSIVE",
}
LINEAGE = ("row_id", "_loaded_at", "_source_file")


def file_columns(schema: StructType) -> list[str]:
    """The columns a file carries; lineage columns are added at load."""
    return [name for name in schema.names if name not in LINEAGE]


def read_options(schema: StructType) -> tuple[StructType, dict[str, str]]:
    """All file columns as text: types are applied after NULL tokens are gone.
    Spark puts a line whose fields don't match the columns into the last one,
    which it can tell only if it reads them all."""
    names = [*file_columns(schema), RAW_LINE]
    return StructType([StructField(name, StringType()) for name in names]), {**FORMAT, "columnNameOfCorruptRecord": RAW_LINE, "columnPruning": "false"}


def with_source(rows: DataFrame) -> DataFrame:
    return rows.select("*", F.col("_metadata.file_path").alias("_source_file"))


def tidy(rows: DataFrame, schema: StructType) -> DataFrame:
    """NULL tokens to NULL, then `schema`'s types.

    An unreadable value is NULL and its column is named in `_unreadable`, so
    that nothing later takes it for an absent one.
    """

    def value(name: str) -> Column:
        text = F.trim(F.col(name))
        return F.when(~text.isin(*NULL_TOKENS), text).alias(name)

    names = file_columns(schema)
    kept = [name for name in rows.columns if name not in names]
    if RAW_LINE in kept:
        # Spark refuses to read the raw line alone, so it always names a column.
        never = F.when(F.length(F.col(names[0])) < 0, "")
        rows = rows.withColumn(RAW_LINE, F.coalesce(F.col(RAW_LINE), never))
    texts = rows.select(*[value(name) for name in names], *kept)
    lost = [
        F.when(F.col(field.name).isNotNull() & F.col(field.name).try_cast(field.dataType).isNull(), field.name)
        for field in schema.fields
        if field.name in names and not isinstance(field.dataType, StringType)
    ]
    named = texts.withColumn(UNREADABLE, F.array_compact(F.array(*lost)).cast("array<string>"))
    return conform(named, schema, (UNREADABLE, RAW_LINE))


def ragged(rows: DataFrame, schema: StructType) -> DataFrame:
    """The rows whose line did not have as many fields as `schema` has file
    columns, with `_fields`, how many it had. Commas inside quotes are text."""
    outside = r',(?=(?:[^"]*"[^"]*")*[^"]*$)'
    fields = (F.regexp_count(RAW_LINE, F.lit(outside)) + 1).alias("_fields")
    return rows.where(F.col(RAW_LINE).isNotNull()).select("*", fields, F.lit(len(file_columns(schema))).alias("_columns"))


def read_csv(spark: SparkSession, path: str | list[str], schema: StructType, **options: str) -> DataFrame:
    """Rows of the CSV files at `path` with load time and source file.

    A row break inside quotes needs `multiLine="true"`, which makes each file
    one task; leave it off for large files.
    """
    text, settings = read_options(schema)
    files = spark.read.schema(text).options(**{**settings, **options}).csv(path)
    return tidy(with_source(files), schema)
