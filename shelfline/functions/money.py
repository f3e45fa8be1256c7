"""Column expressions for exact money arithmetic."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType


def ratio(numerator: Column, denominator: Column) -> Column:
    """Double division that gives NULL for a zero denominator."""
    below = denominator.cast("double")
    return numerator.cast("double") / F.when(below != 0, below)


def percent(numerator: Column, denominator: Column, places: int = 2) -> Column:
    return F.round(ratio(numerator, denominator) * 100, places)


def growth_percent(current: Column, previous: Column) -> Column:
    return percent(current - previous, previous)


def exact_sum(name: str) -> Column:
    return F.sum(F.col(name))


def exact_avg(name: str, over: Callable[[Column], Column] = lambda column: column) -> Column:
    """Average as exact sum by count: the same in any row order.

    `over` puts both parts on one window.
    """
    return ratio(over(F.sum(name)), over(F.count(name)))


def mean_of_averages(name: str) -> Column:
    """Unweighted mean of a double column, summed in decimal."""
    return ratio(F.sum(F.col(name).cast(DecimalType(28, 10))), F.count(name))


def as_report(df: DataFrame) -> DataFrame:
    """Decimals to doubles, for the outermost projection only."""
    return df.select(
        *[
            F.col(field.name).cast("double").alias(field.name)
            if isinstance(field.dataType, DecimalType)
            else F.col(field.name)
            for field in df.schema.fields
        ]
    )
