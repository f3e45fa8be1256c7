"""Column expressions on dates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month labels in calendar order.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


ISO_DATE = "yyyy-MM-dd"


def parsed_date(name: str, formats: Sequence[str] = (ISO_DATE,)) -> Column:
    """Text to DATE by the first format that fits the whole text, else NULL."""

    def read(form: str) -> Column:
        if form == ISO_DATE:
            return F.when(F.col(name).rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.col(name).try_cast("date"))
        return F.try_to_timestamp(F.col(name), F.lit(form)).cast("date")

    return F.coalesce(*map(read, formats))


def month_start(name: str) -> Column:
    return F.trunc(F.col(name), "month")


def month_index(name: str) -> Column:
    """Months since year 0, so that neighbouring months differ by one."""
    return F.year(name) * 12 + F.month(name)


def month_label(name: str) -> Column:
    return F.date_format(F.col(name), "MMM")


def quarter_number(date_name: str, compat: bool = False) -> Column:
    """Calendar quarter, or with `compat` the rounded form (month-1)/3 + 1,
    which puts the last month of a quarter into the next one."""
    if compat:
        return F.round((F.month(date_name) - 1) / 3 + 1, 0).cast("int")
    return F.quarter(date_name)
