"""The tables of one source, written once and read back by every query."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shelfline.operators.dimensions import dim_customers, dim_products
from shelfline.operators.lookback import region_days
from shelfline.operators.silver import silver_sales
from shelfline.session import discard_at_exit, file_system, fresh_path, shuffles_discarded
from shelfline.sources.catalog import STORED_AS, clustered_by_date
from shelfline.sources.order_tables import OrderTables


class Layers:
    """Bronze DataFrames over `folder` and the silver tables built from them.

    A silver table is written to the shared folder when first asked for, and
    deleted when the application ends.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self.home = uuid.uuid4().hex
        self._written: dict[str, DataFrame] = {}
        self.bronze = OrderTables(spark, folder)

    def _stored(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        if name not in self._written:
            path = self.scratch(name)
            built = build()
            with shuffles_discarded(self.spark):
                built.write.option("compression", STORED_AS).parquet(path)
            self._written[name] = self.spark.read.parquet(path)
        return self._written[name]

    @property
    def fact(self) -> DataFrame:
        return self._stored("fact_sales", lambda: self._sales(clustered_by_date))

    @property
    def customers(self) -> DataFrame:
        return self._stored("dim_customers", lambda: dim_customers(self.bronze.customers(), self.fact))

    @property
    def products(self) -> DataFrame:
        return self._stored("dim_products", lambda: dim_products(self.bronze.products()))

    @property
    def warehouses(self) -> DataFrame:
        return self._stored("raw_warehouses", self.bronze.warehouses)

    @property
    def lines(self) -> DataFrame:
        return self._stored("raw_transactions", self.bronze.transactions)

    @property
    def region_days(self) -> DataFrame:
        return self._stored("region_days", lambda: region_days(self.fact, self.products))

    def scratch(self, label: str) -> str:
        """A folder in the shared one, deleted when the application ends."""
        path = fresh_path(self.spark, label)
        discard_at_exit(self.spark, path)
        return path

    def sales(self) -> DataFrame:
        """The silver transform itself, not yet written."""
        return self._sales(lambda typed: typed)

    def _sales(self, arranged: Callable[[DataFrame], DataFrame]) -> DataFrame:
        # Lines that are stored already are not joined again.
        lines = self._written["raw_transactions"] if "raw_transactions" in self._written else self.bronze.transactions()
        return silver_sales(lines, self.bronze.warehouses(), state_codes=self.bronze.state_codes(), arranged=arranged)


_OPEN: dict[tuple[str, str, str], Layers] = {}


def files_state(spark: SparkSession, folder: str) -> str:
    """Names, sizes and times of the files in `folder`, by whatever store."""
    place, files = file_system(spark, folder)
    found = files.listFiles(place, True)
    state = []
    while found.hasNext():
        file = found.next()
        state.append((file.getPath().toString(), file.getLen(), file.getModificationTime()))
    return repr(sorted(state))


def layers(spark: SparkSession, folder: str) -> Layers:
    """The layers of `folder`, built once per application and state of its files."""
    key = (spark.sparkContext.applicationId, folder, files_state(spark, folder))
    if key not in _OPEN:
        _OPEN[key] = Layers(spark, folder)
    return _OPEN[key]
