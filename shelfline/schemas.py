"""Declared schemas of the bronze and silver tables, and `conform` to meet them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    DataType,
    DateType,
    DecimalType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)

# Money is exact: sums of decimals do not depend on the order rows arrive in,
# so a retried or re-partitioned task gives the same total.
MONEY = DecimalType(18, 4)
PRICE = DecimalType(18, 8)
RATE = DecimalType(9, 6)

_TEXT, _LONG, _INT, _DOUBLE = StringType(), LongType(), IntegerType(), DoubleType()
_DATE, _STAMP = DateType(), TimestampNTZType()


def _schema(*columns: tuple[str, DataType], required: tuple[str, ...] = ()) -> StructType:
    return StructType([StructField(name, kind, name not in required) for name, kind in columns])


def _texts(*names: str) -> list[tuple[str, DataType]]:
    return [(name, _TEXT) for name in names]


RAW_TRANSACTIONS = _schema(
    ("row_id", _LONG),
    *_texts("order_id", "order_date", "customer_id", "customer_name", "segment", "region", "state", "city"),
    *_texts("product_id", "product_name", "category", "sub_category"),
    ("quantity", _LONG),
    ("unit_price", _DOUBLE),
    ("discount_pct", _DOUBLE),
    ("sales_amount", _DOUBLE),
    ("profit", _DOUBLE),
    *_texts("ship_mode", "ship_date"),
    ("_loaded_at", _STAMP),
    ("_source_file", _TEXT),
)

RAW_PRODUCTS = _schema(
    *_texts("product_id", "product_name", "category", "sub_category", "brand", "supplier"),
    ("unit_cost", _DOUBLE),
    ("list_price", _DOUBLE),
    ("weight_kg", _DOUBLE),
    ("_loaded_at", _STAMP),
)

RAW_WAREHOUSES = _schema(
    *_texts("warehouse_id", "warehouse_name", "region", "state", "city"),
    ("capacity_units", _LONG),
    ("manager_name", _TEXT),
    ("_loaded_at", _STAMP),
)

RAW_CUSTOMERS = _schema(
    *_texts("customer_id", "customer_name", "segment", "region", "state", "city", "signup_date", "loyalty_tier"),
    ("_loaded_at", _STAMP),
)

FACT_SALES = _schema(
    ("sale_id", _LONG),
    ("order_id", _TEXT),
    ("sale_date", _DATE),
    ("ship_date", _DATE),
    *_texts("customer_id", "product_id", "warehouse_id", "region", "state_code", "state_name"),
    ("quantity", _LONG),
    ("unit_price", PRICE),
    ("discount_pct", RATE),
    ("gross_revenue", MONEY),
    ("discount_amount", MONEY),
    ("net_revenue", MONEY),
    ("profit", MONEY),
    ("ship_mode", _TEXT),
    ("days_to_ship", _INT),
    ("sale_year", _INT),
    ("sale_month", _INT),
    ("sale_quarter", _INT),
    ("_processed_at", _STAMP),
    required=("order_id", "sale_date", "customer_id", "product_id", "quantity", "unit_price"),
)

DIM_CUSTOMERS = _schema(
    *_texts("customer_id", "customer_name", "segment", "region", "state", "city"),
    ("signup_date", _DATE),
    *_texts("loyalty_tier", "customer_segment"),
    ("_processed_at", _STAMP),
    required=("customer_id",),
)

DIM_PRODUCTS = _schema(
    *_texts("product_id", "product_name", "product_category", "product_subcategory", "brand", "supplier"),
    ("unit_cost", MONEY),
    ("list_price", MONEY),
    ("margin_pct", _DOUBLE),
    ("_processed_at", _STAMP),
    required=("product_id",),
)

BRONZE = {
    "raw_transactions": RAW_TRANSACTIONS,
    "raw_products": RAW_PRODUCTS,
    "raw_warehouses": RAW_WAREHOUSES,
    "raw_customers": RAW_CUSTOMERS,
}
SILVER = {
    "fact_sales": FACT_SALES,
    "dim_customers": DIM_CUSTOMERS,
    "dim_products": DIM_PRODUCTS,
}

# The longest text a column is declared to hold, in any table.
TEXT_LIMITS = {
    "order_id": 50,
    "order_date": 50,
    "ship_date": 50,
    "ship_mode": 50,
    "customer_id": 50,
    "customer_name": 200,
    "customer_segment": 50,
    "segment": 50,
    "signup_date": 50,
    "loyalty_tier": 50,
    "product_id": 50,
    "product_name": 300,
    "product_category": 100,
    "product_subcategory": 100,
    "category": 100,
    "sub_category": 100,
    "brand": 100,
    "supplier": 200,
    "warehouse_id": 20,
    "warehouse_name": 100,
    "manager_name": 200,
    "region": 50,
    "state": 100,
    "state_code": 10,
    "state_name": 100,
    "city": 100,
    "_source_file": 500,
}

# Names of the columns whose text could not be read as the declared type.
UNREADABLE = "_unreadable"
# A line that had more or fewer fields than its file has columns, as it stood.
RAW_LINE = "_raw_line"

_FILLED_WHEN_ABSENT = {
    "_loaded_at": lambda: F.current_timestamp(),
    "_processed_at": lambda: F.current_timestamp(),
    "discount_pct": lambda: F.lit(0),
}


def required_columns(schema: StructType) -> list[str]:
    return [field.name for field in schema.fields if not field.nullable]


def conform(df: DataFrame, schema: StructType, extra: tuple[str, ...] = ()) -> DataFrame:
    """Project `df` onto `schema`: order, cast, and fill columns it does not carry.

    Text that does not parse as the declared type becomes NULL. A `row_id` that
    is not there is NULL, too: ids are given when rows are loaded. Columns named
    in `extra` are kept behind the declared ones when `df` has them.
    """
    present = set(df.columns)

    def value(field: StructField) -> Column:
        if field.name in present:
            return F.col(field.name)
        return _FILLED_WHEN_ABSENT.get(field.name, lambda: F.lit(None))()

    declared = [value(field).try_cast(field.dataType).alias(field.name) for field in schema.fields]
    return df.select(*declared, *[name for name in extra if name in present])
