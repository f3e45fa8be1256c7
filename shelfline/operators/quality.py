"""Data-quality rules as counts: (rule, table_name, failed_rows, total_rows, passed)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from shelfline.functions.dates import ISO_DATE, parsed_date
from shelfline.schemas import RAW_LINE, RAW_TRANSACTIONS, TEXT_LIMITS, UNREADABLE, required_columns

RuleSet = Mapping[str, Column]


def _result(rule: Column, table_name: str, failed: Column, total: Column) -> list[Column]:
    return [
        rule.alias("rule"),
        F.lit(table_name).alias("table_name"),
        failed.cast("long").alias("failed_rows"),
        total.cast("long").alias("total_rows"),
        (failed == 0).alias("passed"),
    ]


def row_rules(df: DataFrame, table_name: str, rules: RuleSet) -> DataFrame:
    """All rules of a table in one pass; a rule is the condition of a bad row."""
    bad = [F.count(F.when(condition, 1)).alias(f"_{n}") for n, condition in enumerate(rules.values())]
    counts = df.agg(F.count(F.lit(1)).alias("_rows"), *bad)
    pairs = F.array(
        *[F.struct(F.lit(rule).alias("rule"), F.col(f"_{n}").alias("bad")) for n, rule in enumerate(rules)]
    )
    return counts.select("_rows", F.explode(pairs).alias("_pair")).select(
        *_result(F.col("_pair.rule"), table_name, F.col("_pair.bad"), F.col("_rows"))
    )


def not_null_rules(schema: StructType) -> dict[str, Column]:
    return {f"not_null:{name}": F.col(name).isNull() for name in required_columns(schema)}


def length_rules(schema: StructType) -> dict[str, Column]:
    """Text longer than its column is declared to hold."""
    return {
        f"length:{field.name}": F.char_length(F.col(field.name)) > TEXT_LIMITS[field.name]
        for field in schema.fields
        if isinstance(field.dataType, StringType) and field.name in TEXT_LIMITS
    }


def fact_rules(schema: StructType) -> dict[str, Column]:
    """Required columns, text lengths, value ranges and date order of the fact."""
    return {
        **not_null_rules(schema),
        **length_rules(schema),
        "range:quantity": ~(F.col("quantity") > 0),
        "range:discount_pct": ~F.col("discount_pct").between(0, 1),
        "range:net_revenue": F.col("net_revenue").isNull()
        & F.col("quantity").isNotNull()
        & F.col("unit_price").isNotNull(),
        "range:discount_amount": F.col("discount_amount").isNull() & F.col("gross_revenue").isNotNull(),
        "order:ship_date": F.col("ship_date") < F.col("sale_date"),
    }


def date_text_rules(*names: str, date_formats: Sequence[str] = (ISO_DATE,)) -> dict[str, Column]:
    """Text that is present but reads as no date."""
    return {f"date:{name}": F.col(name).isNotNull() & parsed_date(name, date_formats).isNull() for name in names}


def unreadable_rules(schema: StructType) -> dict[str, Column]:
    """Values that were present in the source and read as nothing, per column."""
    return {
        f"unreadable:{field.name}": F.array_contains(UNREADABLE, field.name)
        for field in schema.fields
        if not isinstance(field.dataType, StringType) and not field.name.startswith("_") and field.name != "row_id"
    }


def unique_rule(df: DataFrame, table_name: str, keys: Sequence[str]) -> DataFrame:
    """Rows whose key occurs more than once."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    repeated = F.coalesce(F.sum(F.when(F.col("_rows") > 1, F.col("_rows"))), F.lit(0))
    total = F.coalesce(F.sum("_rows"), F.lit(0))
    return per_key.agg(repeated.alias("_bad"), total.alias("_all")).select(
        *_result(F.lit("unique:" + ",".join(keys)), table_name, F.col("_bad"), F.col("_all"))
    )


def orphan_rule(df: DataFrame, table_name: str, key: str, parent: DataFrame, parent_name: str) -> DataFrame:
    """Rows whose key is set but missing in `parent`.

    Rows are counted per key first, so a hot key reaches the join as one row.
    """
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    known = parent.select(F.col(key).alias("_known")).where(F.col("_known").isNotNull()).distinct()
    matched = per_key.join(known, F.col(key) == F.col("_known"), "left")
    orphan = F.col(key).isNotNull() & F.col("_known").isNull()
    return matched.agg(
        F.coalesce(F.sum(F.when(orphan, F.col("_rows"))), F.lit(0)).alias("_bad"),
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("_all"),
    ).select(*_result(F.lit(f"orphan:{parent_name}"), table_name, F.col("_bad"), F.col("_all")))


def reconcile_rule(bronze: DataFrame, kept: DataFrame, quarantined: DataFrame, table_name: str) -> DataFrame:
    """Every bronze row is either kept or quarantined."""

    def counted(df: DataFrame, missing: int, total: int) -> DataFrame:
        rows = df.agg(F.count(F.lit(1)).alias("_rows"))
        return rows.select((F.col("_rows") * missing).alias("_missing"), (F.col("_rows") * total).alias("_total"))

    counts = report(counted(bronze, 1, 1), counted(kept, -1, 0), counted(quarantined, -1, 0))
    return counts.agg(F.abs(F.sum("_missing")).alias("_missing"), F.sum("_total").alias("_total")).select(
        *_result(F.lit("reconcile:bronze"), table_name, F.col("_missing"), F.col("_total"))
    )


def report(*results: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, results)


@dataclass(frozen=True)
class Checks:
    """What a table is checked for: conditions of a bad row, keys that must not
    repeat, and columns whose value must stand in a table of that key."""

    table: str
    frame: DataFrame
    rules: RuleSet = field(default_factory=dict)
    unique: Sequence[Sequence[str]] = ()
    refers: Mapping[str, str] = field(default_factory=dict)


# Rules whose outcomes one number holds, a bit each.
MASK_RULES = 60
Space = tuple[str | int, ...]


def _entry(space: int, key: str = "CAST(NULL AS STRING)", mask: str = "0L", refers: bool = False) -> str:
    return f"named_struct('space', {space}, 'key', {key}, 'mask', {mask}, 'refers', {str(refers).lower()})"


def _key(*names: str) -> Column:
    """The key as one text, its parts with their lengths; NULL only for one
    column that is NULL."""
    texts = [F.col(name).cast("string") for name in names]
    if len(texts) == 1:
        return texts[0]
    return F.concat(*(F.coalesce(F.concat(F.char_length(text).cast("string"), F.lit(":"), text), F.lit("-")) for text in texts))


def _masks(rules: int) -> list[str]:
    """Bits of the rules a row breaks, in numbers of `MASK_RULES` each; one
    number even without rules."""
    masks = []
    for first in range(0, max(rules, 1), MASK_RULES):
        bits = [f"IF(_bad_{n}, {1 << n - first}L, 0L)" for n in range(first, min(first + MASK_RULES, rules))]
        masks.append(" | ".join(["0L", *bits]))
    return masks


def one_pass(tables: Sequence[Checks], balance: tuple[str, str, str] | None = None) -> DataFrame:
    """All checks of all tables: each table is read once, and one grouping by
    (what is counted, key) serves every key, from either side.

    A row becomes one entry per key and one for the rules it breaks, as bits;
    equal entries are summed before the shuffle, so only keys that differ
    travel. The grouping tells repeated keys and keys without a parent, with no
    join. `balance` names tables of which the first must hold as many rows as
    the other two.
    """
    numbers: dict[Space, int] = {}

    def numbered(*space: str | int) -> int:
        return numbers.setdefault(space, len(numbers))

    entries = []
    for table in tables:
        bad = [rule.alias(f"_bad_{n}") for n, rule in enumerate(table.rules.values())]
        keys = [_key(*names).alias(f"_unique_{n}") for n, names in enumerate(table.unique)]
        parents = [_key(name).alias(f"_refers_{n}") for n, name in enumerate(table.refers)]
        made = [_entry(numbered("rules", table.table, n), mask=mask) for n, mask in enumerate(_masks(len(bad)))]
        made += [_entry(numbered("key", table.table, *names), f"_unique_{n}") for n, names in enumerate(table.unique)]
        made += [_entry(numbered("key", parent, name), f"_refers_{n}", refers=True) for n, (name, parent) in enumerate(table.refers.items())]
        entries.append(table.frame.select(*bad, *keys, *parents).selectExpr(f"inline(array({', '.join(made)}))"))
    per_key = reduce(DataFrame.union, entries).groupBy("space", "key", "mask").agg(
        F.expr("count_if(NOT refers) AS _own"), F.expr("count_if(refers) AS _referring")
    )
    bits = max(min(len(table.rules), MASK_RULES) for table in tables)
    per_space = per_key.groupBy("space").agg(
        F.expr("sum(_own) AS rows"),
        F.expr("sum(IF(_own > 1, _own, 0L)) AS repeated"),
        F.expr("sum(_referring) AS referring"),
        F.expr("sum(IF(key IS NOT NULL AND _own = 0, _referring, 0L)) AS orphans"),
        *(F.expr(f"sum(IF(mask & {1 << n}L != 0L, _own, 0L)) AS broken_{n}") for n in range(bits)),
    )
    return _reported(per_space, tables, numbers, balance)


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _reported(per_space: DataFrame, tables: Sequence[Checks], numbers: Mapping[Space, int], balance) -> DataFrame:
    """The few counts side by side in one row, and a row per rule out of it."""
    taken: dict[str, str] = {}

    def count(measure: str, *space: str | int) -> str:
        name = f"{measure}_of_{numbers[space]}"
        taken[name] = f"coalesce(sum(IF(space = {numbers[space]}, {measure}, 0L)), 0L) AS {name}"
        return name

    results = []
    for table in tables:
        name, total = table.table, count("rows", "rules", table.table, 0)
        for n, rule in enumerate(table.rules):
            results.append((rule, name, count(f"broken_{n % MASK_RULES}", "rules", name, n // MASK_RULES), total))
        for keys in table.unique:
            results.append(("unique:" + ",".join(keys), name, count("repeated", "key", name, *keys), total))
        for key, parent in table.refers.items():
            results.append((f"orphan:{parent}", name, count("orphans", "key", parent, key), count("referring", "key", parent, key)))
    if balance is not None:
        all_rows, kept, rejected = (count("rows", "rules", name, 0) for name in balance)
        results.append(("reconcile:bronze", balance[1], f"abs({all_rows} - {kept} - {rejected})", all_rows))
    listed = ", ".join(
        f"named_struct('rule', {_text(rule)}, 'table_name', {_text(table)}, 'failed_rows', {bad}, 'total_rows', {total})"
        for rule, table, bad, total in results
    )
    counts = per_space.agg(*(F.expr(text) for text in taken.values())).selectExpr(f"inline(array({listed}))")
    return counts.withColumn("passed", F.col("failed_rows") == 0)


def sales_quality(
    bronze: DataFrame,
    fact: DataFrame,
    quarantined: DataFrame,
    dimensions: Mapping[str, tuple[DataFrame, StructType | None, str]],
    fact_schema: StructType,
    date_formats: Sequence[str] = (ISO_DATE,),
    others: Sequence[Checks] = (),
) -> DataFrame:
    """The whole report, in one pass over each table. `dimensions` maps a table
    name to the frame, its schema if it has required columns, and its key."""
    lost = unreadable_rules(RAW_TRANSACTIONS) if UNREADABLE in bronze.columns else {}
    if RAW_LINE in bronze.columns:
        lost["ragged:line"] = F.col(RAW_LINE).isNotNull()
    dates = date_text_rules("order_date", "ship_date", date_formats=date_formats)
    refers = {key: name for name, (_, _, key) in dimensions.items()}
    tables = [
        Checks("raw_transactions", bronze, {**dates, **lost}, [["row_id"]]),
        Checks("fact_sales", fact, fact_rules(fact_schema), [["sale_id"]], refers),
        Checks("quarantined_sales", quarantined),
        *(
            Checks(name, frame, {} if schema is None else not_null_rules(schema), [[key]])
            for name, (frame, schema, key) in dimensions.items()
        ),
        *others,
    ]
    return one_pass(tables, ("raw_transactions", "fact_sales", "quarantined_sales"))
