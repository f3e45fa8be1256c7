"""Ranks, tiles and rolling frames over groups of any size, in one lazy plan.

A window function puts each of its groups into one task. Here rows are first
counted per bin of their sort value; a running sum over the bins, which are few
whatever the rows, says how many rows stand before each bin, and a window only
has to order the rows of one bin. Nothing runs while a plan is built, and a
view follows its table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

# Bins per factor e of a value, and rows of one value that are put in order at
# a time.
BINS_PER_E = 4096
TIE_ROWS = 1000


def order_bin(value: str) -> Column:
    """A number that never falls where the numeric `value` rises: its sign and
    logarithm, in steps of 1 / BINS_PER_E. A function of the row alone."""
    number = F.col(value).cast("double")
    size = (F.floor(F.log(F.abs(number)) * BINS_PER_E) + F.lit(1 << 24)).cast("long")
    return F.when(number == 0, F.lit(0)).when(number > 0, size).otherwise(-size)


def _before(keys: Sequence[str], *order: Column) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def matched(left: DataFrame, right: DataFrame, names: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL equals NULL; `right` brings its other columns."""
    renamed = right.withColumnsRenamed({name: f"_r_{name}" for name in names})
    condition = F.lit(True)
    for name in names:
        condition = condition & left[name].eqNullSafe(renamed[f"_r_{name}"])
    return left.join(renamed, condition, how).drop(*(f"_r_{name}" for name in names))


def _sorted(value: str, descending: bool) -> Column:
    return F.col(value).desc_nulls_last() if descending else F.col(value).asc_nulls_last()


def value_levels(df: DataFrame, keys: Sequence[str], value: str, descending: bool, *more: Column) -> DataFrame:
    """keys, value, `_ahead` (rows with a value before this one within the
    key) and `_total` (rows of the key), one row per distinct value, which may
    have more aggregates."""
    keys = list(keys)
    levels = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_level_rows"), *more).withColumn("_bin", order_bin(value))
    kept = [name for name in levels.columns if name not in (*keys, value, "_level_rows", "_bin")]
    bins = levels.groupBy(*keys, "_bin").agg(F.sum("_level_rows").alias("_bin_rows"))
    bins = bins.withColumn("_bins_ahead", F.coalesce(F.sum("_bin_rows").over(_before(keys, _sorted("_bin", descending))), F.lit(0)))
    bins = bins.withColumn("_total", F.sum("_bin_rows").over(Window.partitionBy(*keys))).drop("_bin_rows")
    inside = F.coalesce(F.sum("_level_rows").over(_before([*keys, "_bin"], _sorted(value, descending))), F.lit(0))
    placed = matched(levels.withColumn("_inside", inside), bins, [*keys, "_bin"])
    return placed.select(*keys, value, (F.col("_inside") + F.col("_bins_ahead")).alias("_ahead"), "_total", *kept)


def with_rank(
    df: DataFrame, keys: Sequence[str], value: str, name: str, descending: bool = True, once: bool = False
) -> DataFrame:
    """RANK of a numeric `value` within `keys`, equal values sharing a rank,
    NULLs last. A value that many rows share is one row until the last join.

    `once` is for sums over many lines: the levels then ask for all columns of
    `df`, as the rows do, so that both read one exchange and the lines are read
    and moved once.
    """
    # A threshold of no values drops no row.
    levels = value_levels(df.dropna(thresh=0) if once else df, keys, value, descending)
    ranked = levels.select(*keys, value, (F.col("_ahead") + 1).cast("long").alias(name))
    return matched(df, ranked, [*keys, value]).select(*df.columns, name)


def _order_text(df: DataFrame, tie: str) -> Column:
    """Text that sorts as the column does, NULLs last; never empty."""
    kind = dict(df.dtypes)[tie]
    if kind in ("tinyint", "smallint", "int", "bigint"):
        number = F.col(tie).cast("long").bitwiseXOR(F.lit(-(1 << 63)).cast("long"))
        text = F.lpad(F.hex(number), 16, "0")
    elif kind in ("string", "date") or kind.startswith("timestamp"):
        text = F.col(tie).cast("string")
    else:
        raise ValueError(f"ties cannot be broken by {tie}, a column of {kind}")
    return F.coalesce(F.concat(F.lit("0"), text), F.lit("1"))


def _tie_bin() -> Column:
    """The characters of `_t` behind what all ties of the value share, the more
    the more rows the value has: a bin of ids that count up holds about
    `TIE_ROWS` of them, however many there are and however they begin."""
    shared = F.expr("aggregate(sequence(1, least(length(_low), length(_high))), 0, (n, i) -> IF(n = i - 1 AND substring(_low, i, 1) = substring(_high, i, 1), i, n))")
    digits = F.greatest(F.lit(0), F.ceil(F.log10(F.col("_rows") / TIE_ROWS))).cast("int") + 1
    return F.when(F.col("_rows") <= TIE_ROWS, "").otherwise(F.substring(F.col("_t"), shared + 1, digits))


def tie_bins(keys: DataFrame, levels: DataFrame) -> DataFrame:
    """_v, _bin, `_bin_rows` and `_bins_ahead`, for the ties of every value."""
    keyed = matched(keys, levels, ["_v"]).withColumn("_bin", _tie_bin())
    bins = keyed.groupBy("_v", "_bin").agg(F.count(F.lit(1)).alias("_bin_rows"))
    return bins.withColumn("_bins_ahead", F.coalesce(F.sum("_bin_rows").over(_before(["_v"], F.col("_bin").asc())), F.lit(0)))


def tie_levels(keys: DataFrame, descending: bool = True) -> DataFrame:
    """`value_levels` of `_v` with the rows and the least and greatest tie of
    each value."""
    ends = (F.count(F.lit(1)).alias("_rows"), F.min("_t").alias("_low"), F.max("_t").alias("_high"))
    return value_levels(keys, [], "_v", descending, *ends)


def with_tiles(
    df: DataFrame, tiles: int, value: str, tie: str, name: str, descending: bool = True, narrow: DataFrame | None = None
) -> DataFrame:
    """NTILE over all rows by `value`, NULLs last, equal values by `tie`
    ascending; earlier tiles take the rest. A (value, tie) that repeats gives as
    many rows; their order among equals is free.

    Counts say how many rows stand before a value and before a bin of its ties;
    the rows meet these counts and are numbered once, within their bin. The
    counts need `value` and `tie` only; `narrow` may give these two of the same
    rows where they are cheaper to come by.
    """
    source = df if narrow is None else narrow
    keys = source.select(F.col(value).alias("_v"), _order_text(source, tie).alias("_t"))
    levels = tie_levels(keys, descending)
    bins = tie_bins(keys, levels).drop("_bin_rows")
    rows = df.withColumns({"_v": F.col(value), "_t": _order_text(df, tie)})
    rows = matched(matched(rows, levels, ["_v"]).withColumn("_bin", _tie_bin()), bins, ["_v", "_bin"])
    inside = Window.partitionBy("_v", "_bin").orderBy("_t")
    placed = (
        rows.withColumn("_place", F.col("_ahead") + F.col("_bins_ahead") + F.row_number().over(inside) - 1)
        .withColumns({"_size": F.expr(f"_total div {tiles}"), "_rest": F.expr(f"_total % {tiles}")})
        .withColumn("_in_large", F.expr("_rest * (_size + 1)"))  # rows in tiles of one more
    )
    tile = F.expr(
        "CASE WHEN _place < _in_large THEN _place div (_size + 1) + 1 "
        "ELSE _rest + (_place - _in_large) div greatest(_size, 1) + 1 END"
    )
    return placed.select(*df.columns, tile.cast("int").alias(name))


def over_last_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    reach: int,
    columns: Callable[[WindowSpec], dict[str, Column]],
    chunk_rows: int = 500_000,
    days: DataFrame | None = None,
) -> DataFrame:
    """Add window columns whose frames look back at most `reach` rows.

    `columns` gets the ordered window and returns the columns to add. The first
    column of `order` has few values (days); rows are counted per key and day,
    numbered within the day, and cut into chunks, and each chunk also gets the
    last `reach` rows before it, so every frame is whole. `days` gives the rows
    per key and day with their running sum (`_rows`, `_days_ahead`) if they are
    known; the sum may begin anywhere.
    """
    if chunk_rows < reach:
        raise ValueError("a chunk must hold the rows a frame reaches back")
    keys, (day, *rest) = list(keys), order
    if days is None:
        per_day = df.groupBy(*keys, day).agg(F.count(F.lit(1)).alias("_rows"))
        days = per_day.withColumn("_days_ahead", F.coalesce(F.sum("_rows").over(_before(keys, F.col(day).asc_nulls_last())), F.lit(0)))
    within = Window.partitionBy(*keys, day).orderBy(*(F.col(name).asc_nulls_last() for name in rest or [day]))
    numbered = matched(df.withColumn("_number", F.row_number().over(within) - 1), days.drop("_rows"), [*keys, day])
    numbered = numbered.withColumn("_place", F.col("_number") + F.col("_days_ahead"))
    own = F.floor(F.col("_place") / chunk_rows)
    lent = F.col("_place") % chunk_rows >= chunk_rows - reach
    chunked = numbered.withColumn("_own", own).withColumn(
        "_chunk", F.explode(F.when(lent, F.array("_own", F.col("_own") + 1)).otherwise(F.array("_own")))
    )
    window = Window.partitionBy(*keys, "_chunk").orderBy("_place")
    added = chunked.withColumns(columns(window)).where(F.col("_own") == F.col("_chunk"))
    return added.drop("_number", "_days_ahead", "_place", "_own", "_chunk")
