"""Personal data in texts, with DataFrame functions only.

Regular expressions propose spans of each kind, leftmost and without overlap;
validators confirm them (Luhn for cards, mod-97 for IBANs, number ranges);
words near a span raise its score. Kinds of the base set stand whenever they
are valid. The further kinds (`EXTRA`) stand when their score reaches
`LEAST_SCORE`. Positions count code points; the end is exclusive.

Patterns are possessive and begin only where a run of their characters does,
so a very long run costs one look, not one per character, and no group can
exhaust the stack; what they match is what the plain pattern matches.

A null text counts as empty and has no spans. Null or repeated doc_ids and
other columns don't matter: every row is judged alone.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NEAR = 40
BLOCK = 256
LEAST_SCORE = 0.7
CONTEXT = 0.3


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is worked out once, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _ip_parts(value: Column) -> Column:
    def fits(part: Column) -> Column:
        short = F.regexp_replace(part, "^0+(?=[0-9])", "")
        return F.when(F.length(short) > 3, False).otherwise(short.cast("int") <= 255)

    return F.forall(F.split(value, r"\."), fits)


def _card(value: Column) -> Column:
    return _let(_digits(value), lambda d: F.length(d).between(16, 19) & F.call_function("luhn_check", d))


def _phone(value: Column) -> Column:
    return F.length(_digits(value)).between(8, 15)


def mod_97(value: Column) -> Column:
    """ISO 7064 check of an IBAN written with or without spaces."""

    def step(rest: Column, char: Column) -> Column:
        number = F.when(char.between("0", "9"), rest * 10 + char.cast("int")).otherwise(rest * 100 + F.ascii(char) - 55)
        return (number % 97).cast("int")

    plain = F.regexp_replace(value, " ", "")
    turned = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))
    chars = F.filter(F.split(turned, ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(0), step) == 1


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    likely: str  # a cheap test that every text with a match passes
    valid: Callable[[Column], Column]
    score: float
    near: str


LOCAL = "[A-Za-z0-9._%+-]"

BASE = (
    Kind(
        "email",
        rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        "@",
        lambda v: F.lit(True),
        0.9,
        "mail|contact|write|address",
    ),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", _ip_parts, 0.6, "ip|host|server|address|from"),
    Kind("card", r"[0-9](?:[ -]?[0-9])++", r"[0-9][ -]?[0-9]", _card, 0.9, "card|visa|credit|payment"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9]", _phone, 0.6, "phone|call|tel|mobile|fax"),
)

EXTRA = (
    Kind(
        "iban",
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}+(?![A-Za-z0-9])",
        r"[A-Z]{2}[0-9]{2}",
        mod_97,
        0.9,
        "iban|bank|account|konto|compte",
    ),
    Kind(
        "secret",
        r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z0-9_+/=-]*[0-9])[A-Za-z0-9_+/=-]{24,}+",
        r"[A-Za-z0-9_+/=-]{24}",
        lambda v: F.lit(True),
        0.4,
        "token|secret|password|passwd|api.?key|access.?key",
    ),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"[0-9]-[0-9]", lambda v: ~v.rlike("^(000|666|9)|-00-|-0000$"), 0.5, "ssn|social security"),
)


def _sums_before(lengths: Column) -> Column:
    """Sum of the elements before each element, block by block, so that the
    work stays near linear."""

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0), lambda a, x: a + x)

    def within(values: Column, starts: Column) -> Column:
        def at(_: Column, i: Column) -> Column:
            block = F.floor(i / BLOCK).cast("int")
            return F.get(starts, block) + total(F.slice(values, block * BLOCK + 1, i - block * BLOCK))

        return F.transform(values, at)

    def blocks(values: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor(F.size(values) / BLOCK).cast("int"))
        return F.transform(numbers, lambda b: total(F.slice(values, b * BLOCK + 1, F.lit(BLOCK))))

    def started(sums: Column) -> Column:
        return F.transform(sums, lambda _, b: total(F.slice(sums, F.lit(1), b)))

    return _let(lengths, lambda v: _let(blocks(v), lambda s: _let(started(s), lambda p: within(v, p))))


def _spans(text: Column, kind: Kind) -> Column:
    """array<struct<start, end, score>> of the valid spans of a kind."""

    def placed(parts: Column) -> Column:
        gaps, found = parts["gaps"], parts["found"]
        lengths = F.transform(found, lambda m, i: F.length(F.get(gaps, i)) + F.length(m))

        def span(before: Column, i: Column) -> Column:
            start = before + F.length(F.get(gaps, i))
            return F.struct(F.get(found, i).alias("value"), start.cast("int").alias("start"), (start + F.length(F.get(found, i))).cast("int").alias("end"))

        return F.transform(_sums_before(lengths), span)

    def scored(span: Column) -> Column:
        first = F.greatest(span["start"] - NEAR, F.lit(0))
        around = F.lower(F.substring(text, first + 1, span["end"] + NEAR - first))
        score = F.lit(kind.score) + F.when(around.rlike(kind.near), CONTEXT).otherwise(0.0)
        return F.struct(span["start"].alias("start"), span["end"].alias("end"), F.least(score, F.lit(1.0)).alias("score"))

    parts = F.struct(F.split(text, kind.pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)).alias("found"))
    valid = F.filter(_let(parts, placed), lambda span: kind.valid(span["value"]))
    return F.when(text.rlike(kind.likely), F.transform(valid, scored)).otherwise(F.array().cast("array<struct<start:int,end:int,score:double>>"))


def with_spans(rows: DataFrame, text: str, prefix: str) -> DataFrame:
    """`rows` with one array column of spans per kind, named prefix + kind."""
    whole = F.coalesce(F.col(text), F.lit(""))
    for kind in BASE:
        rows = rows.withColumn(prefix + kind.name, _spans(whole, kind))
    for kind in EXTRA:
        rows = rows.withColumn(prefix + kind.name, F.filter(_spans(whole, kind), lambda s: s["score"] >= LEAST_SCORE))
    return rows


def _written(prefix: str, kinds: tuple[Kind, ...]) -> Column:
    """kind:start:end of all spans by kind, then start, comma-joined."""

    def each(kind: Kind) -> Column:
        return F.transform(prefix + kind.name, lambda s: F.concat_ws(":", F.lit(kind.name), s["start"], s["end"]))

    return F.array_join(F.concat(*map(each, kinds)), ",")


def personal_data(documents: DataFrame) -> DataFrame:
    """doc_id, the count of each base kind, `base_sha256` of the base spans,
    and `spans` with all of them."""
    found = with_spans(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "text", "_")
    counts = [F.size("_" + kind.name).cast("long").alias("n_" + kind.name) for kind in BASE]
    return found.select("doc_id", *counts, F.sha2(_written("_", BASE), 256).alias("base_sha256"), _written("_", BASE + EXTRA).alias("spans"))


def _masked(text: Column, spans: Column, mask: str) -> Column:
    """`text` with each stretch of overlapping spans replaced by `mask`."""
    merged_type = "array<struct<start:int,end:int>>"

    def join(merged: Column, span: Column) -> Column:
        last = F.element_at(merged, -1)
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], span["end"]).alias("end"))
        touching = (F.size(merged) > 0) & (F.when(F.size(merged) > 0, last["end"]).otherwise(-1) > span["start"])
        head = F.slice(merged, F.lit(1), F.greatest(F.size(merged) - 1, F.lit(0)))
        return F.when(touching, F.concat(head, F.array(longer))).otherwise(F.concat(merged, F.array(span)))

    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    merged = F.aggregate(ordered, F.array().cast(merged_type), join)

    def rebuilt(cuts: Column) -> Column:
        def piece(span: Column, i: Column) -> Column:
            begin = F.when(i == 0, 0).otherwise(F.get(cuts, i - 1)["end"])
            return F.concat(F.substring(text, begin + 1, span["start"] - begin), F.lit(mask))

        rest = F.substring(text, F.element_at(cuts, -1)["end"] + 1, F.length(text))
        return F.concat(F.array_join(F.transform(cuts, piece), ""), rest)

    return F.when(F.size(spans) == 0, text).otherwise(_let(merged, rebuilt))


def masked(documents: DataFrame, mask: str = "[PII]") -> DataFrame:
    """The rows of `documents`, personal data in `text` replaced by `mask`;
    null texts stay null."""
    prefix = "_pii_"
    while any(name.lower().startswith(prefix) for name in documents.columns):
        prefix += "_"
    found = with_spans(documents, "text", prefix)
    every = prefix + "all"
    found = found.withColumn(every, F.concat(*(prefix + kind.name for kind in BASE + EXTRA)))
    text = F.when(F.col("text").isNotNull(), _masked(F.col("text"), F.col(every), mask))
    return found.withColumn("text", text).select(*documents.columns)
