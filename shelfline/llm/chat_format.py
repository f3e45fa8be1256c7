"""Conversations as canonical JSON, tool calls linked to their results.

A message is a row (conv_id, turn, role, text). An assistant message whose
text is a JSON object with `tool_calls` makes calls, each with `id`, `name`
and `arguments`, the last two also as fields of `function`; a message of role `tool` whose text is a JSON object with
`tool_call_id` is the result of one. Calls and results are joined by
(conv_id, identifier). Messages are ordered by turn, but a result never
stands before its call: it takes the later of both turns. Arguments are
checked against the tool's schema. Objects are written with sorted keys,
without spaces and without null fields. All other fields of such a text and of
its calls are kept beside these; its role is that of the row.

A conversation becomes parts of at most `part_turns` turns, so that a very
long one is not one row. A part in which turns repeat so often that it holds
more than `PART_MESSAGES` is dealt by hash into pieces, each in order; there equal
messages are counted first and dealt evenly, so that one repeated without end
fills no piece. All of it are DataFrame functions.

Defined cases: a message without text has no content; without turn it stands
first; ties stand in the order of call, role and text, and repeated rows are
all kept; rows without conv_id are one conversation; a call identifier used
twice belongs to its first call; a result without a call is kept where it
stands and counted; a text that is no valid JSON object (a key given twice
included), or has a call that is no object, is content as it is. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART_TURNS = 256
PART_MESSAGES = 4096

# Argument names of a tool: their JSON type and whether they are required.
Schema = dict[str, tuple[str, bool]]

TYPES = {
    "string": "^STRING",
    "integer": "^BIGINT",
    "number": "^(BIGINT|DECIMAL|DOUBLE)",
    "boolean": "^BOOLEAN",
    "object": "^OBJECT",
    "array": "^ARRAY",
}

MAP = "map<string,variant>"


def _filled(fields: Column) -> Column:
    return F.map_filter(fields, lambda _, value: value.isNotNull() & ~F.is_variant_null(value))


def _without(fields: Column, *names: str) -> Column:
    return _filled(F.map_filter(fields, lambda key, _: ~key.isin(*names)))


def _variant(fields: Column) -> Column:
    return F.call_function("to_variant_object", fields)


def _texts(**fields: Column) -> Column:
    return _filled(F.create_map(*(item for name, value in fields.items() for item in (F.lit(name), value.cast("variant")))))


def argument_errors(name: Column, arguments: Column, schemas: dict[str, Schema]) -> Column:
    """array<string> of what is wrong with a call; empty when it is valid."""
    parsed = F.try_parse_json(arguments)
    none = F.array().cast("array<string>")
    checks = F.when(parsed.isNull(), F.array(F.lit("arguments are not JSON")))
    for tool, fields in schemas.items():
        found = [
            F.when(
                F.try_variant_get(parsed, f"$.{field}", "variant").isNull(),
                F.lit(f"{field} is missing") if required else F.lit(None),
            ).when(
                ~F.schema_of_variant(F.try_variant_get(parsed, f"$.{field}", "variant")).rlike(TYPES[kind]),
                F.lit(f"{field} is not {kind}"),
            )
            for field, (kind, required) in fields.items()
        ]
        checks = checks.when(name == tool, F.array_compact(F.array(*found)) if found else none)
    return checks.otherwise(F.array(F.concat(F.lit("unknown tool "), F.coalesce(name, F.lit("null")))))


def messages(conversations: DataFrame) -> DataFrame:
    """Typed messages with `calls` and `answers` (the identifier of the call
    that a result answers)."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), "text"
    )
    parsed = F.col("role").isin("assistant", "tool") & F.col("text").rlike(r"^\s*\{")
    rows = rows.withColumn("body", F.when(parsed, F.try_parse_json("text")))
    made = F.when(F.col("role") == "assistant", F.try_variant_get("body", "$.tool_calls", "array<variant>"))
    objects = F.forall(made, lambda item: F.coalesce(F.schema_of_variant(item).startswith("OBJECT"), F.lit(False)))
    calls = F.when((F.size(made) > 0) & objects, F.transform(made, _call))
    answers = F.when(F.col("role") == "tool", F.try_variant_get("body", "$.tool_call_id", "string"))
    rows = rows.withColumns({"calls": calls, "answers": answers})
    read = F.col("calls").isNotNull() | F.col("answers").isNotNull()
    content = F.when(read, F.try_variant_get("body", "$.content", "string")).otherwise(F.col("text"))
    fields = F.try_variant_get("body", "$", MAP)
    rest = F.when(F.col("calls").isNotNull(), _without(fields, "content", "role", "tool_calls"))
    rest = rest.when(F.col("answers").isNotNull(), _without(fields, "content", "role", "tool_call_id"))
    return rows.select("conv_id", "turn", "role", content.alias("content"), "calls", "answers", rest.alias("rest"))


def _call(item: Column) -> Column:
    """id, name and arguments of a call in either form; its other fields."""
    function = F.try_variant_get(item, "$.function", MAP)
    own = {name: F.try_variant_get(item, f"$.{name}", "string") for name in ("name", "arguments")}
    inner = {name: F.try_variant_get(item, f"$.function.{name}", "string") for name in own}
    # A field that `function` gives a second time stays there.
    taken = lambda key: F.coalesce(*(F.when((key == name) & own[name].isNull(), True) for name in own), F.lit(False))
    left = _filled(F.map_filter(function, lambda key, _: ~taken(key)))
    rest = F.when(function.isNull(), _without(F.try_variant_get(item, "$", MAP), "id", "name", "arguments"))
    rest = rest.otherwise(_without(F.try_variant_get(item, "$", MAP), "id", "name", "arguments", "function"))
    rest = F.when(F.size(left) > 0, F.map_concat(rest, F.create_map(F.lit("function"), _variant(left)))).otherwise(rest)
    return F.struct(
        F.try_variant_get(item, "$.id", "string").alias("id"), *(F.coalesce(own[name], inner[name]).alias(name) for name in own), rest.alias("rest")
    )


def linked(rows: DataFrame) -> DataFrame:
    """Messages with the turn and place of the call each one answers."""
    calls = rows.where("calls IS NOT NULL").select("conv_id", "turn", F.posexplode("calls").alias("place", "call"))
    first = calls.groupBy("conv_id", F.col("call.id").alias("answers")).agg(F.min(F.struct("turn", "place")).alias("to"))
    first = first.where("answers IS NOT NULL").withColumnRenamed("conv_id", "of")
    same = F.col("conv_id").eqNullSafe(F.col("of")) & (rows["answers"] == first["answers"])
    results = rows.where("answers IS NOT NULL").join(first.hint("shuffle_hash"), same, "left").drop(first["answers"], "of")
    others = rows.where("answers IS NULL").withColumn("to", F.lit(None).cast("struct<turn:bigint,place:int>"))
    return others.unionByName(results)


def canonical(rows: DataFrame, schemas: dict[str, Schema]) -> DataFrame:
    """One row per message: its place in the order, its JSON, its errors."""

    def call(made: Column) -> Column:
        arguments = F.coalesce(F.to_json(F.try_parse_json(made["arguments"])), made["arguments"])
        return _variant(F.map_concat(made["rest"], _texts(arguments=arguments, id=made["id"], name=made["name"])))

    plain = F.to_json(F.struct("content", "role"))
    own = _texts(content=F.col("content"), role=F.col("role"), tool_call_id=F.col("answers"))
    made = F.when(F.col("calls").isNotNull(), F.create_map(F.lit("tool_calls"), F.transform("calls", call).cast("variant")))
    whole = F.map_concat("rest", own, F.coalesce(made, F.create_map().cast(MAP)))
    json = F.when(F.col("rest").isNull(), plain).otherwise(F.to_json(_variant(whole)))
    wrong = F.filter("calls", lambda c: F.size(argument_errors(c["name"], c["arguments"], schemas)) > 0)
    return rows.select(
        "conv_id",
        F.greatest(F.coalesce("turn", F.col("to.turn")), F.col("to.turn")).alias("turn"),
        "role",
        F.coalesce("to.place", F.lit(-1)).alias("place"),
        json.alias("json"),
        F.coalesce(F.size("calls"), F.lit(0)).alias("calls"),
        F.coalesce(F.size(wrong), F.lit(0)).alias("invalid"),
        F.col("to").isNotNull().cast("int").alias("answered"),
        (F.col("answers").isNotNull() & F.col("to").isNull()).cast("int").alias("orphaned"),
    )


def _dealt(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Messages of large parts, each distinct one with its `copies` in every
    `piece` it is dealt to."""
    distinct = rows.groupBy(*columns, "held").agg(F.count(F.lit(1)).alias("all"))
    pieces = F.ceil(F.col("held") / PART_MESSAGES)
    distinct = distinct.withColumn("pieces", pieces).withColumn("places", F.least("all", "pieces"))
    dealt = distinct.withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("places") - 1)))
    piece = F.pmod(F.pmod(F.xxhash64("json", "turn"), F.col("pieces")) + F.col("nth"), F.col("pieces"))
    more = (F.col("nth") < F.col("all") % F.col("places")).cast("long")
    return dealt.select(*columns, piece.alias("piece"), (F.floor(F.col("all") / F.col("places")) + more).alias("copies"))


def formatted(conversations: DataFrame, schemas: dict[str, Schema] | None = None, part_turns: int = PART_TURNS) -> DataFrame:
    """conv_id, part, piece, n_messages, n_calls, n_invalid_calls, n_answers,
    n_orphans, messages (a JSON array) for every part of a conversation."""
    rows = canonical(linked(messages(conversations)), schemas or {})
    part = F.coalesce(F.floor(F.col("turn") / part_turns), F.lit(-1)).cast("long")
    rows = rows.withColumn("part", part).withColumn("key", F.xxhash64("conv_id", "part"))
    large = rows.groupBy("key").agg(F.count(F.lit(1)).alias("held")).where(F.col("held") > PART_MESSAGES)
    counts = {"n_calls": "calls", "n_invalid_calls": "invalid", "n_answers": "answered", "n_orphans": "orphaned"}
    columns = ["conv_id", "part", "turn", "place", "role", "json", *counts.values()]
    one = F.lit(1).cast("long")
    few = rows.join(large, "key", "left_anti").select(*columns, F.lit(0).cast("long").alias("piece"), one.alias("copies"))
    rows = few.unionByName(_dealt(rows.join(large, "key"), columns))
    order = F.struct(F.coalesce("turn", F.lit(-(2**63))).alias("turn"), "place", F.coalesce("role", F.lit("")).alias("role"), "json", "copies")
    parts = rows.groupBy("conv_id", "part", "piece").agg(
        F.sum("copies").alias("n_messages"),
        *(F.sum(F.col(c) * F.col("copies")).alias(n) for n, c in counts.items()),
        F.array_sort(F.collect_list(order)).alias("ordered"),
    )
    each = F.flatten(F.transform("ordered", lambda m: F.array_repeat(m["json"], m["copies"].cast("int"))))
    written = F.concat(F.lit("["), F.array_join(each, ","), F.lit("]"))
    return parts.select("conv_id", "part", "piece", "n_messages", *counts, written.alias("messages"))
