from __future__ import annotations

import hashlib
import json
import random
import re

from llm import cases
from pyspark.sql import functions as F

from shelfline.llm import chat_format, pii


def luhn(digits):
    total = 0
    for n, char in enumerate(reversed(digits)):
        value = int(char) * (1 + n % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def card(text):
    digits = re.sub("[ -]", "", text)
    return 16 <= len(digits) <= 19 and luhn(digits)


KINDS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", card),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(re.sub("[^0-9]", "", m)) <= 15),
]


def base(text):
    return [[(m.start(), m.end()) for m in re.finditer(p, text or "") if valid(m.group())] for _, p, valid in KINDS]


def texts():
    rng = random.Random(5)
    parts = ["a", "b", "@", "@", ".", ".", "1", "2", "45", "+", "-", " ", "(", ")", "é", "😀", "_", "\n", "255", "4111111111111111", "x@y.z", "+1 234 5678", "007.8.9.1"]
    docs = [(n, "".join(rng.choice(parts) for _ in range(rng.randrange(60)))) for n in range(1500)]
    docs += [(9000, None), (9001, ""), (9002, "a" * 200_000), (9003, "1 " * 20_000), (9004, "1.2.3.4 " * 3000), (9005, "a.b" * 30_000 + "@")]
    return docs + [(9006, "a@b.cd e"), (9006, "a@b.cd e"), (None, "+1 (555) 010-2345")]


def test_base_spans_equal_plain_search(spark):
    docs = texts()
    found = pii.personal_data(cases.frame(spark, docs)).collect()
    assert len(found) == len(docs)
    by_id = {row.doc_id: row for row in found}
    for doc, text in docs:
        spans, row = base(text), by_id[doc]
        written = ",".join(f"{kind[0]}:{a}:{b}" for kind, places in zip(KINDS, spans) for a, b in places)
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [len(places) for places in spans], text
        assert row.base_sha256 == hashlib.sha256(written.encode()).hexdigest() and row.spans.startswith(written)


def test_extra_kinds_need_checks_or_context(spark):
    docs = [
        (1, "iban DE89 3704 0044 0532 0130 00."), (2, "iban DE88 3704 0044 0532 0130 00."), (3, "ssn 123-45-6789"), (4, "no 123-45-6789"),
        (5, 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"'), (6, "see 24be64439e3e49cf46b2d7c90f3602a3d0b907ff"),
    ]
    found = {row.doc_id: row.spans for row in pii.personal_data(cases.frame(spark, docs)).collect()}
    assert found == {1: "iban:5:32", 2: "", 3: "ssn:4:15", 4: "", 5: "secret:9:49", 6: ""}


def test_masks_cover_all_spans_and_nothing_else(spark):
    docs = texts()
    frame = cases.frame(spark, docs)
    spans = {row.doc_id: row.spans for row in pii.personal_data(frame).collect()}
    masked = pii.masked(frame)
    assert masked.columns == frame.columns
    found = {row.doc_id: row.text for row in masked.collect()}
    for doc, text in docs:
        if text is None:
            assert found[doc] is None
            continue
        out, end = "", 0
        for a, b in sorted((int(a), int(b)) for _, a, b in (s.split(":") for s in spans[doc].split(",") if s)):
            if a >= end:
                out += text[end:a] + "[PII]"
            end = max(end, b)
        assert found[doc] == out + text[end:]
    assert pii.masked(frame.limit(0)).count() == 0 and pii.personal_data(frame.limit(0)).count() == 0


def test_no_python_in_the_plans(spark):
    frame = cases.frame(spark, [(1, "x")])
    chat = spark.createDataFrame([(1, 0, "user", "hi")], "conv_id long, turn int, role string, text string")
    for df in (pii.personal_data(frame), pii.masked(frame), chat_format.formatted(chat)):
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().optimizedPlan().toString())


SCHEMAS = {"search": {"query": ("string", True), "limit": ("integer", False), "tags": ("array", False), "exact": ("boolean", False)}}


def call(**arguments):
    return json.dumps({"content": "calling", "tool_calls": [{"id": arguments.pop("id"), "name": arguments.pop("name", "search"), "arguments": arguments}]})


def test_calls_are_linked_ordered_and_checked(spark):
    chat = [
        (1, 0, "system", "be brief"),
        (1, 1, "tool", json.dumps({"tool_call_id": "b", "content": "early"})),
        (1, 2, "user", '"quotes" é\n'),
        (1, 4, "assistant", call(id="b", query="x", limit=3, tags=[1], exact=True)),
        (1, 5, "tool", json.dumps({"tool_call_id": "none", "content": "lost"})),
        (1, 6, "assistant", call(id="c", limit="three")),
        (1, 7, "assistant", call(id="d", name="unknown")),
        (1, 8, "assistant", call(id="b", query="again")),
        (2, None, None, None),
        (2, 0, "assistant", "{not json"),
        (None, 3, "user", "x"),
        (None, 3, "user", "x"),
    ]
    frame = spark.createDataFrame([(*row, "extra", 1) for row in chat], "conv_id long, turn int, role string, text string, json string, part int")
    rows = {(r.conv_id, r.part): r for r in chat_format.formatted(frame, SCHEMAS).collect()}
    one = rows[(1, 0)]
    assert (one.n_messages, one.n_calls, one.n_invalid_calls, one.n_answers, one.n_orphans) == (8, 4, 2, 1, 1)
    messages = json.loads(one.messages)
    assert [m.get("tool_call_id") or m.get("content") for m in messages][:4] == ["be brief", '"quotes" é\n', "calling", "b"]
    assert messages[2]["tool_calls"] == [{"arguments": '{"exact":true,"limit":3,"query":"x","tags":[1]}', "id": "b", "name": "search"}]
    for row in rows.values():
        plain = json.dumps(json.loads(row.messages), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        assert row.messages == plain
    assert rows[(2, -1)].messages == "[{}]" and rows[(2, 0)].n_calls == 0 and rows[(None, 0)].n_messages == 2


def test_both_forms_of_calls_and_other_fields_are_kept(spark):
    asked = {"query": "x"}
    nested = {"id": "b", "type": "function", "function": {"name": "search", "arguments": json.dumps(asked)}}
    both = {"id": "c", "name": "search", "arguments": asked, "index": 1, "function": {"name": "other", "strict": True}}
    texts = [
        ("assistant", {"role": "assistant", "content": None, "tool_calls": [nested, both], "usage": {"n": [1, None]}}),
        ("tool", {"tool_call_id": "b", "content": "found", "name": "search", "is_error": False}),
        ("assistant", {"tool_calls": [3]}),
    ]
    frame = spark.createDataFrame([(1, n, role, json.dumps(text)) for n, (role, text) in enumerate(texts)], "conv_id long, turn int, role string, text string")
    row = chat_format.formatted(frame, SCHEMAS).collect()[0]
    assert (row.n_messages, row.n_calls, row.n_invalid_calls, row.n_answers, row.n_orphans) == (3, 2, 0, 1, 0)
    query = '{"query":"x"}'
    expected = [
        {
            "role": "assistant",
            "tool_calls": [
                {"id": "b", "type": "function", "name": "search", "arguments": query},
                {"id": "c", "name": "search", "arguments": query, "index": 1, "function": {"name": "other", "strict": True}},
            ],
            "usage": {"n": [1, None]},
        },
        {"role": "tool", "tool_call_id": "b", "content": "found", "name": "search", "is_error": False},
        {"role": "assistant", "content": '{"tool_calls": [3]}'},
    ]
    assert row.messages == json.dumps(expected, sort_keys=True, separators=(",", ":"))


def test_long_conversations_become_parts(spark, monkeypatch):
    monkeypatch.setattr(chat_format, "PART_MESSAGES", 50)
    frame = spark.range(600).select(F.lit(7).alias("conv_id"), F.when(F.col("id") < 300, F.col("id")).otherwise(400).alias("turn"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"))
    rows = chat_format.formatted(frame, part_turns=100).collect()
    assert sum(r.n_messages for r in rows) == 600 and len(rows) > 6
    parts = {r.part: [int(m["content"]) for m in json.loads(r.messages)] for r in rows if r.part < 3 and r.piece == 0}
    assert all(found == sorted(found) for found in parts.values())
    assert chat_format.formatted(frame.limit(0)).count() == 0


def test_equal_messages_are_dealt_over_pieces(spark, monkeypatch):
    monkeypatch.setattr(chat_format, "PART_MESSAGES", 50)
    frame = spark.range(610).select(F.lit(None).cast("long").alias("conv_id"), F.lit(3).alias("turn"), F.lit("user").alias("role"), F.when(F.col("id") < 600, "same").otherwise(F.col("id").cast("string")).alias("text"))
    rows = chat_format.formatted(frame).collect()
    texts = [[m["content"] for m in json.loads(r.messages)] for r in rows]
    assert [len(piece) for piece in texts] == [r.n_messages for r in rows] and all(piece == sorted(piece) for piece in texts)
    assert sorted(text for piece in texts for text in piece) == sorted(["same"] * 600 + [str(n) for n in range(600, 610)])
    assert len(rows) == 13 and max(r.n_messages for r in rows) <= 60


def test_argument_errors(spark):
    frame = spark.createDataFrame(
        [("search", '{"query":1}'), ("search", "{}"), ("search", "{"), (None, "{}"), ("search", '{"query":"q","exact":"no"}')], "name string, arguments string"
    )
    found = [row[0] for row in frame.select(chat_format.argument_errors(F.col("name"), F.col("arguments"), SCHEMAS)).collect()]
    assert found == [["query is not string"], ["query is missing"], ["arguments are not JSON"], ["unknown tool null"], ["exact is not boolean"]]
