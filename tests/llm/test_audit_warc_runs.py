from __future__ import annotations

import base64
import gzip
import hashlib
import itertools
import random
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm import cases

from shelfline.llm import filter_audit, periodic_runs, warc
from shelfline.llm.queries import echoed

UPPER = set("ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def plain_failing(text):
    words = cases.WORD.findall(text)
    fails = "A" * (len(words) < 50) + "B" * (100 * len(set(words)) < 65 * len(words))
    return fails + "C" * (100 * sum(c in UPPER for c in text) > 5 * len(text)) + "D" * any(c in "#$%&*|" for c in text)


def plain_audit(rows, labels):
    """rows: (doc_id, text, part); every order walked document by document."""
    least = {}
    for doc, text, _ in rows:
        if doc is not None:
            least[text or ""] = min(doc, least.get(text or "", doc))
    docs = []
    for doc, text, part in rows:
        fails = plain_failing(text or "") + "E" * (doc is not None and least[text or ""] < doc)
        docs.append((part or "", fails, any(q == 1 for d, q, _ in labels if d == doc and d is not None), any(t == 1 for d, _, t in labels if d == doc and d is not None)))
    found = {}
    for part in {d[0] for d in docs}:
        shapley = Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            stay = [d for d in docs if d[0] == part]
            for step, letter in enumerate(order, 1):
                removed = [d for d in stay if letter in d[1]]
                stay = [d for d in stay if letter not in d[1]]
                failing = [d for d in docs if d[0] == part and letter in d[1]]
                shapley[letter] += len(removed)
                found[part, order, step] = [len(stay), len(removed), len(failing) - len(removed), sum(d[1] == letter for d in failing), sum(d[2] for d in removed), sum(d[3] for d in removed)]
        for (p, order, step), row in found.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return {key: tuple(row) for key, row in found.items()}


def audited(spark, rows, labels):
    docs = spark.createDataFrame([(d, t, p, 1, "x") for d, t, p in rows], "doc_id long, text string, source string, mask int, part string").repartition(3)
    marks = spark.createDataFrame([(*r, 5) for r in labels], "doc_id long, quality int, toxic int, n long")
    found = filter_audit.audit(filter_audit.masks(docs), marks).collect()
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in found}, len(found)


@pytest.fixture
def audit_rows():
    rng = random.Random(5)
    rows = []
    for n, (doc, text) in enumerate(cases.corpus()):
        rows.append((doc, text, rng.choice(["a", "b", "", None])))
    rows += [(5_000 + n, cases.prose(rng, 70) + rng.choice([" #", " QQQQQQQQQQQQQQQQQQQQQQQQQQQQQQQ", ""]), "a") for n in range(40)]
    rows += [(6_000 - n, "same " + rows[0][1][:9], "b") for n in range(30)] + [(7_000, "twice", "a"), (7_000, "twice", "b"), (7_001, "twice", "b")]
    labels = [(doc, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for doc, _, _ in rows if rng.random() < 0.6]
    return rows, labels + [(None, 1, 1), (10**9, 1, 1)]


def test_audit_equals_walking_every_order(spark, audit_rows):
    found, count = audited(spark, *audit_rows)
    assert found == plain_audit(*audit_rows) and count == len(found) == 3 * 600


def test_audit_with_flushed_tries_and_lengthened_prefixes(spark, audit_rows, monkeypatch):
    rows, labels = audit_rows
    opening = cases.prose(random.Random(1), 300)
    rows = rows + [(9_000 + n, opening + f" {n % 17}", "a") for n in range(60)]
    monkeypatch.setattr(filter_audit, "FLUSH_BYTES", 3_000)
    monkeypatch.setattr(filter_audit, "RANGE_BYTES", 2_000)
    assert audited(spark, rows, labels)[0] == plain_audit(rows, labels)


def test_audit_of_nothing(spark):
    assert audited(spark, [], []) == ({}, 0)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text("ab", max_size=9), st.integers(0, 5)), max_size=40))
def test_trie_holds_least_ids(rows):
    trie = filter_audit.RadixTrie()
    decided = [row for text, doc in rows for row in trie.add(text.encode(), doc, "p", 0, 1)]
    held = list(trie.holders())
    least = {}
    for text, doc in rows:
        least[text.encode()] = min(doc, least.get(text.encode(), doc))
    assert {row[4]: row[0] for row in held} == least and len(held) == len(least)
    assert sum(row[3] for row in held) + sum(row[3] for row in decided) == len(rows)
    assert Counter(doc for doc, _, mask, n in decided for _ in range(n) if mask) == Counter(d for t, d in rows if d > least[t.encode()])


def plain_runs(words):
    n, best = len(words), {}
    for q in range(1, n // 2 + 1):
        x = 0
        while x < n - q:
            start = x
            while x < n - q and words[x] == words[x + q]:
                x += 1
            if x > start and x - start + q >= max(12, 2 * q):
                best.setdefault((start, x + q), q)
            x += x == start
    return sorted(((s, e - s, q) for (s, e), q in best.items()), key=lambda r: (r[0], r[2]))


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 6), st.integers(0, 130), st.randoms(use_true_random=False), st.booleans())
def test_runs_equal_all_periods(letters, n, rng, echo):
    words = [b"%d" % rng.randrange(letters) for _ in range(n)]
    if echo and n > 3:
        a = rng.randrange(n)
        p = 1 + (n - a) // rng.randrange(3, 11)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    assert [tuple(map(int, row)) for row in periodic_runs.runs_of(words)] == plain_runs(words)


def test_runs_over_grid_blocks(monkeypatch):
    monkeypatch.setattr(periodic_runs, "GRID_WORDS", 64)
    periodic_runs._first_block.cache_clear()
    rng = random.Random(2)
    words = [b"%d" % rng.randrange(9) for _ in range(500)]
    words[200:440] = [words[200 + i % 37] for i in range(240)]
    try:
        assert [tuple(map(int, row)) for row in periodic_runs.runs_of(words)] == plain_runs(words) != []
    finally:
        periodic_runs._first_block.cache_clear()


def test_common_lengths_of_any_two_places():
    rng = random.Random(3)
    words = [rng.randrange(2) for _ in range(60)] * 3
    import numpy as np

    extensions = periodic_runs.Extensions(np.array(words, np.int32))
    pairs = [(a, b) for a in range(len(words)) for b in range(len(words)) if a != b]
    found = extensions.of(np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]))
    for (a, b), length in zip(pairs, found):
        k = 0
        while max(a, b) + k < len(words) and words[a + k] == words[b + k]:
            k += 1
        assert k == length


def plain_document(doc, text):
    words = cases.WORD.findall(text or "")
    n = len(words)
    if doc is not None and n:
        h = zlib.crc32(str(doc).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    return (doc, len(runs), *best, milli, sha(lines), sha(kept))


def test_run_query_equals_plain_version(spark):
    rng = random.Random(8)
    docs = [(n, text) for n, (_, text) in enumerate(cases.corpus()) if not text or len(text) < 9_000]
    docs += [(1_000 + n, cases.prose(rng, rng.randrange(1, 90))) for n in range(300)]
    docs += [(None, "a b " * 20), (None, None), (2, "x y z " * 9), (2, "x y z " * 9), (-40, "w " * 12)]
    found = periodic_runs.digested(periodic_runs.periodic_runs(echoed(cases.frame(spark, docs)))).collect()
    key = lambda row: tuple(map(str, row))
    assert sorted(map(tuple, found), key=key) == sorted((plain_document(*row) for row in docs), key=key)
    assert sum(row.n_runs > 0 for row in found) > 20


def test_long_texts_and_empty_tables_of_runs(spark):
    text = cases.prose(random.Random(4), 40) + " " + "a b c " * 20_000
    found = periodic_runs.periodic_runs(cases.frame(spark, [(1, text)]))
    assert found.schema["runs"].dataType.simpleString() == "array<struct<start:bigint,length:bigint,period:bigint>>"
    row = found.first()
    assert row.n_words == 60_040 and tuple(row.runs[-1]) == (40, 60_000, 3) and row.collapsed == " ".join(text.split()[:43])
    assert periodic_runs.digested(periodic_runs.periodic_runs(cases.frame(spark, [(1, "x")]).limit(0))).count() == 0


PAGES = [
    (1, "http://a.example/x y", "<p>one</p>\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n"),
    (2, "http://b.example/", "<p>same</p>"), (9, "http://b.example/2", "<p>same</p>"), (5, None, "<p>same</p>"),
    (3, "http://c.example", ""), (4, "not an address", None), (None, "http://n.example", "<p>same</p>"), (None, None, "lone\n"),
    (6, "http://e.example", "é ü \n\n\r\n ß"), (7, "http://f.example", "end\r\n\r\n"), (8, "http://g.example", "x" * 3_000_000),
    (10, "http://r.example", "again"), (10, "http://r.example", "again"), (10, "http://s.example", "again"),
]


def pages(spark, rows):
    return spark.createDataFrame([(*row, "r", 1) for row in rows], "page_id long, url string, html string, record_id string, salt int").repartition(3)


def plain_captures(rows):
    groups = defaultdict(list)
    for page, url, html in rows:
        groups[html or ""].append((page is not None, page or 0, url is not None, url or ""))
    found = []
    for page, url, html in rows:
        last = max(groups[html or ""])
        first = not last[0] or last == (page is not None, page or 0, url is not None, url or "")
        data = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        found.append((page, len(data), digest, "response" if first else "revisit", None if first else last[1]))
    return sorted(map(str, found))


def test_pages_come_back_from_archives(spark, tmp_path):
    path = str(tmp_path / "archives")
    warc.write_archives(pages(spark, PAGES), path)
    found = warc.page_captures(spark, path)
    rows = found.collect()
    assert sorted(str((r.page_id, r.response.payload_bytes, r.response.payload_digest, r.response.record_type, r.refers_to_page)) for r in rows) == plain_captures(PAGES)
    texts = {r.page_id: bytes(r.response.block).decode() for r in rows if r.response.record_type == "response" and r.page_id is not None}
    html = {page: text or "" for page, _, text in PAGES}
    assert set(texts) == {1, 9, 4, 6, 7, 8, 10} and all(texts[page] == html[page] for page in texts)
    assert not any(r.response.damaged for r in rows)
    one = next(r for r in rows if r.page_id == 1)
    assert one.response.target_uri == "http://a.example/x%20y" and bytes(one.requests[0].block).startswith(b"GET http://a.example/x%20y HTTP/1.1\r\nHost: a.example\r\n")
    assert all(len(r.requests) == len(r.metadata) == 1 for r in rows)


def archive(path, records, members):
    """Records of another writer, as one gzip member or one each."""
    written = []
    for fields, block in records:
        head = "".join(f"{name}: {value}\r\n" for name, value in fields)
        written.append(f"WARC/1.0\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n")
    path.write_bytes(b"".join(map(gzip.compress, written)) if members else gzip.compress(b"".join(written)))


def record(kind, name, block=b"", linked=(), http=True):
    fields = [("WARC-Type", kind), ("warc-record-id", name), *(("WARC-Concurrent-To", other) for other in linked)]
    return [*fields, ("Content-Type", "application/http" if http else "text/plain")], block


@pytest.mark.parametrize("members", [False, True])
def test_transactions_of_other_writers(spark, tmp_path, members):
    http = b"HTTP/1.1 200 OK\r\n\r\n"
    archive(tmp_path / "a.warc.gz", [
        record("warcinfo", "<i>", b"software: x", http=False),
        record("response", "<r1>", http + b"body\n\r\n\r\nWARC/1.0\n", ["<q1>"]),
        record("request", "<q1>", b"GET /"),
        record("metadata", "<m1>", b"via: x\r\n", ["<q1>"], http=False),
        record("request", "<q2>", b"GET /2", ["<r2>"]),
    ], members)
    archive(tmp_path / "b.warc.gz", [
        record("response", "<r2>", http),
        record("request", "<lost>", b"GET /3", ["<gone>"]),
        record("resource", "<s>", b"plain", http=False),
        record("metadata", "<m2>", b"", ["<s>", "<r2>"], http=False),
    ], members)
    found = {r.capture_id: r for r in warc.captures(warc.read_records(spark, str(tmp_path))).collect()}
    shape = {key: ([q.record_id for q in row.requests], [m.record_id for m in row.metadata]) for key, row in found.items()}
    assert shape == {"<r1>": (["<q1>"], ["<m1>"]), "<r2>": (["<q2>"], ["<m2>"]), "<s>": ([], ["<m2>"]), "<lost>": (["<lost>"], [])}
    assert bytes(found["<r1>"].response.block) == b"body\n\r\n\r\nWARC/1.0\n" and found["<lost>"].response.record_id is None
    assert bytes(found["<s>"].response.block) == b"plain" and found["<r1>"].response.archive.endswith("a.warc.gz")


def test_damaged_records_are_marked(spark, tmp_path):
    good = b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <%d>\r\nContent-Length: 2\r\n\r\nok\r\n\r\n"
    wrong = good.replace(b"Content-Length", b"WARC-Payload-Digest: sha1:AAAA\r\nContent-Length")
    cut = b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <9>\r\nContent-Length: 500\r\n\r\nonly this"
    (tmp_path / "x.warc.gz").write_bytes(gzip.compress(good % 1 + b"stray bytes\r\n" + good % 2 + wrong % 3 + cut))
    rows = [(r.record_id, bytes(r.block).strip(), r.damaged) for r in warc.read_records(spark, str(tmp_path)).collect()]
    assert rows == [("<1>", b"ok", False), (None, b"stray bytes", True), ("<2>", b"ok", False), ("<3>", b"ok", True), ("<9>", b"only this", True)]


def test_captures_of_many_records_go_on(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "CAPTURE_RECORDS", 10)
    archive(tmp_path / "a.warc.gz", [record("response", "<r>")] + [record("metadata", f"<{n}>", b"x", ["<r>"]) for n in range(95)], False)
    rows = warc.captures(warc.read_records(spark, str(tmp_path))).collect()
    assert sorted(m.record_id for r in rows for m in r.metadata) == sorted(f"<{n}>" for n in range(95))
    assert all(len(r.metadata) < 30 and r.response.record_id == "<r>" for r in rows)


def test_archives_of_no_pages(spark, tmp_path):
    path = str(tmp_path / "none")
    warc.write_archives(pages(spark, PAGES[:1]).limit(0), path)
    assert warc.page_captures(spark, path).count() == 0
