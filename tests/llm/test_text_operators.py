from __future__ import annotations

import hashlib
import random
import re

import numpy as np
from llm import cases

from shelfline.llm import jaccard_join, license_scan, quality_rules, substring_dedup


def test_components_equal_all_pairs(spark):
    docs = cases.corpus()
    found = jaccard_join.jaccard_components(cases.frame(spark, docs)).collect()
    assert len(found) == len(docs)
    expected = cases.components(docs)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found if r.doc_id is not None} == expected
    assert sorted((r.n_shingles > 0, r.component_id) for r in found if r.doc_id is None) == [(False, None), (True, None)]


def test_chains_and_unlinked_families(spark):
    """Variants that link only through others, and families that nearly link."""
    rng = random.Random(9)
    base = cases.prose(rng, 120)
    docs, text = [], base
    for n in range(40):
        docs.append((n, text))
        text = cases.edited(rng, text, 1)
    docs += [(100 + n, cases.edited(rng, base, rng.randrange(3, 7))) for n in range(200)]
    found = jaccard_join.jaccard_components(cases.frame(spark, docs)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == cases.components(docs)


def test_a_query_joins_unlinked_members(spark):
    sets = {1: range(85), 2: range(15, 100), 3: range(100), 4: range(100)}
    rows = [(7, doc < 3, doc, np.array(tokens, np.uint64).tobytes()) for doc, tokens in sets.items()]
    opened = spark.createDataFrame(rows, "block long, hub boolean, doc_id long, tokens binary")
    found = jaccard_join._links_of_opened(opened, 80).collect()
    assert len(found) == 3 and {other for row in found for other in row} == {1, 2, 3, 4}


def test_sparse_family_equals_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_DOCS", 1)
    monkeypatch.setattr(jaccard_join, "GROUP_DOCS", 8)
    rng = random.Random(11)
    docs = []
    for _ in range(20):
        base = cases.prose(rng, 150)
        docs += [(len(docs) + n, cases.edited(rng, base, rng.choice([1, 2, 2, 2, 3, 3]))) for n in range(40)]
    found = jaccard_join.jaccard_components(cases.frame(spark, docs)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == cases.components(docs)


def test_a_text_under_a_repeated_id_does_not_speak_for_it(spark, monkeypatch):
    """The text of 2 stands first in its task as the smaller one of 1."""
    monkeypatch.setattr(jaccard_join, "_first_links", lambda *_: spark.createDataFrame([], "a long, b long"))
    rng = random.Random(4)
    words = cases.prose(rng, 60)
    texts = [(1, words), (2, words), (3, words + " end"), (1, cases.prose(rng, 90))]
    found = jaccard_join.jaccard_components(spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)).collect()
    assert {(row.doc_id, row.component_id) for row in found} == {(1, 1), (2, 2), (3, 2)}


def test_small_sets_link_at_lower_thresholds(spark):
    """Sets of 3 in 4 shingles and of 1 in 2."""
    texts = [(1, "a b c d e f g"), (2, "a b c d e f g h"), (3, "q w e r t"), (4, "q w e r t y")]
    for percent, expected in ((75, {(1, 1), (2, 1), (3, 3), (4, 4)}), (50, {(1, 1), (2, 1), (3, 3), (4, 3)})):
        found = jaccard_join.jaccard_components(cases.frame(spark, texts), percent).collect()
        assert {(row.doc_id, row.component_id) for row in found} == expected


def test_repeated_ids_and_empty_tables(spark):
    docs = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "other words"), (2, "A B C D E F")]
    found = jaccard_join.jaccard_components(cases.frame(spark, docs)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == [(1, 1, 1), (1, 2, 1), (1, 2, 1), (2, 2, 1)]
    empty = cases.frame(spark, [(1, "x")]).limit(0)
    assert jaccard_join.jaccard_components(empty).count() == 0
    assert jaccard_join.one_of_each(empty).count() == 0


def test_one_of_each_group_stays(spark):
    docs = cases.corpus()
    kept = jaccard_join.one_of_each(cases.frame(spark, docs))
    assert kept.columns == cases.frame(spark, docs).columns
    expected = sorted(doc for doc, (_, least) in cases.components(docs).items() if doc == least)
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == expected
    assert kept.where("doc_id IS NULL").count() == 2


def test_clean_texts_under_a_repeated_id_stay(spark):
    rng = random.Random(6)
    a, b, c, d = (cases.prose(rng, 60) for _ in range(4))
    docs = [(1, a), (1, b), (1, b), (2, b + " end"), (3, a), (5, a + " end"), (5, c), (6, d), (None, a)]
    kept = jaccard_join.one_of_each(cases.frame(spark, docs))
    assert kept.columns == cases.frame(spark, docs).columns
    assert {(r.doc_id, r.text) for r in kept.collect()} == {(1, a), (1, b), (5, c), (6, d), (None, a)} and kept.count() == 5


def test_repeats_equal_every_window(spark):
    docs = [(doc, text) for doc, text in cases.corpus() if doc is not None]
    docs = list({doc: (doc, text) for doc, text in docs}.values())
    found = substring_dedup.digested(substring_dedup.without_repeats(cases.frame(spark, docs))).collect()
    expected = {
        doc: (n, removed, hashlib.sha256(" ".join(kept).encode()).hexdigest()) for doc, (n, removed, kept) in cases.kept_words(docs).items()
    }
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in found} == expected
    assert sum(removed for _, removed, _ in expected.values()) > 1000


def test_repeats_without_or_with_repeated_ids(spark):
    text = " ".join(f"w{n}" for n in range(30))
    docs = [(None, text), (5, text), (5, text), (6, text + " tail"), (7, None), (8, "")]
    found = substring_dedup.without_repeats(cases.frame(spark, docs)).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed) for r in found) == [
        ("5", 30, 0), ("5", 30, 0), ("6", 31, 30), ("7", 0, 0), ("8", 0, 0), ("None", 30, 0)
    ]
    row = next(r for r in found if r.doc_id == 6)
    assert [tuple(span) for span in row.spans] == [(0, 30)] and row.kept_text == "tail"
    assert substring_dedup.without_repeats(cases.frame(spark, docs).limit(0)).count() == 0


def test_measures_equal_plain_counting(spark):
    docs = cases.corpus() + [(7_000, "a a a a a\na a a a a\n\n \nb|c # x"), (7_001, "x y z x y z")]
    found = quality_rules.judged(cases.frame(spark, docs)).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    key = lambda row: (str(row[0]), *row[1:])
    assert sorted(((r.doc_id, *(r[n] for n in names)) for r in found), key=key) == sorted(((d, *cases.measures(t)) for d, t in docs), key=key)
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in found)
    assert not any(r.kept and r.base_failed for r in found)


def test_ablations_agree_with_the_ledger(spark):
    rows = quality_rules.ledger(cases.frame(spark, cases.corpus()))
    failed = [r.failed for r in rows.collect()]
    order, mask = list(quality_rules.rules()), quality_rules.mask_of(quality_rules.POLICIES[2])
    for row in quality_rules.ablations(rows, 2).collect():
        bit = 1 << order.index(row.rule)
        assert row.n_failing == sum(bool(f & bit) for f in failed)
        assert row.n_only == sum(f & mask == bit for f in failed)
        assert row.n_kept_without == sum(f & mask & ~bit == 0 for f in failed)
    assert quality_rules.ledger(cases.frame(spark, [(1, "x")]).limit(0)).count() == 0


LICENSES = [
    (1, "x MIT  License, and the apache-license. General\nPublic LICENSE é mit license"),
    (2, 'Licensed under the Apache License, Version 2.0 (the "License");'),
    (3, "Licensed under the Apache License, Version 3.0"),
    (4, "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    (5, "Permission is hereby granted, free of charge, to any person"),
    (6, None), (7, ""), (None, "mit license"), (None, "mit license"), (8, "mit " * 50_000),
]


def test_license_phrases_and_templates(spark):
    found = license_scan.license_scan(cases.frame(spark, LICENSES)).collect()
    phrases = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
    for row in found:
        text = next(t for d, t in LICENSES if d == row.doc_id)
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places = [(i, label) for p, label in phrases.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        starts = sorted(i for i, _ in places)
        assert (row.n_words, row.n_base) == (len(words), len(places))
        assert (row.first_word, row.last_word) == ((starts[0], starts[-1]) if starts else (None, None))
        assert row.base_labels == ",".join(sorted({label for _, label in places}))
        assert set(row.base_labels.split(",")) - {""} <= set(row.labels.split(","))
    labels = {row.doc_id: row.labels for row in found}
    assert "apache-2.0-notice" in labels[2] and "apache-2.0-notice" not in labels[3] and "gpl-notice" in labels[4] and labels[5] == ""
    assert license_scan.license_scan(cases.frame(spark, LICENSES).limit(0)).count() == 0


def test_template_regions():
    automaton = license_scan.compile_template("t", "alpha <<optional>>beta <<optional>>gamma<<end>> delta<<end>> <<replace:2>> omega")
    accepts = lambda text: automaton.accepts(text.encode().split(), 0)
    assert all(map(accepts, ("alpha omega", "alpha beta delta omega", "alpha beta gamma delta x y omega", "alpha x omega")))
    assert not any(map(accepts, ("alpha x y z omega", "alpha beta", "beta delta omega", "alpha")))
