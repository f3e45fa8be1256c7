from __future__ import annotations

import random
import zlib

import numpy as np
from llm import cases
from pyspark.sql import functions as F

from shelfline.llm import decontamination, quality_classifier

DATA = "/root/testdata/sf0.01"


def tables(spark):
    return (spark.read.parquet(f"{DATA}/{name}.parquet") for name in ("documents", "labels"))


def test_held_out_accuracy_and_folds(spark):
    documents, labels = tables(spark)
    found = quality_classifier.quality(documents, labels).toPandas()
    assert len(found) == documents.count() and found.score.between(0, 1).all()
    assert (found.predicted == (found.score >= 0.7)).all()
    assert all(held == (zlib.crc32(str(doc).encode()) % 4 == 2) for doc, held in zip(found.doc_id, found.held_out))
    joined = found.merge(labels.toPandas(), on="doc_id")
    held = joined[joined.held_out]
    assert len(held) > 50 and (held.predicted == held.quality).mean() >= 0.95
    good, bad = held[held.quality == 1].score, held[held.quality == 0].score
    assert good.mean() > 0.9 and bad.mean() < 0.3


def test_held_out_labels_are_never_learnt(spark):
    documents, labels = tables(spark)
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(doc_id AS STRING)) % 4 = 2 THEN 1 - quality ELSE quality END AS quality")
    one, other = (quality_classifier.quality(documents, marks).toPandas().sort_values("doc_id") for marks in (labels, turned))
    assert np.allclose(one.score, other.score)


def test_scores_of_awkward_texts(spark):
    documents, labels = tables(spark)
    model = quality_classifier.quality_model(documents, labels)
    docs = cases.corpus()
    frame = cases.frame(spark, docs).drop("score")
    found = quality_classifier.scored(frame, model).collect()
    assert len(found) == len(docs) and all(0 <= row.score <= 1 for row in found)
    by_text = {}
    assert all(by_text.setdefault(row.text or "", row.score) == row.score for row in found)
    assert quality_classifier.scored(frame.limit(0), model).count() == 0


def test_labels_of_one_class_or_none(spark):
    docs = cases.frame(spark, [(0, "a b"), (1, "c"), (3, None)])
    labels = spark.createDataFrame([(0, 1), (1, 1), (3, None), (None, 1)], "doc_id long, quality int")
    assert {row.score > 0.99 for row in quality_classifier.quality(docs, labels).collect()} == {True}
    assert {row.score for row in quality_classifier.quality(docs, labels.limit(0)).collect()} == {0.5}
    assert quality_classifier.accepted(docs, labels).columns == docs.columns


def test_descent_separates():
    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(0, 50, 12) + (0 if n % 2 else 25)).astype(np.int32) for n in range(200)]
    signs = np.where(np.arange(200) % 2, 1.0, -1.0)
    counts = np.zeros((2, quality_classifier.FEATURES))
    for row, sign in zip(rows, signs):
        counts[int(sign > 0), row] += 1
    ratios = np.log((counts[1] + 1) / 102) - np.log((counts[0] + 1) / 102)
    model = quality_classifier.descend(rows, signs, ratios)
    assert np.mean([(model.score(row) > 0.5) == (sign > 0) for row, sign in zip(rows, signs)]) > 0.95


def words_of(text):
    return (text or "").encode().translate(decontamination.TO_WORDS).split()


def fits(item, words, limit):
    """Plain dynamic programme: least edits of the item in any stretch."""
    row = [0] * (len(words) + 1)
    for n, word in enumerate(item, 1):
        new = [n]
        for j, other in enumerate(words, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (word != other)))
        row = new
    return min(row) <= limit


def planted(seed=5):
    rng = random.Random(seed)
    items = [(n, cases.prose(rng, rng.randrange(8, 40))) for n in range(25)] + [(25, "short"), (26, None), (27, ""), (28, "two words")]
    docs = []
    for n in range(120):
        item = items[rng.randrange(25)][1]
        limit = len(item.split()) // 5
        edits = rng.randrange(0, limit + 4)
        words = item.split()
        for _ in range(edits):
            at = rng.randrange(len(words))
            rng.choice([lambda: words.pop(at), lambda: words.insert(at, "zz"), lambda: words.__setitem__(at, "yy")])()
            words = words or ["q"]
        docs.append((n, cases.prose(rng, rng.randrange(0, 60)) + " " + " ".join(words).upper() + "!! " + cases.prose(rng, rng.randrange(0, 60))))
    docs += [(n + 1000, cases.prose(rng, 80)) for n in range(30)] + [(2000, None), (2001, ""), (None, items[0][1]), (2002, items[0][1]), (2002, items[0][1])]
    return items, docs


def test_leaks_reach_the_target_recall(spark):
    items, docs = planted()
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontamination.leaks(cases.frame(spark, docs), benchmark).collect()}
    expected = {
        (doc, item) for doc, text in docs for item, wanted in items
        if words_of(wanted) and fits(words_of(wanted), words_of(text), int(0.2 * len(words_of(wanted)) + 1e-9))
    }
    assert found <= expected
    assert len(found) >= 0.99 * len(expected) > 60
    assert not {doc for doc, _ in found if doc is not None and 1000 <= doc < 2000} - {d for d, _ in expected}


def test_clean_documents_stay_whole(spark, monkeypatch):
    items, docs = planted(6)
    benchmark, frame = spark.createDataFrame(items, "item_id long, text string"), cases.frame(spark, docs)
    leaking = {r.doc_id for r in decontamination.leaks(frame, benchmark).collect()}
    kept = decontamination.without_leaks(frame, benchmark)
    assert kept.columns == frame.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(doc) for doc, _ in docs if doc not in leaking)
    # Items in several blocks, two texts of one item among them.
    benchmark = benchmark.withColumn("item_id", F.when(F.col("item_id") % 5 == 0, 0).otherwise(F.col("item_id")))
    clashing = frame.withColumns({"leaks": F.lit(1), "leaks_0": F.lit(2), "Digest": F.lit(3)})
    whole = sorted(map(str, decontamination.leaks(frame, benchmark).collect()))
    clean = sorted(map(str, decontamination.without_leaks(clashing, benchmark).collect()))
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 600)
    assert sorted(map(str, decontamination.leaks(frame, benchmark).collect())) == whole
    assert sorted(map(str, decontamination.without_leaks(clashing, benchmark).collect())) == clean
    assert decontamination.without_leaks(frame, benchmark.limit(0)).count() == len(docs)
    assert decontamination.leaks(frame.limit(0), benchmark).count() == 0


def test_spans_and_distances(spark):
    benchmark = spark.createDataFrame([(1, "a1 b1 c1 d1 e1 f1 g1 h1 i1 j1")], "item_id long, text string")
    docs = [(1, "x y a1 b1 c1 d1 e1 f1 g1 h1 i1 j1 z"), (2, "x a1 b1 zz d1 e1 f1 g1 h1 j1")]
    found = decontamination.leaks(cases.frame(spark, docs), benchmark).collect()
    assert sorted(tuple(r) for r in found) == [(1, 1, 2, 12, 0), (2, 1, 1, 10, 2)]
