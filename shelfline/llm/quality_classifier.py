"""A quality classifier: naive Bayes features under a linear support vector
machine.

A text is the set of its n-grams, each a hashed indicator: runs of four bytes,
and runs of one to three words by shape (letters and digits folded, so that
`Was` and `The` look alike) together with whether a word repeats the one
before. The indicator of a feature is scaled by its log-count ratio between
the two classes, counted over all labelled rows; the scaled vector has unit
length. A hinge-loss linear model is fitted to a bounded sample of the
labelled rows by dual coordinate descent, and a logistic curve turns its
margin into a score.

Nothing but the text enters a score. Model and ratios have a fixed size
(`FEATURES`), whatever the corpus.

Defined cases: a null or empty text has no features and gets the score of the
bare intercept; labels that are null, or whose document is missing, are left
out of training, and rows that repeat a label or a document count as often as
they stand; with labels of one class only, or none, every score is the share
of class 1 (0.5 without labels). A null `doc_id` is scored, is held out of
training and has a null `held_out`. Only the named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.llm.text import REMEMBERED_WORDS, shuffle_width, small, stored, texts

HALF = 1 << 16
FEATURES = 2 * HALF
SAMPLE_ROWS = 8192
FOLDS, HELD_FOLD = 4, 2
CUT = 0.7
CHUNKS = 64

SHAPES = bytes(65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c >= 128 else 48 if 48 <= c <= 57 else c for c in range(256))
SPREAD = np.uint64(0x9E3779B97F4A7C15)


class _Shapes(dict):
    """A word's shape (upper half) and identity (lower half) as one number."""

    def __missing__(self, word: bytes) -> int:
        folded = word.translate(SHAPES)
        shape = bytes(c for i, c in enumerate(folded) if not i or c != folded[i - 1])
        if len(self) >= REMEMBERED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh32_intdigest(shape) << 32 | xxhash.xxh32_intdigest(word)
        return value


def features(text: bytes | None, shapes: _Shapes) -> np.ndarray:
    """Sorted indices of the features a text has."""
    present = np.zeros(FEATURES, bool)
    raw = np.frombuffer(text or b"", np.uint8).astype(np.uint32)
    if len(raw) > 3:
        grams = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
        present[HALF + ((grams * np.uint32(2654435761)) >> np.uint32(16))] = True
    words = (text or b"").split()
    codes = np.fromiter(map(shapes.__getitem__, words), np.uint64, len(words))
    shape = codes >> np.uint64(32)
    pairs = (shape[:-1] * np.uint64(31) + shape[1:] + np.uint64(7)) * np.uint64(2) + (codes[1:] == codes[:-1])
    triples = pairs[:-1] * np.uint64(1000003) + pairs[1:]
    for grams in (shape, pairs, triples):
        present[(grams * SPREAD) >> np.uint64(48)] = True
    return np.flatnonzero(present).astype(np.int32)


@dataclass
class Model:
    ratios: np.ndarray
    weights: np.ndarray
    intercept: float
    slope: float
    shift: float

    def score(self, present: np.ndarray) -> float:
        values = self.ratios[present]
        norm = np.sqrt((values * values).sum()) or 1.0
        margin = float(values @ self.weights[present]) / norm + self.intercept
        return float(1 / (1 + np.exp(-(self.slope * margin + self.shift))))


def _class_counts(labelled: DataFrame) -> DataFrame:
    """Documents of each class per feature: `chunk` of the feature space,
    packed counts of both classes and numbers of documents.

    Every task counts its own rows; the counts are added in two rounds of about
    the square root of the number of tasks each.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes, counts, docs, salt = _Shapes(), np.zeros((2, FEATURES), np.int64), np.zeros(2, np.int64), 0
        for batch in small(batches):
            for text, label, salt in zip(texts(batch), batch.column("label").to_pylist(), batch.column("salt").to_pylist()):
                counts[label, features(text, shapes)] += 1
                docs[label] += 1
        if docs.sum():
            parts = [p.tobytes() for p in np.split(counts.astype(np.int32), CHUNKS, axis=1)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(CHUNKS), pa.int32()), pa.array([salt] * CHUNKS, pa.int32()), pa.array(parts), pa.array([docs.tobytes()] * CHUNKS)],
                ["chunk", "salt", "counts", "docs"],
            )

    def add(table: pa.Table, first: bool) -> pa.Table:
        kind = np.int32 if first else np.int64
        total = sum(np.frombuffer(part.as_py(), kind).astype(np.int64) for part in table.column("counts"))
        docs = sum(np.frombuffer(part.as_py(), np.int64) for part in table.column("docs"))
        keys = [table.column(name).slice(0, 1) for name in ("chunk", "salt")]
        return pa.table([*keys, pa.array([total.tobytes()]), pa.array([docs.tobytes()])], names=["chunk", "salt", "counts", "docs"])

    schema = "chunk int, salt int, counts binary, docs binary"
    salts = math.isqrt(shuffle_width(labelled.sparkSession)) + 1
    salted = labelled.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)).cast("int"))
    parts = salted.select("text", "label", "salt").mapInArrow(count, schema)
    some = parts.groupBy("chunk", "salt").applyInArrow(lambda table: add(table, True), schema)
    return some.groupBy("chunk").applyInArrow(lambda table: add(table, False), schema)


def _packed_features(labelled: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = _Shapes()
        for batch in small(batches):
            packed = pa.array([features(text, shapes).tobytes() for text in texts(batch)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("rank"), packed], ["label", "rank", "present"])

    return labelled.select("text", "label", "rank").mapInArrow(run, "label int, rank long, present binary")


def descend(rows: list[np.ndarray], signs: np.ndarray, ratios: np.ndarray, rounds: int = 12, bound: float = 10.0) -> Model:
    """Dual coordinate descent on the hinge loss; an extra constant feature
    is the intercept. The scores' logistic curve is fitted to the margins."""
    scaled = []
    for present in rows:
        values = ratios[present]
        scaled.append(values / (np.sqrt((values * values).sum()) or 1.0))
    weights, intercept = np.zeros(FEATURES), 0.0
    duals = np.zeros(len(rows))
    rng = np.random.default_rng(5)
    squares = np.array([values @ values for values in scaled]) + 1.0
    for _ in range(rounds):
        for i in rng.permutation(len(rows)):
            slack = signs[i] * (scaled[i] @ weights[rows[i]] + intercept) - 1
            dual = min(max(duals[i] - slack / squares[i], 0.0), bound)
            step = (dual - duals[i]) * signs[i]
            if step:
                duals[i] = dual
                weights[rows[i]] += step * scaled[i]
                intercept += step
    margins = np.array([values @ weights[present] for values, present in zip(scaled, rows)]) + intercept
    slope, shift, truth = 1.0, 0.0, signs > 0
    for _ in range(500):
        off = 1 / (1 + np.exp(-(slope * margins + shift))) - truth
        slope, shift = slope - 2 * (off * margins).mean(), shift - 2 * off.mean()
    return Model(ratios, weights, intercept, slope, shift)


def _fitted_in_a_task(sample: DataFrame, ratios: np.ndarray) -> Model:
    """The sample has at most `SAMPLE_ROWS` rows, so one task can hold it."""

    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by("rank")
        rows = [np.frombuffer(p.as_py(), np.int32) for p in table.column("present")]
        signs = np.where(np.array(table.column("label").to_pylist()) > 0, 1.0, -1.0)
        model = descend(rows, signs, ratios)
        numbers = np.array([model.intercept, model.slope, model.shift])
        return pa.table({"weights": [model.weights.tobytes()], "numbers": [numbers.tobytes()]})

    found = sample.withColumn("one", F.lit(1)).groupBy("one").applyInArrow(fit, "weights binary, numbers binary").first()
    return Model(ratios, np.frombuffer(found.weights), *np.frombuffer(found.numbers))


def train(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model from rows of (doc_id, text, label), label 0 or 1."""
    counts, docs = np.zeros((2, FEATURES)), np.zeros(2)
    width = FEATURES // CHUNKS
    for row in _class_counts(labelled).collect():  # CHUNKS rows of a fixed size
        at = row.chunk * width
        counts[:, at : at + width] = np.frombuffer(row.counts, np.int64).reshape(2, width)
        docs = np.frombuffer(row.docs, np.int64).astype(float)
    if not docs.all():
        share = docs[1] / docs.sum() if docs.sum() else 0.5
        odds = np.clip(share, 1e-9, 1 - 1e-9)
        return Model(np.zeros(FEATURES), np.zeros(FEATURES), 0.0, 0.0, float(np.log(odds / (1 - odds))))
    ratios = np.log((counts[1] + 1) / (docs[1] + 2)) - np.log((counts[0] + 1) / (docs[0] + 2))
    # Ids are drawn first, by hash; only then do the drawn texts move.
    drawn = labelled.select("doc_id", "label").withColumn("rank", F.xxhash64("doc_id", F.lit(17))).orderBy("rank", "label").limit(sample_rows)
    sample = labelled.join(F.broadcast(drawn.select("doc_id", "rank").distinct()), "doc_id")
    return _fitted_in_a_task(_packed_features(sample.dropDuplicates(["doc_id", "label"])), ratios)


def scored(documents: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """`documents` with a column of scores; no shuffle."""
    broadcast = documents.sparkSession.sparkContext.broadcast(model)
    kept = documents.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes, fitted = _Shapes(), broadcast.value
        for batch in small(batches):
            scores = pa.array([fitted.score(features(text, shapes)) for text in texts(batch)], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], [*kept, column])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema)
    return documents.mapInArrow(run, f"{schema}, `{column}` double")


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % FOLDS


def labelled_texts(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, label of every labelled row outside the held-out fold."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
    marks = marks.where(F.col("label").isin(0, 1) & (fold(F.col("doc_id")) != HELD_FOLD))
    chosen = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # The texts are not sorted for this join; labels are the side that is held.
    return chosen.join(marks.hint("shuffle_hash"), "doc_id")


def quality_model(documents: DataFrame, labels: DataFrame) -> Model:
    return train(stored(labelled_texts(documents, labels), "labelled-texts"))


def quality(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    chosen = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = scored(chosen, quality_model(documents, labels))
    return rows.select("doc_id", (fold(F.col("doc_id")) == HELD_FOLD).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def accepted(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `documents` with a score of `CUT` or more, with their own
    columns."""
    column = "score"
    while column in {name.lower() for name in documents.columns}:
        column += "_"
    return scored(documents, quality_model(documents, labels), column).where(F.col(column) >= CUT).drop(column)
