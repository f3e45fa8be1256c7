"""Remove repeated word passages: seed with winnowed anchors, then extend.

Of any `window` consecutive words, the least hash among their short runs
(grams) is an anchor, which the words alone decide; so two equal windows have
the same anchor. Documents are first joined on anchors: one that stands in a
single place cannot be part of a repeat, and most do. Around each remaining
seed the match is then extended both ways: every window that the seed anchors
is compared, by a 96-bit hash of its words, with the earliest window of the
same words. Windows with an earlier twin that touch or overlap make a maximal
repeat; its words are removed.

Both joins count within a task before the shuffle. A passage that stands in a
third of all documents sends one entry per task, not one per document.

Results: words are runs of anything but ASCII white space. "Earlier" is a
smaller doc_id, or the same document and an earlier start. A null or empty
text has no words. A row without doc_id has no place in the order: it is
returned whole and never counts as an earlier place. Rows that repeat a doc_id
are ordered by a hash of their text; equal rows are the same place and get the
same answer. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.llm.text import Packed, WordHashes, gram_hashes, mixed, packed_schema, planes, shuffle_width, small, texts, unpacked

WINDOW = 20
GRAM = 6
KEYS = ["doc_id", "text_hash"]
ANCHOR = ["anchor", "places", "doc", "hash"]
PLACE = ["low", "high", "doc", "hash", "start"]
OWNED = ["value", "doc", "hash"]


def _sliding(values: np.ndarray, size: int, least: bool) -> np.ndarray:
    """Minimum (or maximum) of every run of `size` neighbours."""
    best = np.minimum if least else np.maximum
    width = 1
    while 2 * width <= size:
        values = best(values[:-width], values[width:])
        width *= 2
    rest = size - width
    return best(values[:-rest], values[rest:]) if rest else values


def window_anchors(words: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """The anchor of each window, and the anchor of each place that is one."""
    grams = gram_hashes(words, gram, seed=41)
    span = window - gram + 1
    if len(grams) < span:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    anchors = _sliding(grams, span, least=True)
    padded = np.concatenate((np.zeros(span - 1, np.uint64), anchors, np.zeros(span - 1, np.uint64)))
    return anchors, grams[_sliding(padded, span, least=False) == grams]


def _starts(order: np.ndarray, *columns: np.ndarray) -> np.ndarray:
    """Where a new value begins among the sorted columns."""
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([c[order[1:]] != c[order[:-1]] for c in columns], axis=0)
    return new


def _to_owners(values: np.ndarray, docs: np.ndarray, hashes: np.ndarray, buckets: int) -> pa.Table:
    """Values dealt into buckets of the documents they belong to, in order."""
    order = np.lexsort((values, hashes, docs))
    values, docs, hashes = values[order], docs[order], hashes[order]
    owners = mixed(docs.view(np.uint64) ^ hashes.astype(np.int64).view(np.uint64))
    batches = list(Packed(OWNED, buckets).rows([values, docs, hashes], owners)) if len(docs) else []
    return pa.Table.from_batches(batches, OWNED_SCHEMA)


OWNED_SCHEMA = pa.schema([("bucket", pa.int32()), *((name, pa.binary()) for name in OWNED)])


def _per_document(dealt: DataFrame, kind: type, name: str) -> DataFrame:
    """One row per document with all its values packed."""

    def gather(table: pa.Table) -> pa.Table:
        values, docs, hashes = unpacked(table, value=kind, doc=np.int64, hash=np.int32)
        order = np.lexsort((values, hashes, docs))
        firsts = np.flatnonzero(_starts(order, docs, hashes))
        edges = np.append(firsts, len(order))
        values = values[order]
        packed = [values[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:])]
        return pa.table({"doc_id": docs[order[firsts]], "text_hash": hashes[order[firsts]], name: pa.array(packed, pa.binary())})

    return dealt.groupBy("bucket").applyInArrow(gather, f"doc_id long, text_hash int, {name} binary")


class _Dealt(Packed):
    """Packed rows of which some are already decided and only pass through
    buckets of their own, chosen by task so that they spread."""

    def decided(self, **arrays: np.ndarray) -> Iterator[pa.RecordBatch]:
        """One row of the arrays that still matter; the others stay empty."""
        docs = arrays["doc"]
        if len(docs):
            bucket = self.buckets + int(docs[0] * 31 + len(docs)) % self.buckets
            packed = [planes(arrays[name]) if name in arrays else b"" for name in self.names]
            columns = [pa.array([bucket], pa.int32()), *(pa.array([a], pa.binary()) for a in packed)]
            yield pa.RecordBatch.from_arrays(columns, ["bucket", *self.names])


def _seeds(documents: DataFrame, buckets: int, window: int, gram: int) -> DataFrame:
    """Per document the anchors it has that stand in two places or more."""

    def flushed(packed: _Dealt) -> Iterator[pa.RecordBatch]:
        anchors, docs, hashes = packed.arrays()
        order = np.argsort(anchors, kind="stable")
        new = _starts(order, anchors)
        group = np.cumsum(new) - 1
        count = np.bincount(group)
        anchors, docs, hashes = anchors[order], docs[order], hashes[order]
        several = count[group] > 1
        # One entry of each anchor goes on; one seen twice here speaks for all.
        yield from packed.rows([anchors[new], np.minimum(count, 2).astype(np.uint8), docs[new], hashes[new]])
        yield from packed.decided(anchor=anchors[several], doc=docs[several], hash=hashes[several])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, packed = WordHashes(), _Dealt(ANCHOR, buckets)
        for batch in small(batches):
            for doc, mark, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch)):
                if not text:
                    continue
                places, times = np.unique(window_anchors(cache.of(text.split()), window, gram)[1], return_counts=True)
                places = np.concatenate((places, places[times > 1]))
                packed.add(places, np.full(len(places), doc, np.int64), np.full(len(places), mark, np.int32))
                if packed.full:
                    yield from flushed(packed)
        if packed.held:
            yield from flushed(packed)

    def repeated(key: tuple, table: pa.Table) -> pa.Table:
        anchors, places, docs, hashes = unpacked(table, anchor=np.uint64, places=np.uint8, doc=np.int64, hash=np.int32)
        if key[0].as_py() < buckets:
            order = np.argsort(anchors, kind="stable")
            group = np.empty(len(order), np.int64)
            group[order] = np.cumsum(_starts(order, anchors)) - 1
            keep = (places == 1) & (np.bincount(group, places)[group] > 1)
            anchors, docs, hashes = anchors[keep], docs[keep], hashes[keep]
        return _to_owners(anchors, docs, hashes, buckets)

    found = documents.mapInArrow(find, packed_schema(ANCHOR)).groupBy("bucket")
    return _per_document(found.applyInArrow(repeated, packed_schema(OWNED)), np.uint64, "seeds")


def _repeats(seeded: DataFrame, buckets: int, window: int, gram: int) -> DataFrame:
    """Per document the starts of its windows that stand earlier too."""

    def flushed(packed: _Dealt) -> Iterator[pa.RecordBatch]:
        low, high, docs, hashes, starts = packed.arrays()
        first, later = _first_and_later(low, high, docs, hashes, starts)
        yield from packed.rows([low[first], high[first], docs[first], hashes[first], starts[first]])
        yield from packed.decided(doc=docs[later], hash=hashes[later], start=starts[later])

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, packed = WordHashes(), _Dealt(PLACE, buckets)
        for batch in small(batches):
            for doc, mark, text, seeds in zip(*(batch.column(i).to_pylist() for i in (0, 1)), texts(batch), batch.column("seeds").to_pylist()):
                words = cache.of(text.split())
                anchors = window_anchors(words, window, gram)[0]
                starts = np.flatnonzero(np.isin(anchors, np.frombuffer(seeds, np.uint64)))
                if not len(starts):
                    continue
                low, high = (gram_hashes(words, window, seed)[starts] for seed in (43, 47))
                marks = np.full(len(starts), mark, np.int32)
                packed.add(low, high.astype(np.uint32), np.full(len(starts), doc, np.int64), marks, starts.astype(np.int32))
                if packed.full:
                    yield from flushed(packed)
        if packed.held:
            yield from flushed(packed)

    def later(key: tuple, table: pa.Table) -> pa.Table:
        low, high, docs, hashes, starts = unpacked(table, low=np.uint64, high=np.uint32, doc=np.int64, hash=np.int32, start=np.int32)
        if key[0].as_py() < buckets:
            keep = _first_and_later(low, high, docs, hashes, starts)[1]
            docs, hashes, starts = docs[keep], hashes[keep], starts[keep]
        return _to_owners(starts, docs, hashes, buckets)

    found = seeded.mapInArrow(extend, packed_schema(PLACE)).groupBy("bucket")
    return _per_document(found.applyInArrow(later, packed_schema(OWNED)), np.int32, "repeats")


def _first_and_later(low: np.ndarray, high: np.ndarray, docs: np.ndarray, hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the earliest window of each content, and of those after it;
    both in the order given. Equal places count once."""
    order = np.lexsort((starts, hashes, docs, high, low))
    new = _starts(order, low, high)
    first = order[new]
    of = first[np.cumsum(new) - 1]
    after = order[(docs[order] != docs[of]) | (hashes[order] != hashes[of]) | (starts[order] != starts[of])]
    return np.sort(first), np.sort(after)


def _cut(rows: DataFrame, window: int) -> DataFrame:
    """Take the words of repeats out; `spans` are the maximal repeats."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            counts, removed, spans, kept = [], [], [], []
            for text, repeats in zip(texts(batch), batch.column("repeats").to_pylist()):
                words = (text or b"").split()
                counts.append(len(words))
                found = []
                if repeats:
                    starts = np.unique(np.frombuffer(repeats, np.int32)).astype(np.int64)
                    cuts = np.flatnonzero(np.diff(starts) > window)
                    begins = starts[np.append(0, cuts + 1)]
                    ends = starts[np.append(cuts, len(starts) - 1)] + window
                    found = list(zip(begins.tolist(), ends.tolist()))
                    for begin, end in reversed(found):
                        del words[begin:end]
                spans.append([{"start": a, "end": b} for a, b in found])
                removed.append(counts[-1] - len(words))
                kept.append(b" ".join(words).decode())
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, span), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "spans", "kept_text"])

    return rows.mapInArrow(run, "doc_id long, n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept_text string")


def without_repeats(documents: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed, spans of maximal repeats, kept_text."""
    buckets = shuffle_width(documents.sparkSession)
    key = F.col("doc_id").cast("long").alias("doc_id")
    # The hash only orders rows that repeat a doc_id; most tables have none.
    repeated = documents.select(key).where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1")
    # Zero, but no literal: a constant would be taken out of the layout below,
    # which then could not be shared.
    zero = F.coalesce((F.col("doc_id").cast("long") % 1).cast("int"), F.lit(0))
    tie = zero if repeated.isEmpty() else F.hash("text")
    chosen = documents.select(key, tie.alias("text_hash"), "text")
    # One shuffle of the texts serves all three looks at them.
    laid_out = chosen.where("doc_id IS NOT NULL").repartition(shuffle_width(documents.sparkSession), *KEYS)
    seeds = _seeds(laid_out, buckets, window, gram)
    seeded = laid_out.join(seeds.hint("shuffle_hash"), KEYS)
    repeats = _repeats(seeded.select(*KEYS, "text", "seeds"), buckets, window, gram)
    marked = laid_out.join(repeats.hint("shuffle_hash"), KEYS, "left")
    nowhere = chosen.where("doc_id IS NULL").withColumn("repeats", F.lit(None).cast("binary"))
    return _cut(marked.select(*KEYS, "text", "repeats").union(nowhere.select(*KEYS, "text", "repeats")), window)


def digested(rows: DataFrame) -> DataFrame:
    """`kept_text` replaced by its SHA-256."""
    return rows.withColumn("kept_sha256", F.sha2("kept_text", 256)).drop("kept_text")
