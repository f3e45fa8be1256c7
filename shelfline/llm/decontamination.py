"""Benchmark passages inside documents, exact or edited.

A passage leaks an item of `n` words when some stretch of the document is
within `floor(edits * n)` word edits of it (insert, delete, replace). Words
are runs of a-z, 0-9 and characters beyond ASCII after lower-casing A-Z.

The edit distance is taken to Hamming distance by the random walk of
Chakraborty, Goldenberg and Koucky: a pointer walks over the words and stays
or steps by a random bit of (step, word), so that two texts with few edits
soon walk together again. Walks are repeated, and of each a few places are
sampled; an item-sized window of a document and an item are candidates when
one walk agrees in all its sampled places. The number of walks is set by the
target recall. Candidates are verified by exact edit distance.

Windows are only set where the item can be: a passage within the edit limit
shares at least `n - q + 1 - q * limit` word q-grams with the item, on
diagonals no further apart than the limit, so places with fewer are left out
without loss.

Items are held in every task in blocks of bounded size (`BLOCK_BYTES`). With
more items the documents' texts are read once per block, one block after the
other: what a block finds is written under the digest of the text, and the
documents meet these few digests at the end.

Defined cases: null and empty texts leak nothing, and neither do items without
words; rows without doc_id or that repeat one are judged each; items that
share an item_id are one item with several texts. Other columns are carried
along unread.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.llm.text import TO_WORDS, mixed, small, stored, texts

EDITS = 0.2
SAMPLED = 3
AGREEMENT = 0.6
RECALL = 0.99
BLOCK_BYTES = 16_000_000


def walks(recall: float = RECALL, agreement: float = AGREEMENT, sampled: int = SAMPLED) -> int:
    """Walks needed when two walks agree in a place with chance `agreement`."""
    return math.ceil(math.log(1 - recall) / math.log(1 - agreement**sampled))


def embedded(words: np.ndarray, size: int, count: int) -> np.ndarray:
    """`count` random walks over word numbers: an array of `count` rows and
    3 * `size` places; past the end stands 0."""
    padded = np.append(words.astype(np.uint64), np.uint64(0))
    at = np.zeros(count, np.int64)
    seeds = np.arange(1, count + 1, dtype=np.uint64) << np.uint64(40)
    out = np.empty((count, 3 * size), np.uint64)
    last = len(words)
    for step in range(3 * size):
        found = padded[at]
        out[:, step] = found
        move = mixed(seeds + (np.uint64(step) << np.uint64(24)) + found) & np.uint64(1)
        at = np.minimum(at + move.astype(np.int64), last)
    return out


def sampled_places(size: int, count: int, sampled: int = SAMPLED) -> np.ndarray:
    return np.random.default_rng(size).integers(0, 3 * size, (count, sampled))


def fit_distance(item: np.ndarray, window: np.ndarray) -> tuple[int, int]:
    """Least edits between the item and any stretch of the window, and the
    first end of such a stretch."""
    places = np.arange(len(window) + 1)
    row = np.zeros(len(window) + 1, np.int64)
    for number, word in enumerate(item, 1):
        best = np.minimum(row[:-1] + (window != word), row[1:] + 1)
        row = np.minimum.accumulate(np.append(number, best) - places) + places
    end = int(row.argmin())
    return int(row[end]), end


class Item:
    def __init__(self, item_id: int, words: np.ndarray, edits: float, count: int):
        self.item_id, self.words, self.size = item_id, words, len(words)
        self.limit = int(edits * self.size + 1e-9)
        self.gram = next((q for q in (3, 2) if self.size - q + 1 - q * self.limit > 0), 1)
        self.shared = self.size - self.gram + 1 - self.gram * self.limit
        self.places = sampled_places(self.size, count)
        self.samples = self._sample(words, count)

    def _sample(self, words: np.ndarray, count: int) -> np.ndarray:
        return np.take_along_axis(embedded(words, self.size, count), self.places, axis=1)

    def near(self, window: np.ndarray) -> bool:
        """Whether some walk over the window agrees with the item's."""
        return bool((self._sample(window, len(self.places)) == self.samples).all(axis=1).any())


class Index:
    """Items of one block, ready to be looked for."""

    def __init__(self, items: list[tuple[int, str]], edits: float, count: int):
        self.numbers: dict[bytes, int] = {}
        self.items = []
        for item_id, text in items:
            words = (text or "").encode().translate(TO_WORDS).split()
            found = [self.numbers.setdefault(word, len(self.numbers) + 1) for word in words]
            if found:
                self.items.append(Item(item_id, np.array(found, np.int64), edits, count))
        self.base = np.int64(len(self.numbers) + 1)
        self.grams: dict[int, tuple[np.ndarray, list[list[tuple[int, int]]]]] = {}
        for size in {item.gram for item in self.items}:
            places = defaultdict(list)
            for number, item in enumerate(self.items):
                if item.gram == size:
                    for offset, code in enumerate(self._codes(item.words, size)):
                        places[int(code)].append((number, offset))
            codes = sorted(places)
            self.grams[size] = (np.array(codes, np.int64), [places[code] for code in codes])

    def _codes(self, words: np.ndarray, size: int) -> np.ndarray:
        count = max(0, len(words) - size + 1)
        code = np.zeros(count, np.int64)
        for offset in range(size):
            code = code * self.base + words[offset : offset + count]
        return code

    def leaks(self, text: bytes | None) -> dict[int, tuple[int, int, int]]:
        """item_id: (distance, start, end) of the nearest stretch."""
        get = self.numbers.get
        listed = (text or b"").translate(TO_WORDS).split()
        words = np.fromiter((get(word, 0) for word in listed), np.int64, len(listed))
        hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for size, (codes, places) in self.grams.items():
            found = self._codes(words, size)
            at = np.searchsorted(codes, found)
            at[at == len(codes)] = 0
            for position in np.flatnonzero(codes[at] == found).tolist():
                for number, offset in places[at[position]]:
                    hits[number].append((position - offset, offset))
        result: dict[int, tuple[int, int, int]] = {}
        for number, pairs in hits.items():
            item = self.items[number]
            if len(pairs) < item.shared:
                continue
            for start in self._starts(item, pairs):
                begin = max(0, start)
                if not item.near(words[begin : begin + item.size]):
                    continue
                found = self._verified(item, words, begin)
                if found and found < result.get(item.item_id, (math.inf,)):
                    result[item.item_id] = found
        return result

    @staticmethod
    def _starts(item: Item, pairs: list[tuple[int, int]]) -> list[int]:
        """Diagonals that lie in a band with enough shared grams."""
        pairs = sorted(set(pairs))
        diagonals = np.array([d for d, _ in pairs])
        ends = np.searchsorted(diagonals, diagonals + item.limit, side="right")
        starts: set[int] = set()
        for first, end in enumerate(ends.tolist()):
            if end - first >= item.shared and len({o for _, o in pairs[first:end]}) >= item.shared:
                starts.update(diagonals[first:end].tolist())
        return sorted(starts)

    @staticmethod
    def _verified(item: Item, words: np.ndarray, start: int) -> tuple[int, int, int] | None:
        low = max(0, start - item.limit)
        window = words[low : start + item.size + item.limit]
        distance, end = fit_distance(item.words, window)
        if distance > item.limit:
            return None
        _, length = fit_distance(item.words[::-1], window[:end][::-1])
        return distance, low + end - length, low + end


LEAK = pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("distance", pa.int64())])


def _scanned(documents: DataFrame, items: list[tuple[int, str]], edits: float, count: int, column: str) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast(items)
    kept = documents.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(shared.value, edits, count)
        for batch in small(batches):
            found = [
                [{"item_id": item, "start": a, "end": b, "distance": d} for item, (d, a, b) in sorted(index.leaks(text).items())]
                for text in texts(batch)
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(LEAK))], [*kept, column])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema)
    return documents.mapInArrow(run, f"{schema}, `{column}` array<struct<item_id:long,start:long,end:long,distance:long>>")


def _free(name: str, documents: DataFrame) -> str:
    while name.lower() in {taken.lower() for taken in documents.columns}:
        name += "_"
    return name


def with_leaks(documents: DataFrame, benchmark: DataFrame, column: str, edits: float = EDITS, recall: float = RECALL) -> DataFrame:
    """`documents` with an array column of the items each one leaks: item_id,
    first and one past the last word of the nearest stretch, its distance."""
    texts_of = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL AND item_id IS NOT NULL")
    size = texts_of.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // BLOCK_BYTES))

    def items(block: int) -> list[tuple[int, str]]:
        mine = texts_of.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        return sorted((row.item_id, row.text) for row in mine.collect())  # at most about BLOCK_BYTES

    if blocks == 1:
        return _scanned(documents, items(0), edits, walks(recall), column)
    found = None
    for block in range(blocks):
        scanned = _scanned(documents.select("text"), items(block), edits, walks(recall), "leaks").where(F.size("leaks") > 0)
        mine = stored(scanned.select(F.sha2("text", 256).alias("digest"), F.inline("leaks")).distinct(), "leaks")
        found = mine if found is None else found.union(mine)
    # Texts of one item may stand in several blocks; the nearest counts.
    nearest = found.groupBy("digest", "item_id").agg(F.min(F.struct("distance", "start", "end")).alias("to"))
    leak = F.struct("item_id", "to.start", "to.end", "to.distance")
    key = _free("digest", documents)
    lists = nearest.groupBy(F.col("digest").alias(key)).agg(F.array_sort(F.collect_list(leak)).alias(column))
    none = F.lit([]).cast("array<struct<item_id:long,start:long,end:long,distance:long>>")
    joined = documents.withColumn(key, F.sha2("text", 256)).join(lists, key, "left")
    return joined.select(*documents.columns, F.coalesce(column, none).alias(column))


def leaks(documents: DataFrame, benchmark: DataFrame, edits: float = EDITS, recall: float = RECALL) -> DataFrame:
    """doc_id, item_id, start, end, distance: one row per document and item."""
    chosen = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = with_leaks(chosen, benchmark, "leak", edits, recall)
    return found.select("doc_id", F.explode("leak").alias("leak")).select("doc_id", "leak.*")


def without_leaks(documents: DataFrame, benchmark: DataFrame, edits: float = EDITS, recall: float = RECALL) -> DataFrame:
    """The rows of `documents` that leak no item, with their own columns."""
    column = _free("leaks", documents)
    found = with_leaks(documents, benchmark, column, edits, recall)
    return found.where(F.size(column) == 0).drop(column)
