"""Words and their hashes, and rows packed by hash bucket for a shuffle."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from shelfline.session import discard_at_exit, fresh_path

LOWER_ASCII = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
# Lower-cases A-Z and turns every other ASCII character outside a-z, 0-9 into a space.
TO_WORDS = bytes(
    c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256)
)
REMEMBERED_WORDS = 200_000
FLUSH_ENTRIES = 1_000_000
SLICE_ROWS = 512


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes | None]:
    """UTF-8 bytes of a string column; splitting bytes splits at ASCII white space only."""
    return batch.column(column).cast(pa.binary()).to_pylist()


def give_back() -> None:
    """Return freed memory to the system: a Python worker lives on from task to
    task, and from one operator to the next."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def small(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that a task holds few rows as Python objects."""
    give_back()
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)
    give_back()


class WordHashes(dict):
    """The 64-bit hash of a word, kept for the words seen lately."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values, so that every bit depends on all."""
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    values = (values ^ (values >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return values ^ (values >> np.uint64(32))


def multipliers(count: int, seed: int) -> np.ndarray:
    """`count` odd 64-bit numbers, the same in every task."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def gram_hashes(words: np.ndarray, size: int, seed: int = 1) -> np.ndarray:
    """Hashes of all runs of `size` consecutive word hashes."""
    count = len(words) - size + 1
    if count < 1:
        return np.empty(0, np.uint64)
    total = np.zeros(count, np.uint64)
    for offset, factor in enumerate(multipliers(size, seed)):
        total += words[offset : offset + count] * factor
    return mixed(total)


def planes(array: np.ndarray) -> bytes:
    """An array byte by byte of significance: the high bytes of small numbers
    become a run of zeros, which the shuffle's codec takes out."""
    return np.ascontiguousarray(array).view(np.uint8).reshape(-1, array.itemsize).T.tobytes()


def from_planes(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(data, np.uint8).reshape(size, -1).T.copy().view(kind).reshape(-1)


class Packed:
    """Parallel arrays dealt into hash buckets: few rows carry many entries.

    One row of a bucket holds one binary column per array. `add` collects, and
    `rows` gives a batch of rows once `FLUSH_ENTRIES` entries are held (or at
    the end), so a task's memory does not grow with its input.
    """

    def __init__(self, names: list[str], buckets: int):
        self.names, self.buckets = names, buckets
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def add(self, *arrays: np.ndarray) -> None:
        if len(arrays[0]):
            self.parts.append(arrays)
            self.held += len(arrays[0])

    @property
    def full(self) -> bool:
        return self.held >= FLUSH_ENTRIES

    def arrays(self) -> list[np.ndarray]:
        joined = [np.concatenate(column) for column in zip(*self.parts)]
        self.parts, self.held = [], 0
        return joined

    def rows(self, arrays: list[np.ndarray] | None = None, key: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        """The held arrays (or those given) as rows. The bucket is taken from
        the hashes in `key`, or else in the first array; within a bucket the
        order of the entries stays."""
        if arrays is None:
            if not self.held:
                return
            arrays = self.arrays()
        key = arrays[0] if key is None else key
        bucket = (key >> np.uint64(33)).astype(np.int64) % self.buckets
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        arrays = [array[order] for array in arrays]
        filled = np.flatnonzero(np.diff(edges))
        columns = [pa.array(filled.astype(np.int32))]
        for array in arrays:
            columns.append(pa.array([planes(array[edges[b] : edges[b + 1]]) for b in filled], pa.binary()))
        yield pa.RecordBatch.from_arrays(columns, ["bucket", *self.names])


def packed_schema(names: list[str]) -> str:
    return ", ".join(["bucket int", *(f"{name} binary" for name in names)])


def unpacked(table: pa.Table, **kinds: type) -> list[np.ndarray]:
    """The arrays of all rows of a bucket, put together."""
    return [
        np.concatenate([np.empty(0, kind), *(from_planes(row, kind) for row in table.column(name).to_pylist())]) for name, kind in kinds.items()
    ]


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def runs(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[tuple[object, list[dict]]]:
    """Rows with equal neighbouring keys, over rows sorted by `key`."""
    current, held = None, []
    for batch in small(batches):
        for row in batch.to_pylist():
            if held and row[key] != current:
                yield current, held
                held = []
            current = row[key]
            held.append(row)
    if held:
        yield current, held


def stored(df: DataFrame, label: str, **options: str) -> DataFrame:
    """`df` written to the shared folder and read back: the lineage ends here.
    The folder is deleted when the application ends."""
    path = fresh_path(df.sparkSession, label)
    df.write.options(**options).parquet(path)
    discard_at_exit(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
