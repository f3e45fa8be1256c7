"""Runs of repeating words in whole texts, by difference-cover extension queries.

A run is a stretch of consecutive words whose smallest period is `q`, at least
`max(12, 2q)` words long, that no neighbouring word extends with period `q`.

Every run of period `q` holds a pair of words `i`, `i + q` with `i` a multiple
of `q`; over all periods these pairs are a harmonic grid of `n ln n` places.
Pairs of equal words whose match reaches `REACH` words are extended as far as
they go in both directions. An extension query compares a few words until both
places fall on the difference cover; from there the common length is a range
minimum over the sorted cover suffixes. Only these are ever sorted, by names
of blocks whose length doubles, and only for texts that have such a pair.

Words are runs of anything but ASCII white space, compared whole. A null text
has no words. A null doc_id is carried along and repeated rows each get their
own row. Very long texts are whole; the grid is walked in blocks, so memory
grows with the text, not with its pairs. An empty table gives an empty result.
Only the named columns are read, so others may have any name. Rows depend on
nothing but their own text: there is no shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.llm.text import small, texts

LEAST_LENGTH = 12
# A run of period q repeats max(12 - q, q) words or more, so six at least.
REACH = 6
# A perfect difference set. Every distance modulo 13 is the
# distance of two members.
PERIOD = 13
COVER = (0, 1, 3, 9)
GRID_WORDS = 16_384


def _grid_block(first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (j - q, j) with j in [first, last) and q a divisor of j, by j."""
    periods, ends = [], []
    for factor in range(1, math.isqrt(max(last - 1, 0)) + 1):
        start = max(-(-first // factor), factor) * factor
        j = np.arange(start, last, factor, dtype=np.int32)
        other = j // factor
        periods += [np.full(len(j), factor, np.int32), other[other != factor]]
        ends += [j, j[other != factor]]
    q, j = (np.concatenate([np.empty(0, np.int32), *part]) for part in (periods, ends))
    order = np.argsort(j, kind="stable")
    return j[order] - q[order], j[order]


@cache
def _first_block() -> tuple[np.ndarray, np.ndarray]:
    return _grid_block(1, GRID_WORDS)


def grid(words: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The harmonic grid of a text in blocks."""
    i, j = _first_block()
    edge = np.searchsorted(j, words) if words < GRID_WORDS else len(j)
    yield i[:edge], j[:edge]
    for first in range(GRID_WORDS, words, GRID_WORDS):
        yield _grid_block(first, min(first + GRID_WORDS, words))


def _sync_table() -> np.ndarray:
    """Words to go until two places, given modulo PERIOD, are both covered."""
    table = np.empty((PERIOD, PERIOD), np.int64)
    for a in range(PERIOD):
        for b in range(PERIOD):
            table[a, b] = next(k for k in range(PERIOD) if (a + k) % PERIOD in COVER and (b + k) % PERIOD in COVER)
    return table


SYNC = _sync_table()


class Extensions:
    """How far two places of a text agree, from a difference cover sample."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        # Marks beyond the end differ from all words and from one another.
        self.words = np.concatenate((codes.astype(np.int32), -1 - np.arange(4 * PERIOD, dtype=np.int32)))
        places = np.arange(n + 2 * PERIOD)
        self.places = places[np.isin(places % PERIOD, COVER)]
        self.index = np.zeros(n + 2 * PERIOD, np.int64)
        self.index[self.places] = np.arange(len(self.places))
        ranks = self._sorted()
        self._range_minima(ranks)

    def _ahead(self, distance: int) -> np.ndarray:
        """Sample numbers of the places `distance` further on (beyond: 0)."""
        ahead = self.places + distance
        inside = ahead < len(self.index)
        return np.where(inside, self.index[np.where(inside, ahead, 0)], 0)

    def _sorted(self) -> list[np.ndarray]:
        """Names of blocks of PERIOD, twice, four times as many words, until
        all suffixes of the sample differ; the last names are their ranks."""
        blocks = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(self.words, PERIOD)[self.places])
        _, names = np.unique(blocks.view(np.dtype((np.void, blocks.itemsize * PERIOD))).ravel(), return_inverse=True)
        levels, count = [names.astype(np.int64)], len(names)
        distance = PERIOD
        while levels[-1].max() + 1 < count:
            names = levels[-1]
            _, names = np.unique(names * count + names[self._ahead(distance)], return_inverse=True)
            levels.append(names.astype(np.int64))
            distance *= 2
        return levels

    def _range_minima(self, levels: list[np.ndarray]) -> None:
        """Common lengths of neighbouring suffixes, and minima of 2^k of them."""
        self.rank = levels[-1]
        order = np.argsort(self.rank)
        a, b = self.places[order[:-1]], self.places[order[1:]]
        length = np.zeros(len(a), np.int64)
        for level in range(len(levels) - 2, -1, -1):
            names, step = levels[level], PERIOD << level
            ends = np.maximum(a, b) + length
            inside = ends < len(self.index)
            at = np.where(inside, length, 0)
            same = inside & (names[self.index[a + at]] == names[self.index[b + at]])
            length += step * same
        length += self._few(a + length, b + length, np.full(len(a), PERIOD))[0]
        self.minima = [length]
        width = 1
        while 2 * width <= len(length):
            last = self.minima[-1]
            self.minima.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def _few(self, a: np.ndarray, b: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words that agree among the first `count`, and whether all do."""
        agreed = np.zeros(len(a), np.int64)
        alive = np.flatnonzero(count > 0)
        while len(alive):
            same = self.words[a[alive] + agreed[alive]] == self.words[b[alive] + agreed[alive]]
            alive = alive[same]
            agreed[alive] += 1
            alive = alive[agreed[alive] < count[alive]]
        return agreed, agreed == count

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common length of the words from `a` on and from `b` on, a <> b."""
        length, reached = self._few(a, b, SYNC[a % PERIOD, b % PERIOD])
        on = np.flatnonzero(reached)
        if not len(on):
            return length
        left, right = (self.rank[self.index[side[on] + length[on]]] for side in (a, b))
        left, right = np.minimum(left, right), np.maximum(left, right)
        level = np.frexp((right - left).astype(float))[1] - 1
        for k in np.unique(level):
            here = level == k
            minima = self.minima[k]
            length[on[here]] += np.minimum(minima[left[here]], minima[right[here] - (1 << int(k))])
        return length


def _reaching(padded: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs of equal words have REACH agreeing words around them.
    `padded` has REACH differing marks on either side of the words."""
    agreeing = np.ones(len(i), np.int64)
    for step in (1, -1):
        alive = np.arange(len(i))
        for k in range(1, REACH):
            same = padded[i[alive] + REACH + step * k] == padded[j[alive] + REACH + step * k]
            alive = alive[same]
            agreeing[alive] += 1
    return agreeing >= REACH


def runs_of(words: list) -> np.ndarray:
    """Rows (start, length, period) of all runs, by start, then period."""
    n = len(words)
    names = {word: code for code, word in enumerate(dict.fromkeys(words))}
    if n < LEAST_LENGTH or len(names) == n:
        return np.empty((0, 3), np.int64)
    codes = np.fromiter(map(names.__getitem__, words), np.int32, n)
    marks = -1 - np.arange(2 * REACH, dtype=np.int32)
    padded = np.concatenate((marks[:REACH], codes, marks[REACH:]))
    forward = backward = None
    found = [np.empty((0, 3), np.int64)]
    for i, j in grid(n):
        equal = np.flatnonzero(codes[i] == codes[j])
        i, j = i[equal].astype(np.int64), j[equal].astype(np.int64)
        far = _reaching(padded, i, j)
        if not far.any():
            continue
        if forward is None:
            forward, backward = Extensions(codes), Extensions(codes[::-1])
        i, j = i[far], j[far]
        start, end = i - backward.of(n - i, n - j), j + forward.of(i, j)
        period = j - i
        whole = end - start >= np.maximum(LEAST_LENGTH, 2 * period)
        found.append(np.unique(np.stack((start, end, period), 1)[whole], axis=0))
    rows = np.unique(np.concatenate(found), axis=0)
    # One stretch found with several periods: the others are multiples of the least.
    least = np.ones(len(rows), bool)
    least[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    rows = rows[least]
    rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
    return np.stack((rows[:, 0], rows[:, 1] - rows[:, 0], rows[:, 2]), 1)


def kept_of(words: list, runs: np.ndarray) -> list:
    """The words without those that a run holds after its first period."""
    if not len(runs):
        return words
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
    return [words[place] for place in np.flatnonzero(np.cumsum(depth[:-1]) == 0)]


RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def periodic_runs(documents: DataFrame) -> DataFrame:
    """doc_id, n_words, `runs` by start and period, and `collapsed`, the text's
    words joined by one space with every run cut to its first period."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            counts, sizes, parts, collapsed = [], [0], [], []
            for text in texts(batch):
                words = (text or b"").split()
                rows = runs_of(words)
                counts.append(len(words))
                sizes.append(sizes[-1] + len(rows))
                parts.append(rows)
                collapsed.append(b" ".join(kept_of(words, rows)).decode())
            rows = np.concatenate([np.empty((0, 3), np.int64), *parts])
            structs = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(column)) for column in rows.T], fields=list(_RUN))
            lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), structs)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), lists, pa.array(collapsed, pa.string())],
                ["doc_id", "n_words", "runs", "collapsed"],
            )

    chosen = documents.select(F.col("doc_id").cast("long"), "text")
    return chosen.mapInArrow(run, f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def longest(found: DataFrame) -> DataFrame:
    """Adds `longest`: the longest run; of equal ones the first, then the one
    of least period. Null without a run."""
    ranked = F.transform("runs", lambda run: F.struct((-run["length"]).alias("order"), run["start"].alias("start"), run["period"].alias("period"), run["length"].alias("length")))
    return found.withColumn("longest", F.array_min(ranked))


def digested(found: DataFrame) -> DataFrame:
    """Per document the number of runs, the longest one and digests of all
    runs and of the collapsed text."""
    line = lambda run: F.concat(run["start"], F.lit(","), run["length"], F.lit(","), run["period"], F.lit("\n"))
    best = F.col("longest")
    return longest(found).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.expr("1000 * longest.length DIV longest.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
