"""Best-fit packing of token sequences by a grouping genetic algorithm.

Every document becomes pieces of at most `capacity` tokens: only a longer one
is cut, into full pieces after a first one that may be shorter. A full piece
is a sequence of its own; the others are packed.

Pieces are dealt into blocks of bounded size. On each block several islands
breed solutions of their own: a child takes whole well-filled bins from one
parent, the other parent's bins that share a document with them are taken
apart, displaced documents take the places of smaller ones that leave more room
than they need, and what is displaced then is put where it fits best, largest
first. Islands are tasks of one shuffle; between epochs each gets the best
solution of its neighbour. Of the best island's solution the full bins stay,
and the documents of the others go on to the next round, in fewer blocks, until
one block holds all of them. Once a round settles less than a fifth (sizes of
which no full bin can be made), the better filled of a block's bins stay, too.
So the open bins of all blocks meet at the end, and no task's work grows with
the corpus.

Null and empty texts have only the end id. Rows with a null or repeated doc_id
are packed like any other. Only doc_id and text are read.
"""

from __future__ import annotations

import random
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.llm.text import small, stored
from shelfline.llm.tokens import encoder as worker_encoder

CAPACITY = 1024
BLOCK_ITEMS = 2048
ISLANDS = 2
EPOCHS = 2
POPULATION = 4
CHILDREN = 6
FULL = 0.995
OPEN_PART = 0.25  # of a block's bins, the worst filled, once few are full
PAIRED = 8  # items of a bin that are tried in pairs

Bins = list[list[int]]


class Filling:
    """Bins that can be asked for the tightest one with room for a size."""

    def __init__(self, sizes: list[int], capacity: int, bins: Bins):
        self.sizes, self.capacity, self.bins = sizes, capacity, bins
        self.with_room: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.rooms = 0
        for number, items in enumerate(bins):
            self._offer(number, capacity - sum(sizes[i] for i in items))

    def _offer(self, number: int, room: int) -> None:
        if room:
            self.with_room[room].append(number)
            self.rooms |= 1 << room

    def place(self, items: list[int]) -> Bins:
        """Best fit, largest first."""
        for item in sorted(items, key=self.sizes.__getitem__, reverse=True):
            size = self.sizes[item]
            fitting = self.rooms >> size
            if fitting:
                room = size + (fitting & -fitting).bit_length() - 1
                number = self.with_room[room].pop()
                if not self.with_room[room]:
                    self.rooms ^= 1 << room
                self.bins[number].append(item)
                self._offer(number, room - size)
            else:
                self.bins.append([item])
                self._offer(len(self.bins) - 1, self.capacity - size)
        return self.bins


def fitness(sizes: list[int], capacity: int, bins: Bins) -> tuple[int, float]:
    """Fewer bins are better, then uneven filling."""
    return -len(bins), sum((sum(sizes[i] for i in items) / capacity) ** 2 for items in bins)


def least_bins(sizes: list[int], capacity: int) -> int:
    """Bins that no packing can do without: for every `small`, items over half
    a bin need one each, and those from `small` to half a bin must fit beside
    the ones that leave room for `small`."""
    half = capacity // 2
    many = np.bincount(sizes, minlength=capacity + 1)
    number, total = np.cumsum(many), np.cumsum(many * np.arange(capacity + 1))
    small = np.arange(1, half + 1)
    over_half = number[capacity] - number[half]
    roomy = number[capacity - small] - number[half]
    free = roomy * capacity - (total[capacity - small] - total[half])
    short = np.maximum(0, total[half] - total[small - 1] - free)
    return int(over_half + np.max(-(-short // capacity), initial=0))


def exchanged(sizes: list[int], capacity: int, bins: Bins, displaced: list[int]) -> list[int]:
    """Displaced items put into `bins` in place of one or two smaller ones that
    leave a bin less filled; returns what is displaced then."""
    waiting = sorted((sizes[i], i) for i in displaced)
    for items in bins:
        room = capacity - sum(sizes[i] for i in items)
        if not room or not waiting:
            continue
        swaps = [(sizes[i], (i,)) for i in items] + [(sizes[i] + sizes[j], (i, j)) for i, j in combinations(items[:PAIRED], 2)]
        gain, at, given = 0, 0, ()
        for size, held in swaps:
            place = bisect_right(waiting, (size + room, len(sizes))) - 1
            if place >= 0 and waiting[place][0] - size > gain:
                gain, at, given = waiting[place][0] - size, place, held
        if gain:
            items.append(waiting.pop(at)[1])
            for item in given:
                items.remove(item)
                insort(waiting, (sizes[item], item))
    return [item for _, item in waiting]


def crossover(sizes: list[int], capacity: int, one: Bins, other: Bins, rng: random.Random) -> Bins:
    """`one` with well-filled bins of `other` put in whole."""
    filled = sorted(other, key=lambda items: -sum(sizes[i] for i in items))
    best = filled[: max(1, len(filled) // 2)]
    injected = [list(items) for items in rng.sample(best, max(1, len(best) // 2))]
    moved = {i for items in injected for i in items}
    kept, displaced = [], []
    for items in one:
        if moved.isdisjoint(items):
            kept.append(list(items))
        else:
            displaced += [i for i in items if i not in moved]
    rng.shuffle(kept)
    displaced = exchanged(sizes, capacity, kept, displaced)
    return Filling(sizes, capacity, injected + kept).place(displaced)


def mutated(sizes: list[int], capacity: int, bins: Bins, rng: random.Random) -> Bins:
    """The emptiest bin and some others taken apart and packed again."""
    order = sorted(range(len(bins)), key=lambda n: sum(sizes[i] for i in bins[n]))
    chosen = {order[0], *rng.sample(range(len(bins)), min(len(bins), 1 + len(bins) // 20))}
    kept = [list(items) for n, items in enumerate(bins) if n not in chosen]
    rng.shuffle(kept)
    displaced = exchanged(sizes, capacity, kept, [i for n in chosen for i in bins[n]])
    return Filling(sizes, capacity, kept).place(displaced)


def evolve(sizes: list[int], capacity: int, elites: list[Bins], seed: int) -> Bins:
    """The best solution an island breeds, starting from the elites given."""
    rng = random.Random(seed)
    everything = list(range(len(sizes)))
    population = [*elites]
    if not elites:
        population.append(Filling(sizes, capacity, []).place(everything))
    least = least_bins(sizes, capacity)
    while len(population) < POPULATION:
        some = rng.sample(everything, len(everything) // 2)
        first = Filling(sizes, capacity, []).place(some)
        population.append(Filling(sizes, capacity, first).place(list(set(everything) - set(some))))
    ranked = sorted(((fitness(sizes, capacity, bins), n, bins) for n, bins in enumerate(population)), reverse=True)
    for child_number in range(CHILDREN):
        if len(ranked[0][2]) == least:
            break
        one, other = rng.sample(ranked[: max(2, POPULATION - 1)], 2)
        child = mutated(sizes, capacity, crossover(sizes, capacity, one[2], other[2], rng), rng)
        ranked[-1] = (fitness(sizes, capacity, child), len(population) + child_number, child)
        ranked.sort(reverse=True)
    return ranked[0][2]


STATE = "block long, island int, items binary, sizes binary, bins binary, fewer int, filled double"


def _islands(groups: DataFrame, capacity: int, epoch: int) -> DataFrame:
    """One epoch on every island; `groups` has either items (first epoch) or
    the elites of the island and its neighbour, keyed by (block, island)."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        block, island = (part.as_py() for part in key)
        if epoch == 0:
            table = table.sort_by("item_id")
            items, sizes = table.column("item_id").to_numpy(), table.column("size").to_numpy().astype(np.int32)
            elites = []
        else:
            rows = table.to_pylist()
            items, sizes = np.frombuffer(rows[0]["items"], np.int64), np.frombuffer(rows[0]["sizes"], np.int32)
            elites = [_as_bins(np.frombuffer(row["bins"], np.int32)) for row in rows]
        plain = sizes.tolist()
        bins = evolve(plain, capacity, elites, seed=7919 * epoch + 31 * island + block % 1009)
        fewer, filled = fitness(plain, capacity, bins)
        number = np.empty(len(items), np.int32)
        for n, held in enumerate(bins):
            number[held] = n
        columns = [[block], [island], [items.tobytes()], [sizes.tobytes()], [number.tobytes()], [fewer], [filled]]
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.float64()]
        names = ["block", "island", "items", "sizes", "bins", "fewer", "filled"]
        return pa.table([pa.array(c, kind) for c, kind in zip(columns, kinds)], names=names)

    return groups.groupBy("block", "island").applyInArrow(run, STATE)


def _as_bins(number: np.ndarray) -> Bins:
    order = np.argsort(number, kind="stable")
    return [part.tolist() for part in np.split(order, np.flatnonzero(np.diff(number[order])) + 1)]


def _placed(best: DataFrame, capacity: int, open_part: float) -> DataFrame:
    """item_id, size, settled, sequence within the block, offset. At most
    `open_part` of a block's bins are not settled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                items, sizes = np.frombuffer(row["items"], np.int64), np.frombuffer(row["sizes"], np.int32).astype(np.int64)
                number = np.frombuffer(row["bins"], np.int32)
                order = np.argsort(number, kind="stable")
                ends = np.cumsum(sizes[order])
                firsts = np.concatenate(([0], np.flatnonzero(np.diff(number[order])) + 1))
                before = (ends - sizes[order])[firsts]
                offsets = ends - sizes[order] - np.repeat(before, np.diff(np.append(firsts, len(order))))
                fill = np.bincount(number, sizes)
                stay = fill >= FULL * capacity
                stay[np.argsort(fill, kind="stable")[int(open_part * len(fill)) :]] = True
                settled = stay[number[order]]
                columns = [items[order], sizes[order], settled, np.full(len(order), row["block"]), number[order].astype(np.int64), offsets]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["item_id", "size", "settled", "block", "bin", "offset"])

    return best.mapInArrow(run, "item_id long, size long, settled boolean, block long, bin long, offset long")


def pack_items(items: DataFrame, capacity: int = CAPACITY, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """item_id, sequence_id, offset for `items` (item_id unique, size)."""
    done, rounds, before, open_part = [], 0, None, 1.0
    left = items.select("item_id", F.col("size").cast("long").alias("size"))
    while True:
        count = left.count()
        blocks = -(-count // block_items)
        if before is not None and 5 * count > 4 * before:
            open_part = OPEN_PART
        last = blocks <= 1
        dealt = left.withColumn("block", F.pmod(F.xxhash64("item_id", F.lit(rounds)), F.lit(max(1, blocks))))
        islands = F.explode(F.array(*(F.lit(i) for i in range(ISLANDS)))).alias("island")
        state = _islands(dealt.select("*", islands), capacity, 0)
        for epoch in range(1, EPOCHS):
            state = stored(state, "islands")
            migrants = state.withColumn("island", (F.col("island") + 1) % ISLANDS)
            state = _islands(state.union(migrants), capacity, epoch)
        best = state.groupBy("block").agg(F.max_by(F.struct("items", "sizes", "bins"), F.struct("fewer", "filled")).alias("s"))
        placed = stored(_placed(best.select("block", "s.*"), capacity, 0.0 if last else open_part), "placed")
        sequence = F.lit(rounds << 55) + F.col("block") * (1 << 20) + F.col("bin")
        done.append(placed.where("settled").select("item_id", sequence.alias("sequence_id"), "offset"))
        if last:
            break
        left, rounds = placed.where("NOT settled").select("item_id", "size"), rounds + 1
        before = count
    result = done[0]
    for more in done[1:]:
        result = result.union(more)
    return result


def token_pieces(documents: DataFrame, tokenizer: str, end_id: int, capacity: int, word_ends: bool) -> DataFrame:
    """Per row of `documents`: a row number, its ids' count and the checksum
    of each piece; `full_before` counts full pieces before it in its task."""
    end = np.uint32(end_id).tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, row, full = worker_encoder(tokenizer, word_ends), 0, 0
        for some in small(batches):
            counts, sums, fulls = [], [], []
            for ids in encoder.encode(some.column("text").to_pylist()):
                ids += end
                n = len(ids) // 4
                first = (n - 1) % capacity + 1
                cuts = [0, *range(first, n + 1, capacity)]
                counts.append(n)
                sums.append([zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(cuts[:-1], cuts[1:])])
                fulls.append(full)
                full += n // capacity
            part = some.column("part")[0].as_py()
            rows = np.arange(row, row + some.num_rows) + (part << 33)
            row += some.num_rows
            columns = [pa.array(rows), some.column("doc_id"), pa.array([part] * some.num_rows, pa.int64())]
            columns += [pa.array(counts, pa.int64()), pa.array(sums, pa.list_(pa.int64())), pa.array(fulls, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["item_id", "doc_id", "part", "n_tokens", "sums", "full_before"])

    chosen = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.spark_partition_id().cast("long").alias("part"))
    return chosen.mapInArrow(encode, "item_id long, doc_id long, part long, n_tokens long, sums array<long>, full_before long")


def packed(documents: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, word_ends: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = stored(token_pieces(documents, tokenizer, end_id, capacity, word_ends), "token-pieces")
    rest = F.col("n_tokens") % capacity
    items = pieces.where(rest > 0).select("item_id", rest.alias("size"))
    places = pack_items(items, capacity)
    first = F.when(rest > 0, rest).otherwise(capacity)
    each = pieces.join(places, "item_id", "left").select("*", F.posexplode("sums").alias("piece", "ids_crc32"))
    short = (F.col("piece") == 0) & (rest > 0)
    full_number = F.col("full_before") + F.col("piece") - F.when(rest > 0, 1).otherwise(0)
    return each.select(
        "doc_id",
        "piece",
        F.when(F.col("piece") == 0, 0).otherwise(first + (F.col("piece") - 1) * capacity).cast("long").alias("start"),
        F.when(F.col("piece") == 0, first).otherwise(capacity).cast("long").alias("length"),
        "ids_crc32",
        F.when(short, F.col("sequence_id")).otherwise(-1 - F.col("part") * (1 << 40) - full_number).alias("sequence_id"),
        F.when(short, F.col("offset")).otherwise(0).cast("long").alias("offset"),
    )
