"""Token ids on disk as directly addressable codes.

An id is cut into chunks of eight bits, lowest first. Level 0 holds the first
chunk of every id, level 1 the second chunk of those ids that have one, and so
on. Beside each level stands a bitmap that says which ids continue, and a rank
directory with the number of set bits before every 512th bit. So the id at any
place is read without decoding others: take its byte, and while its bit is
set, step to the next level at the rank of the bit.

A file set is a Parquet folder `segments` with one row per segment of whole
documents, in ascending order of doc_id (then of a hash of the text), and a
small folder `parts` that says how many ids stand before each part. Spark
writes both, so they may be in any store and a lost executor's work is redone.

Null and empty texts have only the end id. Rows without doc_id come first;
rows that repeat a doc_id follow each other. Only doc_id and text are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from shelfline.llm.text import shuffle_width, small
from shelfline.llm.tokens import encoder as worker_encoder

SEGMENT_TOKENS = 1 << 20
DIRECTORY_BITS = 512
LEVEL = pa.struct([("chunks", pa.binary()), ("continues", pa.binary()), ("ranks", pa.binary())])
SEGMENT = (
    "part int, segment int, before long, n_tokens long, doc_ids array<long>, lengths array<long>, "
    "levels array<struct<chunks:binary,continues:binary,ranks:binary>>"
)


def levels_of(ids: np.ndarray) -> list[dict[str, bytes]]:
    """Chunk levels of ids, unsigned integers."""
    levels, rest = [], ids.astype(np.uint32 if ids.itemsize <= 4 else np.uint64)
    while len(rest) or not levels:
        more = rest > 255
        ranks = np.concatenate(([0], np.cumsum(np.add.reduceat(more, np.arange(0, len(more), DIRECTORY_BITS))))) if len(more) else np.zeros(1)
        levels.append(
            {
                "chunks": rest.astype(np.uint8).tobytes(),  # the low byte
                "continues": np.packbits(more, bitorder="little").tobytes(),
                "ranks": ranks.astype(np.uint32).tobytes(),
            }
        )
        rest = rest[more] >> rest.dtype.type(8)
    return levels


def ids_of(levels: list[dict[str, bytes]]) -> np.ndarray:
    """All ids of a segment, level by level."""
    ids = np.empty(0, np.uint32)
    for level in reversed(levels):
        chunks = np.frombuffer(level["chunks"], np.uint8).astype(np.uint32)
        more = np.unpackbits(np.frombuffer(level["continues"], np.uint8), count=len(chunks), bitorder="little").astype(bool)
        if len(ids):
            chunks[more] |= ids << np.uint32(8)
        ids = chunks
    return ids


def id_at(levels: list[dict[str, bytes]], place: int) -> int:
    """The id at one place of a segment, without decoding any other."""
    value = 0
    for depth, level in enumerate(levels):
        value |= level["chunks"][place] << 8 * depth
        bits = level["continues"]
        if not bits[place >> 3] >> (place & 7) & 1:
            break
        start = place // DIRECTORY_BITS
        rank = int(np.frombuffer(level["ranks"], np.uint32)[start])
        before = int.from_bytes(bits[start * DIRECTORY_BITS // 8 : place // 8 + 1], "little")
        place = rank + (before & ((1 << place - start * DIRECTORY_BITS) - 1)).bit_count()
    return value


def write_token_files(documents: DataFrame, folder: str, tokenizer: str, end_id: int, word_ends: bool = True) -> None:
    """Encode every whole text, end it with `end_id` and write the file set."""
    spark = documents.sparkSession
    chosen = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # The hash splits a doc_id that repeats over several parts.
    laid_out = chosen.withColumn("tie", F.xxhash64("text")).repartitionByRange(shuffle_width(spark), "doc_id", "tie")
    laid_out = laid_out.sortWithinPartitions("doc_id", "tie", "text").withColumn("part", F.spark_partition_id())
    end = np.uint32(end_id).tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(tokenizer, word_ends)
        part, segment, before, docs, held, size = 0, 0, 0, [], [], 0

        def row() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), np.uint32)
            lengths = [len(ids_) // 4 for ids_ in held]
            columns = [[part], [segment], [before], [len(ids)], [docs], [lengths]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            arrays = [pa.array(c, kind) for c, kind in zip(columns, kinds)]
            arrays.append(pa.array([levels_of(ids)], pa.list_(LEVEL)))
            return pa.RecordBatch.from_arrays(arrays, ["part", "segment", "before", "n_tokens", "doc_ids", "lengths", "levels"])

        for some in small(batches):
            part = some.column("part")[0].as_py()
            for doc, ids in zip(some.column("doc_id").to_pylist(), encoder.encode(some.column("text").to_pylist())):
                docs.append(doc)
                held.append(ids + end)
                size += len(ids) // 4 + 1
                if size >= SEGMENT_TOKENS:
                    yield row()
                    segment, before, docs, held, size = segment + 1, before + size, [], [], 0
        if docs:
            yield row()

    laid_out.select("part", "doc_id", "text").mapInArrow(encode, SEGMENT).write.parquet(f"{folder}/segments")
    totals = spark.read.parquet(f"{folder}/segments").groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # One row per shuffle partition.
    running = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    totals.select("part", F.coalesce(running, F.lit(0)).alias("part_start")).write.parquet(f"{folder}/parts")


def read_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Segments with `first`, the number of ids in the files before each."""
    parts = spark.read.parquet(f"{folder}/parts")  # at most one row per shuffle partition of the writer
    segments = spark.read.parquet(f"{folder}/segments").join(F.broadcast(parts), "part")
    return segments.withColumn("first", F.col("part_start") + F.col("before")).drop("part_start")


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lengths = np.array(row["lengths"], np.int64)
                raw = ids_of(row["levels"]).astype("<u4").tobytes()
                ends = np.cumsum(lengths)
                starts = ends - lengths
                sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts, ends)]
                columns = [pa.array(row["doc_ids"], pa.int64()), pa.array(starts + row["first"]), pa.array(lengths), pa.array(sums, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])

    chosen = read_segments(spark, folder).select("first", "doc_ids", "lengths", "levels")
    return chosen.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_at(spark: SparkSession, folder: str, position: int) -> int | None:
    """The id at a position counted over the whole file set."""
    of = (F.col("first") <= position) & (F.col("first") + F.col("n_tokens") > position)
    row: Row | None = read_segments(spark, folder).where(of).select("first", "levels").first()
    return None if row is None else id_at([level.asDict() for level in row.levels], position - row.first)
