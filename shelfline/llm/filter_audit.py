"""What each filter removes, in every order of the filters, with exact repeats
found by radix tries.

Five filters fail a document (bits of its mask, in this order): A, under 50
words; B, fewer than 65 distinct words in 100; C, more than 5 of 100 code
points in A-Z; D, one of `#$%&*|`; E, a text that stands under a smaller
doc_id. A to D are read off the text. For E every task puts its whole texts
into a compressed trie whose terminals hold the least id: a row with a larger
id is decided there and goes on without its text. What is left, at most one
text per task and distinct text, is dealt by ranges of text prefixes, and each
range's trie decides the rest. A prefix is lengthened where more than
`RANGE_BYTES` of text begin alike, so a common opening is spread over ranges.

`masks` gives the mask of every document; `audit` adds masks up per part and
unfolds the sums over all 120 orders without looking at a document again.

A null text is empty, and equal to an empty one. A row without doc_id never
fails E and makes no other row fail it; rows that repeat doc_id and text don't
fail E by one another. A null part is the empty string. Several labels of one
doc_id count if one of them does. Texts of any length are whole: a trie holds
each once. An empty table gives an empty result. Only the named columns are
read, so others may have any name.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.llm.text import small, stored, texts

FILTERS = "ABCDE"
REPEATED = 1 << FILTERS.index("E")
UPPER = bytes(range(65, 91))
SYMBOLS = b"#$%&*|"

# Text held by a task's trie before it is handed on, and by a range.
FLUSH_BYTES = 32 << 20
RANGE_BYTES = 32 << 20
# Prefix lengths grow by this factor where texts begin alike.
PREFIX_BYTES, LONGER = 32, 16

SHARED = "doc_id long, part string, mask int, n long"


class _Node:
    """The end of an edge; a terminal holds the least id of its text, and how
    many rows of each part have that id."""

    __slots__ = ("label", "children", "least", "mask", "parts")

    def __init__(self, label: bytes):
        self.label, self.children = label, {}
        self.least = self.mask = self.parts = None


def _alike(label: bytes, text: bytes, at: int) -> int:
    """Leading bytes of `label` that `text` has at `at`."""
    low, high = 0, min(len(label), len(text) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if text.startswith(label[low:middle], at + low):
            low = middle
        else:
            high = middle - 1
    return low


class RadixTrie:
    """A compressed trie of whole texts."""

    def __init__(self) -> None:
        self.root = _Node(b"")
        self.held = 0

    def terminal(self, text: bytes) -> _Node:
        """The node at which `text` ends; edges are added or cut as needed."""
        node, at, size = self.root, 0, len(text)
        while at < size:
            child = node.children.get(text[at])
            if child is None:
                leaf = node.children[text[at]] = _Node(text[at:])
                self.held += size - at
                return leaf
            if not text.startswith(child.label, at):
                alike = _alike(child.label, text, at)
                upper = _Node(child.label[:alike])
                child.label = child.label[alike:]
                upper.children[child.label[0]] = child
                node.children[upper.label[0]] = upper
                child = upper
            node, at = child, at + len(child.label)
        return node

    def add(self, text: bytes, doc_id: int, part: str, mask: int, n: int) -> Iterator[tuple]:
        """Enter rows of one text and id; gives those that are decided by it."""
        node = self.terminal(text)
        if node.least is None or doc_id < node.least:
            if node.least is not None:
                for other, count in node.parts.items():
                    yield node.least, other, node.mask | REPEATED, count
            node.least, node.mask, node.parts = doc_id, mask, {part: n}
        elif doc_id == node.least:
            node.parts[part] = node.parts.get(part, 0) + n
        else:
            yield doc_id, part, mask | REPEATED, n

    def holders(self) -> Iterator[tuple]:
        """Rows with the least id of their text, with the text, depth first."""
        path = [(self.root, b"")]
        while path:
            node, before = path.pop()
            text = before + node.label
            if node.least is not None:
                for part, count in node.parts.items():
                    yield node.least, part, node.mask, count, text
            path.extend((child, text) for child in node.children.values())


def _failing(text: bytes) -> int:
    """Bits of the filters A to D."""
    words = text.split()
    upper = len(text) - len(text.translate(None, UPPER))
    return (
        (len(words) < 50)
        + 2 * (100 * len(set(words)) < 65 * len(words))
        + 4 * (100 * upper > 5 * len(text.decode()))
        + 8 * (len(text.translate(None, SYMBOLS)) < len(text))
    )


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(column), field.type) for column, field in zip(columns, schema)], schema=schema)


_MASK = pa.schema([("doc_id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("n", pa.int64())])
_LOCAL = pa.schema([*_MASK, ("head", pa.binary()), ("text", pa.binary())])


def _decide_in_tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Masks of all rows; rows that still need other tasks carry their text."""

    def handed_on(trie: RadixTrie) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for row in trie.holders():
            rows.append((*row[:4], row[4][:PREFIX_BYTES], row[4]))
            size += len(row[4])
            if size > FLUSH_BYTES // 8:
                yield _table(rows, _LOCAL)
                rows, size = [], 0
        yield _table(rows, _LOCAL)

    trie = RadixTrie()
    for batch in small(batches):
        decided = []
        for doc_id, part, text in zip(batch.column("doc_id").to_pylist(), batch.column("part").to_pylist(), texts(batch)):
            text = text or b""
            mask = _failing(text)
            if doc_id is None:
                decided.append((None, part, mask, 1, None, None))
                continue
            decided.extend((*row, None, None) for row in trie.add(text, doc_id, part, mask, 1))
            if trie.held > FLUSH_BYTES:
                yield from handed_on(trie)
                trie = RadixTrie()
        yield _table(decided, _LOCAL)
    yield from handed_on(trie)


def _decide_in_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Masks of the rows of one range of texts, of which it sees all."""
    trie = RadixTrie()
    for batch in small(batches):
        decided = []
        for row in batch.to_pylist():
            decided.extend(trie.add(row["text"], row["doc_id"], row["part"], row["mask"], row["n"]))
        yield _table(decided, _MASK)
    rows = []
    for row in trie.holders():
        rows.append(row[:4])
        if len(rows) == 10_000:
            yield _table(rows, _MASK)
            rows = []
    yield _table(rows, _MASK)


def _with_prefix(open_rows: DataFrame) -> DataFrame:
    """The rows with a `prefix` of their text, lengthened while more than
    `RANGE_BYTES` share it.

    A shared prefix is broadcast as one hash of 8 bytes, and there are at most
    as many as ranges, total bytes by `RANGE_BYTES`. Two prefixes with one hash
    only make a prefix longer than it need be.
    """
    length = PREFIX_BYTES
    prefixed = open_rows.withColumn("prefix", F.col("head"))
    sizes = open_rows.select(F.col("head").alias("prefix"), "bytes")
    longest = open_rows.agg(F.max("bytes")).first()[0]
    while True:
        key = F.xxhash64("prefix", F.lit(length))
        alike = sizes.groupBy(key.alias("shared")).agg(F.sum("bytes").alias("bytes")).where(F.col("bytes") > RANGE_BYTES).select("shared")
        alike = stored(alike, "prefixes")
        if length >= (longest or 0) or alike.isEmpty():
            return prefixed
        joined = prefixed.join(F.broadcast(alike), key == F.col("shared"), "left")
        longer = F.substring("text", 1, length * LONGER)
        prefixed = joined.withColumn("prefix", F.when(F.col("shared").isNull(), F.col("prefix")).otherwise(longer)).drop("shared")
        length *= LONGER
        sizes = joined.where(F.col("shared").isNotNull()).select(longer.alias("prefix"), "bytes")


def masks(documents: DataFrame, part: str = "source") -> DataFrame:
    """doc_id, part, mask (bit of each failing filter), n (equal rows)."""
    chosen = documents.select(F.col("doc_id").cast("long"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), "text")
    local = stored(chosen.mapInArrow(_decide_in_tasks, f"{SHARED}, head binary, text binary"), "tasks")
    decided = local.where("text IS NULL").select("doc_id", "part", "mask", "n")
    undecided = local.where("text IS NOT NULL").withColumn("bytes", F.length("text"))
    total = undecided.agg(F.sum("bytes")).first()[0] or 0
    dealt = _with_prefix(undecided).repartitionByRange(total // RANGE_BYTES + 1, "prefix")
    found = dealt.select("doc_id", "part", "mask", "n", "text").mapInArrow(_decide_in_range, SHARED)
    return stored(decided.union(found), "masks")


def _steps() -> list[tuple[str, int, int, int]]:
    """Every order and step with the step's filter bit and those before it."""
    rows = []
    for order in itertools.permutations(FILTERS):
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << FILTERS.index(letter)
            rows.append(("".join(order), step, bit, before))
            before |= bit
    return rows


def audit(document_masks: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, with the documents of
    the part that are kept after the step, `removed` by it, failing but removed
    before (`redundant`), failing nothing else (`unique_fails`), removed though
    labelled good or toxic, and its filter's removals over all orders (`shapley`).

    Masks are counted first, so a part is at most 32 rows from then on. Labels
    meet rows without texts, and only those that some filter fails.
    """
    spark = document_masks.sparkSession
    marked = (
        labels.where("doc_id IS NOT NULL AND (quality = 1 OR toxic = 1)")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max(F.expr("quality <=> 1").cast("long")).alias("good"), F.max(F.expr("toxic <=> 1").cast("long")).alias("toxic"))
    )
    failing = document_masks.where("doc_id IS NOT NULL AND mask <> 0").groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n"))
    lost = failing.join(marked, "doc_id").groupBy("part", "mask").agg(F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))
    zero = F.lit(0).cast("long")
    counted = document_masks.groupBy("part", "mask").agg(F.sum("n").alias("n")).select("part", "mask", "n", zero.alias("good"), zero.alias("toxic"))
    cells = counted.union(lost.select("part", "mask", zero, "good", "toxic")).groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))

    steps = _steps()
    settings = sorted({(bit, before) for _, _, bit, before in steps})
    setting = F.explode(F.array(*(F.struct(F.lit(bit).alias("bit"), F.lit(before).alias("before")) for bit, before in settings)))
    spread = cells.select("*", setting.alias("s")).select("part", "mask", "n", "good", "toxic", "s.bit", "s.before")
    mask, bit, before = F.col("mask"), F.col("bit"), F.col("before")
    fails, free = mask.bitwiseAND(bit) != 0, mask.bitwiseAND(before) == 0
    total = lambda condition, value: F.sum(F.when(condition, value).otherwise(zero))
    # A filter comes first among the k that a document fails in 120 / k orders.
    first_in = F.col("n") * F.expr("120 DIV bit_count(mask)")
    summed = spread.groupBy("part", "bit", "before").agg(
        total(free & ~fails, F.col("n")).alias("kept"),
        total(free & fails, F.col("n")).alias("removed"),
        total(~free & fails, F.col("n")).alias("redundant"),
        total(mask == bit, F.col("n")).alias("unique_fails"),
        total(free & fails, F.col("good")).alias("good_lost"),
        total(free & fails, F.col("toxic")).alias("toxic_lost"),
        total(fails, first_in).alias("shapley"),
    )
    grid = spark.createDataFrame(steps, "filter_order string, step int, bit int, before int")
    measures = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return summed.join(F.broadcast(grid), ["bit", "before"]).select("part", "filter_order", "step", *measures)
