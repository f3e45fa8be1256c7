"""Near-duplicate documents: an exact Jaccard join over word shingles.

The method is a token-group matrix. Similar documents are put into groups, the
matrix holds for every group the union of its members' tokens (shingles), and
the overlap of a document with a group's union bounds its overlap with any
member. Only groups whose bound reaches the threshold are opened.

1. Equal token sets are one class; the rest works on one document per class.
2. Documents sharing a min-hash meet in blocks of bounded size, each with the
   most copied member; links verified there make the first groups. This only
   shortens the work: what it misses is found below.
3. Tokens are ordered by hash. If two sets link, the first `l` tokens they
   share stand in the first `n - ceil(t n) + l` of both, so a document with
   fewer than `l` such tokens in other groups can link to none of them.
4. For the rest, the matrix of (token, group) is joined to the documents'
   rarest tokens, one of which a group must have; the document then meets the
   group's union, and the group is opened when their overlap is at least `t`
   times the document's size.

No pair of documents is ever a row: blocks emit a spanning set of links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfline.llm.components import components
from shelfline.llm.text import (
    LOWER_ASCII,
    Packed,
    WordHashes,
    gram_hashes,
    mixed,
    multipliers,
    packed_schema,
    runs,
    shuffle_width,
    small,
    stored,
    texts,
    unpacked,
)

SHINGLE_WORDS = 5
BANDS = 2
BLOCK_DOCS = 48
BROADCAST_ROWS = 200_000
GROUP_DOCS = 192
GROUP_TOKENS = 200_000
QUERIES_PER_GROUP = 1024


def shingles(text: bytes | None, cache: WordHashes, size: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct hashes of the text's word shingles."""
    words = cache.of((text or b"").translate(LOWER_ASCII).split())
    if not len(words):
        return words
    return np.unique(gram_hashes(words, min(size, len(words)), seed=max(1, size - len(words) + 1)))


def needed(size: int, percent: int) -> int:
    """Least overlap of a set of `size` with any set it links to."""
    return -(-percent * size // 100)


def can_link(size, percent: int):
    """Whether a set of `size` (a number or a column) can link to another set:
    the nearest one holds it and one token more."""
    return 100 * size >= percent * (size + 1)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < percent * len(b):
        return False
    found = np.searchsorted(b, a)
    found[found == len(b)] = 0
    shared = int((b[found] == a).sum())
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def _digest(tokens: bytes) -> bytes | None:
    return xxhash.xxh3_128_digest(tokens) if tokens else None


def _sets(documents: DataFrame, percent: int) -> DataFrame:
    """doc_id, set size, a digest of the set, its min-hashes and its prefix
    tokens, the first of the sorted ones. Of copies within a task one carries
    the prefix for all, so it is stored once per task and distinct set."""
    factors = multipliers(BANDS, 71)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, seen = WordHashes(), set()
        for batch in small(batches):
            sizes, digests, bands, prefixes = [], [], [], []
            for text in texts(batch):
                tokens = shingles(text, cache)
                size, packed = len(tokens), tokens.tobytes()
                digest = _digest(packed)
                sizes.append(size)
                digests.append(digest)
                bands.append([int(mixed(tokens * f).min().view(np.int64)) for f in factors] if size else None)
                speaks = can_link(size, percent) and digest not in seen
                prefixes.append(packed[: 8 * (size - needed(size, percent) + max(1, size // 10))] if speaks else None)
                if speaks:
                    seen.add(digest)
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(prefixes, pa.binary())], ["doc_id", "n_shingles", "set_id", "bands", "prefix"])

    return documents.mapInArrow(run, "doc_id long, n_shingles long, set_id binary, bands array<long>, prefix binary")


def _with_tokens(rows: DataFrame) -> DataFrame:
    """`text` replaced by `tokens`, the packed sorted shingle hashes.

    A row whose text is not the one `set_id` stands for is left out.
    """
    kept = [name for name in rows.columns if name not in ("text", "set_id")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in small(batches):
            tokens = [shingles(text, cache).tobytes() for text in texts(batch)]
            wanted = [_digest(t) == s for t, s in zip(tokens, batch.column("set_id").to_pylist())]
            columns = [*(batch.column(name) for name in kept), pa.array(tokens, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, [*kept, "tokens"]).filter(pa.array(wanted, pa.bool_()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in kept)
    return rows.mapInArrow(run, schema + ", tokens binary")


def _block_links(rows: list[dict], percent: int) -> Iterator[tuple[int, int]]:
    """A spanning set of the links among the rows of one block."""
    rows = list({row["doc_id"]: row for row in sorted(rows, key=lambda row: (not row["hub"], row["doc_id"]))}.values())
    sets = [np.frombuffer(row["tokens"], np.uint64) for row in rows]
    root = list(range(len(rows)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for j in range(1, len(rows)):
        for i in range(j):
            at, to = find(j), find(i)
            if at != to and linked(sets[i], sets[j], percent):
                root[at] = to
                yield rows[i]["doc_id"], rows[j]["doc_id"]


def _links_in_blocks(members: DataFrame, percent: int) -> DataFrame:
    """Links among documents of one block; `members`: block, doc_id, hub, tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in runs(batches, "block"):
            found = list(_block_links(rows, percent))
            if found:
                a, b = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    together = members.repartition(shuffle_width(members.sparkSession), "block").sortWithinPartitions("block")
    return together.mapInArrow(run, "a long, b long")


def _texts_of(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """Tokens of the documents in `rows`, a stored table whose size is looked
    at: while it is small the texts stay where they are."""
    if rows.count() <= BROADCAST_ROWS:
        rows = F.broadcast(rows)
    return _with_tokens(documents.join(rows, "doc_id"))


def _first_links(classes: DataFrame, documents: DataFrame, percent: int) -> DataFrame:
    """Links verified among documents that share a min-hash."""
    banded = classes.where(can_link(F.col("n_shingles"), percent)).select("doc_id", "set_id", "copies", F.posexplode("bands").alias("band", "value"))
    weight = F.struct(F.col("copies"), (-F.col("doc_id")).alias("minus_id"), F.col("set_id"))
    keys = banded.groupBy("band", "value").agg(F.count(F.lit(1)).alias("size"), F.max(weight).alias("hub")).where("size > 1")
    keys = keys.withColumn("blocks", F.ceil(F.col("size") / BLOCK_DOCS).cast("int"))
    block = F.xxhash64("band", "value", "part").alias("block")
    spread = (
        banded.join(keys.select("band", "value", "blocks"), ["band", "value"])
        .withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
        .select("doc_id", "set_id", block, F.lit(False).alias("hub"))
    )
    hubs = keys.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        (-F.col("hub.minus_id")).alias("doc_id"), "hub.set_id", block, F.lit(True).alias("hub")
    )
    places = spread.union(hubs).groupBy("doc_id", "set_id").agg(F.collect_set(F.struct("block", "hub")).alias("places"))
    placed = _texts_of(stored(places, "places"), documents).select("doc_id", "tokens", F.explode("places").alias("at"))
    return _links_in_blocks(placed.select("at.block", "at.hub", "doc_id", "tokens"), percent)


def _set_key(digest: bytes) -> int:
    """What `xxhash64` gives in Spark for a set_id. Sets that share a key get
    each other's tokens, which adds undecided documents and loses none."""
    return xxhash.xxh64_intdigest(digest, seed=42)


def _shared_prefix_tokens(sets: DataFrame) -> DataFrame:
    """(token, set_key) of prefix tokens that stand in two documents or more.

    A prefix speaks for its set, not for a doc_id, which other rows may repeat
    with another text.
    """
    names = ["token", "set"]
    buckets = 4 * shuffle_width(sets.sparkSession)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = Packed(names, buckets)
        for batch in small(batches):
            for digest, prefix in zip(batch.column("set_id").to_pylist(), batch.column("prefix").to_pylist()):
                tokens = np.frombuffer(prefix, np.uint64)
                packed.add(tokens, np.full(len(tokens), _set_key(digest), np.uint64))
                if packed.full:
                    yield from packed.rows()
        yield from packed.rows()

    def shared(table: pa.Table) -> pa.Table:
        tokens, sets = unpacked(table, token=np.uint64, set=np.uint64)
        order = np.argsort(tokens, kind="stable")
        tokens, sets = tokens[order], sets[order]
        same = np.concatenate(([False], tokens[1:] == tokens[:-1], [False]))
        repeated = same[1:] | same[:-1]
        return pa.table({"token": tokens[repeated].view(np.int64), "set_key": sets[repeated].view(np.int64)})

    rows = sets.where("prefix IS NOT NULL").select("set_id", "prefix").mapInArrow(prefixes, packed_schema(names))
    return rows.groupBy("bucket").applyInArrow(shared, "token long, set_key long")


def _undecided(classes: DataFrame, homes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Documents that may link into another group than their own."""
    shared = _shared_prefix_tokens(sets)
    keyed = homes.select(F.xxhash64("set_id").alias("set_key"), "rep", "home")
    placed = shared.join(keyed, "set_key").select("token", "rep", "home")
    across = placed.groupBy("token").agg(F.min("home").alias("low"), F.max("home").alias("high")).where("low <> high")
    counted = placed.join(across.select("token"), "token").groupBy("rep", "home").agg(
        F.count_distinct("token").alias("foreign"), F.min("token").alias("value")
    )
    least = F.greatest(F.lit(1), F.floor(F.col("n_shingles") * percent / 1000))
    return (
        counted.join(classes.select(F.col("doc_id").alias("rep"), "set_id", "n_shingles"), "rep")
        .where(F.col("foreign") >= least)
        .select(F.col("rep").alias("doc_id"), "home", "set_id", F.col("n_shingles").alias("size"), "value")
    )


def _grouped(rows: DataFrame) -> DataFrame:
    """Undecided documents dealt into groups of similar ones: a group holds
    members of one component (`single` false), or documents linked to nothing
    so far with the same least token among those that other components have."""
    alone = rows.groupBy("home").agg((F.count(F.lit(1)) == 1).alias("single"))
    keyed = rows.join(alone, "home").withColumn("key", F.when(F.col("single"), F.col("value")).otherwise(F.col("home")))
    fitting = F.greatest(F.ceil(F.count(F.lit(1)) / GROUP_DOCS), F.ceil(F.sum("size") / GROUP_TOKENS))
    parts = keyed.groupBy("single", "key").agg(fitting.alias("parts"))
    part = F.pmod(F.xxhash64("doc_id"), F.col("parts"))
    dealt = keyed.join(parts, ["single", "key"]).withColumn("group", F.xxhash64("single", "key", part))
    return dealt.select("doc_id", "home", "single", "group", "set_id")


def _matrix(rows: DataFrame) -> DataFrame:
    """The token-group matrix, read by document: doc_id, home, single, group,
    size, token, and `groups`, how many groups have the token. Tokens that only
    one component has are left out."""
    kinds = {"token": np.uint64, "doc": np.int64, "home": np.int64, "group": np.int64, "single": np.int8, "size": np.int32}
    buckets = 4 * shuffle_width(rows.sparkSession)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = Packed(list(kinds), buckets)
        for batch in small(batches):
            for row in batch.to_pylist():
                tokens = np.frombuffer(row["tokens"], np.uint64)
                values = (row["doc_id"], row["home"], row["group"], row["single"], len(tokens))
                packed.add(tokens, *(np.full(len(tokens), v, kind) for v, kind in zip(values, list(kinds.values())[1:])))
                if packed.full:
                    yield from packed.rows()
        yield from packed.rows()

    def cells(table: pa.Table) -> pa.Table:
        arrays = unpacked(table, **kinds)
        order = np.lexsort((arrays[3], arrays[2], arrays[0]))
        token, doc, home, group, single, size = (a[order] for a in arrays)
        first = np.ones(len(token), bool)
        first[1:] = token[1:] != token[:-1]
        run = np.cumsum(first) - 1
        starts = np.flatnonzero(first)
        groups = _distinct_per_run(run, group)
        homes = np.maximum.reduceat(home, starts) != np.minimum.reduceat(home, starts) if len(starts) else np.empty(0, bool)
        keep = homes[run]
        columns = {"doc_id": doc, "home": home, "single": single.astype(bool), "group": group, "size": size.astype(np.int64), "token": token.view(np.int64), "groups": groups[run]}
        return pa.table({name: values[keep] for name, values in columns.items()})

    packed = rows.mapInArrow(spread, packed_schema(list(kinds))).groupBy("bucket")
    return packed.applyInArrow(cells, "doc_id long, home long, single boolean, group long, size long, token long, groups long")


def _distinct_per_run(run: np.ndarray, values: np.ndarray) -> np.ndarray:
    order = np.lexsort((values, run))
    run, values = run[order], values[order]
    new = np.ones(len(run), bool)
    new[1:] = (run[1:] != run[:-1]) | (values[1:] != values[:-1])
    return np.bincount(run[new]).astype(np.int64)


class _Group:
    """Members of one group and the union of their tokens.

    Members need not be of one component, so a query can join several of them.
    """

    def __init__(self, members: list[tuple[int, np.ndarray]]):
        self.docs = [doc for doc, _ in members]
        self.sizes = np.array([len(tokens) for _, tokens in members], np.int64)
        self.union = np.unique(np.concatenate([tokens for _, tokens in members]))
        self.has = np.zeros((len(members), len(self.union)), bool)
        for row, (_, tokens) in zip(self.has, members):
            row[np.searchsorted(self.union, tokens)] = True
        # Members joined by the queries so far have the same number.
        self.joined = np.arange(len(members))

    def links(self, tokens: np.ndarray, percent: int) -> list[int]:
        """Members that `tokens` links to, one of each set of members that
        earlier queries joined; the group is opened only when the overlap with
        its union allows one."""
        found = np.searchsorted(self.union, tokens)
        found[found == len(self.union)] = 0
        found = found[self.union[found] == tokens]
        if len(found) < needed(len(tokens), percent):
            return []
        shared = self.has[:, found].sum(axis=1)
        fit = np.flatnonzero(100 * shared >= percent * (self.sizes + len(tokens) - shared))
        numbers, first = np.unique(self.joined[fit], return_index=True)
        if len(numbers) > 1:
            self.joined[np.isin(self.joined, numbers)] = numbers[0]
        return [self.docs[i] for i in fit[first]]


def _links_of_opened(open_rows: DataFrame, percent: int) -> DataFrame:
    """A spanning set of the links between the queries and the members of a
    block, which are fewer than both together; members stand first in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, members, group = None, [], None
        for batch in small(batches):
            found = []
            for row in batch.to_pylist():
                if row["block"] != block:
                    block, members, group = row["block"], [], None
                tokens = np.frombuffer(row["tokens"], np.uint64)
                if row["hub"]:
                    members.append((row["doc_id"], tokens))
                    continue
                group = group or _Group(members)
                found.extend((row["doc_id"], other) for other in group.links(tokens, percent))
            if found:
                a, b = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    together = open_rows.repartition(shuffle_width(open_rows.sparkSession), "block")
    return together.sortWithinPartitions("block", F.desc("hub")).mapInArrow(run, "a long, b long")


def _group_links(rows: DataFrame, percent: int) -> DataFrame:
    """Links between documents of different components; `rows`: doc_id, home,
    single, group, tokens of the undecided."""
    least = F.ceil(F.col("size") * percent / 100)
    of_doc = Window.partitionBy("doc_id")
    cells = stored(_matrix(rows).withColumn("held", F.count(F.lit(1)).over(of_doc)).where(F.col("held") >= least), "token-groups")
    # What a document asks: single ones ask all groups; of two components the later asks.
    asks = cells.withColumn("rank", F.row_number().over(of_doc.orderBy("groups", "token")))
    union = cells.select("token", "group", F.col("home").alias("group_home"), F.col("single").alias("group_single"))
    union = union.withColumn("group_home", F.when(F.col("group_single"), 0).otherwise(F.col("group_home"))).distinct()
    allowed = (F.col("asking") != F.col("group")) & (
        F.when(F.col("group_single"), F.col("single")).otherwise((F.col("home") > F.col("group_home")) | (F.col("single") & (F.col("home") != F.col("group_home"))))
    )
    rare = asks.where(F.col("rank") <= F.col("held") - least + 1).withColumnRenamed("group", "asking")
    asked = stored(rare.join(union, "token").where(allowed).select("doc_id", "group").distinct(), "asked-groups")
    salts = asked.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / QUERIES_PER_GROUP).cast("int").alias("salts"))
    block = F.xxhash64("group", "salt").alias("block")
    queries = asked.join(salts, "group").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int"))
    held = rows.select("doc_id", "group").join(salts, "group").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    places = queries.select("doc_id", block, F.lit(False).alias("hub")).union(held.select("doc_id", block, F.lit(True).alias("hub")))
    within = rows.where("single").select(F.col("group").alias("block"), F.lit(False).alias("hub"), "doc_id", "tokens")
    across = places.join(rows.select("doc_id", "tokens"), "doc_id")
    return _links_of_opened(across, percent).union(_links_in_blocks(within, percent))


def _with_home(classes: DataFrame, links: DataFrame) -> DataFrame:
    """Every class with the least document of its component as `home`."""
    found = components(links)
    joined = classes.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return joined.withColumn("home", F.coalesce("component", "doc_id")).drop("component")


def jaccard_components(documents: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of `documents`.

    Two documents link when 100 * intersection >= percent * union of their
    shingle sets, `percent` from 1 to 100. `component_id` is the least doc_id
    reachable by links.

    Null or empty texts have an empty set and are alone. A row without doc_id
    keeps its size and has a null component. Rows that repeat a doc_id are one
    document, which links by the largest of their sets; each row is returned
    with its own size. Only doc_id and text are read.
    """
    if not 1 <= percent <= 100:
        raise ValueError("percent must be from 1 to 100")
    chosen = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = stored(_sets(chosen, percent), "shingle-sets")
    chosen = chosen.where("doc_id IS NOT NULL")
    largest = sets.where("doc_id IS NOT NULL AND n_shingles > 0").groupBy("doc_id").agg(F.max(F.struct("n_shingles", "set_id", "bands")).alias("s"))
    largest = stored(largest.select("doc_id", "s.*"), "document-sets")
    classes = largest.groupBy("set_id").agg(
        F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands")
    )
    classes = stored(classes, "set-classes")
    first = stored(_first_links(classes, chosen, percent), "first-links")
    homes = stored(_with_home(classes, first).select("set_id", F.col("doc_id").alias("rep"), "home"), "first-groups")
    undecided = _undecided(classes, homes, sets, percent)
    groups = stored(_grouped(stored(undecided, "undecided")), "groups")
    rows = stored(_texts_of(groups, chosen).dropDuplicates(["doc_id"]), "group-tokens")
    links = stored(first.union(_group_links(rows, percent)), "all-links")
    final = _with_home(classes, links).select("set_id", "home")
    named = largest.join(final, "set_id").select("doc_id", "home")
    joined = sets.select("doc_id", "n_shingles").join(named, "doc_id", "left")
    return joined.select("doc_id", "n_shingles", F.coalesce("home", "doc_id").alias("component_id"))


def one_of_each(documents: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of `documents` whose doc_id is the least of its component,
    with their own columns.

    Rows without doc_id stay. Texts under one doc_id count as documents of
    their own: each stays unless it is near to one that stays, and of rows with
    equal doc_id and text one stays. Of one component the least doc_id stays,
    and of that the largest set.
    """
    repeated = documents.select(F.col("doc_id").cast("long").alias("again")).where("again IS NOT NULL").groupBy("again").count().where("count > 1")
    repeated = stored(repeated.select("again"), "repeated-ids")
    several = repeated.count()
    if not several:
        found = stored(jaccard_components(documents, percent), "components")
        dropped = found.where("doc_id <> component_id").select(F.col("doc_id").alias("gone"))
        return _without(documents, F.col("doc_id").cast("long"), dropped)
    if several <= BROADCAST_ROWS:
        repeated = F.broadcast(repeated)
    row, id = F.struct(*documents.columns).alias("row"), F.col("doc_id").cast("long").alias("id")
    rows = documents.select(row, id, "text").join(repeated, F.col("id") == F.col("again"), "left")
    rows = rows.withColumn("key", F.when(F.col("again").isNull(), F.col("id")).otherwise(F.xxhash64("id", "text")))
    sets = stored(jaccard_components(rows.select(F.col("key").alias("doc_id"), "text"), percent), "components").distinct()
    found = sets.where("doc_id IS NOT NULL").join(rows.where("key IS NOT NULL").select("id", "key").distinct(), F.col("doc_id") == F.col("key"))
    found = found.select("component_id", "key", F.struct("id", -F.col("n_shingles"), "key").alias("place"))
    stays = found.groupBy("component_id").agg(F.min("place").alias("first"))
    dropped = found.join(stays, "component_id").where(F.col("key") != F.col("first.key")).select(F.col("key").alias("gone"))
    kept = _without(rows, F.col("key"), dropped)
    once = kept.where("again IS NULL").select("row.*")
    return once.unionByName(kept.where("again IS NOT NULL").groupBy("key").agg(F.first("row").alias("row")).select("row.*"))


def _without(rows: DataFrame, key: Column, dropped: DataFrame) -> DataFrame:
    """`rows` whose `key` is not in `dropped`."""
    dropped = stored(dropped, "near-duplicates")
    if dropped.count() <= BROADCAST_ROWS:
        dropped = F.broadcast(dropped)
    return rows.join(dropped, key == F.col("gone"), "left_anti")
