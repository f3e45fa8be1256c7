from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from llm import cases
from tokenizers import Tokenizer

from shelfline.llm import packing, token_files
from shelfline.llm.tokens import PieceEncoder
from shelfline.session import fresh_path

ODD = ["a\t b", "x\t\n\ty  z", "don't I'LL 's", "é́ x", "A<|endoftext|>b", "1 2  3\n\n4", " ", "\n", "İstanbul ß", "Σ ΑΣ.", "a \n\n b\n c", "ª²½ ×÷", None, ""]


@pytest.mark.parametrize("name,word_ends", [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_pieces_equal_whole_texts(name, word_ends):
    path = public_tokenizers.path(name)
    encoder, whole = PieceEncoder(path, word_ends), Tokenizer.from_file(path)
    rng = random.Random(1)
    marks = list("abAB12 .,!'-_\n éÉßñ") + ["''", " ", "²", "…", "ª", "\x1c", " "]
    texts = ODD + [text for _, text in cases.corpus()] + ["".join(rng.choice(marks) for _ in range(rng.randrange(30))) for _ in range(3000)]
    for text, ids in zip(texts, encoder.encode(texts)):
        assert np.frombuffer(ids, np.uint32).tolist() == whole.encode(text or "", add_special_tokens=False).ids, text


def ids_of(tokenizer, text, end=2):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_levels_round_trip():
    rng = random.Random(2)
    for size in (0, 1, 7, 511, 512, 513, 3000):
        ids = np.array([rng.choice([0, 1, 255, 256, 65535, 65536, 2**32 - 1, rng.randrange(60_000)]) for _ in range(size)], np.uint32)
        levels = token_files.levels_of(ids)
        assert token_files.ids_of(levels).tolist() == ids.tolist()
        assert [token_files.id_at(levels, i) for i in range(size)] == ids.tolist()


def test_files_give_back_every_id(spark, monkeypatch):
    monkeypatch.setattr(token_files, "SEGMENT_TOKENS", 700)
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = list({doc: (doc, text) for doc, text in cases.corpus() if doc is not None}.values()) + [(-5, t) for t in ODD[:1]]
    folder = fresh_path(spark, "files")
    token_files.write_token_files(cases.frame(spark, docs), folder, path, end_id=2)
    tokenizer, start, expected, every = Tokenizer.from_file(path), 0, {}, []
    for doc, text in sorted(docs):
        ids = ids_of(tokenizer, text)
        expected[doc] = (start, len(ids), crc(ids))
        start += len(ids)
        every += ids
    found = token_files.read_documents(spark, folder).collect()
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in found} == expected and len(found) == len(docs)
    for place in (0, 1, len(every) // 2, len(every) - 1):
        assert token_files.token_at(spark, folder, place) == every[place]
    assert token_files.token_at(spark, folder, len(every)) is None


def test_files_of_nulls_repeats_and_nothing(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    folder = fresh_path(spark, "files")
    token_files.write_token_files(cases.frame(spark, [(None, "a"), (1, "b"), (1, "b"), (1, None), (2, "")]), folder, path, end_id=2)
    found = sorted(token_files.read_documents(spark, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in found] == [None, 1, 1, 1, 2] and [r.start for r in found] == np.cumsum([0, *[r.n_tokens for r in found]])[:-1].tolist()
    folder = fresh_path(spark, "files")
    token_files.write_token_files(cases.frame(spark, [(1, "b")]).limit(0), folder, path, end_id=2)
    assert token_files.read_documents(spark, folder).count() == 0


def checked(found, docs, capacity):
    """Every rule of a packing; the number of sequences."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for row in found:
        pieces[row.doc_id].append(row)
        sequences[row.sequence_id].append(row)
    for doc, text in docs:
        ids, at = ids_of(tokenizer, text), 0
        mine = sorted(pieces[doc], key=lambda r: r.piece)
        assert len(mine) == -(-len(ids) // capacity)
        for n, row in enumerate(mine):
            assert (row.piece, row.start, row.ids_crc32) == (n, at, crc(ids[at : at + row.length])) and (n == 0 or row.length == capacity)
            at += row.length
        assert at == len(ids)
    for rows in sequences.values():
        at = 0
        for row in sorted(rows, key=lambda r: r.offset):
            assert row.offset == at
            at += row.length
        assert at <= capacity
    return len(sequences)


def test_packing_is_whole_and_tight(spark, monkeypatch):
    docs = list({doc: (doc, text) for doc, text in cases.corpus() if doc is not None}.values())
    path = public_tokenizers.path("byte_bpe_50k.json")
    found = packing.packed(cases.frame(spark, docs), path, end_id=2).collect()
    count, least = checked(found, docs, 1024), -(-sum(r.length for r in found) // 1024)
    assert least <= count <= least + 2
    monkeypatch.setattr(packing.pack_items, "__defaults__", (1024, 40))  # several blocks and rounds
    assert checked(packing.packed(cases.frame(spark, docs), path, end_id=2).collect(), docs, 1024) <= least + 12


def test_packing_of_nulls_and_nothing(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    found = packing.packed(cases.frame(spark, [(None, None), (None, ""), (1, "x"), (1, "x")]), path, end_id=2).collect()
    assert sorted(r.length for r in found) == [1, 1, 2, 2] and len({r.sequence_id for r in found}) == 1
    assert packing.packed(cases.frame(spark, [(1, "x")]).limit(0), path, end_id=2).count() == 0


def test_large_items_end_the_rounds(spark):
    items = spark.range(500).selectExpr("id AS item_id", "600 + id % 50 AS size")
    placed = packing.pack_items(items, 1024, 64)
    assert placed.select("sequence_id").distinct().count() == placed.count() == 500


def plain_best_fit(sizes, capacity):
    rooms = []
    for size in sorted(sizes, reverse=True):
        fitting = [n for n, room in enumerate(rooms) if room >= size]
        best = min(fitting, key=rooms.__getitem__, default=None)
        if best is None:
            rooms.append(capacity - size)
        else:
            rooms[best] -= size
    return len(rooms)


def fewest(sizes, capacity):
    """By trying every bin for every item."""
    best = len(sizes)

    def put(at, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if at == len(sizes):
            best = len(rooms)
            return
        for n, room in enumerate(rooms):
            if room >= sizes[at]:
                put(at + 1, [*rooms[:n], room - sizes[at], *rooms[n + 1 :]])
        put(at + 1, [*rooms, capacity - sizes[at]])

    put(0, [])
    return best


def test_bound_is_never_above_the_fewest_bins():
    rng = random.Random(2)
    for _ in range(200):
        sizes = [rng.randrange(1, 21) for _ in range(rng.randrange(1, 8))]
        assert -(-sum(sizes) // 20) <= packing.least_bins(sizes, 20) <= fewest(sizes, 20)


@pytest.mark.parametrize("block_items", [2048, 150])
def test_breeding_beats_plain_best_fit(spark, block_items):
    rng = random.Random(7)
    sizes = [rng.randrange(200, 421) for _ in range(600)]
    items = spark.createDataFrame(list(enumerate(sizes)), "item_id long, size long")
    placed = packing.pack_items(items, 1024, block_items).collect()
    filled = defaultdict(int)
    for row in placed:
        filled[row.sequence_id] += sizes[row.item_id]
    assert sorted(row.item_id for row in placed) == list(range(600)) and max(filled.values()) <= 1024
    assert len(filled) < plain_best_fit(sizes, 1024)


def test_open_bins_of_all_blocks_meet(spark):
    # Two items of 400 to 420 to a sequence, so no bin is ever full; at most one sequence holds a single one.
    items = spark.range(999).selectExpr("id AS item_id", "400 + id % 21 AS size")
    placed = packing.pack_items(items, 1024, 63)
    assert placed.count() == 999 and placed.select("sequence_id").distinct().count() == 500


def test_children_keep_every_item():
    rng = random.Random(4)
    sizes = [rng.randrange(1, 1024) for _ in range(300)]
    one, other = (packing.Filling(sizes, 1024, []).place(rng.sample(range(300), 300)) for _ in range(2))
    for child in (packing.crossover(sizes, 1024, one, other, rng), packing.mutated(sizes, 1024, one, rng), packing.evolve(sizes, 1024, [], 1)):
        assert sorted(i for items in child for i in items) == list(range(300))
        assert max(sum(sizes[i] for i in items) for items in child) <= 1024
