"""Token ids of whole texts, by the public tokenizer files.

Most words of a corpus repeat, so a text is cut where the tokenizer cannot
join across, each distinct piece is encoded once and remembered, and the ids
of the pieces are put together. The result equals encoding the whole text.
"""

from __future__ import annotations

import functools
import os
import re
from array import array

import numpy as np
from tokenizers import Tokenizer

REMEMBERED_PIECES = 900_000
KEPT_LENGTH = 6

# Words of these characters are cut further, into runs of letters, of digits
# and of other marks, as both tokenizers do. An apostrophe may begin a
# contraction, and marks beyond ASCII may join others, so they are left alone.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
PLAIN_WORD = re.compile(f"[!-&(-~{LETTERS}]+")
WORD_RUNS = re.compile(f"[{LETTERS}]+|[0-9]|[^{LETTERS}0-9]+")
PLAIN_CHUNK = re.compile(f" ?[!-&(-~{LETTERS}]+(?:\n[!-&(-~{LETTERS}]+)*\n?")
CHUNK_RUNS = re.compile(f" ?[{LETTERS}]+| ?[0-9]+|\n| ?[^{LETTERS}0-9\n ]+")


# Byte-level vocabularies write the bytes that are no visible Latin-1 character
# as the characters from 256 on.
VISIBLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_CHARACTERS = {byte: 256 + n for n, byte in enumerate(b for b in range(256) if b not in VISIBLE)}


class _Runs(dict):
    """Ids of a run. A run is one word to the tokenizer, already in its form,
    so it goes to the tokenizer's model at once, written as the vocabulary
    writes bytes; what rewrites and splits texts is left out for it."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model

    def encoded(self, run: str) -> bytes:
        return self.of_written(run.encode().decode("latin-1").translate(BYTE_CHARACTERS))

    def of_written(self, written: str) -> bytes:
        return array("I", [token.id for token in self.model.tokenize(written)]).tobytes()

    def whole(self, text: str) -> bytes:
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def __missing__(self, run: str) -> bytes:
        ids = self[run] = self.encoded(run)
        return ids


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, np.uint32).tobytes() if len(ids) > 64 else array("I", ids).tobytes()


class _Words(_Runs):
    """Ids of a word, put together from its runs, which are words too."""

    def __missing__(self, word: str) -> bytes:
        if PLAIN_WORD.fullmatch(word):
            cut = WORD_RUNS.findall(word.lower())
            ids = self.encoded(word) if cut == [word] else b"".join(map(self.__getitem__, cut))
        else:
            ids = self.whole(word)
        self[word] = ids
        return ids


class _Chunks(dict):
    """Ids of what stands between two spaces, put together from its runs.
    `lead` goes before it; a run that begins with it is a chunk too."""

    def __init__(self, runs: _Runs, lead: str):
        self.runs, self.lead = runs, lead
        self.mark = lead.translate(BYTE_CHARACTERS)

    def _ids(self, run: str) -> bytes:
        return self[run[1:]] if self.lead and run[0] == self.lead and len(run) > 1 else self.runs[run]

    def __missing__(self, chunk: str) -> bytes:
        text = self.lead + chunk
        if chunk.isascii() and chunk.isalpha():
            ids = self.runs.of_written(self.mark + chunk)
        elif PLAIN_CHUNK.fullmatch(text):
            cut = CHUNK_RUNS.findall(text)
            ids = self.runs.encoded(text) if cut == [text] else b"".join(map(self._ids, cut))
        else:
            ids = self.runs.whole(text)
        self[chunk] = ids
        return ids


class PieceEncoder:
    """Encodes texts to the bytes of their ids, unsigned 32-bit little-endian.

    `word_ends`: the tokenizer drops white space and case, so pieces are the
    words. Otherwise a space belongs to what follows it, and a piece is a space
    with the characters up to the next one; texts with two spaces in a row are
    encoded whole. So are those with what may be a special token, and those
    with separators that Python takes for white space and the tokenizer doesn't.
    """

    def __init__(self, path: str, word_ends: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        self.word_ends = word_ends
        self.runs = (_Words if word_ends else _Runs)(path)
        self.first, self.after = _Chunks(self.runs, ""), _Chunks(self.runs, " ")

    def _one(self, text: str | None) -> bytes:
        if not text:
            return b""
        unusual = ("<|", "\x1c", "\x1d", "\x1e", "\x1f") if self.word_ends else ("<|", "  ")
        if any(mark in text for mark in unusual):
            return self.runs.whole(text)
        if self.word_ends:
            return b"".join(map(self.runs.__getitem__, text.split()))
        first, *rest = text.split(" ")
        ids = b"".join(map(self.after.__getitem__, rest))
        return self.first[first] + ids if first else ids

    def _forget(self) -> None:
        """Drop the long pieces, which are the rare ones; all if that is not enough."""
        for known in (self.first, self.after, self.runs):
            short = {piece: ids for piece, ids in known.items() if len(piece) <= KEPT_LENGTH}
            known.clear()
            if len(short) < REMEMBERED_PIECES // 6:
                known.update(short)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; none for null."""
        if len(self.first) + len(self.after) + len(self.runs) > REMEMBERED_PIECES:
            self._forget()
        return [self._one(text) for text in texts]


@functools.lru_cache(maxsize=2)
def encoder(path: str, word_ends: bool) -> PieceEncoder:
    """The encoder of a Python worker, kept from task to task."""
    return PieceEncoder(path, word_ends)
