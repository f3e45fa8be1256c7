"""License notices found by template markup.

A template is license wording with two kinds of markup. What stands between
`<<optional>>` and `<<end>>` may be missing; `<<replace:n>>` stands for up to
n words of any kind. Everything else is mandatory and must match word for
word. Each template is compiled to an automaton over words, which is run from
every place where the template can begin; a text is given the template's label
when the automaton accepts somewhere.

Words are taken after lower-casing A-Z: runs of a-z, 0-9 and characters beyond
ASCII. Null and empty texts have no words, no labels and score 0. A null
`doc_id` is carried along; repeated rows are scanned each. Only the named
columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.llm.text import TO_WORDS, small, texts

# Phrases and the labels they stand for.
PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}

# Mandatory wording of public license notices, with markup.
TEMPLATES = {
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 <<optional>>(the License)<<end>>",
    "mit-notice": "<<optional>>This <<replace:3>> is<<end>> <<optional>>Released<<end>> <<optional>>Licensed<<end>> under the "
    "<<optional>>terms of the<<end>> MIT License",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files <<optional>>(the Software)<<end>>, to deal in the Software without restriction, including without "
    "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "gpl-notice": "<<optional>>This <<replace:4>> is free software you can<<end>> redistribute it and or modify it under the terms "
    "of the GNU <<optional>>Lesser<<end>> General Public License as published by the Free Software Foundation <<replace:12>> "
    "any later version",
    "gpl-reference": "Licensed under the <<optional>>terms of the<<end>> GNU <<optional>>Lesser<<end>> General Public License "
    "<<optional>>version<<end>> <<replace:1>>",
    "cc-by-nc-notice": "Licensed under <<optional>>a<<end>> <<optional>>Creative Commons<<end>> <<optional>>CC<<end>> BY NC",
    "bsd-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met",
    "isc-text": "Permission to use, copy, modify, and <<optional>>or<<end>> distribute this software for any purpose with or without fee "
    "is hereby granted",
    "spdx-identifier": "SPDX License Identifier <<replace:4>>",
    "copyright-notice": "Copyright <<optional>>c<<end>> <<replace:8>> All rights reserved",
}


@dataclass
class Automaton:
    """Word automaton. `moves[s]` maps a word to the next state, `free[s]` the
    state that any word leads to, `skips[s]` states reached without a word."""

    label: str
    moves: list[dict[bytes, int]] = field(default_factory=list)
    free: list[int | None] = field(default_factory=list)
    skips: list[list[int]] = field(default_factory=list)
    required: set[bytes] = field(default_factory=set)

    def state(self) -> int:
        self.moves.append({})
        self.free.append(None)
        self.skips.append([])
        return len(self.moves) - 1

    def closure(self, states: set[int]) -> set[int]:
        todo, seen = list(states), set(states)
        while todo:
            for nxt in self.skips[todo.pop()]:
                if nxt not in seen:
                    seen.add(nxt)
                    todo.append(nxt)
        return seen

    @property
    def accepting(self) -> int:
        return len(self.moves) - 1

    def openers(self) -> set[bytes]:
        return {word for state in self.closure({0}) for word in self.moves[state]}

    def accepts(self, words: list[bytes], start: int) -> bool:
        """Whether some run of words from `start` matches the template."""
        states = self.closure({0})
        at = start
        while True:
            if self.accepting in states:
                return True
            if not states or at == len(words):
                return False
            word = words[at]
            nxt = {self.moves[s][word] for s in states if word in self.moves[s]}
            nxt |= {self.free[s] for s in states if self.free[s] is not None}
            states = self.closure(nxt)
            at += 1


def compile_template(label: str, template: str) -> Automaton:
    """The automaton of a template; optional regions may be nested."""
    automaton = Automaton(label)
    at, opened = automaton.state(), []
    for part in re.split(r"(<<[^>]*>>)", template):
        if part == "<<optional>>":
            opened.append(at)
        elif part == "<<end>>":
            automaton.skips[opened.pop()].append(at)
        elif part.startswith("<<replace:"):
            ends = [at]
            for _ in range(int(part[10:-2])):
                nxt = automaton.state()
                automaton.free[at] = nxt
                at = nxt
                ends.append(at)
            last = automaton.state()
            for end in ends:
                automaton.skips[end].append(last)
            at = last
        else:
            for word in part.encode().translate(TO_WORDS).split():
                # A state of its own, so that skips out of `at` don't share the word.
                before, nxt = automaton.state(), automaton.state()
                automaton.skips[at].append(before)
                automaton.moves[before][word] = nxt
                at = nxt
                if not opened:
                    automaton.required.add(word)
    final = automaton.state()
    automaton.skips[at].append(final)
    return automaton


class Scanner:
    """All templates and phrases at once."""

    def __init__(self, templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES):
        self.phrases = {tuple(phrase.encode().split()): label for phrase, label in phrases.items()}
        self.automata = [compile_template(label, template) for label, template in templates.items()]
        self.opens: dict[bytes, list[Automaton]] = {}
        for automaton in self.automata:
            for word in automaton.openers():
                self.opens.setdefault(word, []).append(automaton)

    def scan(self, text: bytes | None) -> tuple[int, list[int], set[str], set[str]]:
        """Words, places of phrases, labels by phrases, labels by templates."""
        words = (text or b"").translate(TO_WORDS).split()
        present = set(words)
        places, base = [], set()
        for phrase, label in self.phrases.items():
            if not present.issuperset(phrase):
                continue
            size = len(phrase)
            found = [i for i in _all(words, phrase[0]) if tuple(words[i : i + size]) == phrase]
            places += found
            base |= {label} if found else set()
        labels = set()
        for word in present & self.opens.keys():
            waiting = [a for a in self.opens[word] if a.label not in labels and a.required <= present]
            for start in _all(words, word) if waiting else ():
                labels |= {a.label for a in waiting if a.accepts(words, start)}
                waiting = [a for a in waiting if a.label not in labels]
                if not waiting:
                    break
        return len(words), sorted(places), base, labels


def _all(words: list[bytes], word: bytes) -> Iterator[int]:
    at = -1
    while True:
        try:
            at = words.index(word, at + 1)
        except ValueError:
            return
        yield at


def license_scan(documents: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    `score` is 1 when a template accepts, 0.5 when only a phrase stands in the
    text, else 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for batch in small(batches):
            rows = [scanner.scan(text) for text in texts(batch)]
            columns = [
                batch.column(0),
                pa.array([n for n, _, _, _ in rows], pa.int64()),
                pa.array([len(places) for _, places, _, _ in rows], pa.int64()),
                pa.array([places[0] if places else None for _, places, _, _ in rows], pa.int64()),
                pa.array([places[-1] if places else None for _, places, _, _ in rows], pa.int64()),
                pa.array([",".join(sorted(base)) for _, _, base, _ in rows], pa.string()),
                pa.array([",".join(sorted(base | labels)) for _, _, base, labels in rows], pa.string()),
                pa.array([1.0 if labels else 0.5 if base else 0.0 for _, _, base, labels in rows], pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, NAMES)

    chosen = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return chosen.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


NAMES = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
