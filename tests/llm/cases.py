"""Awkward documents, and plain versions of what the operators compute."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, tokens string, leaks int, _pii_email string, home long, bucket int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows(texts):
    """Full rows with clashing extra columns; `texts` holds (doc_id, text)."""
    return [(doc, text, None, "s", None, 0.5, "t", 1, "p", 7, None) for doc, text in texts]


def frame(spark, texts):
    return spark.createDataFrame(rows(texts), SCHEMA).repartition(3)


def prose(rng, words):
    syllables = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(words))


def edited(rng, text, edits):
    words = text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = prose(rng, 1) + "x"
    return " ".join(words)


def corpus(seed=3):
    """Copies, near copies in a large family, shared passages, short texts."""
    rng = random.Random(seed)
    base = [prose(rng, rng.randrange(30, 160)) for _ in range(30)]
    passage, line = prose(rng, 60), prose(rng, 10)
    texts = list(base)
    texts += [edited(rng, base[0], rng.randrange(0, 9)) for _ in range(90)]
    texts += [base[1]] * 25
    texts += [line + "\n" + prose(rng, rng.randrange(5, 60)) for _ in range(30)]
    texts += [prose(rng, 40) + " " + passage + " " + prose(rng, 20) for _ in range(25)]
    texts += [edited(rng, rng.choice(base), 1).upper() for _ in range(20)]
    texts += ["", " ", "\n\t", "one", "one", "one two three", "ONE two three", "a b c d", "word " * 300, "word " * 301]
    texts += ["é ü x", "tab\tand\x0bmore\r\nlines here now", "long " + prose(rng, 6000)]
    order = list(enumerate(texts))
    rng.shuffle(order)
    return [(n * 3, text) for n, (_, text) in enumerate(order)] + [(100_000, None), (None, base[0]), (None, None), (3, order[1][1])]


def shingle_set(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    if len(words) < 5:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def components(docs):
    """doc_id to (set size, least doc_id reachable), all pairs compared."""
    sets = {doc: shingle_set(text) for doc, text in docs if doc is not None}
    root = {doc: doc for doc in sets}

    def find(doc):
        while root[doc] != doc:
            doc = root[doc]
        return doc

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                ra, rb = sorted((find(a), find(b)))
                root[rb] = ra
    return {doc: (len(sets[doc]), find(doc)) for doc in ids}


def kept_words(docs, window=20):
    """doc_id to (words, words removed, kept words) for unique doc_ids."""
    words = {doc: WORD.findall(text or "") for doc, text in docs}
    seen, gone = set(), defaultdict(set)
    for doc in sorted(words):
        for i in range(len(words[doc]) - window + 1):
            key = tuple(words[doc][i : i + window])
            if key in seen:
                gone[doc] |= set(range(i, i + window))
            seen.add(key)
    return {
        doc: (len(found), len(gone[doc]), [w for i, w in enumerate(found) if i not in gone[doc]]) for doc, found in words.items()
    }


def measures(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    repeated = {i + o for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for o in range(3)}
    lines = [line for line in (text or "").split("\n") if WORD.search(line)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated)
