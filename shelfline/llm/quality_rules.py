"""Quality rules as a ledger of failure bits, judged later by policies.

Every rule is evaluated once per document. The ledger keeps the measurements
and one 64-bit mask whose bit `i` says that rule `i` failed. A policy is a
versioned mask of rules that reject; applying one, or asking what a policy
would do without one of its rules, is integer arithmetic on the stored masks
and never looks at a text again.

Words are runs of anything but ASCII white space. A null text has no words. A
null `doc_id` is carried along; repeated rows each get their own ledger row.
Only the named columns are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.llm.text import WordHashes, gram_hashes, small, texts

SYMBOLS = b"#*$%&|<>"
NOT_SYMBOLS = bytes(set(range(256)) - set(SYMBOLS))
WHITE_SPACE = b" \t\n\v\f\r"

MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "dup_line_chars", "n_repeat_words", "n_upper_words"]


def _repeat_words(hashes: np.ndarray) -> int:
    """Words inside a three-word window that stands twice or more in the text."""
    grams = gram_hashes(hashes, 3)
    if len(grams) < 2:
        return 0
    order = np.argsort(grams, kind="stable")
    same = grams[order[1:]] == grams[order[:-1]]
    repeated = np.zeros(len(hashes), bool)
    starts = np.concatenate((order[1:][same], order[:-1][same]))
    for offset in range(3):
        repeated[starts + offset] = True
    return int(repeated.sum())


def _measure_text(text: bytes, cache: WordHashes) -> tuple[int, ...]:
    words = text.split()
    seen: set[bytes] = set()
    lines = dup_lines = dup_chars = 0
    for line in text.split(b"\n"):
        if not line.strip(WHITE_SPACE):
            continue
        lines += 1
        if line in seen:
            dup_lines += 1
            dup_chars += len(line)
        seen.add(line)
    return (
        len(words),
        len(b"".join(words).decode()),
        len(text.translate(None, NOT_SYMBOLS)),
        lines,
        dup_lines,
        dup_chars,
        _repeat_words(cache.of(words)),
        sum(1 for word in words if len(word) > 1 and word.isupper()),
    )


def measured(documents: DataFrame) -> DataFrame:
    """doc_id and the measurements of every whole text, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in small(batches):
            rows = [_measure_text(text or b"", cache) for text in texts(batch)]
            columns = np.array(rows, np.int64).reshape(-1, len(MEASURES)).T
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, columns)], ["doc_id", *MEASURES])

    chosen = documents.select(F.col("doc_id").cast("long"), "text")
    return chosen.mapInArrow(run, "doc_id long, " + ", ".join(f"{name} long" for name in MEASURES))


def rules() -> dict[str, Column]:
    """Failure condition of each rule, in bit order. New rules go to the end."""
    words, chars = F.col("n_words"), F.col("word_chars")
    return {
        "too_few_words": words < 50,
        "repeated_word_windows": 100 * F.col("n_repeat_words") > 50 * words,
        "many_symbols": 100 * F.col("n_symbols") > 10 * words,
        "repeated_lines": (F.col("n_lines") >= 4) & (100 * F.col("n_dup_lines") > 30 * F.col("n_lines")),
        "short_words": (words > 0) & (chars < 2 * words),
        "long_words": (words > 0) & (chars > 20 * words),
        "shouting": 100 * F.col("n_upper_words") > 50 * words,
        "no_words": words == 0,
    }


def mask_of(names: list[str] | tuple[str, ...]) -> int:
    order = list(rules())
    return sum(1 << order.index(name) for name in names)


# Versioned policies: the rules whose failure rejects a document.
POLICIES = {
    1: ("too_few_words", "repeated_word_windows"),
    2: ("too_few_words", "repeated_word_windows", "many_symbols", "repeated_lines", "short_words", "long_words", "shouting"),
}


def ledger(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, the measurements, `failed` (bit mask)."""
    bits = [F.when(condition, F.lit(1 << bit)).otherwise(F.lit(0)).cast("long") for bit, condition in enumerate(rules().values())]
    failed = bits[0]
    for bit in bits[1:]:
        failed = failed.bitwiseOR(bit)
    return measured(documents).withColumn("failed", failed)


def apply_policy(ledger_rows: DataFrame, version: int) -> DataFrame:
    """`kept`: none of the policy's rules failed."""
    mask = F.lit(mask_of(POLICIES[version])).cast("long")
    return ledger_rows.withColumn("kept", F.col("failed").bitwiseAND(mask) == 0)


def ablations(ledger_rows: DataFrame, version: int) -> DataFrame:
    """Per rule of a policy: documents failing it, documents that only it
    rejects, and documents kept if the rule were dropped.

    Masks are counted first, so the shuffle carries at most one row per task
    and distinct mask, whatever the number of documents.
    """
    names = POLICIES[version]
    mask = mask_of(names)
    order = list(rules())
    judged = ledger_rows.select(F.col("failed").bitwiseAND(F.lit(mask).cast("long")).alias("hit"))
    counted = judged.groupBy("hit").agg(F.count(F.lit(1)).alias("docs"))
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.lit(1 << order.index(n)).cast("long").alias("bit")) for n in names)))
    spread = counted.select("hit", "docs", each.alias("r")).select("hit", "docs", "r.rule", "r.bit")
    on = F.col("hit").bitwiseAND(F.col("bit")) != 0
    only = F.col("hit") == F.col("bit")
    return spread.groupBy("rule").agg(
        F.sum(F.when(on, F.col("docs")).otherwise(0)).alias("n_failing"),
        F.sum(F.when(only, F.col("docs")).otherwise(0)).alias("n_only"),
        F.sum(F.when(only | (F.col("hit") == 0), F.col("docs")).otherwise(0)).alias("n_kept_without"),
    )


def judged(documents: DataFrame, version: int = 2) -> DataFrame:
    """The ledger with `base_failed` (policy 1) and `kept` (`version`)."""
    base = apply_policy(ledger(documents), 1).withColumnRenamed("kept", "base_kept")
    both = apply_policy(base, version)
    return both.withColumn("kept", F.col("kept") & F.col("base_kept")).withColumn("base_failed", ~F.col("base_kept")).drop("base_kept")
