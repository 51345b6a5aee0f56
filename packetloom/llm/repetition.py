"""Repetition rules: how much of a text lies inside n-grams and lines that it repeats.

Words are coded for a batch of texts at once; rolling hashes of all n-gram lengths come from one recurrence over the
batch (hash of n words = hash of n - 1 words times a constant plus the next word's hash). Within each text, equal
hashes mark the repeated windows, and the characters of marked words are summed. There is no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm.common import slices, small_batches, split_words

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
#: Share of word characters inside repeated n-grams above which a text fails, by n.
NGRAM_LIMITS = {5: 0.30, 7: 0.26, 10: 0.20}
#: Share of word characters in lines that repeat an earlier line, above which a text fails.
LINE_LIMIT = 0.30
STEP = np.uint64(0x9E3779B97F4A7C15)

COUNTS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, dup_line_chars long, " + ", ".join(f"dup_{n}gram_chars long" for n in NGRAM_LIMITS)
_COUNTS = pa.schema([(c.split()[0], pa.int64()) for c in COUNTS.split(", ")])


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys stand there twice or more."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def covered(keys: np.ndarray, n: int) -> np.ndarray:
    """Which words lie in an n-word window that is found twice or more (keys: one for each window)."""
    at = np.flatnonzero(repeated(keys))
    edges = np.bincount(at, minlength=len(keys) + n) - np.bincount(at + n, minlength=len(keys) + n)
    return np.cumsum(edges)[: len(keys) + n - 1] > 0


def exact_triples(codes: np.ndarray, words: int) -> np.ndarray:
    """An integer for each 3-word window, equal just where the words are."""
    if len(codes) < 3:
        return np.zeros(0, np.int64)
    c = codes.astype(np.int64)
    pairs = c[:-2] * words + c[1:-1]
    if words >= 1 << 21:
        pairs = np.unique(pairs, return_inverse=True)[1]
    return pairs * words + c[2:]


def line_counts(text: str) -> tuple[int, int]:
    """Lines with a word that repeat an earlier line, and their characters in words."""
    if "\n" not in text:
        return 0, 0
    seen: set[str] = set()
    n = chars = 0
    for line in text.split("\n"):
        if line in seen:
            n += 1
            chars += len(line) - sum(map(line.count, " \t\x0b\x0c\r"))
        elif line.strip(" \t\x0b\x0c\r"):
            seen.add(line)
    return n, chars


def count_batch(ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    codes, bounds, words = split_words(texts)
    chars = np.asarray(pc.utf8_length(words)).astype(np.int64)[codes] if len(words) else np.zeros(0, np.int64)
    hashes = pd.util.hash_array(words.to_numpy(zero_copy_only=False).astype(object), categorize=False)[codes] if len(words) else np.zeros(0, np.uint64)
    rolling, have = {}, hashes
    for n in range(2, max(NGRAM_LIMITS) + 1):
        have = have[:-1] * STEP + hashes[n - 1 :] if len(have) else have
        if n in NGRAM_LIMITS:
            rolling[n] = have
    out: list[tuple] = []
    for k, text in enumerate(texts.to_pylist()):
        a, b = int(bounds[k]), int(bounds[k + 1])
        text, own, n_words = text or "", chars[a:b], b - a
        triples = exact_triples(codes[a:b], len(words))
        row = [n_words, int(own.sum()), sum(map(text.count, SYMBOLS)), *line_counts(text)]
        row.insert(4, int(covered(triples, 3).sum()) if n_words >= 3 else 0)
        for n, keys in rolling.items():
            row.append(int(own[covered(keys[a : b - n + 1], n)].sum()) if n_words >= n else 0)
        out.append(row)
    columns = [ids.cast(pa.int64()), *(pa.array([r[k] for r in out], pa.int64()) for k in range(len(_COUNTS) - 1))]
    return pa.RecordBatch.from_arrays(columns, schema=_COUNTS)


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, 1):
            yield count_batch(part.column(0), part.column(1))


def repetition_rules(docs: DataFrame) -> DataFrame:
    """Counts and verdict for each row of ``docs`` (``doc_id``, ``text``).

    A null or empty text has no words and fails the base rule. Repeated rows and null ids are judged like any other; an
    empty table gives no rows; other columns are not read. ``kept`` is false if the base rule fails (fewer than
    ``MIN_WORDS`` words, or over half of them in repeated 3-word windows) or a share is over its limit.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = docs.mapInArrow(_count_batches, COUNTS)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    over = F.col("dup_line_chars") > LINE_LIMIT * F.col("word_chars")
    for n, most in NGRAM_LIMITS.items():
        over = over | (F.col(f"dup_{n}gram_chars") > most * F.col("word_chars"))
    return counted.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & ~over)
