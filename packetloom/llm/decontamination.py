"""Benchmark decontamination by the q-gram lemma.

A text region within ``e`` edits of a passage of ``m`` characters shares at least ``m - q + 1 - q * e`` q-grams with it,
all on diagonals (text position minus passage position) that span at most ``e + 1``. Documents are streamed against
an index of the items' q-grams: hits are counted in overlapping diagonal bands, bands that reach the bound are kept,
and a banded alignment verifies them. Texts are never shuffled; a benchmark of up to ``BLOCK_CHARS`` takes one pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.llm.common import small_batches

Q = 8
#: Edits allowed for each character of a passage.
EDIT_RATE = 0.08
#: Normalized passages under so many characters are searched for exactly, between borders of words.
MIN_CHARS = 32
#: Shorter ones yet are not distinctive and are left out; a character of a script without spaces counts twice.
LEAST_WEIGHT = 2 * Q
#: Items of up to LONG_CHARS are one passage. Of longer ones each stretch of PIECE_CHARS, one every PIECE_STEP characters
#: and one at the end, is a passage, so each quote of PIECE_CHARS + PIECE_STEP - 1 characters holds one; passages found
#: side by side are one region. The index holds each character once.
LONG_CHARS, PIECE_CHARS, PIECE_STEP = 600, 300, 100
#: Characters of items in a block: its index takes about 250 MB at most. An item stays in one block.
BLOCK_CHARS = 10_000_000

FOUND = "doc_id long, item_id long, start long, end long, edits int"
_FOUND = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32())])
MIX = np.uint64(0x9E3779B97F4A7C15)
FOLDED = np.array([ord(c) if len(c := chr(k).lower()) == 1 and c.isalnum() else 32 for k in range(1 << 16)], np.uint32)


def normalized(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters and digits with single spaces between, as code points, and where each stood."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    codes = np.where(points < 1 << 16, FOLDED[np.minimum(points, (1 << 16) - 1)], points)
    space = codes == 32
    keep = ~space
    keep[1:] |= space[1:] & ~space[:-1]
    at = np.flatnonzero(keep)
    return codes[at], at


def unspaced(codes: np.ndarray) -> np.ndarray:
    """Which code points are of scripts without spaces between words (kana, ideographs and what stands after them)."""
    return (codes >= 0x2E80) & ~((codes >= 0xAC00) & (codes < 0xD7B0))


def qgrams(codes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each window of Q codes, by doubling."""
    have, n, step = codes.astype(np.uint64) + np.uint64(1), 1, np.array([MIX])
    while n < Q:
        if len(have) <= n:
            return np.zeros(0, np.uint64)
        have = have[:-n] * step + have[n:]
        step, n = step * step, 2 * n
    return have * MIX


class PassageIndex:
    """The q-grams of a block of items."""

    def __init__(self, items: list[tuple[int, str]]):
        self.item: list[int] = []  # of each kept item: its id and codes
        self.codes: list[np.ndarray] = []
        owner, start, size = [], [], []
        self.first_piece = []
        for item_id, text in items:
            codes = normalized(text)[0]
            edge = np.flatnonzero(codes != 32)[[0, -1]] if (codes != 32).any() else (0, -1)
            codes = codes[edge[0] : edge[1] + 1]
            if len(codes) < MIN_CHARS and (len(codes) < Q or len(codes) + unspaced(codes).sum() < LEAST_WEIGHT):
                continue
            self.first_piece.append(len(owner))
            last = len(codes) - PIECE_CHARS
            starts = [0] if len(codes) <= LONG_CHARS else [*range(0, last, PIECE_STEP), last]
            owner += [len(self.item)] * len(starts)
            start += starts
            size += [min(len(codes), LONG_CHARS) if len(starts) == 1 else PIECE_CHARS] * len(starts)
            self.item.append(item_id)
            self.codes.append(codes.astype(np.uint32))
        self.first_piece = np.array([*self.first_piece, len(owner)], np.int64)
        # Of each passage: its item, where it starts there, its length, its edits and the hits that it needs.
        self.owner, self.start, self.size = (np.array(x, np.int64) for x in (owner, start, size))
        self.edits = np.where(self.size >= MIN_CHARS, (EDIT_RATE * self.size).astype(np.int64), 0)
        self.least = self.size - Q + 1 - Q * self.edits
        grams = [qgrams(c) for c in self.codes]
        flat = np.concatenate([np.zeros(0, np.uint64), *grams])
        order = np.argsort(flat, kind="stable")
        counts = [len(g) for g in grams]
        self.gram_item = np.repeat(np.arange(len(grams), dtype=np.int32), counts)[order]
        self.gram_offset = np.concatenate([np.zeros(0, np.int32), *(np.arange(n, dtype=np.int32) for n in counts)])[order]
        self.grams = flat[order]
        self.shift = np.uint64(64 - min(27, max(22, (32 * len(flat)).bit_length())))
        self.table = np.zeros(1 << (64 - int(self.shift)), bool)
        self.table[self.grams >> self.shift] = True

    def in_passages(self, at: np.ndarray, item: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(passage, diagonal) of each hit in each passage that holds its q-gram."""
        first, count = self.first_piece[item], np.diff(self.first_piece)[item]
        long = count > 1
        found = [(first[~long], at[~long] - offset[~long])]
        first, count, at, offset = first[long], count[long], at[long], offset[long]
        for back in range(-(-PIECE_CHARS // PIECE_STEP) if len(at) else 0):
            k = offset // PIECE_STEP - back
            good = (k >= 0) & (k < count - 1) & (offset + Q <= k * PIECE_STEP + PIECE_CHARS)
            found.append((first[good] + k[good], at[good] - offset[good] + k[good] * PIECE_STEP))
        last = first + count - 1
        start = self.start[last] if len(last) else last
        good = offset >= start
        found.append((last[good], at[good] - offset[good] + start[good]))
        return np.concatenate([p for p, _ in found]), np.concatenate([d for _, d in found])

    def bands(self, codes: np.ndarray) -> list[tuple[int, int, int]]:
        """(passage, first diagonal, last diagonal) of the bands that reach the lemma's bound."""
        grams = qgrams(codes)
        at = np.flatnonzero(self.table[grams >> self.shift])
        low, high = np.searchsorted(self.grams, grams[at], "left"), np.searchsorted(self.grams, grams[at], "right")
        n = high - low
        if not n.sum():
            return []
        posting = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        passage, diagonal = self.in_passages(np.repeat(at, n), self.gram_item[posting].astype(np.int64), self.gram_offset[posting].astype(np.int64))
        band = (diagonal + LONG_CHARS) // (self.edits[passage] + 1)
        bands = np.int64(len(codes) + 2 * LONG_CHARS + 2)
        keys, counts = np.unique(np.concatenate([passage * bands + band, passage * bands + np.maximum(band - 1, 0)]), return_counts=True)
        passage, band = keys // bands, keys % bands
        good = counts >= self.least[passage]
        passage, band = passage[good], band[good]
        width = self.edits[passage] + 1
        low = band * width - LONG_CHARS
        return list(zip(passage.tolist(), low.tolist(), (low + 2 * width - 1).tolist(), strict=True))

    @staticmethod
    def bordered(text: np.ndarray, start: int, end: int) -> bool:
        """Whether no word goes on over either end of the region."""
        for at in (start, end):
            if 0 < at < len(text) and 32 not in text[at - 1 : at + 1] and not unspaced(text[at - 1 : at + 1]).any():
                return False
        return True

    def align(self, pattern: np.ndarray, budget: int, text: np.ndarray, low: int, high: int) -> tuple[int, int, int] | None:
        """(edits, start, end) of the best region for the pattern on diagonals low..high, if within its budget."""
        m = len(pattern)
        for d in range(max(low, 0), min(high, len(text) - m) + 1):
            if text[d] == pattern[0] and np.array_equal(text[d : d + m], pattern) and (m >= MIN_CHARS or self.bordered(text, d, d + m)):
                return 0, d, d + m
        if m < MIN_CHARS:
            return None
        low, high = low - budget, high + budget
        width, n = high - low + 1, len(text)
        unit, steps = 1 << 40, np.arange(width, dtype=np.int64) << 40
        outside = np.int64((m + width + 2) * unit)
        # A cell holds edits * 2**40 + start; cell k of row r ends at text position r + low + k.
        cells = np.arange(low, high + 1, dtype=np.int64)
        cells = np.where((cells >= 0) & (cells <= n), cells, outside)
        padded = np.full(n + 2 * (width + m) + abs(low) + 2, 0xFFFFFFFF, np.uint32)
        shift = max(0, -low) + 1
        padded[shift : shift + n] = text
        for r in range(1, m + 1):
            a = r - 1 + low + shift
            moved = cells + np.where(padded[a : a + width] == pattern[r - 1], 0, unit)
            moved[:-1] = np.minimum(moved[:-1], cells[1:] + unit)
            cells = np.minimum.accumulate(moved - steps) + steps
            ends = r + low
            if ends < 0:
                cells[: min(width, -ends)] = outside
            if ends + width - 1 > n:
                cells[max(0, n - ends + 1) :] = outside
            if cells.min() >= (budget + 1) * unit:
                return None
        k = int(np.argmin(cells))
        return int(cells[k]) // unit, int(cells[k]) % unit, m + low + k

    def regions(self, codes: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(edits, item, start, end) of every passage found; those of a long item that follow each other are one region."""
        hits, long = [], {}
        for passage, low, high in self.bands(codes):
            own, a = int(self.owner[passage]), int(self.start[passage])
            pattern = self.codes[own][a : a + int(self.size[passage])]
            if got := self.align(pattern, int(self.edits[passage]), codes, low, high):
                if self.first_piece[own + 1] - self.first_piece[own] == 1:
                    hits.append((got[0], own, *got[1:]))
                else:
                    long.setdefault(own, set()).add((got[1], a, got[2], got[0]))
        for own, found in long.items():
            chains: list[list[tuple[int, int, int, int]]] = []
            for hit in sorted(found):
                chain = next((c for c in chains if c[-1][1] <= hit[1] <= c[-1][1] + PIECE_CHARS and hit[0] <= c[-1][2]), None)
                chain.append(hit) if chain else chains.append([hit])
            hits += [(*self.chained(own, chain, codes),) for chain in chains]
        return hits

    def chained(self, own: int, chain: list[tuple[int, int, int, int]], codes: np.ndarray) -> tuple[int, int, int, int]:
        """The region of passages that follow each other, with the edits of the whole stretch of the item."""
        first, last = chain[0][1], chain[-1][1] + PIECE_CHARS
        start, end = chain[0][0], max(x[2] for x in chain)
        worst = sum(x[3] for x in chain) + abs((end - start) - (last - first))
        if worst:
            shift = [x[0] - (x[1] - first) for x in chain]
            if got := self.align(self.codes[own][first:last], worst, codes, min(shift), max(shift)):
                return got[0], own, got[1], got[2]
        return worst, own, start, end

    def search(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item, start, end, edits) in the text, best first where regions for one item overlap."""
        codes, at = normalized(text or "")
        if len(codes) < Q:
            return []
        hits = [(edits, self.item[own], int(at[start]), int(at[max(start, end - 1)]) + 1) for edits, own, start, end in self.regions(codes)]
        out: list[tuple[int, int, int, int]] = []
        for edits, item, start, end in sorted(set(hits)):
            if all(item != x[0] or end <= x[1] or start >= x[2] for x in out):
                out.append((item, start, end, edits))
        return out


def shared_indexes(spark: SparkSession, benchmark: DataFrame) -> Iterator[Broadcast]:
    """The index of each block of items, broadcast one after another; a block is bounded, and most benchmarks are one."""
    small_batches(spark)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where(F.length("text") >= Q)
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-chars // BLOCK_CHARS)
    for block in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        yield spark.sparkContext.broadcast(PassageIndex(sorted(tuple(r) for r in own.toLocalIterator())))


def find_passages(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Regions of ``docs`` (``doc_id``, ``text``) within the edit budget of a passage of ``benchmark`` (``item_id``, ``text``).

    Returns one row for each region: doc_id, item_id, start, end (code points of the text, end exclusive) and edits.
    Case, punctuation and white space count for nothing. Items of over LONG_CHARS are found wherever PIECE_CHARS +
    PIECE_STEP - 1 characters of them stand; a longer stretch, or the whole item, is still one region. Items under
    MIN_CHARS are found where they stand exactly; null ones and those under LEAST_WEIGHT are not searched for. Null or
    empty texts hold no region; equal items each find their own; repeated documents and null ids each have their rows;
    either table may be empty; other columns are not read.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = spark.createDataFrame([], FOUND)
    for shared in shared_indexes(spark, benchmark):

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                rows = [(i, *hit) for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for hit in index.search(text)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_FOUND)], schema=_FOUND)

        out = out.unionAll(docs.mapInArrow(search, FOUND))
    return out


def leak_test(shared: Broadcast):
    @F.pandas_udf("boolean")
    def leaks(texts: pd.Series) -> pd.Series:
        return pd.Series([bool(shared.value.search(t)) for t in texts], dtype=bool)

    return leaks


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without any region that ``find_passages`` finds, with all their columns.

    Null and empty texts stay; rows are judged by their own text, so repeated and null ids make no difference.
    """
    for shared in shared_indexes(docs.sparkSession, benchmark):
        docs = docs.where(~leak_test(shared)(F.col("text").cast("string")))
    return docs
