"""Hierarchical residual packing of token pieces into sequences of a fixed capacity.

Each partition packs its own pieces by best fit and emits the bins that are nearly full. Underfull bins become items of
the next round, where groups of partitions merge as in a tree, until one group is left or merging no longer shrinks
what is left. A group never holds more than ``GROUP_ROWS`` pieces on average, so no task grows with the corpus.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm.bestfit import best_fit_decreasing
from packetloom.llm.common import slices, small_batches, written
from packetloom.llm.tokens import CACHED_WORDS, default_vocabulary, encoder

CAPACITY = 4096
END_ID = 1
NEARLY_FULL = 0.998
GROUP_ROWS = 200_000
FAN_IN = 8
LOCAL_ROWS = 500_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECES}, sequence_id long, offset long, fill long"
_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
_PACKED = pa.schema([*_PIECES, ("sequence_id", pa.int64()), ("offset", pa.int64()), ("fill", pa.int64())])


def piece_bounds(bounds: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each piece of texts with the given bounds in their ids: its text, its number and where its ids start."""
    counts = -(-np.diff(bounds) // capacity)
    text = np.repeat(np.arange(len(counts)), counts)
    piece = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    return text, piece, bounds[text] + piece * capacity


def pieces_of(doc_ids: pa.Array, ids: np.ndarray, bounds: np.ndarray, capacity: int) -> pa.Table:
    """One row for each piece of each encoded document, in order."""
    text, piece, first = piece_bounds(bounds, capacity)
    length = np.minimum(bounds[text + 1] - first, capacity)
    data = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
    crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(first.tolist(), (first + length).tolist(), strict=True)]
    columns = [doc_ids.take(pa.array(text)), pa.array(piece, pa.int32()), pa.array(piece * capacity), pa.array(length), pa.array(crc, pa.int64())]
    return pa.Table.from_arrays(columns, schema=_PIECES)


def with_bins(table: pa.Table, bins: np.ndarray, offsets: np.ndarray, fills: np.ndarray, first_bin: int) -> pa.Table:
    return pa.Table.from_arrays([*(table.column(f.name) for f in _PIECES), pa.array(first_bin + bins), pa.array(offsets), pa.array(fills[bins])], schema=_PACKED)


def _batches(table: pa.Table) -> list[pa.RecordBatch]:
    return table.combine_chunks().to_batches(max_chunksize=50_000)


def pack_documents(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, cached: int = CACHED_WORDS) -> DataFrame:
    """Pack whole documents (``doc_id``, ``text``) into sequences of at most ``capacity`` tokens.

    A document is its ids and ``end_id``; a null or empty text is ``end_id`` alone. Only longer documents are cut, into
    pieces of ``capacity`` with a shorter last one. Repeated rows and null ids are packed like any other row; an empty
    table gives none; other columns are not read. Returns ``PACKED`` rows; ``fill`` is the sequence's token count. A worker
    keeps the ids of ``cached`` words: fewer take less memory and more time.
    """
    small_batches(docs.sparkSession)
    vocabulary = vocabulary or default_vocabulary()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, bin_ = encoder(vocabulary, end_id, cached).encode_flat, TaskContext.get().partitionId() << 36
        held: list[pa.Table] = []
        rows = 0

        def packed() -> pa.Table:
            table = pa.concat_tables(held)
            return with_bins(table, *best_fit_decreasing(np.asarray(table["length"]), capacity), bin_)

        for batch in batches:
            for part in slices(batch, 1, rows=2048):
                held.append(pieces_of(part.column(0), *encode(part.column(1)), capacity))
                rows += held[-1].num_rows
                if rows >= LOCAL_ROWS:
                    yield from _batches(packed())
                    bin_, held, rows = bin_ + rows, [], 0
        if rows:
            yield from _batches(packed())

    return merge_underfull(written(docs.mapInArrow(local, PACKED), "packed-0"), capacity)


def merge_underfull(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Repeated best-fit rounds over underfull bins, in ever fewer groups."""
    full = F.col("fill") >= int(NEARLY_FULL * capacity)
    done, groups, level = [packed.where(full)], None, 0
    while True:
        rest = packed.where(~full)
        rows, bins = rest.agg(F.count("*"), F.count_distinct("sequence_id")).first()
        groups = groups or max(1, rows // 64, 1)
        least = max(1, -(-rows // GROUP_ROWS))
        fewer = max(least, min(groups // FAN_IN, -(-bins // FAN_IN)))
        if bins <= 1 or level and (groups == 1 or fewer >= groups):
            done.append(rest)
            break
        groups, level = fewer, level + 1
        packed = written(_merged(rest, groups, level, capacity), f"packed-{level}")
        done.append(packed.where(full))
    out = done[0]
    for part in done[1:]:
        out = out.union(part)
    return out


def _merged(rest: DataFrame, groups: int, level: int, capacity: int) -> DataFrame:
    names = [f.name for f in _PACKED]

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        table = table.select(names).sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
        ids, first, back = np.unique(np.asarray(table["sequence_id"]), return_index=True, return_inverse=True)
        bins, offsets, fills = best_fit_decreasing(np.asarray(table["fill"])[first], capacity)
        base = (level << 58) + (int(key[0].as_py()) << 36)
        return with_bins(table, bins[back], offsets[back] + np.asarray(table["offset"]), fills, base)

    dealt = rest.withColumn("merge_group", F.pmod(F.xxhash64("sequence_id"), F.lit(groups)))
    return dealt.groupBy("merge_group").applyInArrow(merge, PACKED)
