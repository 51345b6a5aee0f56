"""Packed token-id matrices as binary rows.

Every partition tokenizes its documents, splits overlong ones without loss, packs the pieces by best-fit decreasing
with a segment-tree capacity search and writes the sequences at once, so ids never cross the network. One row is one
line of the id matrix: ``capacity`` little-endian uint16 ids (padded), with the cumulative lengths of its segments and a
bit mask of the positions where position ids start again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm.bestfit import best_fit_decreasing
from packetloom.llm.common import new_table_path, slices, small_batches
from packetloom.llm.packing import piece_bounds
from packetloom.llm.tokens import default_vocabulary, encoder

CAPACITY = 4096
END_ID = 1
PAD_ID = 0
#: Tokens that a task holds before it packs and writes them: 32 MB of ids, 4,000 sequences.
HELD_TOKENS = 16_000_000

MATRIX = (
    "sequence_id long, n_tokens int, n_segments int, ids binary, cu_seqlens array<int>, resets binary, "
    "doc_ids array<long>, pieces array<int>, starts array<long>"
)
_MATRIX = pa.schema([
    ("sequence_id", pa.int64()), ("n_tokens", pa.int32()), ("n_segments", pa.int32()), ("ids", pa.binary()), ("cu_seqlens", pa.list_(pa.int32())),
    ("resets", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("pieces", pa.list_(pa.int32())), ("starts", pa.list_(pa.int64())),
])


#: Lines that are laid out at once: 2M ids.
LINES = 512


class Pieces:
    """Pieces of encoded documents that wait to be packed: their ids in one buffer of uint16, and where each lies in it."""

    def __init__(self):
        self.parts: list[tuple] = []
        self.tokens = 0

    def add(self, doc_ids: pa.Array, ids: np.ndarray, bounds: np.ndarray, capacity: int) -> None:
        if len(ids) and int(ids.max()) > 0xFFFF:
            raise ValueError("the matrices hold ids under 65,536; take a smaller vocabulary")
        text, piece, first = piece_bounds(bounds, capacity)
        length = np.minimum(bounds[text + 1] - first, capacity)
        self.parts.append((doc_ids.take(pa.array(text)), piece.astype(np.int32), first + self.tokens, length, ids.astype("<u2")))
        self.tokens += len(ids)

    def packed(self, capacity: int, first_line: int) -> Iterator[pa.RecordBatch]:
        """Pack all pieces and lay out their lines, some at a time."""
        doc_ids = pa.concat_arrays([x[0] for x in self.parts])
        piece, first, length, ids = (np.concatenate([x[k] for x in self.parts]) for k in range(1, 5))
        bins, offsets, fills = best_fit_decreasing(length, capacity)
        order = np.lexsort((offsets, bins))
        ends = np.cumsum(np.bincount(bins, minlength=len(fills)))
        for low in range(0, len(fills), LINES):
            high = min(low + LINES, len(fills))
            own = order[ends[low - 1] if low else 0 : ends[high - 1]]
            size, place = length[own], (bins[own] - low) * capacity + offsets[own]
            within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            lines = np.full((high - low) * capacity, PAD_ID, "<u2")
            lines[np.repeat(place, size) + within] = ids[np.repeat(first[own], size) + within]
            resets = np.zeros((high - low) * capacity, np.uint8)
            resets[place] = 1
            segments = np.bincount(bins[own] - low, minlength=high - low)
            cuts = np.insert(offsets[own] + size, np.cumsum(segments) - segments, 0)
            listed = lambda values, counts=segments: pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), values)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.arange(first_line + low, first_line + high)), pa.array(fills[low:high], pa.int32()), pa.array(segments, pa.int32()),
                binary_rows(lines.view(np.uint8), high - low), listed(pa.array(cuts, pa.int32()), segments + 1), binary_rows(np.packbits(resets.reshape(high - low, -1), axis=1).ravel(), high - low),
                listed(doc_ids.take(pa.array(own))), listed(pa.array(piece[own], pa.int32())), listed(pa.array(piece[own].astype(np.int64) * capacity)),
            ], schema=_MATRIX)


def binary_rows(data: np.ndarray, rows: int) -> pa.Array:
    """``rows`` binary values of equal length from one buffer."""
    bounds = np.arange(rows + 1, dtype=np.int32) * np.int32(len(data) // rows)
    return pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])


def token_matrices(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Rows of packed id matrices (``MATRIX``) of whole documents.

    A null or empty text is ``end_id`` alone; a document longer than ``capacity`` is cut into pieces of ``capacity`` and
    a rest, and ids, piece numbers and starts give it back exactly. Null and repeated ids are kept as they are; an empty
    table gives no rows; other columns are not read. An id over 65,535 is an error. A task packs what it holds at each
    HELD_TOKENS, so its memory is bounded, and each such time leaves one line in part empty.
    """
    small_batches(docs.sparkSession)
    vocabulary = vocabulary or default_vocabulary()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, first, held = encoder(vocabulary, end_id).encode_flat, TaskContext.get().partitionId() << 36, Pieces()
        for batch in batches:
            for part in slices(batch, 1, rows=2048):
                held.add(part.column(0), *encode(part.column(1)), capacity)
                if held.tokens >= HELD_TOKENS:
                    yield from held.packed(capacity, first)
                    first, held = first + held.tokens, Pieces()
        if held.tokens:
            yield from held.packed(capacity, first)

    return docs.mapInArrow(pack, MATRIX)


def write_token_matrices(docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write the matrices as Parquet with binary columns (by default into the shared folder) and read them back.

    Rows are those of ``token_matrices``; an existing ``path`` is an error.
    """
    spark = docs.sparkSession
    path = path or new_table_path(spark, "token-matrices")
    token_matrices(docs, **options).write.parquet(path)
    return spark.read.schema(MATRIX).parquet(path)


def digest(matrices: DataFrame) -> DataFrame:
    """What a check needs of each sequence, without its ids: their unsigned CRC-32 stands for them."""
    return matrices.select(
        "sequence_id", "n_tokens", "n_segments", F.crc32("ids").alias("ids_crc32"), F.crc32("resets").alias("resets_crc32"), "cu_seqlens", "doc_ids", "pieces", "starts"
    )
