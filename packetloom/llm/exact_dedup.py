"""Exact deduplication by a tree-merge of sorted digest runs.

Each partition reads its texts once and keeps a digest of each. Its rows, sorted by digest, are merged into a run: one
entry for each digest, with the row that would stay and a count. Runs then meet in rounds. A run's address is written
in digits of base ``FAN_IN``; in round r the nodes whose addresses differ in digit r alone exchange parts of their runs,
so that each gets the digests whose own digit r is its address's, from all of them, and merges these sorted parts into
one. After the last round a node has all entries of its digests. A node gets one entry of a digest from each run that
meets there, so a text that a third of all rows share is merged in the tree like any other.

Entries are taken for equal only if the SHA-256, the length and a second, unrelated hash of the texts agree, at each
level. Texts themselves are never shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.llm.common import slices, small_batches, written

#: Runs that meet in a node in one round.
FAN_IN = 8
#: Most rounds: 8 ** 4 nodes.
MOST_ROUNDS = 4
#: Bytes that don't count; none of them is part of another character in UTF-8.
BLANKS = b"\t\n\x0b\x0c\r "

#: What makes two texts the same.
SAME = ("digest", "size", "check")
ENTRY = "node long, digest binary, size long, check long, n_chars long, keep_id long, keep_row long, n long"
_ENTRY = pa.schema([(c.split()[0], pa.binary() if c.endswith("binary") else pa.int64()) for c in ENTRY.split(", ")])
ROW = "doc_id long, n_chars long, digest binary, size long, check long"
_ROW = pa.schema([(c.split()[0], pa.binary() if c.endswith("binary") else pa.int64()) for c in ROW.split(", ")])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, 1, rows=4096):
            texts = pc.fill_null(part.column(1), "")
            data = [x.translate(None, BLANKS) for x in texts.cast(pa.binary()).to_pylist()]
            columns = [
                part.column(0), pc.utf8_length(texts).cast(pa.int64()), pa.array([hashlib.sha256(x).digest() for x in data], pa.binary()),
                pa.array(map(len, data), pa.int64()), pa.array(np.fromiter((xxhash.xxh3_64_intdigest(x) for x in data), np.uint64, len(data)).view(np.int64)),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=_ROW)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One entry for each node and text of rows sorted by both and by who stays: the first row, and the sum of the counts."""
    held: pa.RecordBatch | None = None
    for batch in batches:
        batch = pa.RecordBatch.from_arrays(batch.columns, schema=_ENTRY)
        rows = pa.Table.from_batches([batch] if held is None else [held, batch], schema=_ENTRY).combine_chunks()
        if not rows.num_rows:
            continue
        differs = np.zeros(rows.num_rows - 1, bool)
        for name in ("node", *SAME):
            x = rows.column(name).combine_chunks()
            differs |= np.asarray(pc.not_equal(x[1:], x[:-1]))
        first = np.concatenate([[0], 1 + np.flatnonzero(differs)])
        sums = np.add.reduceat(rows.column("n").to_numpy(), first)
        merged = rows.take(pa.array(first)).set_column(rows.schema.get_field_index("n"), _ENTRY.field("n"), pa.array(sums, pa.int64()))
        merged = merged.combine_chunks().to_batches()[0]
        yield merged.slice(0, merged.num_rows - 1)
        held = merged.slice(merged.num_rows - 1)
    if held is not None:
        yield held


def merged_run(entries: DataFrame) -> DataFrame:
    """The entries of each partition as one sorted run; the row of most code points, then of the smallest id, stands for its text."""
    order = ["node", *SAME, F.desc("n_chars"), F.asc_nulls_last("keep_id"), "keep_row"]
    return entries.select(*_ENTRY.names).sortWithinPartitions(*order).mapInArrow(_merge, ENTRY)


def round_address(step: int) -> Column:
    """The node that gets an entry in round ``step``: its address with digit ``step`` taken from the digest."""
    place = FAN_IN**step
    number = "cast(conv(hex(substring(digest, 1, 7)), 16, 10) as bigint)"
    return F.expr(f"node + ({number} div {place} % {FAN_IN} - node div {place} % {FAN_IN}) * {place}")


def tree_merge(runs: DataFrame, rounds: int) -> DataFrame:
    """One entry for each text of all ``runs``, by ``rounds`` exchanges among FAN_IN ** rounds nodes."""
    nodes = FAN_IN**rounds
    runs = runs.withColumn("node", F.col("node") % nodes)
    for step in range(rounds):
        moved = runs.withColumn("node", round_address(step))
        runs = merged_run(moved.repartitionById(nodes, F.col("node").cast("int")))
    return runs


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """Which rows of ``docs`` (``doc_id``, ``text``) stay when texts that differ in blanks alone are one.

    Returns one row for each row: ``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``. A null text counts as
    empty; all empty and blank texts are one group. Of a group the row of most code points stays, then that of the
    smallest ``doc_id``, null ids last; of rows equal in all that, exactly one is ``kept``. An empty table gives no rows;
    other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = plain.mapInArrow(_digests, ROW).withColumn("row", F.monotonically_increasing_id())
    rows = written(found, "exact-rows")  # from here on a row's number is fixed, whatever executor is lost
    part = F.shiftright("row", 33)
    entries = rows.select(part.alias("node"), *SAME, "n_chars", F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row"), F.lit(1).cast("long").alias("n"))
    runs = written(merged_run(entries), "exact-runs")
    parts = runs.agg(F.max("node")).first()[0]
    rounds = 1
    while rounds < MOST_ROUNDS and FAN_IN**rounds <= (parts or 0):
        rounds += 1
    shared = tree_merge(runs, rounds).where("n > 1").select(*SAME, "keep_id", "keep_row", F.col("n").alias("group_size"))
    # Back the same way: to the runs first, so that the rows of one large group stay in as many places as they came from.
    answers = runs.select("node", *SAME).join(shared, list(SAME)).dropDuplicates(["node", *SAME])
    joined = rows.withColumn("node", part).join(answers, ["node", *SAME], "left")
    single = F.col("group_size").isNull()
    return joined.select(
        "doc_id", F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (single | (F.col("row") == F.col("keep_row"))).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )
