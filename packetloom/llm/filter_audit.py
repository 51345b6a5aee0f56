"""Filter interaction audit: what each of five filters removes in every order of the five, by Lehmer-rank difference arrays.

A document is its failure mask, and documents are counted by part and mask. The orders are ranked as permutations in
lexicographic order (their Lehmer code), so all orders that begin alike are an interval of ranks. A mask is removed at
step s by filter x in just the orders that begin with s - 1 filters it passes and then x; these intervals, merged where
they meet, depend on nothing but the mask. Each count is added at the start of its mask's intervals and taken off at
their ends, and a prefix sum over the 120 ranks gives the removals of every order at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packetloom.llm.common import slices, small_batches, split_words, written

FILTERS = "ABCDE"
ORDERS = factorial(len(FILTERS))
MIN_WORDS = 100
SYMBOLS = b"#$%&*|"
#: Bits of a mask: filter k is bit k. COPY is filter E, which the first row of each text passes.
COPY = 1 << FILTERS.index("E")
COUNTED = ("n", "good", "toxic")

FACT = "doc_id long, part string, digest binary, mask int"
_FACT = pa.schema([("doc_id", pa.int64()), ("part", pa.string()), ("digest", pa.binary()), ("mask", pa.int32())])


@cache
def order_of(rank: int) -> str:
    """The order of this rank: its Lehmer code's digits pick from the letters that are left."""
    left, out = list(FILTERS), ""
    for k in range(len(FILTERS) - 1, -1, -1):
        digit, rank = divmod(rank, factorial(k))
        out += left.pop(digit)
    return out


def rank_of(start: tuple[int, ...]) -> int:
    """The rank of the first order that begins with these filters."""
    return sum(sum(y < x and y not in start[:k] for y in range(len(FILTERS))) * factorial(len(FILTERS) - 1 - k) for k, x in enumerate(start))


@cache
def intervals() -> tuple[tuple[int, int, int, int], ...]:
    """(mask, step, first rank, rank after the last): the orders in which step removes the mask; fewer than 900 rows."""
    found: list[tuple[int, int, int, int]] = []
    for mask in range(1, 1 << len(FILTERS)):
        passed = [k for k in range(len(FILTERS)) if not mask >> k & 1]
        failed = [k for k in range(len(FILTERS)) if mask >> k & 1]
        for step in range(1, len(passed) + 2):
            size = factorial(len(FILTERS) - step)
            starts = sorted(rank_of((*before, x)) for before in permutations(passed, step - 1) for x in failed)
            for start in starts:
                if found and found[-1][:2] == (mask, step) and found[-1][3] == start:
                    found[-1] = (*found[-1][:3], start + size)
                else:
                    found.append((mask, step, start, start + size))
    return tuple(found)


def in_texts(data: np.ndarray, bounds: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """How many bytes of each text are ``wanted`` (a table of 256)."""
    return np.diff(np.searchsorted(np.flatnonzero(wanted[data]), bounds))


CAPITAL, SYMBOL = np.zeros(256, bool), np.zeros(256, bool)
CAPITAL[ord("A") : ord("Z") + 1] = True
SYMBOL[list(SYMBOLS)] = True


def masks(texts: pa.Array) -> np.ndarray:
    """Failures of A to D of each text as bits."""
    codes, bounds, words = split_words(texts)
    n_words = np.diff(bounds)
    owner = np.repeat(np.arange(len(texts)), n_words)
    distinct = np.bincount(np.unique(owner * max(len(words), 1) + codes) // max(len(words), 1), minlength=len(texts))
    data = b"".join(texts.cast(pa.binary()).to_pylist())
    ends = np.concatenate([[0], np.cumsum(np.asarray(pc.binary_length(texts)).astype(np.int64))])
    raw = np.frombuffer(data, np.uint8)
    failed = (
        n_words < MIN_WORDS,
        100 * distinct < 80 * n_words,
        100 * in_texts(raw, ends, CAPITAL) > 10 * np.asarray(pc.utf8_length(texts)).astype(np.int64),
        in_texts(raw, ends, SYMBOL) > 0,
    )
    return sum((x.astype(np.int32) << k for k, x in enumerate(failed)), np.zeros(len(texts), np.int32))


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, 2, rows=1024):
            texts = pc.fill_null(part.column(2), "")
            digests = pa.array([hashlib.sha256(x).digest() for x in texts.cast(pa.binary()).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1).cast(pa.string()), digests, pa.array(masks(texts))], schema=_FACT)


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents (``n``), those of quality 1 (``good``) and toxic ones (``toxic``) for each part and mask.

    Rows that have a text's smallest ``doc_id`` pass filter E. They are found by joining on digest and id together, keys
    that no copies share, and moved from the mask with bit E to the mask without it.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.col("text").cast("string").alias("text"))
    facts = written(plain.mapInArrow(_facts, FACT), "audit-facts")
    flags = labels.where("doc_id is not null and (quality = 1 or toxic = 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    flags = flags.agg(F.coalesce(F.max((F.col("quality") == 1).cast("long")), F.lit(0)).alias("good"), F.coalesce(F.max((F.col("toxic") == 1).cast("long")), F.lit(0)).alias("toxic"))
    first = facts.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    rows = facts.join(first, ["digest", "doc_id"], "left").join(flags, "doc_id", "left")
    alone = F.coalesce(F.col("first"), F.col("doc_id").isNull())
    failed = F.when(alone, F.col("mask")).otherwise(F.col("mask") + COPY)
    counts = rows.groupBy("part", failed.alias("mask")).agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in COUNTED[1:]))
    return written(counts, "audit-counts")


def orders(spark: SparkSession) -> DataFrame:
    """``rank`` and ``filter_order`` of all orders."""
    return spark.createDataFrame([(r, order_of(r)) for r in range(ORDERS)], "rank int, filter_order string")


def removals(counts: DataFrame) -> DataFrame:
    """What each step of each order removes, by part: the prefix sums of the difference arrays, zeros included."""
    spark = counts.sparkSession
    spans = F.broadcast(spark.createDataFrame(list(intervals()), "mask int, step int, start int, stop int"))
    both = F.array(
        F.struct(F.col("start").alias("rank"), *(F.col(c).alias(c) for c in COUNTED)),
        F.struct(F.col("stop").alias("rank"), *((-F.col(c)).alias(c) for c in COUNTED)),
    )
    ends = counts.join(spans, "mask").select("part", "step", F.inline(both)).where(F.col("rank") < ORDERS)
    steps = counts.select("part").distinct().select("part", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    zeros = steps.select("part", "step", F.explode(F.sequence(F.lit(0), F.lit(ORDERS - 1))).alias("rank"), *(F.lit(0).cast("long").alias(c) for c in COUNTED))
    edges = ends.unionByName(zeros).groupBy("part", "step", "rank").agg(*(F.sum(c).alias(c) for c in COUNTED))
    before = Window.partitionBy("part", "step").orderBy("rank")
    return edges.select("part", "step", "rank", *(F.sum(c).over(before).alias(c) for c in COUNTED))


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part (``lang``; null: the empty string), order of the filters and step.

    A null text is an empty one: it has no words, so it fails A and, if not the first of its kind, E. A row of a null id
    is the copy of none and makes none. Rows that repeat an id are counted each; a label that stands there twice counts
    once, for quality and toxicity if any of its rows has them. An empty table gives no rows; other columns aren't read.
    """
    small_batches(docs.sparkSession)
    counts = mask_counts(docs, labels)
    fails = F.array(*(F.sum(F.when(F.col("mask").bitwiseAND(1 << k) != 0, F.col("n")).otherwise(0)) for k in range(len(FILTERS))))
    only = F.array(*(F.sum(F.when(F.col("mask") == 1 << k, F.col("n")).otherwise(0)) for k in range(len(FILTERS))))
    parts = counts.groupBy("part").agg(F.sum("n").alias("total"), fails.alias("fails"), only.alias("only"))
    rows = removals(counts).join(F.broadcast(orders(docs.sparkSession)), "rank").join(parts, "part")
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    rows = rows.withColumn("letter", letter).withColumn("place", F.instr(F.lit(FILTERS), F.col("letter")))
    so_far = Window.partitionBy("part", "rank").orderBy("step")
    return rows.select(
        "part", "filter_order", "step", (F.col("total") - F.sum("n").over(so_far)).alias("kept"), F.col("n").alias("removed"),
        (F.element_at("fails", F.col("place")) - F.col("n")).alias("redundant"), F.element_at("only", F.col("place")).alias("unique_fails"),
        F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), F.sum("n").over(Window.partitionBy("part", "letter")).alias("shapley"),
    )
