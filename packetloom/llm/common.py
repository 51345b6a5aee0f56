"""Shared helpers: the shared scratch folder, written intermediate tables, and Arrow word splitting."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of an Arrow batch. Spark's own bound is ARROW_DEFAULT, which long texts reach in the JVM and in every worker.
ARROW_BYTES, ARROW_DEFAULT = 4 << 20, 64 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by ARROW_BYTES; a bound that the user has set stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key).rstrip("b") == str(ARROW_DEFAULT):
        spark.conf.set(key, str(ARROW_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where it is unset, a temporary one, in local mode alone."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write the rows to the shared folder and read them back: lineage ends there, and lost executors cost no rework."""
    spark = df.sparkSession
    path = new_table_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_KEPT: dict[str, dict] = {}


def kept(kind: str) -> dict:
    """What a worker process keeps between tasks for one kind of work; what it kept for another kind is given up.

    Workers outlive stages, so without this the caches of one stage would stand beside the memory of the next.
    """
    if kind not in _KEPT:
        _KEPT.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        _KEPT[kind] = {}
    return _KEPT[kind]


#: Most bits of a filter: 64 MB, enough for 50 million keys at one wrong answer in 100. More keys only raise that share.
BLOOM_BITS = 1 << 29
BLOOM_HASHES = 3


def bloom_test(keys: DataFrame):
    """A column function: whether a long is perhaps among ``keys`` (one long column). It is never wrong for a key that is.

    The words of the filter are made by a grouped aggregation and broadcast, at most BLOOM_BITS of them.
    """
    keys = keys.toDF("key").where("key is not null")
    bits = min(BLOOM_BITS, 1 << max(16, (10 * keys.count()).bit_length()))
    low, high = F.col("key").bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned("key", 32)
    slots = F.explode(F.array(*((low + high * k).bitwiseAND(bits - 1) for k in range(BLOOM_HASHES))))
    words = keys.select(slots.alias("slot")).groupBy(F.shiftright("slot", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("word")).toArrow()
    table = np.zeros(bits // 64, np.int64)
    table[words["at"].to_numpy()] = words["word"].to_numpy()
    shared = keys.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def perhaps(found: pd.Series) -> pd.Series:
        given, words = found.to_numpy(np.uint64), shared.value.view(np.uint64)
        low, high, out = given & np.uint64(0xFFFFFFFF), given >> np.uint64(32), np.ones(len(found), bool)
        for k in range(BLOOM_HASHES):
            slot = (low + high * np.uint64(k)) & np.uint64(64 * len(words) - 1)
            out &= (words[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)
        return pd.Series(out)

    return perhaps


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fold(doc_id, folds: int = 5):
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def slices(batch: pa.RecordBatch, column: int, rows: int = 256, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of at most ``rows`` rows, cut sooner where the texts of ``column`` reach ``most_bytes``; a longer text stands alone."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        fits = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most_bytes, "right"))
        end = min(max(fits, at + 1), at + rows, batch.num_rows)
        yield batch.slice(at, end - at)
        at = end


def split_words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a batch of texts (null: none) as codes into a dictionary.

    Returns codes (int32, all words in order), offsets (int64, one more than texts) and the dictionary.
    """
    # No cast here: kernels misread the offsets of a slice that was cast to large_string.
    texts = pc.fill_null(texts, "")
    if lower:
        texts = pc.ascii_lower(texts)
    parts = pc.ascii_split_whitespace(texts)
    if isinstance(parts, pa.ChunkedArray):
        parts = parts.combine_chunks()
    words = parts.flatten()
    bounds = np.asarray(parts.offsets).astype(np.int64)
    bounds = bounds - bounds[0]
    real = np.asarray(pc.greater(pc.binary_length(words), 0))
    before = np.concatenate([[0], np.cumsum(real)])
    coded = words.filter(pa.array(real)).dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    return np.asarray(coded.indices).astype(np.int32), before[bounds], coded.dictionary
