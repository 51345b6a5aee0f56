"""Corpus pipeline over ``documents``: toxicity, near-duplicates, benchmark passages, secrets, packing.

Each stage works on all that the one before kept, and its decisions take effect: toxic documents go, one document of
each group of near-duplicates stays, documents with a benchmark passage go, secrets are masked, and what is left is
packed. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.llm import decontamination, near_dedup, packing, secret_scan, toxicity
from packetloom.llm.common import documents, written


#: Words whose ids a worker keeps while it packs; the other stages' memory stands beside them.
PACKING_WORDS = 200_000


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the toxicity model doesn't reject. Null and empty texts and null or repeated ids are rows like any
    other; without labels of both kinds the model is a constant, which rejects nothing unless most labels are toxic."""
    return toxicity.reject_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with a number ``row`` of its own for each row, in order of ``doc_id``, null ids last."""
    order = [F.col("doc_id").asc_nulls_last(), F.col("row")]
    dealt = docs.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    return written(dealt.withColumn("row", F.monotonically_increasing_id()), "numbered")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component, that of the smallest id; rows that repeat an id or have none are judged one by one.

    So a text of its own stays whatever other text has its id, and equal rows become one. Texts without words, null ones
    among them, are duplicates of nothing: each of their rows stays. An empty table gives none.
    """
    if not docs.groupBy("doc_id").count().where("doc_id is null or count > 1").isEmpty():
        rows = numbered(docs)
        judged = near_dedup.near_duplicates(rows.select(F.col("row").alias("doc_id"), "text"))
        dropped = written(judged.where(~F.col("kept")).select(F.col("doc_id").alias("id")), "near-duplicates")
        return near_dedup.without(rows, dropped, "row").select(*docs.columns)
    judged = near_dedup.near_duplicates(docs)
    dropped = written(judged.where(~F.col("kept")).select(F.col("doc_id").alias("id")).distinct(), "near-duplicates")
    return near_dedup.without(docs, dropped, "doc_id")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows without a region of a benchmark item; each is judged by its own text, and null or empty texts stay."""
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with the secrets of their texts masked and ``n_chars`` counted anew where one was."""
    return secret_scan.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of all rows; a null or empty text is its end alone, and repeated ids are packed as they stand."""
    return packing.pack_documents(docs, cached=PACKING_WORDS)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("packing", pack),
]
#: Trained scores, minima and token ids have no SQL; tests/llm compares the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for turn, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if turn < len(STAGES):
            docs = written(docs, f"pipeline-{name}")
    return docs
