"""Secret scans over an incremental ledger of content-addressed blobs.

Every version of every document is addressed by the SHA-256 of its text. The ledger is a table of (blob, rule version)
with what was found there; a scan reads only the texts of pairs that the ledger lacks, one text for each blob, and the
findings are joined back to all rows that hold the blob.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from packetloom.llm.common import bloom_test, new_table_path, slices, small_batches, written

RULE_VERSION = "2"
BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)),
    ("access", re.compile(r"AKIA[A-Z0-9]+")),
    ("hex", re.compile(r"[0-9a-f]{24,}")),
)
#: A private key from its BEGIN line through the END line that follows it. Where another line of dashes or the end of the
#: text comes first, its header lines, long runs of key characters and lines of nothing else belong to it.
PEM = re.compile(
    r"""
    -----BEGIN\ (?:[A-Z]+\ )*PRIVATE\ KEY-----
    (?:
        (?:[^-]++|-(?!----))*+ -----END\ (?:[A-Z]+\ )*PRIVATE\ KEY-----
        |
        (?:(?:\s|\\[nrt]|["'`>|\#*,\\])++ [A-Za-z][A-Za-z0-9-]*+ : [^\r\n\\]*+)*+
        (?:
            (?:\s|\\[nrt]|\+(?=\s)|["'`>|\#*,\\])*+ [A-Za-z0-9+/]{20,}+ ={0,2}+
            |
            (?:[ \t\r"'`]|\\r)*+ (?:\n|\\n) (?:[\s"'`>|\#*])*+ [A-Za-z0-9+/]++ ={0,2}+ (?=[\x20\t]*+ (?:[\r\n"'`]|\\[nr]|\Z))
        )++
        (?:[\x20\t]++ (?=[A-Za-z]*[0-9+/=]) [A-Za-z0-9+/]++ ={0,2}+)?+
        |
    )""",
    re.VERBOSE,
)
#: Kinds that the method adds to the base ones: a text must hold the word in the middle to be searched.
ADDED = (
    ("pem", "PRIVATE KEY-----", PEM),
    ("jwt", "eyJ", re.compile(r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+")),
    ("forge", "gh", re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}")),
)
ASSIGN_WORDS = ("passw", "secret", "token", "api")
#: Rows of (id, blob) that may be broadcast: at most about 64 MB.
BROADCAST_ROWS = 1_000_000

FOUND = "blob binary, rule_version string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
_FOUND = pa.schema([
    ("blob", pa.binary()), ("rule_version", pa.string()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()),
])
MASK = "<secret>"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base kinds, leftmost and non-overlapping within each kind."""
    spans = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        spans += [(m.start(), 0, m.end()) for m in BASE[0][1].finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in BASE[1][1].finditer(text) if m.end() - m.start() >= 20]
    spans += [(m.start(), 2, m.end()) for m in BASE[2][1].finditer(text)]
    return sorted(spans)


def scan(text: str) -> tuple[int, int, int, str, str]:
    base = base_spans(text)
    kinds = [k for k, _ in BASE] + [k for k, _, _ in ADDED]
    joined = lambda spans: ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in spans)
    more = [(m.start(), len(BASE) + n, m.end()) for n, (_, word, rx) in enumerate(ADDED) if word in text for m in rx.finditer(text)]
    counts = [sum(k == n for _, k, _ in base) for n in range(3)]
    return (*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(sorted(base + more)))


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in (part for batch in batches for part in slices(batch, 1)):
        rows = [(blob, RULE_VERSION, *scan(text)) for blob, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_FOUND)], schema=_FOUND)


def blob_of(text):
    return F.unhex(F.sha2(text.cast("binary"), 256))


class BlobLedger:
    """A table of what was found in each (blob, rule version), kept at ``path`` and extended by every scan."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        small_batches(spark)
        self.spark, self.path = spark, path or new_table_path(spark, "blob-ledger")
        spark.createDataFrame([], FOUND).write.mode("append").parquet(self.path)

    def entries(self) -> DataFrame:
        """What was found under the present rules; two scans at a time may have written a blob twice."""
        return self.spark.read.schema(FOUND).parquet(self.path).where(F.col("rule_version") == RULE_VERSION)

    def rows(self) -> DataFrame:
        """What was found under the present rules, once for each blob."""
        return self.entries().dropDuplicates(["blob"])

    def findings(self, paths: DataFrame) -> DataFrame:
        """The rows of the blobs of ``paths``, as a table: a join with it can split a blob of very many paths."""
        return written(self.rows().join(paths.select("blob").distinct(), "blob", "left_semi"), "findings")

    def scan_new(self, versions: DataFrame, paths: DataFrame) -> None:
        """Scan one text of each blob of ``versions`` (id, text, blob) that the ledger lacks; paths: its (id, blob).

        Texts are scanned where they are read and never shuffled. Rows to skip (known blobs and repeats) are broadcast
        while they are few. Beyond that a filter of them is, and due rows that it keeps back by mistake are scanned in a
        second pass, behind a filter of those.
        """
        due = paths.groupBy("blob").agg(F.min("id").alias("id")).join(self.entries().select("blob"), "blob", "left_anti")
        due = written(due, "blobs-due")
        same = lambda a, b: (a["blob"] == b["blob"]) & a["id"].eqNullSafe(b["id"])
        skipped = written(paths.distinct().join(due, same(paths, due), "left_anti"), "blobs-skipped")
        if skipped.count() <= BROADCAST_ROWS:
            self._scan(versions.join(F.broadcast(skipped), same(versions, skipped), "left_anti"))
            return
        key = F.xxhash64("id", "blob")
        self._scan(versions.where(~bloom_test(skipped.select(key))(key)))
        missed = written(due.join(self.entries().select("blob"), "blob", "left_anti"), "blobs-missed")
        if missed.limit(1).count():
            self._scan(versions.where(bloom_test(missed.select(key))(key)), missed)

    def _scan(self, texts: DataFrame, wanted: DataFrame | None = None) -> None:
        found = texts.select("blob", "text").mapInArrow(_scan_batches, FOUND).dropDuplicates(["blob"])
        found = found if wanted is None else found.join(wanted.select("blob"), "blob", "left_semi")
        found.write.mode("append").parquet(self.path)


def scanned_paths(docs: DataFrame, ledger: BlobLedger) -> DataFrame:
    """(id, blob) of every row of ``docs``, all of whose blobs the ledger knows now."""
    versions = docs.select(F.col("doc_id").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    versions = versions.withColumn("blob", blob_of(F.col("text")))
    paths = written(versions.select("id", "blob"), "blob-paths")
    ledger.scan_new(versions, paths)
    return paths


def scan_secrets(docs: DataFrame, ledger: BlobLedger | None = None) -> DataFrame:
    """Findings for every row of ``docs`` (``doc_id``, ``text``; null text: empty), through the ledger.

    Returns doc_id, n_assign, n_access, n_hex, base_sha256 and spans. Equal texts are scanned once and share their
    findings; repeated rows and null ids come back as often as they stand in ``docs``; an empty table gives none; other
    columns are not read.
    """
    ledger = ledger or BlobLedger(docs.sparkSession)
    paths = scanned_paths(docs, ledger)
    return paths.join(ledger.findings(paths), "blob", "left").select(F.col("id").alias("doc_id"), "n_assign", "n_access", "n_hex", "base_sha256", "spans")


@F.pandas_udf(StringType())
def masked(text: pd.Series, spans: pd.Series) -> pd.Series:
    """The text with every found span replaced; overlapping spans count as one."""

    def mask(text: str, spans: str | None) -> str:
        if not spans:
            return text
        out, at = [], 0
        for start, end in sorted(tuple(map(int, s.split(":")[1:])) for s in spans.split(",")):
            if start >= at:
                out += [text[at:start], MASK]
            at = max(at, end)
        return "".join([*out, text[at:]])

    return pd.Series([mask(t, s) for t, s in zip(text, spans, strict=True)], dtype=object)


def redact(docs: DataFrame, ledger: BlobLedger | None = None) -> DataFrame:
    """``docs`` with all secrets of ``text`` masked and ``n_chars`` (if there) counted anew; no row is dropped.

    Rows without findings, null texts among them, stay as they are; repeated rows and null ids are masked like any
    other; other columns keep their values, also those named like this module's own.
    """
    ledger = ledger or BlobLedger(docs.sparkSession)
    scanned_paths(docs, ledger)
    hits = written(ledger.rows().where("spans <> ''").select(F.col("blob").alias("hit_blob"), F.col("spans").alias("hit_spans")), "secret-hits")
    n, chars = hits.agg(F.count("*"), F.coalesce(F.sum(F.length("hit_spans")), F.lit(0))).first()
    rows = docs.select(F.struct("*").alias("doc"))
    blob = blob_of(F.coalesce(F.col("doc.text"), F.lit("")))
    if n <= BROADCAST_ROWS // 4 and chars < 64_000_000:
        joined = rows.join(F.broadcast(hits), blob == F.col("hit_blob"), "left")
    else:
        # Only texts that a filter of the hits can't clear are shuffled.
        perhaps = bloom_test(hits.select(F.xxhash64("hit_blob")))(F.xxhash64(blob))
        clean = rows.where(~perhaps).select("doc", F.lit(None).cast("binary").alias("hit_blob"), F.lit(None).cast("string").alias("hit_spans"))
        joined = clean.unionAll(rows.where(perhaps).join(hits, blob == F.col("hit_blob"), "left"))
    found = F.col("hit_spans").isNotNull()
    joined = joined.withColumn("masked", F.when(found, masked(F.coalesce("doc.text", F.lit("")), "hit_spans")).otherwise(F.col("doc.text")))
    new = {"text": F.col("masked"), "n_chars": F.when(found, F.length("masked").cast("long")).otherwise(F.col("doc.n_chars")) if "n_chars" in docs.columns else None}
    return joined.select(*((new[c] if c in new else F.col("doc")[c]).alias(c) for c in docs.columns))
