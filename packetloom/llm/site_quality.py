"""Quality by hierarchical empirical Bayes over hosts and paths.

A logistic model on a text's shape gives each document's own evidence. Evidence and labels are summed by host and by
path in grouped aggregations; a host's quality is shrunk toward the global rate and a path's toward its host's, by
prior strengths that the spread between groups sets (method of moments). A document's score combines the posterior of
its path, in log odds, with its own evidence. Its own label and evidence are left out of the posteriors that it gets, so
they count once. No text is shuffled: only numbers are grouped and joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.llm.common import fold, slices, small_batches, split_words, written

HELD_OUT = 0
#: The sample of labelled rows that the document model is fitted on: at most so many of each label.
SAMPLE_ROWS = 3000
#: Weight of an unlabelled document's evidence beside a labelled one's 1 in its host's and path's sums.
EVIDENCE_WEIGHT = 0.25
STRENGTH_LEAST, STRENGTH_MOST = 5.0, 500.0
STEPS, RATE, RIDGE = 400, 0.5, 1e-3

FEATURES = ("log_words", "word_chars", "symbols", "digits", "upper", "repeats", "line_repeats", "long_words", "stops", "commas")
_FEATURES = pa.schema([("doc_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("x", pa.list_(pa.float64()))])
FEATURE_ROW = "doc_id long, host string, path string, x array<double>"


def text_features(texts: pa.Array) -> np.ndarray:
    """The shape of each text: lengths, shares of kinds of characters and of repeated words and lines."""
    texts = pc.fill_null(texts, "")
    codes, bounds, words = split_words(texts)
    n = np.maximum(np.diff(bounds), 1).astype(float)
    doc = np.repeat(np.arange(len(texts)), np.diff(bounds))
    sums = lambda of_word: np.bincount(doc, weights=np.asarray(of_word, float)[codes], minlength=len(texts)) if len(words) else np.zeros(len(texts))
    sizes = np.asarray(pc.utf8_length(words)).astype(float) if len(words) else np.zeros(0)
    chars = np.maximum(sums(sizes), 1.0)
    share = lambda pattern: sums(pc.count_substring_regex(words, pattern)) / chars
    distinct = np.bincount(np.unique(doc * np.int64(max(1, len(words))) + codes) // max(1, len(words)), minlength=len(texts))
    lines = [t.split("\n") for t in texts.to_pylist()]
    repeated = np.array([1 - len(set(x)) / len(x) for x in lines])
    columns = [
        np.log1p(np.diff(bounds)), chars / n, share(r"[#*$%&|<>]"), share("[0-9]"), share(r"\p{Lu}"), 1 - distinct / n, repeated,
        sums(sizes > 16) / n, sums(sizes <= 3) / n, share("[,.]"),
    ]
    return np.stack(columns, axis=1)


def fit_logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, scales and weights (the last one the intercept) of a ridge logistic model over x and its squares."""
    x = np.concatenate([x, x * x], axis=1)
    if len(y) == 0 or y.min() == y.max():
        rate = (y.sum() + 1.0) / (len(y) + 2.0)
        return np.zeros(2 * len(FEATURES)), np.ones(2 * len(FEATURES)), np.append(np.zeros(2 * len(FEATURES)), np.log(rate / (1 - rate)))
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.concatenate([(x - mean) / scale, np.ones((len(x), 1))], axis=1)
    w = np.zeros(z.shape[1])
    for _ in range(STEPS):
        error = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30))) - y
        w -= RATE * (z.T @ error / len(y) + RIDGE * np.append(w[:-1], 0))
    return mean, scale, w


def evidence(x: np.ndarray, model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    mean, scale, w = model
    z = (np.concatenate([x, x * x], axis=1) - mean) / scale
    return np.clip(z @ w[:-1] + w[-1], -12, 12)


def rate_of(log_odds: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-log_odds))


def log_odds(rate: Column) -> Column:
    return F.log(rate / (F.lit(1.0) - rate))


def strength(groups: DataFrame, prior: Column) -> float:
    """How many documents the prior is worth: the method of moments on groups (k of n), within fixed bounds.

    Groups of weight up to 1 say nothing about the spread and are left out here alone.
    """
    enough = groups.where("n > 1")
    residual = F.col("k") - F.col("n") * prior
    row = enough.agg(F.sum(residual * residual), F.sum(F.col("n") * prior * (1 - prior)), F.sum(F.col("n") * (F.col("n") - 1) * prior * (1 - prior))).first()
    if not row[0] or not row[2]:
        return STRENGTH_MOST
    rho = (row[0] - row[1]) / row[2]
    return float(np.clip(1 / rho - 1, STRENGTH_LEAST, STRENGTH_MOST)) if rho > 0 else STRENGTH_MOST


def judge_quality(docs: DataFrame, labels: DataFrame, host: Column, path: Column) -> DataFrame:
    """Score every row of ``docs`` (``doc_id``, ``text``) for quality, with its site given by ``host`` and ``path``.

    ``labels`` (``doc_id``, ``quality``) outside the held-out fold are learnt. Returns doc_id, held_out, evidence,
    host_rate and path_rate (what the other documents there say), score and kept (score >= 0.5). Null hosts and paths are sites of their own; null texts are
    empty; repeated rows and null ids are scored, and counted for their site, like any other; null labels are left out;
    without labels every rate is one half; an empty table gives no rows; other columns are not read.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(host.cast("string"), F.lit("")).alias("host"), F.coalesce(path.cast("string"), F.lit("")).alias("path"), F.col("text").cast("string").alias("text"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 3, 1024):
                x = text_features(part.column(3))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), lists], schema=_FEATURES)

    measured = written(docs.mapInArrow(measure, FEATURE_ROW), "text-features")
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("double").alias("y"))
    known = known.where(fold(F.col("doc_id")) != HELD_OUT)
    labelled = measured.join(known, "doc_id", "left")
    sample = [labelled.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(SAMPLE_ROWS).select("y", "x").collect() for y in (0, 1)]
    rows = [r for part in sample for r in part]
    model = fit_logistic(np.array([r.x for r in rows], float).reshape(len(rows), len(FEATURES)), np.array([r.y for r in rows], float))
    share = known.agg(F.avg("y")).first()[0]

    got = [len(part) for part in sample]
    shift = float(np.log(share / (1 - share)) - np.log(got[1] / got[0])) if share and share < 1 and min(got) else 0.0

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column(3).flatten()).reshape(batch.num_rows, len(FEATURES))
            # The sample balances the labels; their share in all labels puts the intercept right.
            values = evidence(x, model) + shift
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], batch.column(4), pa.array(values)], names=["doc_id", "host", "path", "y", "evidence"])

    scored = written(labelled.select("doc_id", "host", "path", "x", "y").mapInArrow(weigh, "doc_id long, host string, path string, y double, evidence double"), "quality-evidence")

    # Pseudo-counts: a labelled document counts as its label, another one as a part of its evidence.
    weight = F.when(F.col("y").isNotNull(), F.lit(1.0)).otherwise(F.lit(EVIDENCE_WEIGHT))
    good = F.coalesce(F.col("y"), rate_of(F.col("evidence")))
    paths = written(scored.groupBy("host", "path").agg(F.sum(weight).alias("n"), F.sum(weight * good).alias("k")), "path-counts")
    hosts = written(paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("k").alias("host_k")), "host-counts")
    total = hosts.agg(F.sum("host_k"), F.sum("host_n")).first()
    base = float((total[0] + 0.5) / (total[1] + 1.0)) if total[1] else 0.5
    a = strength(hosts.select(F.col("host_n").alias("n"), F.col("host_k").alias("k")), F.lit(base))
    shrunk = lambda k, n, prior, worth: (k + worth * prior) / (n + worth)
    paths = paths.join(hosts, "host")
    b = strength(paths, shrunk(F.col("host_k"), F.col("host_n"), F.lit(base), a))
    out = scored.join(written(paths, "site-counts"), ["host", "path"])
    # What the other documents of the host and of the path say.
    out = out.withColumn("host_rate", shrunk(F.col("host_k") - weight * good, F.greatest(F.col("host_n") - weight, F.lit(0.0)), F.lit(base), a))
    out = out.withColumn("path_rate", shrunk(F.col("k") - weight * good, F.greatest(F.col("n") - weight, F.lit(0.0)), F.col("host_rate"), b))
    out = out.withColumn("path_rate", F.least(F.greatest("path_rate", F.lit(1e-9)), F.lit(1 - 1e-9)))
    # The site moves a document's own odds by how far its path stands from the global rate.
    moved = F.col("evidence") + log_odds(F.col("path_rate")) - F.lit(float(np.log(base / (1 - base))))
    out = out.withColumn("score", rate_of(moved))
    return out.select("doc_id", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), "evidence", "host_rate", "path_rate", "score", (F.col("score") >= 0.5).alias("kept"))
