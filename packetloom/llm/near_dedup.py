"""Near-duplicate components: MinHash with banding, signature check, exact confirmation and alternating stars.

Equal shingle sets collapse to one representative before anything is compared. A band's bucket is compared with one
pivot (its smallest member), never pair by pair. What the pivots leave in different components (stragglers) is compared
in blocks inside tasks, by signature and then by sets, and only links leave the tasks. A bucket with many stragglers (a
template that many texts share) is dealt anew by the rarest shingles of its members, of which linked texts share one.
So every pair that shares a bucket is confirmed, rejected, or already connected.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from packetloom.llm.common import bloom_test, slices, small_batches, split_words, written

SHINGLE_WORDS = 5
#: Link documents with LINK_OF * intersection >= LINK_AT * union.
LINK_AT, LINK_OF = 75, 100
BANDS, ROWS = 32, 4
#: Of the 128 minima, 96 agree on average at a similarity of 0.75, with a standard deviation of 4.9.
LEAST_AGREEING = 69
SEED = 11
STEP = np.uint64(0x9E3779B97F4A7C15)
#: Ids that may be broadcast: 1,000,000 longs take about 16 MB.
BROADCAST_IDS = 1_000_000
#: Members and stragglers of a block. A bucket of more than CROWDED stragglers is dealt anew by rare shingles; up to that
#: a member has at most 16 rows and a straggler one for each block, 20 rows a member in all.
BLOCK, STRAGGLERS, CROWDED = 1024, 256, 4096
#: Shingles that stand in at least one of so many parts of all (and in RARE texts) count as frequent: there can't be more.
FREQUENT, RARE = 500_000, 16

SETS = "doc_id long, n_shingles long, digest binary, bands array<long>, low_bits binary"
_SETS = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64())), ("low_bits", pa.binary())])


def spread(keys: np.ndarray) -> np.ndarray:
    keys = (keys ^ (keys >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return keys ^ (keys >> np.uint64(29))


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted 64-bit hashes of each text's distinct shingles."""
    codes, bounds, words = split_words(texts, lower=True)
    if not len(words):
        return [np.zeros(0, np.uint64)] * len(texts)
    hashes = spread(pd.util.hash_array(words.to_numpy(zero_copy_only=False).astype(object), categorize=False))[codes]
    runs = {1: hashes}
    for n in range(2, SHINGLE_WORDS + 1):
        runs[n] = runs[n - 1][:-1] * STEP + hashes[n - 1 :] if len(hashes) >= n else hashes[:0]
    runs = {n: spread(run + np.uint64(n)) for n, run in runs.items()}
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        n = min(SHINGLE_WORDS, b - a)
        out.append(np.unique(runs[n][a : b - n + 1]) if n else np.zeros(0, np.uint64))
    return out


def hash_family() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    a = rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def minima(shingles: np.ndarray, family: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    a, b = family
    low = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 512):
        np.minimum(low, (shingles[at : at + 512, None] * a + b).min(axis=0), out=low)
    return low


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    family = hash_family()
    band = np.arange(BANDS, dtype=np.uint64)
    for batch in batches:
        for part in slices(batch, 1):
            found = shingle_sets(part.column(1))
            digests, bands, low_bits = [], [], []
            for s in found:
                low = minima(s, family)
                key = band
                for r in range(ROWS):
                    key = spread(key * STEP + low[r::ROWS])
                bands.append(key.view(np.int64) if len(s) else [])
                low_bits.append((low >> np.uint64(40)).astype(np.uint8).tobytes())
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
            columns = [part.column(0), [len(s) for s in found], digests, bands, low_bits]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, _SETS, strict=True)], schema=_SETS)


def only(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Rows whose long ``column`` is in ``ids`` (one distinct column ``id``): a broadcast while the ids are few, else a
    filter in front of the join, so that hardly any other row is shuffled."""
    if ids.count() <= BROADCAST_IDS:
        return df.join(F.broadcast(ids), df[column] == ids["id"], "left_semi")
    return df.where(bloom_test(ids)(F.col(column))).join(ids, F.col(column) == ids["id"], "left_semi")


def without(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Rows whose long ``column`` is null or not in ``ids``: a broadcast while the ids are few, else only rows that a
    filter can't clear are shuffled."""
    if ids.count() <= BROADCAST_IDS:
        return df.join(F.broadcast(ids), df[column] == ids["id"], "left_anti")
    perhaps = F.coalesce(bloom_test(ids)(F.coalesce(column, F.lit(0))), F.lit(False)) & F.col(column).isNotNull()
    return df.where(~perhaps).unionAll(df.where(perhaps).join(ids, F.col(column) == ids["id"], "left_anti"))


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep: list[bool] = []
        for part in slices(batch, 2, rows=64):
            left, right = shingle_sets(part.column(2)), shingle_sets(part.column(3))
            for a, b in zip(left, right, strict=True):
                same = len(np.intersect1d(a, b, assume_unique=True)) if LINK_OF * min(len(a), len(b)) >= LINK_AT * max(len(a), len(b)) else 0
                keep.append(same > 0 and LINK_OF * same >= LINK_AT * (len(a) + len(b) - same))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))


@F.pandas_udf(IntegerType())
def agreeing(a: pd.Series, b: pd.Series) -> pd.Series:
    if not len(a):
        return pd.Series([], dtype="int32")
    left, right = (np.frombuffer(b"".join(x), np.uint8).reshape(len(x), -1) for x in (a, b))
    return pd.Series((left == right).sum(axis=1).astype("int32"))


def likely_links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) that sizes and signatures leave possible."""
    small = sets.select("doc_id", "n_shingles", "low_bits")
    one, two = small.toDF("u", "n_u", "low_u"), small.toDF("v", "n_v", "low_v")
    sizes = F.lit(LINK_OF) * F.least("n_u", "n_v") >= F.lit(LINK_AT) * F.greatest("n_u", "n_v")
    likely = pairs.distinct().join(one, "u").join(two, "v").where(sizes).where(agreeing("low_u", "low_v") >= LEAST_AGREEING)
    return written(likely.select("u", "v"), "likely-pairs")


def confirmed(likely: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs whose full shingle sets are linked."""
    texts = docs.select("doc_id", "text")
    texts = written(only(texts, likely.select(F.explode(F.array("u", "v")).alias("id")).distinct(), "doc_id").distinct(), "likely-texts")
    both = likely.join(texts.toDF("u", "text_u"), "u").join(texts.toDF("v", "text_v"), "v").select("u", "v", "text_u", "text_v")
    return written(both.mapInArrow(_confirmed, "u long, v long").distinct(), "links")


SHORT_SETS = "id long, short binary"
_SHORT_SETS = pa.schema([("id", pa.int64()), ("short", pa.binary())])


def _short_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted 32-bit forms of each text's shingles."""
    for batch in batches:
        for part in slices(batch, 1):
            short = [np.unique((s >> np.uint64(32)).astype(np.uint32)).tobytes() for s in shingle_sets(part.column(1))]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(short, pa.binary())], schema=_SHORT_SETS)


def compare_block(table: pa.Table) -> pa.Table:
    """The pairs of a straggler and a member of another component that short sets can't rule out.

    A short set lacks as many elements as its shingles collide in 32 bits, so a pair shares at most as many shingles as
    its short sets share, plus the smaller lack. A pair that shares several bands is looked at in the first of them alone.
    """
    low, keys = (np.frombuffer(b"".join(table[c].to_pylist()), kind).reshape(table.num_rows, -1) for c, kind in (("low_bits", np.uint8), ("keys", np.dtype(">i8"))))
    ids, sizes, parts, straggler = (np.asarray(table[c]) for c in ("id", "n_shingles", "component", "straggler"))
    short = [np.frombuffer(x, np.uint32) for x in table["short"].to_pylist()]
    lacks = sizes - np.fromiter(map(len, short), np.int64, len(short))
    band, others, left, right = int(table["band"][0].as_py()), np.flatnonzero(straggler == 0), [], []
    for k in np.flatnonzero(straggler == 1).tolist():
        near = LINK_OF * np.minimum(sizes[others], sizes[k]) >= LINK_AT * np.maximum(sizes[others], sizes[k])
        near = others[near & (parts[others] != parts[k])]
        near = near[(low[near] == low[k]).sum(axis=1) >= LEAST_AGREEING]
        if keys.shape[1]:
            near = near[keys[k][(keys[near] == keys[k]).argmax(axis=1)] == band]
        if not len(near):
            continue
        # All partners at once: where each of their shingles would stand in the straggler's sorted set.
        own, joined = short[k], np.concatenate([short[n] for n in near])
        place = np.minimum(np.searchsorted(own, joined), len(own) - 1)
        counts = np.array([len(short[n]) for n in near])
        same = np.add.reduceat((own[place] == joined).astype(np.int64), np.cumsum(counts) - counts) + np.minimum(lacks[near], lacks[k])
        near = near[LINK_OF * same >= LINK_AT * (sizes[near] + sizes[k] - same)]
        left += np.minimum(ids[near], ids[k]).tolist()
        right += np.maximum(ids[near], ids[k]).tolist()
    return pa.table([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["u", "v"])


def split_buckets(placed: DataFrame) -> DataFrame:
    """Members (band, id, component, seldom) of the buckets that hold two components or more, with the bucket's size
    ``n``, its largest component ``main``, and how many members are outside of it (``stragglers``) or ``seldom``."""
    parts = placed.groupBy("band", "component").agg(F.count("*").alias("count"), F.count_if("seldom").alias("seldom"))
    sizes = parts.groupBy("band").agg(
        F.sum("count").alias("n"), F.max("count").alias("most"), F.max_by("component", F.struct("count", "component")).alias("main"), F.sum("seldom").alias("rare"), F.count("*").alias("parts")
    )
    sizes = sizes.where("parts > 1 and rare > 0").select("band", "n", "main", (F.col("n") - F.col("most")).alias("stragglers"), "rare")
    return placed.join(sizes, "band")


def rare_buckets(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """(band, id, seldom): the members of ``ids`` dealt by their rarest shingles, so that linked ones share a bucket.

    Sets are sorted by one order of all shingles, rare ones first. Of two linked sets of n <= m shingles, one of the
    m - ceil(0.75 m) + 1 first of the larger is among the n - ceil(6 n / 7) + 1 first of the smaller (``seldom``): else
    they would share fewer than 3/7 (n + m). Only counts of frequent shingles, whose number is bounded, are broadcast.
    """
    texts = written(only(docs.select("doc_id", "text"), ids, "doc_id").distinct(), "crowded-texts")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, rows=2048):
                found, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_sets(part.column(1))]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], names=["shingle", "n"])

    counts = written(texts.mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")), "shingle-counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    table = counts.where(F.col("n") >= max(RARE, -(-total // FREQUENT))).toArrow()
    shingle, times = table["shingle"].to_numpy().view(np.uint64), table["n"].to_numpy()
    order = np.argsort(shingle)
    shared = docs.sparkSession.sparkContext.broadcast((shingle[order], times[order]))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, often = shared.value
        for batch in batches:
            for part in slices(batch, 1):
                sets = shingle_sets(part.column(1))
                rows, seldom = [], []
                for s in sets:
                    n = len(s)
                    rank = np.zeros(n, np.int64)
                    if n and len(frequent):
                        at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
                        rank = np.where(frequent[at] == s, often[at], 0)
                    first = np.lexsort((s, rank))[: n - -(-LINK_AT * n // LINK_OF) + 1 if n else 0]
                    rows.append(s[first])
                    seldom.append(np.arange(len(first)) <= n - -(-2 * LINK_AT * n // (LINK_AT + LINK_OF)))
                sizes = [len(r) for r in rows]
                doc = pa.array(np.repeat(np.arange(len(rows)), sizes))
                columns = [np.concatenate([np.zeros(0, kind), *x]) for x, kind in ((rows, np.uint64), (seldom, bool))]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0].view(np.int64)), part.column(0).take(doc), pa.array(columns[1])], names=["band", "id", "seldom"])

    dealt = texts.mapInArrow(deal, "band long, id long, seldom boolean")
    return written(dealt.groupBy("band", "id").agg(F.max("seldom").alias("seldom")), "rare-buckets")


def bucket_members(placed: DataFrame, docs: DataFrame) -> DataFrame | None:
    """The members that must be compared, with ``crowded`` and what ``dealt`` needs. None: no bucket is split.

    The members of buckets with more than ``CROWDED`` stragglers are dealt anew by ``rare_buckets``, and there the smaller
    of stragglers and ``seldom`` members meet the others. Only where both are many do rows grow with the product of a
    bucket's blocks.
    """
    split = written(split_buckets(placed.withColumn("seldom", F.lit(True))), "split-buckets")
    if not split.limit(1).count():
        return None
    rows = split.where(F.col("stragglers") <= CROWDED).withColumns({"left": F.col("component") != F.col("main"), "lefts": F.col("stragglers"), "crowded": F.lit(False)})
    crowded = split.where(F.col("stragglers") > CROWDED).select("id", "component").distinct()
    if crowded.limit(1).count():
        crowded = written(crowded, "crowded")
        again = rare_buckets(crowded.select("id"), docs).join(crowded, "id")
        again = written(split_buckets(again), "rare-split")
        few = F.col("rare") <= F.col("stragglers")
        left = F.when(few, F.col("seldom")).otherwise(F.col("component") != F.col("main"))
        rows = rows.unionByName(again.withColumns({"left": left, "lefts": F.least("rare", "stragglers"), "crowded": F.lit(True)}))
    return rows.select("crowded", "band", "id", "component", "n", "left", "lefts")


def dealt(rows: DataFrame) -> DataFrame:
    """Members (``straggler`` 0) and stragglers (1) by block and group: each member meets each straggler in one of them."""
    rows = rows.withColumns({"block": F.ceil(F.col("n") / BLOCK).cast("int"), "group": F.ceil(F.col("lefts") / STRAGGLERS).cast("int")})
    own = lambda c, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(c)).cast("int").alias(c)
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1)).alias(c)
    keep = [c for c in rows.columns if c not in ("n", "left", "lefts", "block", "group")]
    return rows.select(*keep, own("block", 1), every("group"), F.lit(0).alias("straggler")).unionAll(rows.where("left").select(*keep, every("block"), own("group", 2), F.lit(1).alias("straggler")))


def across_components(members: DataFrame, component: DataFrame, sets: DataFrame, docs: DataFrame) -> DataFrame | None:
    """Pairs (u, v) of different components within a bucket that short sets can't rule out. None: no bucket is split."""
    placed = members.join(component, "id", "left").select("band", "id", F.coalesce("component", "id").alias("component"))
    rows = bucket_members(placed, docs)
    if rows is None:
        return None
    short = only(docs.select("doc_id", "text"), rows.select("id").distinct(), "doc_id").distinct().mapInArrow(_short_sets, SHORT_SETS)
    keys = F.unhex(F.array_join(F.transform("bands", lambda b: F.lpad(F.hex(b), 16, "0")), "")).alias("keys")
    small = sets.select(F.col("doc_id").alias("id"), "n_shingles", "low_bits", keys).dropDuplicates(["id", "low_bits"])
    rows = rows.join(written(small.join(short, "id"), "short-sets"), "id")
    rows = rows.withColumn("keys", F.when(F.col("crowded"), F.lit(bytearray())).otherwise(F.col("keys")))
    return written(dealt(rows).groupBy("crowded", "band", "block", "group").applyInArrow(compare_block, "u long, v long").distinct(), "across")


def connected(edges: DataFrame) -> DataFrame:
    """(id, component) of every node of the edges (u, v), by alternating large-star and small-star until all edges lead to roots."""
    edges = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while True:
        parents = edges.select(F.col("v").alias("u")).distinct()
        nodes = edges.agg(F.count("*"), F.count_distinct("u")).first()
        if nodes[0] == nodes[1] and not edges.join(parents, "u", "left_semi").limit(1).count():
            break
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), "u").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.toDF("u", "v"))
        edges = written(small.distinct(), "edges")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs`` (``doc_id``, ``text``): doc_id, n_shingles, component_id and kept.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case; a text of fewer than five is one shingle. Null texts, and
    those without words, have no shingle and are linked with nothing. A null id takes no part: its component is null and
    it is kept. Rows that repeat an id are judged one by one and named by that id. An empty table gives no rows; other
    columns are not read.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sets = written(docs.mapInArrow(_sets, SETS), "shingle-sets")
    real = sets.where("n_shingles > 0 and doc_id is not null")
    classes = written(real.groupBy("digest", "n_shingles").agg(F.min("doc_id").alias("class_id")), "classes")
    copies = real.select("doc_id", "digest", "n_shingles").join(classes, ["digest", "n_shingles"]).groupBy("doc_id").agg(F.bool_and(F.col("doc_id") != F.col("class_id")).alias("copy"))
    firsts = without(real, written(copies.where("copy").select(F.col("doc_id").alias("id")), "copies"), "doc_id")

    bands = firsts.select(F.explode("bands").alias("band"), F.col("doc_id").alias("id"))
    shared = bands.groupBy("band").agg(F.min("id").alias("pivot"), F.max("id").alias("last")).where("pivot <> last").drop("last")
    buckets = written(bands.join(shared, "band").distinct(), "buckets")
    small = firsts.select("doc_id", "n_shingles", "low_bits")
    tried = likely_links(buckets.where("id <> pivot").select(F.least("pivot", "id").alias("u"), F.greatest("pivot", "id").alias("v")), small)
    edges = confirmed(tried, docs)
    component = connected(edges)
    likely = across_components(buckets.select("band", "id"), component, firsts, docs)
    if likely is not None and likely.limit(1).count():
        component = connected(edges.unionAll(confirmed(likely, docs)))
    named = classes.join(component, classes["class_id"] == component["id"], "left").select("digest", "n_shingles", F.coalesce("component", "class_id").alias("component_id"))
    out = sets.select("doc_id", "n_shingles", "digest").join(named, ["digest", "n_shingles"], "left")
    component_id = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component_id.alias("component_id")).withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))
