"""Phrase collocation mining with broadcast double-array tries.

1. Texts become blocks of one language: a dictionary of words and a code for each position, pieces parted by a mark.
   The blocks are written once; all later passes are numpy over their codes.
2. For 1 to 5 words in turn, the windows whose parts have passed are hashed into count tables of a fixed size, and the
   tasks' tables are summed in spans. A window can only be frequent if its own bucket and those of all windows inside it
   reach the least count; a bucket never counts too little, so no frequent phrase is lost (Apriori-safe). The windows
   that pass are the candidates. What a task sends is bounded by the table and by its distinct windows.
3. Candidates are dealt into shards of bounded size, and a task builds the double-array trie of each.
4. Tries are broadcast, a bounded number at a time. In every block all text positions advance through the trie at once,
   word by word: ``next = base[state] + label``, kept where ``check[next] == state``. States reached are counted by
   ``bincount``, and the shards' counts are summed. These counts are exact, since labels are words, not hashes.
5. Cuts, scores and ranks are joins and windows on the frequent phrases.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packetloom.llm.common import slices, small_batches, written

LONGEST = 5
#: Buckets of a count table and of a row of it while tables are summed, as powers of 2. One more bit is 32 MB more in a
#: worker. A level's table parts windows well while its windows, over its buckets, are fewer than the least count.
BUCKET_BITS, SPAN_BITS = 25, 16
#: Phrases in a trie (about 20 MB), and tries broadcast at once.
TRIE_PHRASES, TRIES_AT_ONCE = 500_000, 2
#: Phrases that a task gathers before it reports them, and the lists into which all reports are dealt by hash.
REMEMBERED, DEALS = 500_000, 512

STEP, SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
WORD, BREAK = np.ones(256, bool), np.zeros(256, bool)
BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
WORD[BREAK] = False
WORD[list(b" \t")] = False

BLOCK = "lang string, words array<string>, codes binary, n_codes long, n_words long"
_BLOCK = pa.schema([("lang", pa.string()), ("words", pa.list_(pa.string())), ("codes", pa.binary()), ("n_codes", pa.int64()), ("n_words", pa.int64())])


def coded_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The words of all texts in order as codes into a dictionary; pieces and texts are parted by its length as a code."""
    raw = texts.cast(pa.binary())
    data = np.frombuffer(b"".join(raw.to_pylist()), np.uint8)
    ends = np.cumsum(np.asarray(pc.binary_length(raw)).astype(np.int64))
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    inside = WORD[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[starts[starts < len(data)]] = False
    after[ends[ends > 0] - 1] = False
    first, last = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after)
    offsets = np.concatenate([[0], np.cumsum(last - first + 1)]).astype(np.int32)
    words = pa.Array.from_buffers(pa.string(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(LOWER[data[inside]])]).dictionary_encode()
    piece = np.searchsorted(np.flatnonzero(BREAK[data]), first) + np.searchsorted(ends, first, "right")
    parted = 1 + np.flatnonzero(np.diff(piece))
    return np.insert(np.asarray(words.indices).astype(np.int64), parted, len(words.dictionary)), words.dictionary


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, 1, rows=1 << 20):
            texts, langs = pc.fill_null(part.column(1), ""), part.column(0)
            for lang in pc.unique(langs).to_pylist():
                codes, words = coded_words(texts.filter(pc.equal(langs, lang)))
                if len(codes):
                    kind = np.uint16 if len(words) < 1 << 16 else np.uint32
                    n_words = int((codes < len(words)).sum())
                    columns = [[lang], [words], [codes.astype(kind).tobytes()], [len(codes)], [n_words]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _BLOCK, strict=True)], schema=_BLOCK)


def read_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Array, np.ndarray]]:
    """Language, dictionary and codes of each block."""
    for batch in batches:
        for k in range(batch.num_rows):
            codes, n = batch.column(2)[k].as_py(), batch.column(3)[k].as_py()
            yield batch.column(0)[k].as_py(), batch.column(1)[k].values, np.frombuffer(codes, np.uint16 if len(codes) == 2 * n else np.uint32).astype(np.int64)


def windows(lang: str, words: pa.Array, codes: np.ndarray, frequent: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For m = 1, 2, ...: the places of the windows of m words whose parts all passed, their buckets, and which of these
    pass. The level after the last of ``frequent`` (packed bits of a level in each row) comes last, with no verdicts."""
    seed = xxhash.xxh3_64_intdigest(lang)
    own = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words.to_pylist()), np.uint64, len(words))
    at = np.flatnonzero(codes < len(words))
    rolling = own[codes[at]]
    for m in range(1, LONGEST + 1):
        if m > 1:  # both windows of m - 1 words passed; they overlap or adjoin, so they lie in one piece
            both = np.flatnonzero(at[1:] == at[:-1] + 1)
            at = at[both]
            rolling = rolling[both] * STEP + own[codes[at + m - 1]]
        bucket = ((rolling * SPREAD) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
        if m > len(frequent):
            yield m, at, bucket, np.zeros(0, bool)
            return
        passed = frequent[m - 1][bucket >> 3] >> (7 - (bucket & 7)).astype(np.uint8) & 1 == 1
        yield m, at, bucket, passed
        at, rolling = at[passed], rolling[passed]


SHARE = "span long, counts binary"
_SHARE = pa.schema([("span", pa.int64()), ("counts", pa.binary())])


def share_row(span: int, counts: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([span], pa.int64()), pa.array([counts], pa.binary())], schema=_SHARE)


def packed_span(part: np.ndarray) -> bytes:
    """The counts of a span; places and counts alone where few are left from zero."""
    places = np.flatnonzero(part)
    sparse = b"s" + places.astype(np.uint16).tobytes() + part[places].tobytes()
    return sparse if len(sparse) < part.nbytes else b"d" + part.tobytes()


def add_span(total: np.ndarray, data: bytes, kind: np.dtype) -> None:
    if data[:1] == b"d":
        total += np.frombuffer(data, kind, offset=1)
        return
    n = (len(data) - 1) // (2 + kind.itemsize)
    total[np.frombuffer(data, np.uint16, n, 1)] += np.frombuffer(data, kind, n, 1 + 2 * n)


def bucket_counts(shared, least: int):
    """Each task's table of the next level, counted up to ``least``, in spans."""
    kind, span = np.min_scalar_type(least), 1 << SPAN_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << BUCKET_BITS, kind)
        for block in read_blocks(batches):
            for m, _, bucket, _ in windows(*block, shared.value):
                if m > len(shared.value):
                    at, times = np.unique(bucket, return_counts=True)
                    table[at] = np.minimum(table[at] + times, least)
        for k in range(0, len(table), span):
            if (part := table[k : k + span]).any():
                yield share_row(k // span, packed_span(part))

    return run


def summed_spans(kind: np.dtype, result, schema: str):
    """Sums of the tasks' spans as a DataFrame function: ``result`` makes a batch of each sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = None, np.zeros(1 << SPAN_BITS, np.int64)
        for batch in batches:
            for at, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held not in (None, at):
                    yield result(held, total)
                    total[:] = 0
                held = at
                add_span(total, counts, kind)
        if held is not None:
            yield result(held, total)

    return lambda shares: shares.repartition("span").sortWithinPartitions("span").mapInArrow(run, schema)


def frequent_buckets(blocks: DataFrame, least: int) -> np.ndarray:
    """Packed bits of the buckets that reach ``least``, a row for each level: 4 MB each."""
    found = np.zeros((LONGEST, 1 << (BUCKET_BITS - SPAN_BITS), 1 << (SPAN_BITS - 3)), np.uint8)
    for level in range(LONGEST):
        shared = blocks.sparkSession.sparkContext.broadcast(found.reshape(LONGEST, -1)[:level])
        shares = blocks.mapInArrow(bucket_counts(shared, least), SHARE)
        sums = summed_spans(np.min_scalar_type(least), lambda at, total: share_row(at, np.packbits(total >= least).tobytes()), SHARE)(shares)
        for at, packed in zip(*(c.to_pylist() for c in sums.toArrow().columns), strict=True):
            found[level, at] = np.frombuffer(packed, np.uint8)
        shared.unpersist()
    return found.reshape(LONGEST, -1)


REPORT, PHRASE = "deal int, lang string, phrases array<string>", "lang string, phrase string"
_REPORT = pa.schema([("deal", pa.int32()), ("lang", pa.string()), ("phrases", pa.list_(pa.string()))])
_PHRASE = pa.schema([("lang", pa.string()), ("phrase", pa.string())])


def dealt_lists(known: dict[str, set[str]]) -> Iterator[pa.RecordBatch]:
    """The phrases as one list for each language and deal."""
    for lang, found in known.items():
        phrases = np.array([*found, None], object)[:-1]
        deals = pd.util.hash_array(phrases, categorize=False) % np.uint64(DEALS)
        order = np.argsort(deals, kind="stable")
        cuts = np.flatnonzero(np.diff(deals[order])) + 1
        lists = [x for x in np.split(phrases[order], cuts) if len(x)]
        own = [int(x) for x in deals[order][np.concatenate([[0], cuts])[: len(lists)]]]
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array([lang] * len(own), pa.string()), pa.array(lists, pa.list_(pa.string()))], schema=_REPORT)


def surviving_windows(shared):
    """The windows of 2 and more words whose own bucket and those of all windows inside them are frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, set[str]] = {}
        for lang, words, codes in read_blocks(batches):
            prefix = np.zeros(len(codes), np.int64)
            for m, at, _, passed in windows(lang, words, codes, shared.value):
                at = at[passed]
                # Equal windows have equal prefixes and last words: a number for each distinct one.
                _, first, number = np.unique(prefix[at] * (len(words) + 1) + codes[at + m - 1], return_index=True, return_inverse=True)
                prefix[at] = number
                if m > 1 and len(at):
                    parts = [words.take(pa.array(codes[at[first] + k])) for k in range(m)]
                    known.setdefault(lang, set()).update(pc.binary_join_element_wise(*parts, " ").to_pylist())
            if sum(map(len, known.values())) > REMEMBERED:
                yield from dealt_lists(known)
                known.clear()
        yield from dealt_lists(known)

    return run


def merged_reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct phrases of each deal and language, from lists sorted by both."""
    held, known = None, set()

    def rows() -> Iterator[pa.RecordBatch]:
        found = list(known)
        for k in range(0, len(found), 65536):
            part = found[k : k + 65536]
            yield pa.RecordBatch.from_arrays([pa.array([held[1]] * len(part), pa.string()), pa.array(part, pa.string())], schema=_PHRASE)

    for batch in batches:
        for deal, lang, phrases in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held not in (None, (deal, lang)):
                yield from rows()
                known.clear()
            held = deal, lang
            known.update(phrases)
    if held is not None:
        yield from rows()


def candidates(blocks: DataFrame, least: int) -> DataFrame:
    """``lang``, ``phrase``: every phrase of 2 to LONGEST words that can have ``least`` occurrences, and the words in them."""
    shared = blocks.sparkSession.sparkContext.broadcast(frequent_buckets(blocks, least))
    reports = blocks.mapInArrow(surviving_windows(shared), REPORT).repartition("deal", "lang").sortWithinPartitions("deal", "lang")
    longer = written(reports.mapInArrow(merged_reports, PHRASE), "phrase-windows")
    shared.unpersist()
    pairs = longer.where(F.size(F.split("phrase", " ")) == 2)
    return longer.unionByName(pairs.select("lang", F.explode(F.split("phrase", " ")).alias("phrase")).distinct())


def double_array(parent: np.ndarray, label: np.ndarray, n_labels: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``base``, ``check`` and the slot of each node for nodes 1.. sorted by (parent, label); node 0 is the root.

    The child of state s by label c has slot base[s] + c, and its check is s. Slots start at ``n_labels`` and as many
    stand empty at the end, so base + label is always a place of the arrays. Nodes of many children are placed first,
    those of one child fill what is left.
    """
    n = len(parent) + 1
    owners, start, count = np.unique(parent, return_index=True, return_counts=True)
    size = int(1.3 * n) + n_labels + 64
    used = np.zeros(n_labels + size, bool)
    slot = np.zeros(n, np.int64)
    slot[0], used[n_labels] = n_labels, True
    first_base = np.zeros(n, np.int64)
    draw = np.random.default_rng(7)
    for k in np.argsort(-count, kind="stable")[: int((count > 1).sum())].tolist():
        own = label[start[k] : start[k] + count[k]]
        shift, tries = own - own[0], 32
        while True:
            room = len(used) - int(shift[-1])
            places = draw.integers(n_labels, room, tries) if room > n_labels else np.zeros(0, np.int64)
            fits = ~used[places[:, None] + shift].any(1)
            if fits.any():
                at = int(places[np.argmax(fits)])
                break
            if tries < 4096:
                tries *= 2
            else:  # too full for this node: new room at the end
                used = np.append(used, np.zeros(len(own) + int(shift[-1]) + 64, bool))
        used[at + shift] = True
        slot[1 + start[k] + np.arange(count[k])] = at + shift
        first_base[owners[k]] = at - own[0]
    lone = count == 1
    free = np.flatnonzero(~used[n_labels:])[: int(lone.sum())] + n_labels
    if len(free) < lone.sum():
        free = np.append(free, len(used) + np.arange(int(lone.sum()) - len(free)))
    slot[1 + start[lone]] = free
    first_base[owners[lone]] = free - label[start[lone]]
    total = int(slot.max()) + 1 + n_labels
    base, check = np.zeros(total, np.int32), np.full(total, -1, np.int32)
    base[slot] = first_base
    check[slot[1:]] = slot[parent]
    return base, check, slot


TRIE = "shard long, langs array<string>, words array<string>, base binary, check binary, phrase_langs array<string>, phrases array<string>, slots array<long>"
_TRIE = pa.schema([("shard", pa.int64()), *((c, pa.list_(pa.string())) for c in ("langs", "words")), ("base", pa.binary()), ("check", pa.binary()), *((c, pa.list_(pa.string())) for c in ("phrase_langs", "phrases")), ("slots", pa.list_(pa.int64()))])


def build_trie(rows: pa.Table) -> pa.Table:
    """The trie of one shard (shard, lang, phrase). Labels are numbers of (language, word)."""
    langs, phrases = rows.column("lang").to_pylist(), rows.column("phrase").to_pylist()
    numbers: dict[tuple[str, str], int] = {}
    steps = np.full((len(phrases), LONGEST), -1, np.int64)
    for k, (lang, phrase) in enumerate(zip(langs, phrases, strict=True)):
        for j, word in enumerate(phrase.split(" ")):
            steps[k, j] = numbers.setdefault((lang, word), len(numbers))
    n_labels, node = len(numbers), np.zeros(len(phrases), np.int64)
    parents, labels, last = [], [], 0
    for j in range(LONGEST):
        there = np.flatnonzero(steps[:, j] >= 0)
        key, number = np.unique(node[there] * n_labels + steps[there, j], return_inverse=True)
        parents.append(key // n_labels)
        labels.append(key % n_labels)
        node[there] = last + 1 + number
        last += len(key)
    base, check, slot = double_array(np.concatenate(parents), np.concatenate(labels), n_labels)
    pairs = list(numbers)
    values = [rows.column("shard")[0].as_py(), [a for a, _ in pairs], [w for _, w in pairs], base.tobytes(), check.tobytes(), langs, phrases, slot[node].tolist()]
    return pa.table([pa.array([v], f.type) for v, f in zip(values, _TRIE, strict=True)], schema=_TRIE)


REACHED = "shard long, slot long, a long"
_REACHED = pa.schema([(c.split()[0], pa.int64()) for c in REACHED.split(", ")])


def reached_states(shared):
    """How often each state of each broadcast trie is reached from a position of the task's blocks, in spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries = []
        for shard, langs, words, base, check in shared.value:
            labels: dict[str, dict[str, int]] = {}
            for k, (lang, word) in enumerate(zip(langs, words, strict=True)):
                labels.setdefault(lang, {})[word] = k
            base, check = np.frombuffer(base, np.int32).astype(np.int64), np.frombuffer(check, np.int32)
            tries.append((shard, labels, len(words), base, check, np.zeros(len(base), np.int64)))
        for lang, words, codes in read_blocks(batches):
            names = words.to_pylist()
            for _, labels, root, base, check, reached in tries:
                if lang not in labels:
                    continue
                known = labels[lang]
                label = np.append(np.fromiter((known.get(w, -1) for w in names), np.int64, len(names)), -1)[codes]
                label = np.append(label, -1)  # past the last position
                at = np.flatnonzero(label >= 0)
                state = np.full(len(at), root)
                for m in range(LONGEST):
                    step = label[np.minimum(at + m, len(label) - 1)]
                    ahead = base[state] + np.maximum(step, 0)
                    on = (step >= 0) & (check[ahead] == state)
                    at, state = at[on], ahead[on]
                    if not len(at):
                        break
                    reached += np.bincount(state, minlength=len(reached))
        span = 1 << SPAN_BITS
        for shard, _, _, _, _, reached in tries:
            for k in range(0, len(reached), span):
                if (part := reached[k : k + span]).any():
                    yield share_row(shard << 32 | k // span, packed_span(np.pad(part, (0, span - len(part)))))

    return run


def reached_often(least: int):
    """Spans of summed counts as rows: the states reached ``least`` times or more."""

    def rows(span: int, total: np.ndarray) -> pa.RecordBatch:
        slot = np.flatnonzero(total >= least)
        columns = [np.full(len(slot), span >> 32), slot + ((span & 0xFFFFFFFF) << SPAN_BITS), total[slot]]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=_REACHED)

    return summed_spans(np.dtype(np.int64), rows, REACHED)


def frequent_phrases(blocks: DataFrame, found: DataFrame, least: int) -> DataFrame:
    """``lang``, ``phrase``, ``a``: the phrases of ``found`` with ``least`` occurrences or more, counted exactly."""
    spark = blocks.sparkSession
    found = written(found, "phrase-candidates")
    shards = max(1, -(-found.count() // TRIE_PHRASES))
    dealt = found.withColumn("shard", F.pmod(F.xxhash64("lang", "phrase"), F.lit(shards)).cast("long"))
    tries = written(dealt.groupBy("shard").applyInArrow(build_trie, TRIE), "phrase-tries")
    counted = []
    for k in range(0, shards, TRIES_AT_ONCE):
        rows = tries.where(F.col("shard").between(k, k + TRIES_AT_ONCE - 1)).select("shard", "langs", "words", "base", "check").toArrow()
        shared = spark.sparkContext.broadcast([tuple(r.values()) for r in rows.to_pylist()])
        counted.append(written(reached_often(least)(blocks.mapInArrow(reached_states(shared), SHARE)), "phrase-counts"))
        shared.unpersist()
    counts = counted[0]
    for more in counted[1:]:
        counts = counts.unionByName(more)
    names = tries.select("shard", F.inline(F.arrays_zip(F.col("phrase_langs").alias("lang"), F.col("phrases").alias("phrase"), F.col("slots").alias("slot"))))
    return names.toDF("shard", "lang", "phrase", "slot").join(counts, ["shard", "slot"]).select("lang", "phrase", "a")


def top_phrases(docs: DataFrame, least: int = 100, most: int = 2000) -> DataFrame:
    """The ``most`` best phrases of 2 to 5 words of each ``lang`` (null: ``und``) among those with ``least`` occurrences.

    A phrase is cut where its score floor(1000 * a * n / (l * r)) is lowest, at the first such place. Phrases inside a
    longer one that is as frequent are left out; for that it is enough to look at those longer by one word, since every
    phrase between the two is as frequent too. A null or empty text has no words; repeated rows count each; ``doc_id``
    and other columns aren't read. A language without such phrases has no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    plain = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    blocks = written(plain.mapInArrow(_blocks, BLOCK), "phrase-blocks")
    totals = written(blocks.groupBy("lang").agg(F.sum("n_words").alias("n")), "phrase-words")
    frequent = written(frequent_phrases(blocks, candidates(blocks, least), least), "phrases")

    parts = F.split("phrase", " ")
    cuts = frequent.withColumn("words", parts).where(F.size("words") > 1).select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    joined = lambda start, n: F.array_join(F.slice("words", start, n), " ")
    cuts = cuts.select("lang", "phrase", "a", "k", (F.col("k") == F.size("words") - 1).alias("last"), joined(1, F.col("k")).alias("left"), joined(F.col("k") + 1, F.size("words") - F.col("k")).alias("right"))
    of = lambda side, n: frequent.select("lang", F.col("phrase").alias(side), F.col("a").alias(n))
    cuts = written(cuts.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"]), "phrase-cuts")

    inside = cuts.where("last and a >= l").select("lang", F.col("left").alias("phrase")).unionByName(cuts.where("k = 1 and a >= r").select("lang", F.col("right").alias("phrase")))
    exact = "decimal(38, 0)"
    score = F.expr(f"(cast(1000 as {exact}) * a * n) div (cast(l as {exact}) * r)")
    scored = cuts.join(totals, "lang").withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    kept = scored.join(inside.distinct(), ["lang", "phrase"], "left_anti").select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    place = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return kept.withColumn("rank", F.row_number().over(place).cast("long")).where(F.col("rank") <= most).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
