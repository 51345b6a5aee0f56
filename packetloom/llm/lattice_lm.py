"""Document probability from a subword lattice.

A text is its lower-cased words and one end. A word is generated by unigram pieces of an existing vocabulary file,
which never cross words, so its probability is a sum over all of its segmentations (forward recursion in log space) and
a document's is the product over its words and the end. The file's own scores, which are ranks, give the prior;
counts of the pieces in the training words give the rest.

Word counts are one table that grows with the corpus. Frequent words, whose number is bounded by their frequency, are
broadcast; the words of the long tail are joined by key. Each distinct word is scored once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm.common import fold, slices, split_words, written

HELD_OUT = 1
MARK = "▁"
#: A word in at least one of so many training tokens is broadcast: there can be no more such words than that.
HOT_WORDS = 500_000
#: Weight of the prior, in tokens, against the counts.
PRIOR_TOKENS = 32_000.0

WORDS = "word string, n long"
_WORDS = pa.schema([("word", pa.string()), ("n", pa.int64())])
SCORED = "word string, n long, log10 double"
_SCORED = pa.schema([("word", pa.string()), ("n", pa.int64()), ("log10", pa.float64())])
PARTS = "row long, word string, tf long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double"
_PARTS = pa.schema([
    ("row", pa.int64()), ("word", pa.string()), ("tf", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()),
])


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def load_pieces(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


class Lattice:
    """Marginal log probabilities of words under unigram pieces."""

    def __init__(self, pieces: list[str], log_p: np.ndarray):
        """``pieces`` may hold byte pieces ``<0x00>`` to ``<0xFF>``: they spell the characters that no piece is."""
        self.byte = np.full(256, np.inf)
        table: dict[str, float] = {}
        for piece, p in zip(pieces, log_p.tolist(), strict=True):
            if len(piece) == 6 and piece.startswith("<0x"):
                self.byte[int(piece[3:5], 16)] = p
            elif piece not in ("<unk>", "<s>", "</s>"):
                table[piece] = p
        self.byte[np.isinf(self.byte)] = log_p.min()
        self.single: dict[str, float] = {k: v for k, v in table.items() if len(k) == 1}
        self.longest = max(map(len, table), default=1)
        names = [k for k in table if len(k) > 1]
        names.sort(key=len)
        keys = np.zeros(len(names), np.uint64)
        sizes = np.array([*map(len, names)], np.int64)
        for size in np.unique(sizes).tolist():
            own = np.flatnonzero(sizes == size)
            codes = np.frombuffer("".join(names[k] for k in own.tolist()).encode("utf-32-le", "surrogatepass"), "<u4")
            keys[own] = self._hash(codes.reshape(len(own), size).astype(np.uint64))
        order = np.argsort(keys)
        self.keys, self.values = keys[order], np.array([table[k] for k in names])[order]
        if len(np.unique(self.keys)) < len(names):
            raise ValueError("two pieces share a hash")
        self.slots = np.zeros(1 << 18, bool)
        self.slots[self._slot(self.keys)] = True

    STEP = np.uint64(0x9E3779B97F4A7C15)

    @classmethod
    def _hash(cls, codes: np.ndarray) -> np.ndarray:
        have = np.zeros(codes.shape[0], np.uint64)
        for k in range(codes.shape[1]):
            have = have * cls.STEP + codes[:, k] + np.uint64(1)
        return have

    @classmethod
    def _slot(cls, keys: np.ndarray) -> np.ndarray:
        return ((keys * cls.STEP) >> np.uint64(46)).astype(np.int64)

    def spelled(self, char: str) -> float:
        """A character's log probability as a piece, or through its bytes."""
        if char not in self.single:
            p = sum(self.byte[b] for b in char.encode("utf-8", "replace"))
            if len(self.single) > 200_000:
                return float(p)
            self.single[char] = float(p)
        return self.single[char]

    def words(self, words: list[str]) -> np.ndarray:
        """The natural-log marginal of each word, its leading mark included."""
        out = np.zeros(len(words))
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        for size in np.unique(sizes).tolist():
            own = np.flatnonzero(sizes == size)
            step = max(1, 200_000 // (size + 1))
            for at in range(0, len(own), step):
                part = own[at : at + step]
                out[part] = self._equal_length([MARK + words[k] for k in part.tolist()], size + 1)
        return out

    def _equal_length(self, words: list[str], size: int) -> np.ndarray:
        n = len(words)
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(n, size).astype(np.uint64)
        chars, back = np.unique(codes, return_inverse=True)
        single = np.array([self.spelled(chr(c)) for c in chars.tolist()])[back.reshape(n, size)]
        alpha = np.full((n, size + 1), -np.inf)
        alpha[:, 0] = 0.0
        running: list[np.ndarray] = []  # hashes of the pieces that start at the last few places and end here
        for end in range(1, size + 1):
            code = codes[:, end - 1]
            running = [r * self.STEP + code + np.uint64(1) for r in running[-(self.longest - 1) :]] + [code + np.uint64(1)]
            ways = [alpha[:, end - 1] + single[:, end - 1]]
            if len(running) > 1:
                keys = np.stack(running[:-1], axis=1)
                rows, cols = np.nonzero(self.slots[self._slot(keys)])
                found = keys[rows, cols]
                at = np.searchsorted(self.keys, found)
                at[at == len(self.keys)] = 0
                real = self.keys[at] == found
                gain = np.full(keys.shape, -np.inf)
                gain[rows[real], cols[real]] = self.values[at[real]]
                first = end - len(running)
                ways += list((gain + alpha[:, first : end - 1]).T)
            ways = np.stack(ways)
            most = ways.max(axis=0)
            alpha[:, end] = most + np.log(np.exp(ways - most).sum(axis=0))
        return alpha[:, size]


def word_counts(docs: DataFrame, lower: bool = True) -> DataFrame:
    """(word, n) of all words of ``text``; n counts only rows with ``learn``, so words of other rows may have 0."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, bounds, words = split_words(batch.column(0), lower)
            learn = np.repeat(batch.column(1).to_numpy(zero_copy_only=False).astype(float), np.diff(bounds))
            n = np.bincount(codes, weights=learn, minlength=len(words)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([words.cast(pa.string()), pa.array(n)], schema=_WORDS)

    return docs.select("text", "learn").mapInArrow(count, WORDS).groupBy("word").agg(F.sum("n").alias("n"))


def piece_log_p(words: DataFrame, ends: int, vocabulary: str) -> np.ndarray:
    """The log probability of each piece of the vocabulary, from the words' counts and the file's ranks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load_pieces(vocabulary)
        total = np.zeros(model.get_piece_size())
        for batch in batches:
            found = model.encode(batch.column(0).to_pylist(), num_threads=1)
            n = np.asarray(batch.column(1))
            total += np.bincount(np.concatenate([np.zeros(0, np.int64), *found]).astype(np.int64), weights=np.repeat(n, [len(x) for x in found]), minlength=len(total))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used].astype(np.int64))], names=["piece", "n"])

    counted = words.where("n > 0").select("word", "n").mapInArrow(count, "piece long, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    model = load_pieces(vocabulary)
    n = np.zeros(model.get_piece_size())
    for row in counted.collect():  # at most a row for each piece of the file
        n[row.piece] = row.n
    n[model.eos_id()] += ends
    ranks = np.array([-model.get_score(k) for k in range(len(n))])
    prior = 1.0 / (np.maximum(ranks, 0) + 10.0)
    weight = n + PRIOR_TOKENS * prior / prior.sum()
    return np.log(weight / weight.sum())


def lattice_scores(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Score every row of ``docs`` (``doc_id``, ``text``; null text: empty), learning from four of five folds.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-half word unigrams) and score (log10 of
    the text's marginal probability). An empty text is its end alone. Null ids are of the fold of the empty string;
    repeated rows are scored, and learnt, as often as they stand there; an empty table gives no rows; other columns are
    not read.
    """
    vocabulary = vocabulary or default_vocabulary()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("held_out", fold(F.col("doc_id")) == HELD_OUT)
    counts = written(word_counts(docs.select("text", (~F.col("held_out")).alias("learn"))), "word-counts")
    known = counts.where("n > 0")
    tokens, distinct = known.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    ends = docs.where("not held_out").count()
    tokens, distinct = tokens + ends, distinct + bool(ends)
    below = tokens + 0.5 * (distinct + 1)

    model = load_pieces(vocabulary)
    log_p = piece_log_p(counts, ends, vocabulary)
    pieces = [model.id_to_piece(k) for k in range(model.get_piece_size())]
    shared = docs.sparkSession.sparkContext.broadcast((pieces, log_p))
    end = (float(np.log10((ends + 0.5) / below)), float(log_p[model.eos_id()] / np.log(10)), int(ends > 0))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(*shared.value)
        for batch in batches:
            found = lattice.words(batch.column(0).to_pylist()) / np.log(10)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found)], schema=_SCORED)

    scored = written(counts.mapInArrow(score, SCORED), "word-scores")
    hot = (scored.where(F.col("n") * HOT_WORDS >= tokens) if tokens else scored.limit(0)).toPandas().sort_values("word")  # at most HOT_WORDS
    frequent = docs.sparkSession.sparkContext.broadcast((hot["word"].to_numpy(object), np.log10((hot["n"].to_numpy(float) + 0.5) / below), hot["log10"].to_numpy(float)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, base_of, score_of = frequent.value
        names, base_of, score_of = pa.array(names, pa.string()), np.append(base_of, 0.0), np.append(score_of, 0.0)
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            for part in slices(batch, 1, 1024):
                yield from _parts(part, row, names, base_of, score_of, end)
                row += part.num_rows

    parts = written(docs.mapInArrow(read, PARTS), "document-words")
    tail = parts.where("word is not null").select("row", "word", "tf").join(scored, "word")
    base = F.log10((F.col("n") + 0.5) / F.lit(below))
    tail = tail.groupBy("row").agg(
        F.sum(F.when(F.col("n") > 0, F.col("tf")).otherwise(0)).alias("tail_known"), F.sum(F.col("tf") * base).alias("tail_base"), F.sum(F.col("tf") * F.col("log10")).alias("tail_score")
    )
    rows = parts.where("word is null").join(tail, "row", "left")
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return rows.select(
        "doc_id", "held_out", "n_tokens", plus("n_known", "tail_known").alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        plus("base", "tail_base").alias("base_score"), plus("score", "tail_score").alias("score"),
    )


def _parts(batch: pa.RecordBatch, row: int, names: pa.Array, base_of: np.ndarray, score_of: np.ndarray, end: tuple[float, float, int]) -> Iterator[pa.RecordBatch]:
    """A row for each document with the sums over its frequent words and its end, and one for each other word of it."""
    n = batch.num_rows
    codes, bounds, words = split_words(batch.column(1), lower=True)
    place = np.asarray(pc.fill_null(pc.index_in(words, value_set=names), len(names))).astype(np.int64) if len(words) else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(n), np.diff(bounds))
    hot = place < len(names)
    count = lambda weights: np.bincount(doc, weights=weights, minlength=n)
    known = count(hot[codes].astype(float)).astype(np.int64) + end[2]
    rows = np.arange(row, row + n)
    none = lambda kind, size=n: pa.nulls(size, kind)
    yield pa.RecordBatch.from_arrays(
        [pa.array(rows), none(pa.string()), none(pa.int64()), batch.column(0), batch.column(2), pa.array(np.diff(bounds) + 1), pa.array(known), pa.array(count(base_of[place][codes]) + end[0]), pa.array(count(score_of[place][codes]) + end[1])],
        schema=_PARTS,
    )
    cold = ~hot[codes]
    keys, tf = np.unique(doc[cold] * np.int64(max(1, len(words))) + codes[cold], return_counts=True)
    doc, code = keys // max(1, len(words)), keys % max(1, len(words))
    size = len(keys)
    yield pa.RecordBatch.from_arrays(
        [pa.array(rows[doc]), words.take(pa.array(code)).cast(pa.string()), pa.array(tf.astype(np.int64)), none(pa.int64(), size), none(pa.bool_(), size), none(pa.int64(), size), none(pa.int64(), size), none(pa.float64(), size), none(pa.float64(), size)],
        schema=_PARTS,
    )
