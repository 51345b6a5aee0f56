"""Toxicity: a bidirectional gated recurrent network with attention pooling, written and trained in numpy.

A word's input is its own hashed vector next to the scaled sum of those of its character n-grams, so spellings never
seen still say something. Windows of words overlap and cover the whole text; a window's states are pooled by attention
into one logit. A document's score is a small logistic model over all its windows: the worst ones, and how many are
toxic. Both are trained on a bounded sample of labelled rows, the second on rows that the network has not learnt from.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm.common import fold, kept, slices, small_batches, split_words, written

HELD_OUT = 0
WINDOW, STRIDE = 48, 32
#: The sample of labelled documents: at most so many of each label, of any length. The network learns from at most
#: SAMPLE_WINDOWS windows of each (of longer texts those of the least hashes, anywhere in the text): 180,000 windows,
#: 35 MB of word codes, in all. The model over the windows and every score see all windows of a text.
SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_WINDOWS = 1500, 4000, 32
#: One sampled document of so many is kept from the network, for the model over its windows.
APART = 4
WORD_ROWS = GRAM_ROWS = 1 << 16
#: Words and n-grams of fewer sampled texts stay at zero: what one text alone holds teaches nothing about others.
LEAST_TEXTS = 4
WIDTH, HIDDEN = 8, 8
GRAMS = (3, 4, 5)
BATCH, STEPS, RATE, DECAY = 512, 320, 0.012, 0.15
#: Share of windows of toxic texts in a training step, and worst windows that the text's model sees.
TOXIC_SHARE, TOP = 0.4, 3
SEED = 5

MIX = np.uint64(0x9E3779B97F4A7C15)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * (np.tanh(np.float32(0.5) * x) + np.float32(1))


def spread(keys: np.ndarray, rows: int) -> np.ndarray:
    keys = (keys ^ (keys >> np.uint64(29))) * MIX
    return (keys >> np.uint64(64 - int(rows).bit_length() + 1)).astype(np.int64)


def summed_rows(index: np.ndarray, values: np.ndarray, rows: int) -> np.ndarray:
    """The sums of the rows of ``values`` by ``index``."""
    out = np.zeros((rows, values.shape[1]), values.dtype)
    if len(index):
        index = index.astype(np.uint16) if rows <= 1 << 16 else index  # sorted by radix
        order = np.argsort(index, kind="stable")
        index = index[order]
        starts = np.flatnonzero(np.append(True, index[1:] != index[:-1]))
        out[index[starts]] = np.add.reduceat(values[order], starts, axis=0)
    return out


class Vocabulary:
    """The words of a batch as rows of the hashed tables: one for each word, several for its character n-grams."""

    def __init__(self, words: pa.Array):
        parts = [self._part(words.slice(at, 1 << 15).to_pylist(), at) for at in range(0, len(words), 1 << 15)] or [self._part([], 0)]
        self.grams, self.owners, counts, self.words = (np.concatenate(x) for x in zip(*parts, strict=True))
        self.counts = counts.astype(np.float32)
        self.starts = np.cumsum(counts) - counts

    @staticmethod
    def _part(words: list[str], first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Rows of the n-grams of some words, the words they are of, how many each has, and rows of the words."""
        texts = [f"\x02{w}\x03" for w in words]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        owner = np.repeat(np.arange(len(texts)), sizes)
        place = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        rows, owners = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
        have = codes + np.uint64(1)
        for n in range(2, max(GRAMS) + 1):
            if len(have) < 2:
                break
            have = have[:-1] * MIX + codes[n - 1 :]
            if n in GRAMS:
                inside = place[: len(have)] + n <= sizes[owner[: len(have)]]
                rows.append(spread(have[inside] + np.uint64(n), GRAM_ROWS).astype(np.int32))
                owners.append(owner[: len(have)][inside].astype(np.int32))
        rows, owners = np.concatenate(rows), np.concatenate(owners)
        order = np.argsort(owners, kind="stable")
        whole = np.zeros(len(texts), np.uint64)
        if len(texts):
            power = np.cumprod(np.full(min(int(sizes.max()), len(codes)), MIX, np.uint64))
            whole = np.add.reduceat((codes + np.uint64(1)) * power[place], np.cumsum(sizes) - sizes)
        return rows[order], owners[order] + np.int32(first), np.bincount(owners, minlength=len(texts)), spread(whole, WORD_ROWS)


class Network:
    """The parameters and the forward and backward passes. Index ``len(words)`` of a window stands for padding."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        small = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
        self.p = {"word": small(WORD_ROWS, WIDTH) * np.float32(0.2), "gram": small(GRAM_ROWS, WIDTH) * np.float32(0.2), "v": small(2 * HIDDEN), "w": small(2 * HIDDEN), "b": np.zeros(1, np.float32)}
        for d in "fb":
            self.p |= {f"W{d}": small(2 * WIDTH, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, np.float32), f"U{d}": small(HIDDEN, 3 * HIDDEN)}

    def inputs(self, words: Vocabulary) -> np.ndarray:
        out = np.zeros((len(words.words), 2 * WIDTH), self.p["word"].dtype)
        out[:, :WIDTH] = self.p["word"][words.words]
        ends = np.append(words.starts, len(words.grams)).astype(np.int64)
        for at in range(0, len(out), 1 << 14):
            to = min(at + (1 << 14), len(out))
            rows = self.p["gram"][words.grams[ends[at] : ends[to]]]
            out[at:to, WIDTH:] = np.add.reduceat(rows, words.starts[at:to] - ends[at], axis=0) / np.sqrt(words.counts[at:to])[:, None]
        return out

    def projected(self, inputs: np.ndarray, d: str) -> np.ndarray:
        out = inputs @ self.p[f"W{d}"] + self.p[f"c{d}"]
        return np.concatenate([out, np.zeros((1, 3 * HIDDEN), np.float32)])

    def run(self, projected: np.ndarray, codes: np.ndarray, real: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """States [time, window, HIDDEN] of one direction; a padded step leaves the state as it is."""
        h = np.zeros((len(codes), HIDDEN), np.float32)
        states = np.empty((codes.shape[1], len(codes), HIDDEN), np.float32)
        recurrent, k = self.p[f"U{d}"], HIDDEN
        for t in range(codes.shape[1])[:: 1 if d == "f" else -1]:
            given, own = projected[codes[:, t]], h @ recurrent
            gates = sigmoid(given[:, : 2 * k] + own[:, : 2 * k])
            r, z = gates[:, :k], gates[:, k:]
            n = np.tanh(given[:, 2 * k :] + r * own[:, 2 * k :])
            before = h
            h = np.where(real[:, t, None], n + z * (h - n), h)
            states[t] = h
            if keep is not None:
                keep.append((t, before, r, z, n, own[:, 2 * k :]))
        return states

    def pooled(self, states: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Attention weights [time, window] and the pooled states; windows of padding alone pool to zero."""
        e = np.where(real.T, states @ self.p["v"], np.float32(-1e9))
        a = np.exp(e - e.max(axis=0)) * real.T
        a /= np.maximum(a.sum(axis=0), np.float32(1e-9))
        return a, np.einsum("tw,twh->wh", a, states)

    def logits(self, inputs: np.ndarray, codes: np.ndarray) -> np.ndarray:
        forward, backward = self.projected(inputs, "f"), self.projected(inputs, "b")
        out = np.empty(len(codes), np.float32)
        for at in range(0, len(codes), 1024):
            part = codes[at : at + 1024]
            real = part < len(inputs)
            states = np.concatenate([self.run(forward, part, real, "f"), self.run(backward, part, real, "b")], axis=2)
            out[at : at + 1024] = self.pooled(states, real)[1] @ self.p["w"] + self.p["b"]
        return out

    def gradients(self, words: Vocabulary, codes: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> dict[str, np.ndarray]:
        p, k = self.p, HIDDEN
        x = self.inputs(words)
        real, kept = codes < len(x), {"f": [], "b": []}
        states = np.concatenate([self.run(self.projected(x, d), codes, real, d, kept[d]) for d in "fb"], axis=2)
        a, pooled = self.pooled(states, real)
        error = ((sigmoid(pooled @ p["w"] + p["b"]) - labels) * weights / weights.sum()).astype(np.float32)
        g = {"w": pooled.T @ error, "b": error.sum(keepdims=True)}
        d_pooled = error[:, None] * p["w"]
        d_a = np.einsum("twh,wh->tw", states, d_pooled)
        d_e = a * (d_a - (a * d_a).sum(axis=0))
        g["v"] = np.einsum("tw,twh->h", d_e, states)
        d_states = a[:, :, None] * d_pooled + d_e[:, :, None] * p["v"]
        d_x = np.zeros_like(x)
        for d, part in (("f", slice(0, k)), ("b", slice(k, 2 * k))):
            recurrent, carried = p[f"U{d}"], np.zeros((len(codes), k), np.float32)
            d_u, d_steps = np.zeros_like(recurrent), []
            for t, before, r, z, n, own in reversed(kept[d]):
                whole = d_states[t, :, part] + carried
                now = whole * real[:, t, None]
                d_n = now * (1 - z) * (1 - n * n)
                d_r, d_z = d_n * own * r * (1 - r), now * (before - n) * z * (1 - z)
                d_own = np.concatenate([d_r, d_z, d_n * r], axis=1)
                d_steps.append((codes[:, t], np.concatenate([d_r, d_z, d_n], axis=1)))
                d_u += before.T @ d_own
                carried = now * z + (whole - now) + d_own @ recurrent.T
            d_given = summed_rows(np.concatenate([c for c, _ in d_steps]), np.concatenate([v for _, v in d_steps]), len(x) + 1)[:-1]
            g |= {f"U{d}": d_u, f"W{d}": x.T @ d_given, f"c{d}": d_given.sum(axis=0)}
            d_x += d_given @ p[f"W{d}"].T
        g["word"] = summed_rows(words.words, d_x[:, :WIDTH], WORD_ROWS)
        g["gram"] = summed_rows(words.grams, (d_x[:, WIDTH:] / np.sqrt(words.counts)[:, None])[words.owners], GRAM_ROWS)
        return g


def windows(codes: np.ndarray, bounds: np.ndarray, padding: int) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping windows [window, WINDOW] over each text and the text of each; a text without words has one, all padding."""
    sizes = np.diff(bounds)
    counts = 1 + np.maximum(0, -(-(sizes - WINDOW) // STRIDE))
    text = np.repeat(np.arange(len(sizes)), counts)
    first = (np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)) * STRIDE
    return laid_out(codes, bounds[text] + first, bounds[text + 1], padding), text


def laid_out(codes: np.ndarray, first: np.ndarray, end: np.ndarray, padding: int) -> np.ndarray:
    """[window, WINDOW] codes from ``first`` on, with padding from ``end`` on."""
    at = first[:, None] + np.arange(WINDOW)
    inside = at < end[:, None]
    return np.where(inside, np.append(codes.astype(np.int32), np.int32(padding))[np.minimum(at, len(codes))], np.int32(padding))


def texts_of(batch: pa.Array) -> tuple[Vocabulary, np.ndarray, np.ndarray]:
    codes, bounds, words = split_words(batch, lower=True)
    return Vocabulary(words), *windows(codes, bounds, len(words))


def evidence(logits: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
    """What all windows of each text say: the three worst logits, how many windows are toxic, and how many there are."""
    order = np.lexsort((-logits, text))
    rank = np.arange(len(order)) - np.searchsorted(text[order], text[order])
    out = np.full((texts, TOP), -6.0)
    top = rank < TOP
    out[text[order][top], rank[top]] = np.clip(logits[order][top], -6, 8)
    count = np.bincount(text, weights=1 / (1 + np.exp(-np.clip(logits, -30, 30).astype(np.float64))), minlength=texts)
    return np.column_stack([out, np.log1p(count), np.log1p(np.bincount(text, minlength=texts))])


def fit_head(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A ridge logistic model over the evidence: means, scales and weights, the last one the intercept."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        ridge = np.append(np.full(len(w) - 1, 0.5), 1e-6)
        w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (p - y) + ridge * w)
    return mean, scale, w


class Scorer:
    """A trained network and the model over its windows; ``blank`` is the score of texts without words."""

    def __init__(self, net: Network, head: tuple[np.ndarray, np.ndarray, np.ndarray], blank: float):
        self.net, self.head, self.blank = net, head, blank

    def scores(self, texts: pa.Array) -> np.ndarray:
        mean, scale, w = self.head
        z = (text_evidence(self.net, texts) - mean) / scale
        found = 1 / (1 + np.exp(-np.clip(z @ w[:-1] + w[-1], -30, 30)))
        bare = pc.equal(pc.binary_length(pc.ascii_trim_whitespace(pc.fill_null(texts, ""))), 0)
        return np.where(np.asarray(bare), self.blank, found)


def text_evidence(net: Network, texts: pa.Array) -> np.ndarray:
    words, codes, text = texts_of(texts)
    return evidence(net.logits(net.inputs(words), codes), text, len(texts))


def texts_with(doc: np.ndarray, codes: np.ndarray, bounds: np.ndarray, words: int) -> np.ndarray:
    """In how many documents each word stands (``doc``: of each window, in order), some windows at a time."""
    out = np.zeros(words, np.int64)
    starts = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    for part in np.array_split(starts, max(1, len(doc) // 8192)):
        if len(part):
            after = starts[np.searchsorted(starts, part[-1], "right") :]
            last = after[0] if len(after) else len(doc)
            own = np.repeat(doc[part[0] : last], np.diff(bounds[part[0] : last + 1]))
            own = np.unique(own, return_inverse=True)[1]
            out += np.bincount(np.unique(own * np.int64(words) + codes[bounds[part[0]] : bounds[last]]) % words, minlength=words)
    return out


def train(texts: pa.Array, doc: np.ndarray, labels: np.ndarray, steps: int = STEPS) -> Network:
    """A network that has learnt from windows (``doc``: the document of each, in order; ``labels``: 0 and 1).

    A step draws as many windows of toxic documents as ``TOXIC_SHARE`` says; only drawn windows are laid out.
    """
    codes, bounds, names = split_words(texts, lower=True)
    words, net, rng = Vocabulary(names), Network(), np.random.default_rng(SEED)
    met = texts_with(doc, codes, bounds, len(names)) if len(names) else np.zeros(0, np.int64)
    seen = {"word": np.bincount(words.words, weights=met, minlength=WORD_ROWS), "gram": np.bincount(words.grams, weights=met[words.owners], minlength=GRAM_ROWS)}
    used_rows = {name: (n >= LEAST_TEXTS)[:, None] for name, n in seen.items()}
    for name, rows in used_rows.items():
        net.p[name] *= rows
    first = {k: np.zeros_like(v) for k, v in net.p.items()}
    second = {k: np.zeros_like(v) for k, v in net.p.items()}
    pools = [np.flatnonzero(labels == y) for y in (1, 0)]
    for step in range(steps):
        some = np.concatenate([rng.choice(pools[0], int(BATCH * TOXIC_SHARE)), rng.choice(pools[1], BATCH - int(BATCH * TOXIC_SHARE))])
        drawn = laid_out(codes, bounds[some], bounds[some + 1], len(names))
        used = np.unique(drawn)
        used = used[used < len(names)]
        part, own_codes = subset(words, used), np.searchsorted(used, drawn)
        rate = RATE * min(1.0, 2.0 * (1 - step / steps))
        for name, g in net.gradients(part, own_codes, labels[some].astype(np.float32), np.ones(BATCH, np.float32)).items():
            if name in used_rows:
                g = g * used_rows[name]
                net.p[name] *= 1 - rate * DECAY
            first[name] = 0.9 * first[name] + 0.1 * g
            second[name] = 0.99 * second[name] + 0.01 * g * g
            net.p[name] -= rate * (first[name] / (1 - 0.9 ** (step + 1))) / (np.sqrt(second[name] / (1 - 0.99 ** (step + 1))) + 1e-6)
    return net


def subset(words: Vocabulary, used: np.ndarray) -> Vocabulary:
    """The vocabulary of the given words alone, in their order."""
    out = object.__new__(Vocabulary)
    out.words, out.counts = words.words[used], words.counts[used]
    counts = out.counts.astype(np.int64)
    out.starts = np.cumsum(counts) - counts
    out.owners = np.repeat(np.arange(len(used)), counts)
    out.grams = words.grams[np.repeat(words.starts[used] - out.starts, counts) + np.arange(counts.sum())]
    return out


def training_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, toxic, text) of a bounded sample, by the hash of their ids, of documents that are not held out.

    An id that is labelled twice counts as toxic if one label says so; of an id's texts the one that sorts first is taken.
    """
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.where(fold(F.col("doc_id")) != HELD_OUT)
    picked = None
    for toxic, most in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN)):
        part = known.where(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        picked = part if picked is None else picked.unionAll(part)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    return written(rows, "toxicity-sample")


WINDOWS = "doc_id long, toxic int, place int, text string"
_WINDOWS = pa.schema([("doc_id", pa.int64()), ("toxic", pa.int32()), ("place", pa.int32()), ("text", pa.string())])


def sample_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of each sampled text that the network may learn from, at most SAMPLE_WINDOWS, as their words."""
    kept("toxicity")
    for batch in batches:
        for part in slices(batch, 2):
            codes, bounds, words = split_words(part.column(2), lower=True)
            counts = 1 + np.maximum(0, -(-(np.diff(bounds) - WINDOW) // STRIDE))
            row = np.repeat(np.arange(part.num_rows), counts)
            place = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
            ids = part.column(0).to_numpy().astype(np.uint64)
            order = np.lexsort((spread(ids[row] * MIX + place.astype(np.uint64), 1 << 40), row))
            rank = np.arange(len(order)) - (np.cumsum(counts) - counts)[row[order]]
            some = np.sort(order[rank < SAMPLE_WINDOWS])
            row, place = row[some], place[some]
            first = bounds[row] + place * STRIDE
            size = np.minimum(bounds[row + 1], first + WINDOW) - first
            at = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), words.take(pa.array(codes[at])).cast(pa.string()))
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row)), pa.array(place, pa.int32()), pc.binary_join(lists, " ")], schema=_WINDOWS)


def trained_network(sample: DataFrame) -> Network:
    """Train in one task, whose rows the sample's limits bound; only the parameters (4 MB) come to the driver."""
    steps = STEPS

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("toxicity")
        rows = pa.Table.from_batches(batches, _WINDOWS)
        text = pa.concat_arrays(rows["text"].chunks)
        net = train(text, rows["doc_id"].to_numpy(), rows["toxic"].to_numpy(), steps)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(net.p)], pa.binary())], names=["parameters"])

    own = sample.select("doc_id", "toxic", "text").mapInArrow(sample_windows, WINDOWS)
    row = own.repartition(1).sortWithinPartitions("doc_id", "place").mapInArrow(learn, "parameters binary").first()
    net = Network()
    net.p = pickle.loads(row.parameters)
    return net


def fitted(docs: DataFrame, labels: DataFrame) -> Scorer | float:
    """A scorer, or the share of toxic rows where there are not two labels to tell apart.

    The network learns from three documents of four of the sample; the model over its windows from the fourth, which the
    network has not seen.
    """
    sample = training_sample(docs, labels).withColumn("apart", F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(APART)) == 0)
    counts = {(r.apart, r.toxic): r["count"] for r in sample.groupBy("apart", "toxic").count().collect()}
    share = (sum(n for (_, toxic), n in counts.items() if toxic) + 0.5) / (sum(counts.values()) + 50.0)
    if len(counts) < 4:
        return share
    net = trained_network(sample.where("not apart"))
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("toxicity")
        for batch in batches:
            for part in slices(batch, 2):
                x = text_evidence(shared.value, part.column(2))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "toxic", "x"])

    got = sample.where("apart").select("doc_id", "toxic", "text").mapInArrow(measure, "doc_id long, toxic int, x array<double>")
    rows = sorted(got.collect())
    shared.destroy()
    return Scorer(net, fit_head(np.array([r.x for r in rows]), np.array([r.toxic for r in rows], float)), share)


def scorer(docs: DataFrame, labels: DataFrame):
    """A column function from text to score, trained on the labels."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        kept("toxicity")
        found = shared.value
        if isinstance(found, float):
            return pd.Series(np.full(len(texts), found))
        batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string(), from_pandas=True)], names=["text"])
        return pd.Series(np.concatenate([np.zeros(0), *(found.scores(part.column(0)) for part in slices(batch, 0, 256, 1 << 20))]))

    return score


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score every row of ``docs`` (``doc_id``, ``text``), learning from ``labels`` (``doc_id``, ``toxic``) outside the held-out fold.

    Returns doc_id, held_out, score (0 to 1) and predicted (1 from 0.5 on). Texts without words, null ones among them,
    get the smoothed share of toxic documents in the sample; equal texts get equal scores. Repeated rows and null ids are scored like any other; null labels are left
    out, and an id with both labels counts as toxic; without labels of both kinds every score is the smoothed share of
    toxic ones; an empty table gives no rows; other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = docs.select("doc_id", scorer(docs, labels)("text").alias("score"))
    return scored.select("doc_id", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``score_toxicity`` predicts 0 for, with all their columns.

    Null and empty texts, null ids and repeated rows are judged like any other: rows of one text stay or go together.
    """
    return docs.where(scorer(docs, labels)(F.col("text").cast("string")) < 0.5)
