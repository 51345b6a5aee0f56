"""Token ids of whole texts, word by word.

The vocabulary file drops white space and never merges across it, so a text's ids are the ids of its words in order.
Each worker keeps the ids of the words it has met (up to a fixed number), which saves most of the merging; a batch's
distinct words are looked up once each, and its ids are gathered in arrays.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa

from packetloom.llm.common import kept, split_words

#: About 200 bytes each in every worker.
CACHED_WORDS = 400_000
CACHED_WORD_CHARS = 48
#: Words of letters that have one lower-case form, and perhaps a mark whose ids follow theirs.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,]?)")


class WordEncoder:
    """Encodes batches of texts, each text ended by ``end_id``."""

    def __init__(self, path: str, end_id: int, cached: int = CACHED_WORDS):
        self.cached = cached
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.end = np.array([end_id], "<u4").tobytes()
        self.known: dict[str, bytes] = {}
        self.marks = {"": b"", ".": self._ids("."), ",": self._ids(",")}
        self.final = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.final[[k for name, k in self.tokenizer.get_vocab().items() if name.endswith("</w>")]] = True

    def _ids(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _learn(self, words: list[str]) -> None:
        """Words go through the tokenizer in lines: plain ones are parted by the ids that end words, others by offsets."""
        plain, stems, others = [], [], []
        for word in words:
            if found := PLAIN.fullmatch(word):
                plain.append((word, found[2]))
                stems.append(found[1])
            else:
                others.append(word)
        line = self._ids(" ".join(stems))
        ends = (4 * (1 + np.flatnonzero(self.final[np.frombuffer(line, "<u4")]))).tolist()
        if len(ends) != len(plain):
            raise ValueError("the vocabulary doesn't end each word by an id of its own")
        start = 0
        for (word, mark), end in zip(plain, ends, strict=True):
            self.known[word] = line[start:end] + self.marks[mark]
            start = end
        if others:
            self._learn_by_offsets(others)

    def _learn_by_offsets(self, words: list[str]) -> None:
        coded = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        first = np.cumsum([0, *(len(w) + 1 for w in words)])
        owner = np.searchsorted(first, np.fromiter((a for a, _ in coded.offsets), np.int64, len(coded.ids)), "right") - 1
        if (owner[1:] < owner[:-1]).any():
            self.known.update((w, self._ids(w)) for w in words)
            return
        ids, cuts = array("I", coded.ids).tobytes(), (4 * np.searchsorted(owner, np.arange(len(words) + 1))).tolist()
        self.known.update((w, ids[cuts[k] : cuts[k + 1]]) for k, w in enumerate(words))

    def encode_flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in order (uint32) and the bounds of each text (null: empty) in them."""
        codes, bounds, names = split_words(texts)
        words = names.to_numpy(zero_copy_only=False).tolist()
        new = [w for w in words if w not in self.known]
        for at in range(0, len(new), 2048):
            self._learn(new[at : at + 2048])
        own = [*map(self.known.__getitem__, words), self.end]
        room = max(0, self.cached - (len(self.known) - len(new)))
        for k, w in enumerate(new):
            if k >= room or len(w) > CACHED_WORD_CHARS:
                del self.known[w]
        pool, sizes = np.frombuffer(b"".join(own), "<u4"), np.fromiter(map(len, own), np.int64, len(own)) // 4
        run = np.insert(codes, bounds[1:], len(words))
        size = sizes[run]
        after = np.cumsum(size)
        ids = pool[np.repeat((np.cumsum(sizes) - sizes)[run] - after + size, size) + np.arange(after[-1] if len(after) else 0)]
        return ids, np.append(0, after)[bounds + np.arange(len(bounds))]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian uint32 ids of each text."""
        ids, bounds = self.encode_flat(pa.array(texts, pa.string()))
        data = ids.tobytes()
        return [data[4 * a : 4 * b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def encoder(path: str, end_id: int, cached: int = CACHED_WORDS) -> WordEncoder:
    """One encoder for each worker process and file, which keeps at most ``cached`` words."""
    known, key = kept("tokens"), (path, end_id, cached)
    if key not in known:
        known[key] = WordEncoder(*key)
    return known[key]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
