import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from packetloom.llm import packing, token_output

from packetloom.llm.bestfit import best_fit_decreasing
from packetloom.llm.common import split_words
from packetloom.llm.tokens import default_vocabulary, encoder

TOKENIZER = Tokenizer.from_file(default_vocabulary())
ROWS = [(1, "Hello  world\n it's fine"), (2, None), (3, ""), (4, "naïve Été café, " * 3000), (4, "again"), (None, "no id"), (7, "x" * 9000), (8, "<|endoftext|> a b́ \x1c c")]


def expected_ids(text):
    t = TOKENIZER
    return [*t.encode(text or "", add_special_tokens=False).ids, 1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=80))
def test_best_fit(lengths):
    sizes = np.array(lengths, np.int64)
    bins, offsets, fills = best_fit_decreasing(sizes, 50)
    assert fills.sum() == sizes.sum() and (not len(fills) or fills.max() <= 50)
    for b in range(len(fills)):
        own = sorted(zip(offsets[bins == b], sizes[bins == b]))
        at = 0
        for o, s in own:
            assert o == at
            at += s
    # brute force: best fit, decreasing, over a plain list
    rooms = []
    for s in sorted(lengths, reverse=True):
        fit = [r for r in rooms if r >= s]
        if fit:
            rooms.remove(min(fit))
            rooms.append(min(fit) - s)
        else:
            rooms.append(50 - s)
    assert len(fills) == len(rooms)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("abcdEÉéßøÿİſ.,'s|<>#9 \n\t\x1c\u0301\u00a0tre"), max_size=30), max_size=5))
def test_encoder_equals_the_tokenizer(texts):
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder(default_vocabulary(), 1).encode(texts)] == [expected_ids(t) for t in texts]


def test_pack_documents(spark):
    docs = spark.createDataFrame([(i, t, "x", 9) for i, t in ROWS], "doc_id long, text string, piece string, length int")
    got = packing.pack_documents(docs).collect()
    want = sorted((-1 if i is None else i, k // 4096, k, len(p), zlib.crc32(np.array(p, "<u4").tobytes())) for i, t in ROWS for ids in [expected_ids(t)] for k in range(0, len(ids), 4096) for p in [ids[k : k + 4096]])
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append(r)
    for rows in by.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096 and all(r.fill == at for r in rows)
    assert len(by) <= -(-sum(x[3] for x in want) // 4096) + 1
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_merge_rounds_keep_pieces(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ROWS", 40)
    docs = spark.createDataFrame([(i, "word " * (i * 37 % 1500)) for i in range(400)], "doc_id long, text string").repartition(40)
    got = packing.pack_documents(docs).toPandas()
    assert sorted(got.doc_id) == list(range(400))
    sums = got.groupby("sequence_id").length.sum()
    assert sums.max() <= 4096 and len(sums) <= 1.15 * (sums.sum() / 4096) + 2


def test_token_matrices_round_trip(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    rows = token_output.write_token_matrices(docs).collect()
    found = {}
    for r in rows:
        ids = np.frombuffer(r.ids, "<u2")
        assert len(ids) == 4096 and r.cu_seqlens[-1] == r.n_tokens and (ids[r.n_tokens :] == 0).all()
        resets = np.flatnonzero(np.unpackbits(np.frombuffer(r.resets, np.uint8)))
        assert resets.tolist() == r.cu_seqlens[:-1]
        for k in range(r.n_segments):
            found.setdefault(r.doc_ids[k], []).append((r.pieces[k], r.starts[k], ids[r.cu_seqlens[k] : r.cu_seqlens[k + 1]].tolist()))
    whole = sorted((x for i in found for x in texts_of(found[i])), key=str)
    assert whole == sorted((expected_ids(t) for _, t in ROWS), key=str)
    assert sorted(i for i in found if i is not None) == [1, 2, 3, 4, 7, 8] and any(len(t) > 20_000 for t in whole)
    assert token_output.digest(token_output.token_matrices(docs.limit(0))).count() == 0


def texts_of(pieces):
    """The texts of one id from their (piece, start, ids): a piece number 0 begins a text; here only the longest has more."""
    firsts = sorted((p for p in pieces if p[0] == 0), key=lambda p: len(p[2]))
    rest = sorted(p for p in pieces if p[0])
    assert [(p, s) for p, s, _ in rest] == [(k + 1, 4096 * (k + 1)) for k in range(len(rest))]
    out = [p[2] for p in firsts]
    out[-1] = sum((p[2] for p in rest), out[-1])
    return out


def test_matrices_refuse_wide_ids():
    with pytest.raises(ValueError):
        token_output.Pieces().add(pa.array([1]), np.array([70_000], np.uint32), np.array([0, 1]), 4096)


def test_long_text_beside_clashing_columns(spark):
    text = "Étude of 12 things, " * 5000
    docs = spark.createDataFrame([(5, text, 3, "x")], "doc_id long, text string, n_tokens int, ids string")
    rows = sorted((p, s, np.frombuffer(r.ids, "<u2")[r.cu_seqlens[k] : r.cu_seqlens[k + 1]].tolist()) for r in token_output.token_matrices(docs).collect() for k, (p, s) in enumerate(zip(r.pieces, r.starts)))
    assert texts_of(rows) == [expected_ids(text)] and len(rows) > 5


@pytest.mark.parametrize("lower", [True, False])
def test_split_words(lower):
    texts = [None, "", " a  B\tc\n\x0bd\x0ce\r", "É  x y \x1cz", "A" * 100]
    whole = pa.array(["before this slice", *texts, "after"], pa.string())
    filled = pa.array(["before this slice", *(t or "" for t in texts), "after"], pa.string())
    for array in (pa.array(texts, pa.string()), whole.slice(1, len(texts)), filled.slice(1, len(texts))):
        check_words(texts, *split_words(array, lower), lower)


def check_words(texts, codes, offsets, words, lower):
    for k, t in enumerate(texts):
        want = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        if lower:
            want = [re.sub("[A-Z]+", lambda m: m[0].lower(), w) for w in want]
        assert [words[int(c)].as_py() for c in codes[offsets[k] : offsets[k + 1]]] == want
