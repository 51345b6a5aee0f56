"""Exact duplicates, phrases and the filter audit against plain Python, on awkward rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest

from packetloom.llm import exact_dedup, filter_audit, phrases

SCHEMA = "doc_id long, text string, lang string, source string, digest string, n long, part string, node long, phrase string, rank int"


def frame(spark, rows):
    """Documents with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, lang, "s", "x", 7, "y", 1, "z", 2) for i, t, lang in rows], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


AWKWARD = [
    (3, "a b", "en"), (1, "ab", "en"), (2, " a\tb ", "de"), (4, None, None), (5, "", "en"), (6, " \n\x0b\x0c\r", ""), (7, "A b", "en"), (None, "a  b!", "en"), (8, "a b!", "fr"),
    (9, "é x", "fr"), (10, "é  x", "fr"), (11, "éx", None), (12, "ab", "en"), (12, "ab", "en"), (None, None, "en"), (13, "w " * 30_000, "en"), (14, "w" * 30_000, "de"),
]


def exact_by_hand(rows):
    groups = defaultdict(list)
    for k, (i, text, _) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), i is None, i, k))
    out = []
    for text, members in groups.items():
        best = min(members, key=lambda m: (m[0], m[1], m[2] or 0))
        sha = hashlib.sha256(text.encode()).hexdigest()
        same = [m for m in members if m[:3] == best[:3]]
        out += [(m[2], best[2], len(members), m[3] == same[0][3], sha) for m in members]
    return out


def plain(rows):
    return sorted(map(str, rows))


def test_exact_duplicates(spark):
    found = [tuple(r) for r in exact_dedup.exact_duplicates(frame(spark, AWKWARD).repartition(3)).collect()]
    assert plain(found) == plain(exact_by_hand(AWKWARD))
    assert exact_dedup.exact_duplicates(frame(spark, [])).collect() == []


def test_exact_duplicates_in_many_runs(spark, monkeypatch):
    """Three rounds of base 2, copies in every run, a third of the rows one text."""
    monkeypatch.setattr(exact_dedup, "FAN_IN", 2)
    draw = random.Random(3)
    rows = [(i, "hot text" if i % 3 == 0 else f"text {draw.randrange(40)}" + " " * draw.randrange(3), "en") for i in range(400)]
    found = [tuple(r) for r in exact_dedup.exact_duplicates(frame(spark, rows).repartition(7)).collect()]
    assert plain(found) == plain(exact_by_hand(rows))


def test_merge_keeps_apart_what_hashes_alone_would_join():
    row = lambda digest, size, check, n_chars, keep: (0, digest, size, check, n_chars, keep, keep, 1)
    rows = [row(b"d", 5, 1, 9, 1), row(b"d", 5, 1, 7, 2), row(b"d", 5, 2, 9, 3), row(b"d", 6, 2, 9, 4), row(b"e", 6, 2, 9, 5)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), exact_dedup._ENTRY, strict=True)], schema=exact_dedup._ENTRY) for part in (rows[:1], rows[1:2], rows[2:])]
    merged = pa.Table.from_batches(list(exact_dedup._merge(iter(batches)))).to_pylist()
    assert [(r["keep_id"], r["n"]) for r in merged] == [(1, 2), (3, 1), (4, 1), (5, 1)]


def phrases_by_hand(rows, least, most):
    count, total = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            own = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(own)
            for m in range(1, 6):
                count[lang].update(tuple(own[i : i + m]) for i in range(len(own) - m + 1))
    out = []
    for lang, f in count.items():
        kept = []
        for p, a in f.items():
            if len(p) < 2 or a < least:
                continue
            if any(b >= a and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in f.items()):
                continue
            score, k = min((1000 * a * total[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, turn, p.decode(), -a, left, right, total[lang], -s) for turn, (s, a, p, left, right) in enumerate(sorted(kept)[:most], 1)]
    return out


@pytest.mark.parametrize("trie", [400_000, 5])
def test_phrases(spark, monkeypatch, trie):
    """Also with tries of few phrases, so that several are built and counted in several passes."""
    monkeypatch.setattr(phrases, "TRIE_PHRASES", trie)
    draw, pool = random.Random(5), ["the", "The", "cat", "sat", "on", "mat", "é", "ß x", "x-y", "Zoë"]
    rows = [(i, draw.choice([" ", "  ", "\t"]).join(draw.choice(pool) + draw.choice(["", "", "", ".", ",\n"]) for _ in range(draw.randrange(60))), draw.choice(["en", "de", None])) for i in range(150)]
    rows += [(1, "one two three four five six", "en")] * 9 + [(2, None, "en"), (3, "", None), (4, "a a a a a a a a a a a a", "de"), (5, "...,;", "xx"), (None, "lone", "yy")]
    rows += [(6, "z" * 100_000 + " " + "long words " * 5_000, "de")]
    found = [tuple(r) for r in phrases.top_phrases(frame(spark, rows).repartition(3), 8, 60).collect()]
    assert plain(found) == plain(phrases_by_hand(rows, 8, 60))
    assert found
    if trie > 5:
        assert phrases.top_phrases(frame(spark, [])).collect() == []
        assert phrases.top_phrases(frame(spark, [(1, None, None), (2, "", "en")])).collect() == []


def test_double_array_holds_each_step_and_no_other():
    draw = np.random.default_rng(1)
    seqs = sorted({tuple(draw.integers(0, 50, draw.integers(1, 5)).tolist()) for _ in range(2000)})
    nodes = sorted({s[:k] for s in seqs for k in range(1, len(s) + 1)}, key=lambda s: (len(s), s))
    number = {(): 0, **{s: k for k, s in enumerate(nodes, 1)}}
    parent, label = np.array([number[s[:-1]] for s in nodes]), np.array([s[-1] for s in nodes])
    base, check, slot = phrases.double_array(parent, label, 50)
    assert len(set(slot.tolist())) == len(slot)
    for s, k in number.items():
        for c in range(50):
            ahead = base[slot[k]] + c
            assert (check[ahead] == slot[k]) == ((*s, c) in number)
            assert check[ahead] != slot[k] or ahead == slot[number[*s, c]]


def audit_by_hand(rows, labels):
    first = {}
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    masks = defaultdict(list)
    for i, text, lang in rows:
        text = text or ""
        w = words(text)
        fails = {
            "A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(re.search(r"[#$%&*|]", text)),
            "E": i is not None and i > first[text],
        }
        own = [r for r in labels if r[0] == i and i is not None]
        masks[lang or ""].append((fails, any(r[1] == 1 for r in own), any(r[2] == 1 for r in own)))
    out = []
    for part, docs in masks.items():
        shapley, found = Counter(), []
        for order in permutations("ABCDE"):
            left = docs
            for step, x in enumerate(order, 1):
                gone = [d for d in left if d[0][x]]
                left = [d for d in left if not d[0][x]]
                shapley[x] += len(gone)
                only = sum(d[0][x] and sum(d[0].values()) == 1 for d in docs)
                found.append((x, part, "".join(order), step, len(left), len(gone), sum(d[0][x] for d in docs) - len(gone), only, sum(d[1] for d in gone), sum(d[2] for d in gone)))
        out += [(*row, shapley[x]) for x, *row in found]
    return out


def test_filter_audit(spark):
    draw = random.Random(9)
    rows = [(i, " ".join(draw.choice(["word", "Ab", "CD", "x$", f"w{i}{k}"][: draw.randrange(1, 6)]) for k in range(draw.randrange(0, 160))), draw.choice(["en", "de", None, ""])) for i in range(150)]
    rows += [(200 + i, "same text", "en") for i in range(40)] + [(200, "same text", "de"), (None, "same text", "en"), (None, None, None), (300, None, "en"), (301, "", "de")]
    rows += [(302, " ".join(f"plain{k}" for k in range(120)), "en"), (303, "É" * 50 + " A", "en"), (304, "Word " * 50_000, "fr")]
    labels = [(i, draw.choice([0, 1, None]), draw.choice([0, 1, None])) for i in range(0, 260, 2)] + [(200, 1, 0), (200, 0, 1), (None, 1, 1), (999, 1, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = [tuple(r) for r in filter_audit.audit_filters(frame(spark, rows).repartition(3), table).collect()]
    assert plain(found) == plain(audit_by_hand(rows, labels))
    assert filter_audit.audit_filters(frame(spark, []), table).collect() == []
    none = filter_audit.audit_filters(frame(spark, rows[:9]), table.limit(0)).agg({"good_lost": "sum", "toxic_lost": "sum"}).first()
    assert tuple(none) == (0, 0)


def test_ranks_and_intervals():
    assert [filter_audit.order_of(k) for k in range(120)] == ["".join(p) for p in permutations("ABCDE")]
    assert len(filter_audit.intervals()) < 900
    for mask in range(32):
        covered = {(rank, step) for m, step, start, stop in filter_audit.intervals() if m == mask for rank in range(start, stop)}
        failed = [x for k, x in enumerate("ABCDE") if mask >> k & 1]
        assert covered == {(rank, 1 + min(map(order.index, failed))) for rank, order in enumerate(map("".join, permutations("ABCDE"))) if failed}
