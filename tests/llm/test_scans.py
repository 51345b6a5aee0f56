"""URL rules, secrets, repetition rules and decontamination against plain Python."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from packetloom.llm import decontamination, repetition, secret_scan, url_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " \n\t ", "one", "\n\n\nx\nx\n x\n", "ſecret=abcdefgh éé 東京 \U0001f600\n" * 3, "a b c " * 400]


def docs_of(spark, texts):
    return spark.createDataFrame([(k, t, "clash", 3) for k, t in enumerate(texts)], "doc_id long, text string, host string, n_words int")


def sample_texts(spark, sf_dir):
    return [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]


# ---- URL rules


def judged(url, rules):
    rest = None if url is None or "://" not in url else url.split("://", 1)[1]
    host = "" if rest is None else re.match(r"[^/?#]*", rest)[0]
    path = "" if rest is None else re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h + p), len(h), h, h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


@pytest.mark.parametrize("seed", [1, 2])
def test_url_rules(spark, seed):
    rng = random.Random(seed)
    labels, parts = ["a", "b", "org", "x-y", "bb", "é"], ["/", "/e", "/en", "/en/1", "", "/en/12", "/é"]
    hosts = [".".join(rng.choice(labels) for _ in range(rng.randint(1, 4))) for _ in range(60)]
    rules = {}
    for _ in range(40):
        rules[rng.choice(hosts), rng.choice(parts)] = rng.choice(["allow", "block"])
    rules = [(h, p, v) for (h, p), v in rules.items()]
    urls = [f"http://{rng.choice(hosts).upper() if k % 3 else rng.choice(hosts)}{rng.choice(parts)}{rng.choice(['', '?q=/en', '#f', '/z'])}" for k in range(300)]
    urls += [None, "", "no scheme", "://", "x://?q", "http://a.org:80/en", "http://.org/en", "a://b://c/d"] + urls[:5]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    table = spark.createDataFrame([*rules, (None, "/", "block"), ("a", None, None)], "host string, path string, verdict string")
    got = {r.page_id: tuple(r)[1:] for r in url_rules.judge_urls(pages, table).collect()}
    assert got == {k: judged(u, rules) for k, u in enumerate(urls)}
    assert url_rules.judge_urls(pages.limit(0), table).count() == 0
    assert {r.verdict for r in url_rules.judge_urls(pages, table.limit(0)).collect()} == {"allow"}


def test_url_rules_of_odd_rows(spark):
    rows = [(1, "http://a.org/en", "x", "y"), (1, "http://a.org/en", "x", "y"), (None, "HTTP://B.A.ORG/en/2", "x", "y"), (None, None, None, None), (2, "http://a.org/" + "z" * 200_000, "x", "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, rule string")
    table = spark.createDataFrame([("a.org", "/en", "block"), ("a.org", "/en", "allow"), ("A.org", "/", "allow"), ("org", "/en/2", "allow")], "host string, path string, verdict string")
    got = sorted((str(r.page_id), r.host, str(r.rule), r.verdict) for r in url_rules.judge_urls(pages, table).collect())
    assert got == sorted([("1", "a.org", "a.org/en", "block")] * 2 + [("None", "b.a.org", "a.org/en", "block"), ("None", "", "None", "allow"), ("2", "a.org", "a.org/", "allow")])


# ---- secrets


def test_secrets(spark, sf_dir):
    extra = ["password:token: abcdefgh", 'API_KEY = "abc.def-9"', "AKIA" + "A1" * 9 + " AKIA12", "f" * 23 + " " + "0a" * 12, "apikey:short", "K" * 3 + "secret=" + "z" * 6]
    texts = sample_texts(spark, sf_dir) + ODD + extra + extra
    got = secret_scan.scan_secrets(docs_of(spark, texts)).collect()
    assert len(got) == len(texts)
    rx = {
        "assign": re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
        "access": re.compile("AKIA[A-Z0-9]+"),
        "hex": re.compile("[0-9a-f]+"),
    }
    for r in got:
        t = texts[r.doc_id] or ""
        base = [(m.start(), n, k, m.end()) for n, k in enumerate(rx) for m in rx[k].finditer(t) if len(m[2] if k == "assign" else m[0]) >= (6, 20, 24)[n]]
        joined = ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(base))
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(x[2] == k for x in base) for k in rx]
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))
    assert secret_scan.scan_secrets(docs_of(spark, texts).limit(0)).count() == 0


def test_ledger_scans_only_new_blobs(spark):
    ledger = secret_scan.BlobLedger(spark)
    one = spark.createDataFrame([(1, "token = abcdefgh"), (2, "token = abcdefgh"), (None, None), (1, "old")], "doc_id long, text string")
    assert secret_scan.scan_secrets(one, ledger).count() == 4
    before = ledger.rows().collect()
    assert len(before) == 3
    two = one.unionAll(spark.createDataFrame([(9, "new"), (9, "new")], one.schema))
    assert secret_scan.scan_secrets(two, ledger).count() == 6
    after = ledger.rows().collect()
    assert len(after) == 4 and all(r in after for r in before)


def test_ledger_scans_each_new_blob_without_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(secret_scan, "BROADCAST_ROWS", 0)
    monkeypatch.setattr("packetloom.llm.common.BLOOM_BITS", 1 << 7)  # so full that rows are kept back by mistake
    ledger = secret_scan.BlobLedger(spark)
    rows = [(k % 90, f"token = abcdefgh{k % 70}") for k in range(300)] + [(None, "password=hunter22"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for part in (docs.where("doc_id < 40"), docs, docs):
        got = secret_scan.scan_secrets(part, ledger)
        assert got.count() == part.count() and got.where("base_sha256 is null").count() == 0
    assert ledger.rows().count() == ledger.spark.read.parquet(ledger.path).count() == 72


def test_bloom_test_knows_all_keys(spark):
    from pyspark.sql import functions as F

    from packetloom.llm.common import bloom_test

    keys = spark.range(3000).select(F.xxhash64("id").alias("k"))
    assert keys.where(bloom_test(keys)("k")).count() == 3000
    assert spark.range(3000, 23_000).where(bloom_test(keys)(F.xxhash64("id"))).count() < 800


@pytest.mark.parametrize("most", [0, 1000])
def test_redact(spark, monkeypatch, most):
    monkeypatch.setattr(secret_scan, "BROADCAST_ROWS", most)
    docs = spark.createDataFrame([(1, "a token = abcdefgh b", 20), (2, None, None), (3, "clean", 5), (3, "clean", 5)], "doc_id long, text string, n_chars long")
    got = sorted(map(tuple, secret_scan.redact(docs).collect()))
    assert got == [(1, "a <secret> b", 12), (2, None, None), (3, "clean", 5), (3, "clean", 5)]


@pytest.mark.parametrize("broken", ["\n", "\r\n", "\\n", " ", '\\n" +\n  "', "\n> "])
@pytest.mark.parametrize("end", [True, False])
def test_redact_masks_whole_keys(spark, broken, end):
    rng = random.Random(8)
    body = ["".join(rng.choice("ABCDxyz0189+/") for _ in range(64)) for _ in range(5)] + ["aB3/" * 4 + "Qw=="]
    head = ["Proc-Type: 4,ENCRYPTED", "DEK-Info: AES-128-CBC,0123ABCD", ""] if broken in ("\n", "\r\n") else []
    key = broken.join(["-----BEGIN RSA PRIVATE KEY-----", *head, *body] + ["-----END RSA PRIVATE KEY-----"] * end)
    cert = "-----BEGIN CERTIFICATE-----\nMIIBcert\n-----END CERTIFICATE-----"
    texts = [f"before {key}\nafter the key. {cert}", f"{key}\n\n{key}\n\nplain words end.", "see -----BEGIN PRIVATE KEY----- lines of text"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r.text for r in secret_scan.redact(docs).orderBy("doc_id").collect()]
    assert not [line for line in body + [x for x in head if x] for text in got if line in text]
    assert got[0] == f"before <secret>\nafter the key. {cert}"
    assert got[1] == "<secret>\n\n<secret>\n\nplain words end."
    assert got[2] == "see <secret> lines of text"


def test_short_last_line_of_a_cut_key():
    key = "-----BEGIN PRIVATE KEY-----\n" + "Ab+/" * 16 + "\nQ1w2"
    assert secret_scan.scan(f"x {key}\nmore text, plain")[4] == f"pem:2:{2 + len(key)}"
    many = "-----BEGIN PRIVATE KEY-----\nword " * 5000
    assert secret_scan.scan(many)[4].count("pem:") == 5000


# ---- repetition


def test_repetition_of_odd_rows(spark):
    rows = [(1, "a b c " * 30, 5), (1, "a b c " * 30, 5), (1, None, 5), (None, "x y", 5), (None, "", 5), (2, "w" * 300_000, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int")
    got = sorted((str(r.doc_id), r.n_words, r.word_chars, r.base_failed, r.kept) for r in repetition.repetition_rules(docs).collect())
    assert got == sorted([("1", 90, 90, True, False), ("1", 90, 90, True, False), ("1", 0, 0, True, False), ("None", 2, 2, True, False), ("None", 0, 0, True, False), ("2", 1, 300_000, True, False)])


def test_repetition(spark, sf_dir):
    texts = sample_texts(spark, sf_dir) + ODD
    got = repetition.repetition_rules(docs_of(spark, texts)).collect()
    assert len(got) == len(texts)
    for r in got:
        t = texts[r.doc_id] or ""
        w = WORD.findall(t)

        def inside(n, w=w):
            grams = [tuple(w[k : k + n]) for k in range(len(w) - n + 1)]
            twice = Counter(grams)
            return {k + j for k, g in enumerate(grams) if twice[g] > 1 for j in range(n)}

        seen, dup = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        want = [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(inside(3))]
        assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] == want
        for n in repetition.NGRAM_LIMITS:
            assert r[f"dup_{n}gram_chars"] == sum(len(w[k]) for k in inside(n))
        assert r.base_failed == (len(w) < 50 or 100 * want[4] > 50 * len(w))
        assert not (r.base_failed and r.kept)
    assert repetition.repetition_rules(docs_of(spark, []).limit(0)).count() == 0


# ---- decontamination


def edit_distance_inside(pattern, text):
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for k, p in enumerate(pattern):
            new.append(min(row[k] + (p != c), row[k + 1] + 1, new[k] + 1))
        row = new
        best = min(best, row[-1])
    return best


def plain(text):
    return re.sub(r"[\W_]+", " ", text.lower()).strip()


def test_decontamination(spark, sf_dir):
    rng = random.Random(3)
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()][:12]
    filler = " ".join(sample_texts(spark, sf_dir)[2:6])[:1500]
    docs, edits = [], [0, 1, 4, 8, 12, 20, 30]
    for n, (_, text) in enumerate(bench):
        chars = list(text)
        for _ in range(edits[n % len(edits)]):
            k = rng.randrange(len(chars))
            rng.choice([lambda: chars.__setitem__(k, "q"), lambda: chars.insert(k, "z"), lambda: chars.pop(k)])()
        at = rng.randrange(200)
        docs.append(filler[:at] + "; " + "".join(chars).upper().replace(" ", "\n ") + "!" + filler[at : at + 300])
    docs += [bench[0][1], bench[1][1] + bench[1][1], filler, None, "", bench[2][1][: len(bench[2][1]) // 2]]
    table = spark.createDataFrame([*bench, (99, None), (98, "too short")], "item_id long, text string")
    got = decontamination.find_passages(docs_of(spark, docs), table).collect()
    want = set()
    for k, doc in enumerate(docs):
        for item, text in bench:
            p = plain(text)
            if len(p) >= decontamination.MIN_CHARS and edit_distance_inside(p, plain(doc or "")) <= int(decontamination.EDIT_RATE * len(p)):
                want.add((k, item))
    assert {(r.doc_id, r.item_id) for r in got} == want and len(want) >= 8
    for r in got:
        p = plain(dict(bench)[r.item_id])
        region = plain(docs[r.doc_id][r.start : r.end])
        assert abs(len(region) - len(p)) <= r.edits and edit_distance_inside(p, region) == r.edits
    assert sum(r.doc_id == 13 for r in got) == 2
    left = decontamination.drop_contaminated(docs_of(spark, docs), table)
    assert sorted(r.doc_id for r in left.collect()) == [k for k in range(len(docs)) if k not in {x[0] for x in want}]
    assert decontamination.find_passages(docs_of(spark, docs), table.limit(0)).count() == 0


def test_passage_blocks_and_pieces(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK_CHARS", 300)
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(400)]
    long = " ".join(words[:220])
    bench = spark.createDataFrame([(1, long), (2, " ".join(words[220:260])), (3, " ".join(words[260:300]))], "item_id long, text string")
    docs = docs_of(spark, [f"x {long} y", " ".join(words[210:270]), " ".join(words[90:150]), "none"])
    got = {(r.doc_id, r.item_id) for r in decontamination.find_passages(docs, bench).collect()}
    # 60 running words (419 characters) of a long item are more than the 399 that are sure to be found.
    assert got == {(0, 1), (1, 2), (2, 1)}


def random_words(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n)]


def test_a_long_item_is_one_region_whole_or_cut():
    long = " ".join(random_words(6, 715))[:5000].strip()
    index = decontamination.PassageIndex([(1, long), (2, " ".join(random_words(7, 300)))])
    half = long[: len(long) // 2]
    for text, edits in ((f"zz {long} zz", 0), (f"zz {half} zz", 0), (f"{half[:900]}qq{half[902:]} zz", 2), (f"{half[:900]}{half[905:]} zz", 5)):
        (item, start, end, found), = index.search(text)
        assert (item, found) == (1, edits) and abs((end - start) - (len(text) - 6 if text[0] == "z" else len(text) - 3)) <= 60
    assert {x[0] for x in index.search(f"{half} filler {long[3000:3500]}")} == {1} and len(index.search(f"{half} filler {long[3000:3500]}")) == 2
    assert not index.search(long[100:250])


def test_ten_million_characters_are_one_pass(spark):
    rng = np.random.default_rng(3)
    items = [(k, rng.integers(97, 123, 100_000, np.uint8).tobytes().decode()) for k in range(99)]
    bench = spark.createDataFrame(items, "item_id long, text string").repartition(4)
    (shared,) = decontamination.shared_indexes(spark, bench)
    docs = docs_of(spark, [f"x {items[5][1][700:1200]} y", "nothing of the kind", items[98][1]])
    got = decontamination.find_passages(docs, bench).collect()
    assert [(r.doc_id, r.item_id, r.edits) for r in sorted(got)] == [(0, 5, 0), (2, 98, 0)]
    shared.destroy()


def test_decontamination_odd_rows(spark):
    bench = spark.createDataFrame([(1, " ".join(random_words(8, 20)))], "item_id long, text string")
    text = f"a {' '.join(random_words(8, 20))} b"
    rows = [(1, text, 7, "s"), (1, text, 7, "s"), (None, text, 7, "s"), (2, None, None, None), (None, "", 0, "s"), (3, "clean " * 9, 1, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, edits int, start string")
    got = decontamination.find_passages(docs, bench).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "1", "None"] and {r.edits for r in got} == {0}
    left = decontamination.drop_contaminated(docs, bench)
    assert left.columns == docs.columns and sorted(map(str, left.collect())) == sorted(map(str, docs.where("text is null or length(text) < 100").collect()))
    assert decontamination.find_passages(docs.limit(0), bench).count() == 0 and decontamination.drop_contaminated(docs.limit(0), bench).count() == 0


def test_stretches_of_long_passages(spark):
    rng = random.Random(5)
    long = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(220))
    index = decontamination.PassageIndex([(1, long)])
    stretch = decontamination.PIECE_CHARS + decontamination.PIECE_STEP - 1
    for a in [*range(0, len(long) - stretch, 37), len(long) - stretch]:
        got = index.search(f"{long[a:a + 9].upper()}{long[a + 9 : a + stretch]}")
        # A passage that the text lacks a few characters of, at either end, is part of the region.
        assert [x[0] for x in got] == [1] and got[0][3] <= 2 * int(decontamination.EDIT_RATE * decontamination.PIECE_CHARS)
    assert [(x[0], x[3]) for x in index.search(long)] == [(1, 0)]
    bench = spark.createDataFrame([(1, long)], "item_id long, text string")
    edited = long[100:500] + "zz" + long[502:800] + long[803:1100]
    left = decontamination.drop_contaminated(docs_of(spark, [f"x {long[100:1100]} y", edited, "none"]), bench)
    assert [r.doc_id for r in left.collect()] == [2]


def test_short_passages(spark):
    items = [(1, "Who wrote Hamlet?"), (2, "東京都の人口は何人ですか"), (3, "What is 2+2?"), (4, "a b c"), (5, "東京都の人口")]
    texts = ["Q: who  wrote HAMLET -- Bacon", "Who wrote Hamlets", "xwho wrote hamlet", "who wrote a hamlet", "who wrote hamlet", "答えて東京都の人口は何人ですかね", "東京都の人口 what is 2 2 a b c"]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.find_passages(docs_of(spark, texts), bench).collect()
    assert {(r.doc_id, r.item_id, texts[r.doc_id][r.start : r.end], r.edits) for r in got} == {(0, 1, "who  wrote HAMLET", 0), (4, 1, "who wrote hamlet", 0), (5, 2, items[1][1], 0)}
    both = "xwho wrote hamlet; who wrote hamlet"
    assert [x[:2] for x in decontamination.PassageIndex(items).search(both)] == [(1, 19)]
    passage = "the thirty-two folded characters"
    assert decontamination.PassageIndex([(7, passage)]).search(passage[:-1])
    left = decontamination.drop_contaminated(docs_of(spark, texts), bench)
    assert sorted(r.doc_id for r in left.collect()) == [1, 2, 3, 6]
