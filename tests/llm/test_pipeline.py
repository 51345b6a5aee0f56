"""The pipeline's stages against plain Python on a small table with planted rows."""

import re

import corpus_pipeline
import pytest
from test_models import components
from test_scans import edit_distance_inside, plain

from packetloom.llm import decontamination, secret_scan, toxicity


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    source = "/root/testdata/sf0.01"
    path = str(tmp_path_factory.mktemp("corpus"))
    docs = spark.read.parquet(f"{source}/documents.parquet").where("length(text) < 4000").orderBy("doc_id").limit(250)
    bench = spark.read.parquet(f"{source}/benchmark.parquet").orderBy("item_id").limit(6)
    texts = [r.text for r in docs.collect()]
    leaks = [r.text for r in bench.collect()]
    planted = [(5000 + k, f"{texts[k][:200]} {t} tail", "en", "src0", 1) for k, t in enumerate(leaks[:3])]
    planted += [(5100, texts[7], "en", "src0", len(texts[7])), (5101, "the " * 30 + "token = abcdefgh12345", "en", "x", 5), (5102, None, None, None, None), (5103, "", "en", "x", 0)]
    docs.unionByName(spark.createDataFrame(planted, docs.schema)).repartition(3).write.parquet(f"{path}/documents.parquet")
    bench.write.parquet(f"{path}/benchmark.parquet")
    spark.read.parquet(f"{source}/labels.parquet").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder, monkeypatch):
    monkeypatch.setattr(toxicity, "STEPS", 40)  # the model itself is judged in test_models and by test_run
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    bench = [plain(r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in docs.collect()}
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), docs.schema)
        assert docs.columns == columns
        after = {r.doc_id: r for r in docs.collect()}
        if name == "near_duplicates":
            assert set(after) == {i for i, (_, c) in components([(r.doc_id, r.text) for r in before.values()]).items() if c == i}
            assert 5100 not in after
        elif name == "decontamination":
            leaky = {i for i, r in before.items() if any(len(p) >= decontamination.MIN_CHARS and edit_distance_inside(p, plain(r.text or "")) <= int(decontamination.EDIT_RATE * len(p)) for p in bench)}
            assert set(after) == set(before) - leaky and {5000, 5001, 5002} & set(before) <= leaky
        elif name == "secrets":
            assert set(after) == set(before)
            for i, r in after.items():
                dirty = bool(secret_scan.scan(before[i].text or "")[4])
                assert dirty == (r.text != before[i].text)
                assert not secret_scan.scan((r.text or "").replace(secret_scan.MASK, " "))[4] and (not dirty or r.n_chars == len(r.text))
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in docs.collect()}


def test_run(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    ids = {r.doc_id for r in rows}
    assert len(ids) > 150 and 5102 in ids and 5103 in ids and not ids & {5000, 5001, 5002, 5100}
    assert max(r.offset + r.length for r in rows) <= 4096
    assert re.match("toxicity", corpus_pipeline.STAGES[0][0])


def test_near_duplicates_of_repeated_and_null_ids(spark):
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(60)) for x in "abcd")
    rows = [(3, d), (2, a), (None, b), (1, a), (2, c), (None, a), (1, a), (3, d), (None, b), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(1, a), (None, b), (2, c), (3, d), (4, None)], key=str)
