import hashlib
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from colscope.llm import neardup
from colscope.llm.decontaminate import plain
from colscope.llm.secret_scan import base_spans
from tests.llm.test_neardup import brute


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows that go into and come out of each stage."""
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, found[-1], folder).write.parquet(path)
        found.append(spark.read.parquet(path))
    return [[r.asDict() for r in x.collect()] for x in found], found


def test_columns_and_order(stages):
    _, found = stages
    assert [n for n, _ in corpus_pipeline.STAGES][0::4] == ["importance_resampling", "byte_bpe"]
    assert all(x.columns == found[0].columns for x in found[:-1])


def test_filters_keep_rows_as_they_are(stages):
    (docs, good, single, clean, *_), _ = stages
    by = {d["doc_id"]: d for d in docs}
    for rows in (good, single, clean):
        assert rows and all(by[d["doc_id"]] == d for d in rows)


def test_dedup_against_brute_force(stages):
    (_, good, single, *_), _ = stages
    wanted = {i for i, (_, part) in brute([(d["doc_id"], d["text"]) for d in good], 5, 80).items() if i == part}
    assert {d["doc_id"] for d in single} == wanted


def test_later_stages_against_brute_force(spark, stages):
    (_, _, single, clean, redacted, tokens), _ = stages
    items = [plain(r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()]
    exact = {d["doc_id"] for d in single if any(x in plain(d["text"]) for x in items)}
    gone = {d["doc_id"] for d in single} - {d["doc_id"] for d in clean}
    assert exact <= gone and len(gone) <= len(exact) + 2
    before = {d["doc_id"]: d["text"] for d in clean}
    assert {d["doc_id"] for d in redacted} == before.keys()
    for d in redacted:
        assert not base_spans(d["text"]) and d["n_chars"] == len(d["text"])
        if not base_spans(before[d["doc_id"]]) and not re.search("[0-9]{2}", before[d["doc_id"]]):
            assert d["text"] == before[d["doc_id"]]
    texts = {d["doc_id"]: d["text"] for d in redacted}
    assert {t["doc_id"]: t["decoded_sha256"] for t in tokens} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in texts.items()}


def test_dedup_of_odd_rows(spark, make_docs):
    docs = make_docs((1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (3, None)).withColumn("kept", F.lit(0))
    found = neardup.deduplicate(docs)
    assert found.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in found.collect()) == ["1", "3", "None"]
