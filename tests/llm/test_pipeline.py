import pytest

import corpus_pipeline
from tests.llm import brute

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def outcome(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    from framelens.llm import common

    seen = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        seen.append(common.stored(stage(spark, seen[-1], SF_DIR)))
    return seen


def test_stages_keep_the_columns(outcome):
    assert all(df.columns == outcome[0].columns for df in outcome)
    sizes = [df.count() for df in outcome]
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0


def test_near_dedup_leaves_one_of_each_group(outcome):
    before = [(r.doc_id, r.text) for r in outcome[2].collect()]
    want = {i for i, (_, c) in brute.near_duplicates(before).items() if i == c}
    assert {r.doc_id for r in outcome[3].collect()} == want


def test_run_equals_its_stages(spark, outcome):
    want = {r.doc_id: brute.byte_bpe(r.text) for r in outcome[-1].collect()}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, SF_DIR).collect()}
    assert got == want


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_DIR)
    assert docs.count() == 0
