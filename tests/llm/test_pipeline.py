"""The pipeline's stages on a small table, each judged on its own input."""

import zlib

import corpus_pipeline
from chronoloom.llm.shared import durable

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "ngram_join", "mixing", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = durable(stage(spark, docs, SF), name)
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
        before, after = {r.doc_id for r in docs.collect()}, {r.doc_id for r in out.collect()}
        assert after <= before and after
        if name == "language_id":
            assert len(after) >= 0.97 * len(before)
        if name == "line_dedup":
            assert after == before
        docs = out
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in docs.collect()}
    assert all(r.ids_crc32 == zlib.crc32((1).to_bytes(4, "little")) for r in packed if r.doc_tokens == 1)


def test_run_agrees_with_the_stages(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.count() == corpus_pipeline.run(spark, SF).count() > 0


def test_each_stage_begins_by_giving_memory_back(spark, monkeypatch):
    import pytest

    class Given(Exception):
        pass

    def given(_):
        raise Given

    monkeypatch.setattr(corpus_pipeline, "heaps_give_back", given)
    for _, stage in corpus_pipeline.STAGES:
        with pytest.raises(Given):
            stage(spark, None, SF)
