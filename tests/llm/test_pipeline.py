from __future__ import annotations

import corpus_pipeline


def test_stages_take_effect(spark, odd_documents, no_documents, tmp_path):
    docs = odd_documents
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, "")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == odd_documents.columns
        out.write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        if name == "quality_rules":
            assert 0 < docs.count() < before.count()
        if name == "near_duplicates":
            assert docs.count() < before.count()
    assert docs.select("doc_id").distinct().count() == before.select("doc_id").distinct().count()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_documents, "").count() == 0


def test_queries_are_registered():
    import __spark_entry__
    names = __spark_entry__.queries()
    assert all(any(q.startswith(f"op{n}_") for q in names) for n in range(1, 11)) and "pipeline" in names
