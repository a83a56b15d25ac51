"""The pipeline's stages, each held against the operators' own results."""

import corpus_pipeline
from formbook.llm import minhash
from formbook.llm.common import table


def test_stages_in_order(spark, data, tmp_path):
    docs = table(spark, data, "documents")
    columns = docs.columns
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name == "near_duplicates":
            first = {r["class_id"] for r in minhash.near_duplicates(docs).collect()}
        stage(spark, docs, data).write.parquet(str(tmp_path / str(n)))
        docs = spark.read.parquet(str(tmp_path / str(n)))
        kept = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert kept and kept <= set(before)
        if n < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        if name == "near_duplicates":
            assert kept == first
        if name == "decontamination":
            items = [" ".join(r["text"].lower().split()) for r in table(spark, data, "benchmark").collect()]
            held = {k for k, t in before.items() if any(i in " ".join((t or "").lower().split()) for i in items)}
            assert not kept & held and len(kept) >= len(before) - len(held) - 1
        if name == "secrets":
            assert kept == set(before)
    assert sorted(map(str, corpus_pipeline.run(spark, data).collect())) == sorted(map(str, docs.collect()))
