"""The pipeline's stages keep the columns of documents, and each acts on what the one before kept."""

import corpus_pipeline
from quantfield.llm import near_duplicates, repeats
from quantfield.llm.common import materialize

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near duplicates", "repeats", "mixing", "packing"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, materialize(stage(spark, docs, SMALL), "stage")
        kept[name] = docs
        if name != "packing":
            assert docs.columns == columns
        if name == "near duplicates":
            want = near_duplicates.brute_force([(r.doc_id, r.text) for r in before.collect()])
            assert sorted(r.doc_id for r in docs.collect()) == sorted({head for _, head in want.values()})
        if name == "repeats":
            rows = before.collect()
            want = sum(n - gone for n, gone, _, _ in repeats.brute_force([r.text for r in rows]))
            assert sum(len(r.text.encode()) for r in docs.collect()) <= want and docs.count() == len(rows)
    assert kept["packing"].where("offset + length > 2048").count() == 0
    assert set(kept["packing"].columns) >= {"doc_id", "start", "length", "sequence_id", "offset"}
