from __future__ import annotations

import os

import corpus_pipeline
from pagemark.llm import decontaminate, minhash
from pagemark.llm.common import shared_folder

DATA = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names, columns = [n for n, _ in corpus_pipeline.STAGES], docs.columns
    assert names == ["quality_classifier", "near_dedup", "substring_dedup", "benchmark_decontamination", "best_fit_packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == columns and out.schema.simpleString() == docs.schema.simpleString()
        out.write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        assert 0 < docs.count() <= before.count()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()
    assert {r.doc_id for r in last} == {r.doc_id for r in docs.collect()}
    run = corpus_pipeline.run(spark, DATA)
    assert not [x for x in os.listdir(shared_folder(spark).removeprefix("file:")) if x.startswith("pipeline-")]
    assert sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in run.collect()) == sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in last)
    assert decontaminate.decontaminate(docs, spark.read.parquet(f"{DATA}/benchmark.parquet")).where("n_hit > 0").count() == 0
    dedup = spark.read.parquet(f"{tmp_path}/near_dedup")
    assert minhash.digest(minhash.near_duplicates(dedup)).where("NOT kept").count() == 0
