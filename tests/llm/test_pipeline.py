"""The pipeline's stages take effect, one after another."""

import corpus_pipeline
from ampflow.llm.common import saved


def test_stages(spark, docs, tmp_path):
    labels = spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(120)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    now, counts = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        now = saved(stage(spark, now, str(tmp_path)), name)
        counts[name] = now.count()
        if name != "packing":
            assert now.columns == corpus_pipeline.COLUMNS
    ids = {r.doc_id for r in now.select("doc_id").collect()}
    assert not ids & {200, 201, 202, 203, 205} and 4 in ids
    assert counts["quality_classifier"] < counts["language_id"] < docs.count()
    assert {r.doc_id for r in docs.select("doc_id").collect() if r.doc_id is not None and r.doc_id < 120 and r.doc_id % 5} <= ids


def test_run_over_a_folder(spark, docs, tmp_path):
    labels = spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(120)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs.where("doc_id < 120").select(*corpus_pipeline.COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
