"""The pipeline's stages on the driver's rows, each judged on its own input."""
from pyspark.sql import functions as F

import corpus_pipeline
from sigspark.llm import block_naming, decontaminate, simhash
from sigspark.llm.common import load


def test_stages_keep_columns_and_take_effect(spark, sf):
    docs = load(spark, sf, "documents")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).persist()
        assert docs.columns == columns, name
        assert 0 < docs.count() <= before, name
        before = docs.count()
    assert block_naming.exact_duplicates(docs).where("not kept").count() == 0
    assert simhash.near_duplicates(docs).where("group_size > 1").count() == 0
    assert decontaminate.contamination(docs, load(spark, sf, "benchmark"), "f").where(decontaminate.contaminated(F.col("f"))).count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert last.count() == before and last.where("n_tokens < 0").count() == 0


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert {"doc_id", "ids", "n_tokens"} <= set(out.columns) and out.count() > 0


def test_empty_documents(spark, sf):
    docs = load(spark, sf, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0, name
