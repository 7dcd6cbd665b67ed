"""The pipeline's stages one after another on the smallest tables."""

from pyspark.sql import functions as F

import corpus_pipeline
from tickloom.llm.common import written


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
        assert docs.columns == columns, name
        kept = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert kept <= before and len(kept) > len(before) / 2, name
        before = kept
    assert docs.groupBy("doc_id").count().where("count > 1").isEmpty()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == before
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").isEmpty()
