"""The pipeline's stages ask for small Arrow batches, so that what they leave in executors doesn't add up."""

import corpus_pipeline

NAME = "spark.sql.execution.arrow.maxRecordsPerBatch"


def test_stages_ask_for_small_batches_and_keep_smaller_ones(spark):
    docs = spark.createDataFrame([(1, "write to a.b@example.org", 24), (2, None, 0)], "doc_id long, text string, n_chars long")
    try:
        spark.conf.set(NAME, "10000")
        made = {r["doc_id"]: r["text"] for r in corpus_pipeline.mask_pii(spark, docs, "").collect()}
        assert made == {1: "write to [EMAIL]", 2: None} and int(spark.conf.get(NAME)) <= 500
        spark.conf.set(NAME, "7")
        corpus_pipeline.encode(spark, docs, "")
        assert spark.conf.get(NAME) == "7"
    finally:
        spark.conf.unset(NAME)
