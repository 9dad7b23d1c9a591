"""A training-data pipeline over `documents`: five of the ten operators, each on all that the one before it kept.

run(spark, sf_dir) applies the stages to the table; every stage but the last returns the table's columns. A stage's
decisions take effect: texts that the quality classifier rejects go, one document of each near-duplicate group stays,
contaminated documents go, personal data is masked in the text (n_chars follows), and the rest is encoded.

Defined results: stages decide about rows, not ids, so rows without an id and rows that share one are judged each by its
own text; of a near-duplicate group the row with the least doc_id stays (one without an id only if no other has one, and
one of repeated rows); null and empty texts are copies of nothing, hold no benchmark passage, and stay unless the classifier
rejects them; extra columns go through; an empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ampliqua.llm import bpe, decontam, pii, puquality, setsketch
from ampliqua.llm.common import stored, table

#: Ids that are broadcast at most to drop rows; more are joined by shuffles.
BROADCAST_IDS = 1_000_000
#: Rows of an Arrow batch at most: executors keep what each stage's workers and buffers took, so five stages add up.
BATCH_ROWS = 500
#: Column of a row's number within a stage.
ROW = "_row"
#: Least similarity, in percent, of the texts that near_dedup links.
NEAR_PERCENT = 80


def _small_batches(spark: SparkSession) -> None:
    """Arrow batches of so many rows at most, unless the session asks for smaller ones; the operators keep that."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = spark.conf.get(name, None)
    if now is None or not now.isdigit() or not 0 < int(now) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def _keyed(docs: DataFrame, name: str) -> tuple[DataFrame, bool]:
    """docs with a number of its own for every row: the id where ids are different numbers (True), else one that is stored."""
    _small_batches(docs.sparkSession)
    if isinstance(docs.schema["doc_id"].dataType, (T.IntegerType, T.LongType)):
        n, different = docs.agg(F.count(F.lit(1)), F.count_distinct("doc_id")).first()
        if n == different:
            return docs.withColumn(ROW, F.col("doc_id").cast("long")), True
    return stored(docs.sparkSession, docs.withColumn(ROW, F.monotonically_increasing_id()), name), False


def _without(keyed: DataFrame, gone: DataFrame, name: str) -> DataFrame:
    """The rows whose number isn't among those in gone, without the number."""
    gone = stored(keyed.sparkSession, gone, name)
    return keyed.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, ROW, "left_anti").select(*(c for c in keyed.columns if c != ROW))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the positive-unlabelled classifier, trained on their labels, rejects."""
    keyed, _ = _keyed(docs, "quality-rows")
    judged = puquality.classify(keyed, table(spark, sf_dir, "labels"), row_col=ROW)
    return _without(keyed, judged.filter("predicted = 0").select(F.col("row").alias(ROW)), "rejected")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each near-duplicate group."""
    keyed, by_id = _keyed(docs, "dedup-rows")
    judged = setsketch.near_duplicates(keyed, id_col=ROW, percent=NEAR_PERCENT).withColumnRenamed("doc_id", ROW)
    if by_id:
        return _without(keyed, judged.filter("not kept").select(ROW), "copies")
    judged = stored(spark, judged.select(ROW, "component_id"), "groups")
    least = judged.join(keyed.select(ROW, "doc_id"), ROW).groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", ROW)).alias("least"), F.count(F.lit(1)).alias("n"))
    least = least.filter("n > 1").select("component_id", F.col(f"least.{ROW}").alias("_stays"))
    return _without(keyed, judged.join(least, "component_id").filter(F.col(ROW) != F.col("_stays")).select(ROW), "copies")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a window of a benchmark item."""
    keyed, _ = _keyed(docs, "decontaminate-rows")
    judged = decontam.judge(keyed, table(spark, sf_dir, "benchmark"), id_col=ROW)
    return _without(keyed, judged.filter("contaminated").select(F.col("doc_id").alias(ROW)), "contaminated")


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data in the texts; n_chars is the length of the new text, which is null where the old one was."""
    _small_batches(spark)
    work = docs.withColumn("_rest", F.struct(*(F.col(c) for c in docs.columns if c not in ("text", "n_chars"))))
    masked = pii.redact(work, pii.train(docs), "_rest", "text")
    made = masked.select("_rest.*", "text", F.length("text").cast("long").alias("n_chars"))
    return made.select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the decoded text of each document."""
    _small_batches(spark)
    return bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mask_pii", mask_pii), ("encode", encode)]

#: No stage's rules can be put in SQL as a whole (trained models, byte-pair encoding): tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(spark, stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
