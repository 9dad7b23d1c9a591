"""Continuous ingest (an extension): chunks of token rows dropped in a folder refresh indel counts; windows over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ampliqua.operators.profile import count_indels, explode_tokens
from ampliqua.schemas import TOKENS


def token_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Parquet files of TOKENS rows as a stream."""
    return spark.readStream.schema(TOKENS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def running_counts(stream: DataFrame) -> DataFrame:
    """Counts by sample, allele and position over all that has come in; state grows with positions, not with reads."""
    return count_indels(explode_tokens(stream, ["sample", "allele"]), ["sample", "allele"])


def windowed_events(events: DataFrame, window: str = "1 hour", late: str = "2 hours", time: str = "ts") -> DataFrame:
    """Events by type in event-time windows; later ones than the watermark are dropped."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def start(counts: DataFrame, table: str, checkpoint: str):
    """Writes each refresh of the counts over the one before it."""
    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/version={number % 2}")

    return counts.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(keep).start()
