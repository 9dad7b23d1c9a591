"""What a run did: rows and seconds of every stage that is written; rows are told by the files' footers, no job more."""

from __future__ import annotations

import threading
import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own = threading.local()


class RunLog:
    """Rows (stage, rows, seconds) in the order in which stages ended."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, int, float]] = []

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(k, *r) for k, r in enumerate(self.rows)], "ord int, stage string, rows long, seconds double")


@contextmanager
def recording() -> Iterator[RunLog]:
    """Stages that this thread writes meanwhile are recorded; a recording within another has its own."""
    before, _own.log = getattr(_own, "log", None), RunLog()
    try:
        yield _own.log
    finally:
        _own.log = before


def rows_in(spark: SparkSession, path: str) -> int:
    """Rows of a folder's Parquet files."""
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    at = jvm.org.apache.hadoop.fs.Path(path)
    n = 0
    for state in at.getFileSystem(conf).listStatus(at):
        if state.getPath().getName().startswith("part-"):
            reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(state.getPath(), conf))
            n += reader.getRecordCount()
            reader.close()
    return n


def write(df: DataFrame, path: str, stage: str) -> None:
    """Writes df as Parquet; a recording that is on gets its rows."""
    log, began = getattr(_own, "log", None), time.time()
    df.write.parquet(path)
    if log is not None:
        log.rows.append((stage, rows_in(df.sparkSession, path), round(time.time() - began, 3)))
