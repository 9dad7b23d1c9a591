"""Session defaults, and the shared folder in which iterative plans cut their lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ampliqua import runlog


def session(app: str = "ampliqua", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and Arrow; a cluster manager's own master wins over `master`."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    }
    return builder.config(map=defaults | conf).getOrCreate()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir, removed at the end; a local session may do without that setting."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = os.path.join(tempfile.gettempdir(), "checkpoints")
    path = f"{root.rstrip('/')}/ampliqua-{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(at)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again; a recording of the run gets its rows."""
    path = scratch(df.sparkSession, name)
    runlog.write(df, path, name)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def importable(spark: SparkSession) -> None:
    """Lets Python workers import this package when the driver found it by sys.path alone."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    if root not in [*env.get("PYTHONPATH", "").split(os.pathsep), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]:
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def bounded_batches(spark: SparkSession, most: int = 32 << 20) -> None:
    """Arrow batches of so many bytes at most, unless the session asks for smaller ones."""
    importable(spark)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, None)
    if now is None or not now.isdigit() or not 0 < int(now) <= most:
        spark.conf.set(name, str(most))
