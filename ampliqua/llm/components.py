"""Connected components by alternating large-star and small-star steps, in DataFrame operations alone.

No step gathers a node's neighbours: each takes a minimum by key (combined before the shuffle) and joins it back, so a
node with very many neighbours is split by the adaptive skew join. Every round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ampliqua.llm.common import scratch


def _round(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.filter("v > u").join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    low = large.groupBy("u").agg(F.min("v").alias("m"))  # every edge of large leads to a smaller node
    joined = large.join(low, "u")
    return joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """node, component (its least node) of every node with an edge to another; loops and nulls are left out."""
    spark = edges.sparkSession
    now = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).filter("u <> v")
    kind = now.schema
    last = None
    while True:
        path = scratch(spark, "edges")
        (now if last is None else _round(now)).write.parquet(path)
        now = spark.read.schema(kind).parquet(path)
        mark = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == last or not mark[0]:
            break
        last = mark
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
