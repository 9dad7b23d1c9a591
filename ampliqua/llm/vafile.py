"""Exact top-k search by inner product over a vector-approximation file.

The file has a row for each block of vectors: per dimension a grid of 64 cells between the block's least and largest
value, each vector's cells (a byte a dimension), and in a column of its own, which the first two passes don't read, the
exact vectors. One matrix product of queries with cells bounds inner products from above; from below they are less by an
amount that depends on query and grid alone. Queries are taken in waves of bounded size, each in three passes:

1. every task keeps the k largest lower bounds of each query of the wave; merged, the kth is a floor for its results;
2. a block's survivors are the vectors whose upper bound reaches the query's floor;
3. exact vectors of blocks with survivors are read, in descending order of the upper bound, until the kth exact score is
   above the next bound.

Of equal vectors in a block only those are kept that some query may need (the least ids), so very common vectors don't
survive by the thousand. What a task holds is bounded by a wave and a block, whatever the size of the table.

Defined results: vectors that are null, or hold null or non-finite components, and null ids take no part; a component x
counts as floor(scale * x); a vector shorter than another counts as zero in the missing dimensions; a query never
matches rows of its own id; repeated candidates stay repeated, each repeated query row is a query; ties go to the smaller
id; scores beyond 64 bits are held at the limit; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ampliqua.llm.common import arrow_type, freed, record_batch, repo_on_workers, scratch, stored

#: Cells of a dimension, exact vectors read at a time, queries of a wave (about), and queries that meet a block at once.
CELLS, STEP, WAVE, TOGETHER = 64, 32, 8192, 512
#: Blocks that are named in a filter of the file at most; with more survivors all blocks are read.
NAMED_BLOCKS = 1000
_LIMIT = 1 << 62


def _matrix(column: pa.Array, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Integer vectors, padded with zeros, and which rows of the column they are."""
    rows, keep = [], []
    for k, v in enumerate(column.to_pylist()):
        if v is None or any(x is None for x in v):
            continue
        x = np.asarray(v, np.float64)
        if np.isfinite(x).all():
            rows.append(np.floor(scale * x))
            keep.append(k)
    out = np.zeros((len(rows), max(map(len, rows), default=0)))
    for k, x in enumerate(rows):
        out[k, : len(x)] = x
    return np.clip(out, -_LIMIT, _LIMIT).astype(np.int64), np.array(keep, np.int64)


def _needed(exact: np.ndarray, ids: list, k: int) -> np.ndarray:
    """Rows that can be among the k best of some query: of equal vectors, k rows of each of the k + 1 least ids."""
    if len(exact) <= k or not exact.shape[1]:
        group = np.zeros(len(exact), np.int64)
    else:
        group = np.unique(np.ascontiguousarray(exact).view(np.dtype((np.void, exact.shape[1] * 8))).ravel(), return_inverse=True)[1]
    crowded = np.flatnonzero(np.bincount(group, minlength=1) > k + 1)
    keep = np.ones(len(exact), bool)
    for g in crowded:
        rows = sorted(np.flatnonzero(group == g).tolist(), key=lambda r: ids[r])
        seen: dict = {}
        for r in rows:
            seen[ids[r]] = seen.get(ids[r], 0) + 1
            keep[r] = len(seen) <= k + 1 and seen[ids[r]] <= k
    return np.flatnonzero(keep)


def _packed(df: DataFrame, id_col: str, vector_col: str, scale: float, k: int | None = None) -> DataFrame:
    """A row for each block: block, n, dim, ids, low, step (grid), cells and exact (int64), as bytes. k: see _needed."""
    id_type = df.schema[id_col].dataType
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("n", T.LongType()), T.StructField("dim", T.IntegerType()), T.StructField("ids", T.ArrayType(id_type)), *(T.StructField(n, T.BinaryType()) for n in ("low", "step", "cells", "exact"))])
    out = pa.schema([(f.name, arrow_type(f.dataType)) for f in schema])

    @freed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 32
        for number, batch in enumerate(batches):
            exact, keep = _matrix(batch.column(1), scale)
            if not len(keep):
                continue
            ids = batch.column(0).take(pa.array(keep)).to_pylist()
            if k is not None:
                rows = _needed(exact, ids, k)
                exact, ids = exact[rows], [ids[r] for r in rows]
            x = exact.astype(np.float64)
            low, high = (x.min(axis=0), x.max(axis=0)) if x.shape[1] else (np.zeros(0), np.zeros(0))
            step = np.maximum((high - low) / CELLS, 1e-6)
            cells = np.clip((x - low) // step, 0, CELLS - 1).astype(np.uint8)
            yield record_batch(out, [[part | number], [len(ids)], [x.shape[1]], pa.array([ids], out.field(3).type), [low.tobytes()], [step.tobytes()], [cells.tobytes()], [exact.tobytes()]])

    return df.filter(F.col(id_col).isNotNull()).select(id_col, vector_col).mapInArrow(run, schema)


def _pad(x: np.ndarray, dim: int) -> np.ndarray:
    return x if x.shape[1] == dim else np.pad(x, ((0, 0), (0, dim - x.shape[1])))


def _products(vectors: np.ndarray, query: np.ndarray, safe: bool) -> list[int]:
    """Exact inner products; safe: every partial sum is an integer that a double holds."""
    if safe:
        return (vectors.astype(np.float64) @ query.astype(np.float64)).astype(np.int64).tolist()
    top = (1 << 63) - 1
    return [max(-top - 1, min(top, sum(int(a) * int(b) for a, b in zip(v, query, strict=True)))) for v in vectors]


class Wave:
    """Some queries: their ids, integer vectors, and where each stands among all queries."""

    def __init__(self, blocks: list[dict]) -> None:
        dim = max(b["dim"] for b in blocks)
        self.ids = [i for b in blocks for i in b["ids"]]
        self.vectors = np.concatenate([_pad(np.frombuffer(b["exact"], np.int64).reshape(b["n"], b["dim"]), dim) for b in blocks])
        self.numbers = np.concatenate([(b["block"] >> 32 << 40 | (b["block"] & 0xFFFFFFFF) << 20) + np.arange(b["n"]) for b in blocks])
        self.where: dict = {}
        for k, i in enumerate(self.ids):
            self.where.setdefault(i, []).append(k)

    def bounds(self, block: dict, first: int) -> tuple[np.ndarray, np.ndarray]:
        """Upper bounds of some queries' products with a block's vectors, and what the lower ones are less by. Own rows: minus infinity."""
        dim = max(self.vectors.shape[1], block["dim"])
        q = _pad(self.vectors[first : first + TOGETHER], dim)[:, : block["dim"]].astype(np.float64)
        cells = np.frombuffer(block["cells"], np.uint8).reshape(block["n"], block["dim"]).astype(np.float64)
        low, step = np.frombuffer(block["low"]), np.frombuffer(block["step"])
        slack = 1e-9 * (np.abs(q) @ np.maximum(np.abs(low), np.abs(low + CELLS * step))) + 1e-6
        upper = (q * step) @ cells.T + (q @ low + np.maximum(q, 0) @ step + slack)[:, None]
        for column, i in enumerate(block["ids"]):
            for k in self.where.get(i, ()):
                if first <= k < first + len(q):
                    upper[k - first, column] = -np.inf
        return upper, np.abs(q) @ step + 2 * slack

    def firsts(self) -> range:
        return range(0, len(self.ids), TOGETHER)


def _largest(best: np.ndarray, more: np.ndarray) -> np.ndarray:
    """The k largest of each row of both."""
    both, k = np.concatenate([best, more], axis=1), best.shape[1]
    return np.partition(both, both.shape[1] - k, axis=1)[:, both.shape[1] - k :]


def _floors(file: DataFrame, wave: Broadcast, k: int) -> np.ndarray:
    """The kth largest lower bound of each query over the whole file; minus infinity where it has no k vectors."""
    out = pa.schema([("best", pa.binary())])

    @freed
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = wave.value
        best = np.full((len(own.ids), k), -np.inf)
        for batch in batches:
            for block in batch.to_pylist():
                for first in own.firsts():
                    upper, less = own.bounds(block, first)
                    best[first : first + len(upper)] = _largest(best[first : first + len(upper)], upper - less[:, None])
        yield record_batch(out, [[best.tobytes()]])

    @freed
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full((len(wave.value.ids), k), -np.inf)
        for batch in batches:
            for data in batch.column(0).to_pylist():
                best = _largest(best, np.frombuffer(data).reshape(-1, k))
        yield record_batch(out, [[best.tobytes()]])

    groups = max(1, round(file.rdd.getNumPartitions() ** 0.5))
    found = file.select("n", "dim", "ids", "low", "step", "cells").mapInArrow(each, "best binary").repartition(groups).mapInArrow(merge, "best binary").repartition(1).mapInArrow(merge, "best binary").collect()  # one row
    return np.frombuffer(bytes(found[0]["best"])).reshape(-1, k).min(axis=1)


def _survivors(file: DataFrame, wave: Broadcast, floors: Broadcast) -> DataFrame:
    """block, and packed: queries, rows and upper bounds of the block's survivors (queries that meet the block at once, a row)."""
    out = pa.schema([("block", pa.int64()), ("queries", pa.binary()), ("rows", pa.binary()), ("upper", pa.binary())])

    @freed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, floor = wave.value, floors.value
        for batch in batches:
            for block in batch.to_pylist():
                for first in own.firsts():
                    upper, _ = own.bounds(block, first)
                    q, rows = np.nonzero((upper >= floor[first : first + len(upper), None]) & (upper > -np.inf))
                    if len(q):
                        yield record_batch(out, [[block["block"]], [(first + q).astype(np.int32).tobytes()], [rows.astype(np.int32).tobytes()], [upper[q, rows].tobytes()]])

    return file.select("block", "n", "dim", "ids", "low", "step", "cells").mapInArrow(run, "block long, queries binary, rows binary, upper binary")


def best_of_block(wave: Wave, queries: np.ndarray, rows: np.ndarray, upper: np.ndarray, ids: list, exact: np.ndarray, k: int) -> tuple[list[tuple[int, int, object]], int]:
    """(query, score, id) of the k best survivors of each query, and how many exact vectors were read for them."""
    dim = max(wave.vectors.shape[1], exact.shape[1])
    exact = _pad(exact, dim)
    biggest, out, read = float(np.abs(exact).max(initial=0)), [], 0
    order = np.lexsort((-upper, queries))
    starts = np.flatnonzero(np.diff(queries[order], prepend=-1))
    for part in np.split(order, starts[1:]):
        q = int(queries[part[0]])
        vector = _pad(wave.vectors[q : q + 1], dim)[0]
        safe = biggest * float(np.abs(vector).max(initial=0)) * max(dim, 1) < 2.0**53
        mine: list[tuple] = []
        for at in range(0, len(part), STEP):
            some = rows[part[at : at + STEP]]
            if len(mine) == k and -mine[k - 1][0] > upper[part[at]]:
                break
            read += len(some)
            mine = sorted([*mine, *((-s, ids[r]) for s, r in zip(_products(exact[some], vector, safe), some.tolist(), strict=True))])[:k]
        out += [(q, -s, i) for s, i in mine]
    return out, read


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding", wave: int = WAVE) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k best rows for each row that is_query holds for."""
    spark = vectors.sparkSession
    repo_on_workers(spark)
    file = stored(spark, _packed(vectors, id_col, vector_col, scale, k), "vafile")
    asked = vectors.filter(is_query).select(id_col, vector_col)
    queries = stored(spark, _packed(asked.repartition(1 + asked.count() // min(wave, 2048)), id_col, vector_col, scale), "queries")
    id_type = vectors.schema[id_col].dataType
    schema = T.StructType([T.StructField("query", T.LongType()), T.StructField("query_id", id_type), T.StructField("vec_id", id_type), T.StructField("score", T.LongType())])
    out = pa.schema([(f.name, arrow_type(f.dataType)) for f in schema])
    results = scratch(spark, "found")
    spark.createDataFrame([], schema).write.parquet(results)
    waves: list[list[int]] = [[]]
    held = 0
    for r in queries.select("block", "n").orderBy("block").collect():  # a row a block of queries
        if waves[-1] and held + r["n"] > wave:
            waves.append([])
            held = 0
        waves[-1].append(r["block"])
        held += r["n"]
    for blocks in waves if waves[0] else []:
        now = spark.sparkContext.broadcast(Wave([r.asDict() for r in queries.filter(F.col("block").isin(blocks)).collect()]))  # at most a wave
        floors = spark.sparkContext.broadcast(_floors(file, now, k))
        survivors = stored(spark, _survivors(file, now, floors), "survivors")
        there = [r["block"] for r in survivors.select("block").distinct().limit(NAMED_BLOCKS + 1).collect()]
        read = file.filter(F.col("block").isin(there)) if len(there) <= NAMED_BLOCKS else file

        @freed
        def exact(batches: Iterator[pa.RecordBatch], now: Broadcast = now) -> Iterator[pa.RecordBatch]:
            own = now.value
            for batch in batches:
                for row in batch.to_pylist():
                    found, _ = best_of_block(own, np.frombuffer(row["queries"], np.int32), np.frombuffer(row["rows"], np.int32), np.frombuffer(row["upper"]), row["ids"], np.frombuffer(row["exact"], np.int64).reshape(len(row["ids"]), row["dim"]), k)
                    yield record_batch(out, [[int(own.numbers[q]) for q, _, _ in found], [own.ids[q] for q, _, _ in found], [i for _, _, i in found], [s for _, s, _ in found]])

        joined = survivors.join(read.select("block", "dim", "ids", "exact"), "block").select("queries", "rows", "upper", "dim", "ids", "exact")
        joined.mapInArrow(exact, schema).write.mode("append").parquet(results)
        now.unpersist()
    ranked = spark.read.schema(schema).parquet(results).withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256.0::DOUBLE * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
