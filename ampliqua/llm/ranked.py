"""Ranked lexical search as a sparse matrix product in blocks.

The term-document matrix is written once, in blocks of documents (segments): sorted term hashes, where each term's
documents end, and the occurrences. A block of items is a sparse matrix of term multiplicities. Its product with a segment
of int64 impacts is formed row by row (Gustavson): an item's row is the sum of its terms' rows, merged in a dense
accumulator over the segment's documents. Each task keeps the best k of every item over its segments; these are merged
in two steps. The index holds every term of every document and doesn't depend on the items.

Terms are compared by 64-bit hashes: with q different item terms and v different terms in the corpus, a false match has a
chance of about q * v / 2^64.

Defined results: a null or empty text has no terms, counts nowhere and ranks nowhere; rows that share a doc_id are
documents of their own, and so are rows without one, which come last among equal scores; rows of items are ranked each by
itself, also with equal or null ids; no items or no documents give no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ampliqua.llm.common import arrow_type, blobs, freed, record_batch, repo_on_workers, runs, scratch
from ampliqua.llm.wordtable import gather, parts

#: Terms of a segment (about), bytes of a text that are cut into terms at once, and bytes of item text of a block.
SEGMENT_TERMS, PART_BYTES, ITEM_BLOCK_BYTES = 1 << 18, 1 << 20, 4 << 20
#: Length normalisation in percent, and saturation: an occurrence counts 10^9 tf / (1000 tf + SATURATION * m).
NORMALISE, SATURATION = 90, 8
#: Groups in which the tasks' best are merged first.
MERGES = 64

#: Bytes of terms, A-Z as a-z; all others become blanks.
_TERM_BYTES = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def hashes(data: bytes) -> np.ndarray:
    """64-bit hashes of the terms, in order: maximal runs of ASCII letters, digits and characters beyond ASCII."""
    found = data.translate(_TERM_BYTES).split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))


def counted(data: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """Different term hashes of a text of any length, their occurrences, and the number of terms."""
    terms, times = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for part in parts(data, PART_BYTES):
        own, n = np.unique(hashes(part), return_counts=True)
        if not len(terms):
            terms, times = own, n.astype(np.int64)
            continue
        terms, where = np.unique(np.concatenate([terms, own]), return_inverse=True)
        times = np.bincount(where, np.concatenate([times, n]), len(terms)).astype(np.int64)
    return terms, times, int(times.sum())


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The term-document matrix of all rows that have terms, written to the shared folder and read again.

    A row a segment: doc_ids, lengths (terms of each document), terms (sorted hashes), ends (of each term's postings),
    docs (their documents, by number in the segment) and times; n_docs and n_terms are sums.
    """
    spark = docs.sparkSession
    repo_on_workers(spark)
    id_type = docs.schema[id_col].dataType
    binary = [T.StructField(n, T.BinaryType()) for n in ("lengths", "terms", "ends", "docs", "times")]
    schema = T.StructType([T.StructField("doc_ids", T.ArrayType(id_type)), *binary, T.StructField("n_docs", T.LongType()), T.StructField("n_terms", T.LongType())])
    out = pa.schema([(f.name, arrow_type(f.dataType)) for f in schema])

    def segment(ids: list, found: list[tuple[np.ndarray, np.ndarray, int]]) -> pa.RecordBatch:
        term, times = (np.concatenate([x[k] for x in found]) for k in (0, 1))
        doc = np.repeat(np.arange(len(found), dtype=np.int32), [len(x[0]) for x in found])
        order = np.argsort(term, kind="stable")  # within a term the documents stay in order
        starts = runs(term[order])
        lengths = np.array([x[2] for x in found], np.int64)
        arrays = (lengths, term[order][starts[:-1]], starts[1:].astype(np.int64), doc[order], times[order])
        return record_batch(out, [pa.array([ids], out.field(0).type), *([x.tobytes()] for x in arrays), [len(ids)], [int(lengths.sum())]])

    @freed
    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, found, filled = [], [], 0
        for batch in batches:
            for doc_id, data in zip(batch.column(0).to_pylist(), blobs(batch.column(1)), strict=True):
                row = counted(data)
                if not row[2]:
                    continue
                ids.append(doc_id)
                found.append(row)
                filled += len(row[0])
                if filled >= SEGMENT_TERMS:
                    yield segment(ids, found)
                    ids, found, filled = [], [], 0
        if ids:
            yield segment(ids, found)

    path = scratch(spark, "term-documents")
    made = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(segments, schema)
    # a segment is a row of some MB: small row groups keep a reader's batch small
    made.write.option("compression", "zstd").option("parquet.block.size", 16 << 20).option("parquet.page.size.row.check.min", 4).parquet(path)
    return spark.read.schema(schema).parquet(path)


@dataclass(frozen=True)
class ItemBlock:
    """Items as a sparse matrix: sorted term hashes, each item's terms (numbers of columns) and their multiplicities."""

    ids: list
    terms: np.ndarray
    columns: list[np.ndarray]
    times: list[np.ndarray]

    @staticmethod
    def of(items: list[tuple[object, bytes]], repeats: bool) -> ItemBlock:
        found = [(i, *counted(data)) for i, data in items]
        found = [x for x in found if x[3]]
        terms = np.unique(np.concatenate([x[1] for x in found])) if found else np.zeros(0, np.uint64)
        return ItemBlock([x[0] for x in found], terms, [np.searchsorted(terms, x[1]) for x in found], [x[2] if repeats else np.ones(len(x[2]), np.int64) for x in found])


def _columns(row: dict, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which of these sorted terms the segment has, and where their postings begin and end."""
    own, ends = np.frombuffer(row["terms"], np.uint64), np.frombuffer(row["ends"], np.int64)
    at = np.minimum(np.searchsorted(own, terms), len(own) - 1)
    have = np.flatnonzero(own[at] == terms)
    at = at[have]
    return have, np.where(at > 0, ends[at - 1], 0), ends[at]


def document_counts(index: DataFrame, terms: np.ndarray) -> np.ndarray:
    """How many documents hold each of these terms: one scan of the index's terms, a number a term at the end."""
    wanted = index.sparkSession.sparkContext.broadcast(terms)

    @freed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(wanted.value), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                have, starts, stops = _columns(row, wanted.value)
                n[have] += stops - starts
        k = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n[k])], names=["k", "n"])

    out = np.zeros(len(terms), np.int64)
    for r in index.select("terms", "ends").mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():
        out[r["k"]] = r["n"]
    return out


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)


def product(row: dict, block: ItemBlock, weight: np.ndarray, n_docs: int, n_terms: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The product's rows with entries: item, documents (numbers in the segment) and their scores, all above zero."""
    lengths = np.frombuffer(row["lengths"], np.int64).tolist()
    have, starts, stops = _columns(row, block.terms)
    sizes = stops - starts
    docs, times = gather(np.frombuffer(row["docs"], np.int32), starts, sizes), gather(np.frombuffer(row["times"], np.int64), starts, sizes)
    m = np.array([100 - NORMALISE + NORMALISE * n * n_docs // n_terms for n in lengths], np.int64)
    impact = np.repeat(weight[have], sizes) * (1_000_000_000 * times // (1000 * times + SATURATION * m[docs]))
    begin, size = np.zeros(len(block.terms), np.int64), np.zeros(len(block.terms), np.int64)
    begin[have], size[have] = np.cumsum(sizes) - sizes, sizes
    total = np.zeros(len(lengths), np.int64)
    for item, (columns, multiplicity) in enumerate(zip(block.columns, block.times, strict=True)):
        n = size[columns]
        if not n.any():
            continue
        where = gather(docs, begin[columns], n)
        np.add.at(total, where, gather(impact, begin[columns], n) * np.repeat(multiplicity, n))
        hit = np.flatnonzero(total)
        yield item, hit, total[hit]
        total[hit] = 0


def _order(x: tuple) -> tuple:
    return -x[0], x[1] is None, x[1] if x[1] is not None else 0


def _best(index: DataFrame, block: ItemBlock, k: int, n_docs: int, n_terms: int, id_type: T.DataType, item_type: T.DataType) -> DataFrame:
    """item (number in the block), item_id, doc_id, score, part: the best k of each item in each task."""
    shared = index.sparkSession.sparkContext.broadcast((block, weights(document_counts(index, block.terms), n_docs)))
    schema = T.StructType([T.StructField("item", T.LongType()), T.StructField("item_id", item_type), T.StructField("doc_id", id_type), T.StructField("score", T.LongType()), T.StructField("part", T.LongType())])
    out = pa.schema([(f.name, arrow_type(f.dataType)) for f in schema])

    @freed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, weight = shared.value
        best: dict[int, list[tuple]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                ids = row["doc_ids"]
                for item, docs, scores in product(row, own, weight, n_docs, n_terms):
                    kept = best.setdefault(item, [])
                    least = kept[-1][0] if len(kept) == k else 1
                    if len(scores) > k:
                        least = max(least, int(np.partition(scores, -k)[-k]))
                    good = scores >= least  # with all that are equal to the kth
                    kept += [(s, ids[d]) for s, d in zip(scores[good].tolist(), docs[good].tolist(), strict=True)]
                    kept.sort(key=_order)
                    del kept[k:]
        part = TaskContext.get().partitionId() % MERGES
        rows = [(i, own.ids[i], doc, score, part) for i, found in best.items() for score, doc in found]
        yield record_batch(out, [[r[c] for r in rows] for c in range(5)])

    found = index.select("doc_ids", "lengths", "terms", "ends", "docs", "times").mapInArrow(run, schema)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).filter(F.col("rank") <= k)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= k)
    return found.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", repeats: bool = False, block_bytes: int = ITEM_BLOCK_BYTES) -> DataFrame:
    """item_id, rank (from 1), doc_id, score of each item's k best documents with a score above 0.

    repeats: a term that an item holds several times counts as often. Items are taken in blocks of bounded size, all
    against the same index.
    """
    index = build_index(docs, id_col, text_col)
    n_docs, n_terms = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    named = items.select(F.col(item_col).alias("item_id"), F.coalesce(F.col(item_text).cast("string"), F.lit("")).alias("text"))
    blocks = 1 + int((named.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes)
    found = None
    for b in range(blocks):
        rows = (named if blocks == 1 else named.filter(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b)).collect()  # a block is bounded
        block = ItemBlock.of([(r["item_id"], r["text"].encode()) for r in rows], repeats)
        best = _best(index, block, k, n_docs, max(n_terms, 1), docs.schema[id_col].dataType, items.schema[item_col].dataType)
        found = best if found is None else found.unionByName(best)
    return found


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS t FROM documents),
n AS (SELECT r, doc_id, CAST(len(t) AS BIGINT) AS n, t FROM d WHERE len(t) > 0),
g AS (SELECT CAST(count(*) AS BIGINT) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM n),
q AS (SELECT DISTINCT i, item_id, term FROM (SELECT i, item_id, unnest(t) AS term FROM (SELECT row_number() OVER () AS i, item_id, {_TERMS} AS t FROM benchmark))),
tf AS (SELECT r, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, unnest(t) AS term FROM n) WHERE term IN (SELECT term FROM q) GROUP BY 1, 2),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * max(nn) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tf, g GROUP BY term),
s AS (SELECT i, item_id, r, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nn) // ll)))) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN tf USING (term) JOIN n USING (r), g GROUP BY 1, 2, 3),
k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM s JOIN n USING (r) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10
"""
