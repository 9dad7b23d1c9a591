"""Near-duplicate groups of whole texts with SetSketch registers.

A text's set is its different five-word shingles. Texts with the same words are one node. Each node gets registers
K_i = floor(1 - log_b(min over the set of an exponential value)), truncated at 0 and q+1: they merge by maximum and two
sets' registers agree about as often as their Jaccard similarity. Bands of registers propose pairs in two rounds:

1. in every bucket, each member with the bucket's least node (a star, not all pairs);
2. in buckets that the verified links of round 1 leave in several components, each member outside the bucket's largest
   component with all members of other components, in blocks.

A pair is verified on the full sets if the likelihood of its registers, given both sizes, doesn't rule the similarity
out. In round 2 two more bounds come first: distances to the bucket's pivot, exact from round 1 (1 - similarity is a
metric), and registers of a finer sketch. Links end in connected components. Bucket members never meet in one task as a whole, and copies cost one node.

Defined results: a null or wordless text has an empty set and is linked with nothing; a text of fewer than five words is
one shingle; rows that share a doc_id are one node; a null doc_id has a null component and is kept; repeated rows each
get a row; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, reduce
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ampliqua.llm.common import arrow_type, blobs, freed, record_batch, repo_on_workers, stored, word_hashes
from ampliqua.llm.components import connected_components

#: Words of a shingle; least similarity of a link in percent, where the caller names none.
SHINGLE, PERCENT = 5, 85
#: SetSketch: registers, base, rate, and the largest value q + 1.
REGISTERS, BASE, RATE, TOP = 128, 1.001, 20.0, 65535
#: Registers of a band, and the probability, at the least similarity, of sharing no band that the number of bands must go below.
ROWS, MISSED = 5, 1e-6
#: How much less likely than its best value the least similarity may be (natural logarithm): about five standard errors.
SLACK = 12.5
#: The finer sketch of round 2: registers (their low bytes).
FINE = 1024
#: Members of a block in round 2, and ids that are broadcast at most (else they are joined by shuffles).
BLOCK, BROADCAST_IDS = 512, 1_000_000

_rng = np.random.default_rng(7)
_PLACE = _rng.integers(0, 1 << 63, SHINGLE + 1, dtype=np.uint64) | np.uint64(1)
_MULTIPLY = (_rng.integers(0, 1 << 32, REGISTERS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_ADD = _rng.integers(0, 1 << 32, REGISTERS, dtype=np.uint64).astype(np.uint32)
_FINE_MULTIPLY = (_rng.integers(0, 1 << 32, FINE, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_FINE_ADD = _rng.integers(0, 1 << 32, FINE, dtype=np.uint64).astype(np.uint32)


@lru_cache
def n_bands(percent: int) -> int:
    """The least number of bands of which a pair of this similarity shares none with a probability below MISSED."""
    if not 50 <= percent <= 100:
        raise ValueError("the least similarity must lie between 50 and 100 percent")
    j, agree = percent / 100, np.arange(REGISTERS + 1)
    share = np.array([comb(REGISTERS, int(x)) * j**x * (1 - j) ** (REGISTERS - x) for x in agree])
    none = np.array([1 - comb(int(x), ROWS) / comb(REGISTERS, ROWS) for x in agree])
    n = 1
    while (share * none**n).sum() >= MISSED:
        n += 1
    return n


@lru_cache
def _band_plan(percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The registers of each band and what they are multiplied by."""
    rng, n = np.random.default_rng(8), n_bands(percent)
    return np.array([rng.permutation(REGISTERS)[:ROWS] for _ in range(n)]), rng.integers(0, 1 << 63, (n, ROWS), dtype=np.uint64) | np.uint64(1)


def fine_least(percent: int) -> int:
    """How many registers of the finer sketch must agree: five standard errors below the mean."""
    j = percent / 100
    return int(FINE * (j + (1 - j) / 256 - 5 * (j * (1 - j) / FINE) ** 0.5))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def shingles(words: np.ndarray) -> np.ndarray:
    """Sorted different 64-bit hashes of the shingles of a sequence of word hashes."""
    n = len(words)
    if n == 0:
        return words
    if n < SHINGLE:
        return _mix(np.array([sum(int(w) * int(_PLACE[k]) for k, w in enumerate(words)) + n * int(_PLACE[SHINGLE]) & (1 << 64) - 1], np.uint64))
    h = words[: n - SHINGLE + 1] * _PLACE[0]
    for k in range(1, SHINGLE):
        h += words[k : n - SHINGLE + 1 + k] * _PLACE[k]
    return np.unique(_mix(h))


def _minima(found: np.ndarray, multiply: np.ndarray, add: np.ndarray) -> np.ndarray:
    low = np.full(len(multiply), 0xFFFFFFFF, np.uint32)
    x = (found >> np.uint64(32)).astype(np.uint32)
    step = max(1, (1 << 17) // len(multiply))
    for k in range(0, len(x), step):
        low = np.minimum(low, (x[k : k + step, None] * multiply + add).min(axis=0))
    return low


def fine_registers(found: np.ndarray) -> np.ndarray:
    """A byte of each minimum: equal if the minima are, else by chance once in 256."""
    low = _minima(found, _FINE_MULTIPLY, _FINE_ADD)
    return (low ^ (low >> np.uint32(11)) ^ (low >> np.uint32(22))).astype(np.uint8)


def registers(found: np.ndarray) -> np.ndarray:
    """The set's registers; those of a union are the maximum of its parts'."""
    low = _minima(found, _MULTIPLY, _ADD)
    value = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(value) / np.log(BASE)), 0, TOP).astype(np.uint16)


def _p(x: np.ndarray) -> np.ndarray:
    return np.clip(-np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE), 1e-12, 1)


def log_likelihood(more: np.ndarray, less: np.ndarray, n_u: np.ndarray, n_v: np.ndarray, j: np.ndarray | float) -> np.ndarray:
    """Of similarity j, given in how many registers the first set's is larger or smaller, and both sizes."""
    u = n_u / (n_u + n_v)
    a, b = _p(u - (1 - u) * j), _p(1 - u - u * j)
    return more * np.log(a) + less * np.log(b) + (REGISTERS - more - less) * np.log(np.clip(1 - a - b, 1e-12, 1))


_GRID = np.linspace(0, 1, 101)


def estimate(more: np.ndarray, less: np.ndarray, n_u: np.ndarray, n_v: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Joint maximum-likelihood similarity (over a grid), and how much less likely the least similarity is."""
    at = lambda j: log_likelihood(more[:, None], less[:, None], n_u[:, None], n_v[:, None], j)
    grid = at(np.minimum(_GRID[None, :], (np.minimum(n_u, n_v) / np.maximum(n_u, n_v))[:, None]))
    best = grid.argmax(axis=1)
    return _GRID[best], grid.max(axis=1) - at(np.full((1, 1), percent / 100))[:, 0]


def plausible(more: np.ndarray, less: np.ndarray, n_u: np.ndarray, n_v: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Whether a pair may have the least similarity; sizes alone can rule it out."""
    ok = 100 * np.minimum(n_u, n_v) >= percent * np.maximum(n_u, n_v)
    some = np.flatnonzero(ok)
    j, lack = estimate(more[some], less[some], n_u[some].astype(float), n_v[some].astype(float), percent)
    ok[some] = (j >= percent / 100) | (lack <= SLACK)
    return ok


def sketch(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest (of the words in order; null without words), n_shingles, registers (null without an id, or where the same task has given this digest's)."""
    repo_on_workers(docs.sparkSession)
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("digest", T.BinaryType()), T.StructField("n_shingles", T.LongType()), T.StructField("registers", T.BinaryType())])
    out = pa.schema([(f.name, arrow_type(f.dataType)) for f in schema])

    @freed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[bytes, int] = {}
            given: set[bytes] = set()
            digests, sizes, regs = [], [], []
            for data, has_id in zip(blobs(batch.column(1)), batch.column(0).is_valid().to_pylist(), strict=True):
                words = word_hashes(data)
                key = hashlib.blake2b(words.tobytes(), digest_size=16).digest() if len(words) else None
                digests.append(key)
                # a row without an id is no node: the registers go to a row with one
                if key is None or key in given or (key in seen and not has_id):
                    sizes.append(seen.get(key, 0))
                    regs.append(None)
                    continue
                found = shingles(words)
                seen[key] = len(found)
                sizes.append(len(found))
                regs.append(registers(found).astype("<u2").tobytes() if has_id else None)
                if has_id:
                    given.add(key)
            yield record_batch(out, [batch.column(0), digests, sizes, regs])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("_text")).mapInArrow(run, schema)


def _band_keys(regs: np.ndarray, percent: int) -> np.ndarray:
    band, multiply = _band_plan(percent)
    regs = regs.astype(np.uint64) + np.uint64(1)
    return np.stack([_mix((regs[:, band[b]] * multiply[b]).sum(axis=1, dtype=np.uint64) + np.uint64(b)) for b in range(len(band))], axis=1).view(np.int64)


def _bands(nodes: DataFrame, percent: int) -> DataFrame:
    """key (of a band and its registers), node."""
    id_type = nodes.schema["node"].dataType
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("node", id_type)])
    out = pa.schema([(f.name, arrow_type(f.dataType)) for f in schema])

    @freed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            regs = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u2").reshape(-1, REGISTERS)
            keys = _band_keys(regs, percent)
            yield record_batch(out, [keys.ravel(), batch.column(0).take(pa.array(np.repeat(np.arange(len(regs)), keys.shape[1])))])

    return nodes.select("node", "registers").mapInArrow(run, schema)


def _few(rows: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """Rows whose column is among the (different) ids: broadcast if their number allows it, else joined by shuffles."""
    ids = ids.select(F.col(ids.columns[0]).alias(column))
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, column, "left_semi")


def _likely(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) that their registers don't rule out."""
    schema = pairs.schema
    out = pa.schema([(f.name, arrow_type(f.dataType)) for f in schema])

    @freed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u2").reshape(-1, REGISTERS) for k in (2, 4))
            n_u, n_v = (np.array(batch.column(k).to_pylist(), np.int64) for k in (3, 5))
            ok = pa.array(plausible((a > b).sum(axis=1), (a < b).sum(axis=1), n_u, n_v, percent))
            yield record_batch(out, [batch.column(0).filter(ok), batch.column(1).filter(ok)])

    one = nodes.select(F.col("node").alias("u"), F.col("registers").alias("r_u"), F.col("n").alias("n_u"))
    two = nodes.select(F.col("node").alias("v"), F.col("registers").alias("r_v"), F.col("n").alias("n_v"))
    return pairs.join(one, "u").join(two, "v").select("u", "v", "r_u", "n_u", "r_v", "n_v").mapInArrow(run, schema)


def _verified(pairs: DataFrame, docs: DataFrame, name: str) -> DataFrame:
    """The pairs (u, v) with the sizes of their full sets' intersection and union."""
    spark = docs.sparkSession
    pairs = stored(spark, pairs, f"pairs-{name}")
    ids = stored(spark, pairs.select("u").union(pairs.select("v")).distinct(), f"ids-{name}")
    wanted = stored(spark, _few(docs.filter("doc_id is not null"), "doc_id", ids), f"texts-{name}")
    schema = T.StructType([*pairs.schema, T.StructField("both", T.LongType()), T.StructField("either", T.LongType())])
    out = pa.schema([(f.name, arrow_type(f.dataType)) for f in schema])

    @freed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[bytes | None, np.ndarray] = (None, np.zeros(0, np.uint64))
        for batch in batches:
            found = []
            for one, two in zip(blobs(batch.column(2)), blobs(batch.column(3)), strict=True):
                if two != last[0]:
                    last = (two, shingles(word_hashes(two)))
                a, b = shingles(word_hashes(one)), last[1]
                small, large = (a, b) if len(a) <= len(b) else (b, a)
                both = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum()) if len(small) else 0
                found.append((both, len(a) + len(b) - both))
            yield record_batch(out, [batch.column(0), batch.column(1), *([f[k] for f in found] for k in (0, 1))])

    side = lambda c: wanted.select(F.col("doc_id").alias(c), F.col("_text").alias(f"t_{c}"))
    # the pivot's side comes last, so that a pivot's pairs follow each other
    return stored(spark, pairs.join(side("u"), "u").join(side("v"), "v").select("u", "v", "t_u", "t_v").mapInArrow(run, schema).distinct(), f"links-{name}")


def _linked(tested: DataFrame, percent: int) -> DataFrame:
    return tested.filter((F.col("either") > 0) & (100 * F.col("both") >= percent * F.col("either"))).select("u", "v").distinct()


def _fine(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """node, fine: the finer sketches of these nodes."""
    schema = T.StructType([T.StructField("node", docs.schema["doc_id"].dataType), T.StructField("fine", T.BinaryType())])
    out = pa.schema([(f.name, arrow_type(f.dataType)) for f in schema])

    @freed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield record_batch(out, [batch.column(0), [fine_registers(shingles(word_hashes(d))).tobytes() for d in blobs(batch.column(1))]])

    wanted = _few(docs.filter("doc_id is not null"), "doc_id", ids)
    return wanted.select("doc_id", "_text").mapInArrow(run, schema).groupBy("node").agg(F.max("fine").alias("fine"), F.count(F.lit(1)).alias("n_texts"))


def _rest(docs: DataFrame, members: DataFrame, component: DataFrame, nodes: DataFrame, tested: DataFrame, percent: int) -> DataFrame:
    """Round 2: pairs (u, v) of different components in a bucket, one outside its largest component, neither its pivot."""
    sizes = component.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    labelled = component.join(sizes, "component").select("node", "component", "size")
    rows = members.join(labelled, "node", "left").select("key", "node", "pivot", F.coalesce("component", "node").alias("component"), F.coalesce("size", F.lit(1)).alias("size"))
    open_ = rows.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.max_by("component", F.struct("size", "component")).alias("main"), F.count(F.lit(1)).alias("n")).filter("lo <> hi and n > 2").select("key", "main", "n")
    rows = rows.filter("node <> pivot").join(open_, "key").withColumn("out", F.col("component") != F.col("main"))
    counts = rows.groupBy("key").agg(F.sum(F.col("out").cast("int")).alias("n_out")).filter("n_out > 0")
    rows = stored(docs.sparkSession, rows.join(counts, "key"), "open")
    ids = stored(docs.sparkSession, rows.select("node").distinct(), "open-ids")
    near = tested.select(F.col("u").alias("node"), F.col("v").alias("pivot"), (1 - F.col("both") / F.greatest("either", F.lit(1))).alias("far")).groupBy("node", "pivot").agg(F.min("far").alias("far"), F.count(F.lit(1)).alias("n_far"))
    # where rows of one doc_id differ, a node has several texts and no bound holds
    rows = rows.join(near.select("node", "pivot", F.when(F.col("n_far") == 1, F.col("far")).alias("far")), ["node", "pivot"], "left")
    rows = rows.join(_fine(docs, ids), "node").join(nodes.select("node", "registers", F.col("n").alias("size_n")), "node").withColumn("far", F.when(F.col("n_texts") == 1, F.col("far"))).withColumn("fine", F.when(F.col("n_texts") == 1, F.col("fine")))
    salt = lambda n: F.pmod(F.xxhash64("node", "key"), F.ceil(n / BLOCK).cast("int")).cast("int")
    left = rows.filter("out").withColumn("a", salt(F.col("n_out"))).withColumn("b", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / BLOCK).cast("int") - 1)))
    right = rows.withColumn("b", salt(F.col("n"))).withColumn("a", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n_out") / BLOCK).cast("int") - 1)))
    keep = ["key", "a", "b", "node", "component", "out", "size_n", "registers", "far", "fine"]
    both = left.select(*keep, F.lit(True).alias("first")).union(right.select(*keep, F.lit(False).alias("first")))
    id_type = nodes.schema["node"].dataType
    schema = T.StructType([T.StructField("u", id_type), T.StructField("v", id_type)])
    out = pa.schema([(f.name, arrow_type(f.dataType)) for f in schema])
    least = fine_least(percent)

    def compare(rows: pa.Table) -> pa.Table:
        node, comp, is_out = (np.array(rows.column(c).to_pylist(), object) for c in ("node", "component", "out"))
        size, first = np.array(rows.column("size_n").to_pylist(), np.int64), np.array(rows.column("first").to_pylist(), bool)
        regs = np.frombuffer(b"".join(rows.column("registers").to_pylist()), "<u2").reshape(-1, REGISTERS)
        far = np.array([np.nan if x is None else x for x in rows.column("far").to_pylist()])
        known = np.array([x is not None for x in rows.column("fine").to_pylist()])
        fine = np.frombuffer(b"".join(x or bytes(FINE) for x in rows.column("fine").to_pylist()), np.uint8).reshape(-1, FINE)
        # a pair that an earlier band brings together is left to that band's bucket, or was a star there
        band = int((_band_keys(regs[:1], percent)[0] == rows.column("key")[0].as_py()).argmax())
        u, v = [], []
        r = np.flatnonzero(~first)
        for k in np.flatnonzero(first):
            # two members outside the largest component meet once
            cand = r[(comp[r] != comp[k]) & (~is_out[r].astype(bool) | (node[r] < node[k])) & (100 * np.minimum(size[r], size[k]) >= percent * np.maximum(size[r], size[k]))]
            cand = cand[~(np.abs(far[cand] - far[k]) > 1 - percent / 100 + 1e-9)]
            if len(cand):
                cand = cand[~(known[cand] & known[k]) | ((fine[cand] == fine[k]).sum(axis=1) >= least)]
            if len(cand) and band:
                cand = cand[~(regs[cand] == regs[k])[:, _band_plan(percent)[0][:band]].all(axis=2).any(axis=1)]
            if len(cand):
                cand = cand[plausible((regs[k] > regs[cand]).sum(axis=1), (regs[k] < regs[cand]).sum(axis=1), np.full(len(cand), size[k]), size[cand], percent)]
                u += [max(node[k], x) for x in node[cand]]
                v += [min(node[k], x) for x in node[cand]]
        return pa.table([pa.array(u, out.field(0).type), pa.array(v, out.field(1).type)], schema=out)

    return both.groupBy("key", "a", "b").applyInArrow(compare, schema).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """Per document row: doc_id, n_shingles, component_id (least doc_id reachable by links), kept (it is that one).

    Links join texts whose similarity is `percent` or more.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("_text"))
    marks = stored(spark, sketch(docs, "doc_id", "_text"), "sketches")
    # registers of a digest are the same wherever they were made, so any serves
    nodes = marks.filter("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("node"), F.max("n_shingles").alias("n"), F.max("registers").alias("registers"))
    nodes = stored(spark, nodes, "nodes")
    bands = _bands(nodes, percent)
    buckets = bands.groupBy("key").agg(F.min("node").alias("pivot"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", "pivot")
    members = stored(spark, bands.join(buckets, "key"), "members")
    stars = members.filter("node <> pivot").select(F.col("node").alias("u"), F.col("pivot").alias("v")).distinct()
    tested = _verified(_likely(stars, nodes, percent), docs, "stars")
    links = _linked(tested, percent)
    component = connected_components(links)
    more = _linked(_verified(_rest(docs, members, component, nodes, tested, percent), docs, "rest"), percent)
    if more.limit(1).count():
        component = connected_components(reduce(DataFrame.union, [links, more]))
    labels = nodes.select("digest", "node").join(component, "node", "left").select("digest", F.coalesce("component", "node").alias("component_id"))
    linked = marks.filter("digest is not null").join(labels, "digest", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    alone = marks.filter("digest is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
