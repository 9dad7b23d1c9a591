"""Token ids in a content-addressed binary store.

Each document's ids (and an end id) are cut into chunks where a rolling hash of the last 16 ids says so, which makes
copied passages give the same chunks wherever they stand. A chunk is stored once, under the hash of its bytes; a
document is a recipe: its chunks' hashes in order, and their Merkle root. Recipes are written in ascending document
order, in parts; the manifest has for each part its first position, counts and Merkle root, and the root over all. Reading
checks the recipes against the manifest and the chunks against their addresses.

Layout under the path: objects/kind=chunk (key, ids as little-endian unsigned 16- or 32-bit integers), objects/kind=recipe
(as encoded), recipes (ordered, with positions), manifest.

Defined results: a null or empty text has only the end id; a null document id sorts first; repeated rows are documents of
their own; no documents give an empty store; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ampliqua.llm.common import arrow_type, blobs, freed, record_batch, repo_on_workers, scratch
from ampliqua.llm.wordtable import SHORT, Arena, WordTable, gather, in_blocks

#: Ids of a chunk: at least, at most; a cut is made where this many low bits of the rolling hash are zero.
LEAST, MOST, CUT_BITS = 64, 4096, 9
#: Documents whose roots make a leaf of the Merkle tree, and documents of a part (about) where the store is large.
LEAVES, PART_DOCS = 1024, 1 << 20
#: Different words remembered by a worker, and bytes of text that are looked up together.
MAX_WORDS, BLOCK_BYTES = 1_000_000, 1 << 19

_GEAR = np.random.default_rng(20240501).integers(0, 1 << 63, 1 << 16, dtype=np.uint64) | np.uint64(1)


def address(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def merkle(hashes: list[bytes]) -> bytes:
    """Root of a binary hash tree over the hashes in order; an odd last one is carried up."""
    level = hashes or [b""]
    while len(level) > 1:
        level = [address(b"".join(level[k : k + 2])) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
    return address(b"root" + level[0])


def cut_marks(ids: np.ndarray) -> np.ndarray:
    """Ends of the places where the rolling hash of the last 16 ids allows a cut.

    A cut is only made LEAST ids after the one before it, so texts may stand together here: no window that counts reaches
    over a text's beginning.
    """
    h = _GEAR[ids & 0xFFFF]
    for k in (1, 2, 4, 8):  # after this, h[i] holds the ids i-15..i, each shifted by its distance
        if len(h) > k:
            h[k:] = h[k:] + (h[:-k] << np.uint64(k))
    return np.flatnonzero((h >> np.uint64(40)) & np.uint64((1 << CUT_BITS) - 1) == 0) + 1


def cut_points(n: int, marks: list[int]) -> list[int]:
    """Ends of the chunks of a text of n ids: content decides, within the bounds of a chunk's size."""
    ends, at, k = [], 0, 0
    while n - at > LEAST:
        while k < len(marks) and marks[k] < at + LEAST:
            k += 1
        end = min(marks[k] if k < len(marks) else n, at + MOST, n)
        if end >= n:
            break
        ends.append(end)
        at = end
    return [*ends, n] if n else []


def chunk_ends(ids: np.ndarray, stops: np.ndarray) -> list[list[int]]:
    """Of texts whose ids stand together and end at these stops: each text's cut points."""
    marks = cut_marks(ids)
    out, begin, low = [], 0, 0
    for stop, high in zip(stops.tolist(), np.searchsorted(marks, stops, "right").tolist(), strict=True):
        out.append(cut_points(stop - begin, (marks[low:high] - begin).tolist()))
        begin, low = stop, high
    return out


_SPACE, _PUNCTUATION, _ALNUM, _ZERO = 1, 2, 4, 8
_KIND = np.zeros(256, np.uint8)
_KIND[list(b"\t\n\x0b\x0c\r ")] = _SPACE
_KIND[[c for c in range(33, 127) if not chr(c).isalnum()]] = _PUNCTUATION
_KIND[[c for c in range(33, 127) if chr(c).isalnum()]] = _ALNUM
_KIND[0] = _ZERO
#: White space beyond ASCII, in UTF-8.
_WIDE_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
_SPACES = b"\t\n\x0b\x0c\r "


class Encoder:
    """Encodes with the library, each different unit once.

    A unit begins where white space begins and where ASCII punctuation follows an ASCII letter or digit: there the
    byte-level pre-tokenizer always begins a piece, so a unit is encoded alike anywhere. A zero byte stands before a text
    that doesn't begin with white space, and after each text, where it becomes the end id. Texts with zero bytes, special
    tokens or white space beyond ASCII go to the library as they are, and so does everything if the tokenizer is of another
    kind.
    """

    def __init__(self, spec: str, end_id: int = 0) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(spec)
        self.library.no_truncation()
        self.library.no_padding()
        rules = json.loads(spec)
        split = rules["pre_tokenizer"] or {}
        self.by_unit = rules["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split["add_prefix_space"] and rules["model"]["type"] == "BPE" and not rules["model"]["dropout"]
        self.special = [x.content.encode() for x in self.library.get_added_tokens_decoder().values()]
        self.dtype = np.dtype("<u2" if max(self.library.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4")
        self.widths = np.zeros(1 + max(self.library.get_vocab().values()), np.int64)  # bytes of each token: byte-level names have a letter a byte
        for name, k in self.library.get_vocab(with_added_tokens=False).items():
            self.widths[k] = len(name)
        self.end = np.array([end_id], self.dtype)
        self._forget()

    def _forget(self) -> None:
        self.table, self.ids = WordTable(), Arena(self.dtype)
        self.at, self.size = Arena(np.int64), Arena(np.int32)

    def whole(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of whole texts, by the library alone."""
        return [np.array(e.ids, self.dtype) for e in self.library.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]

    def _learn(self, units: list[bytes]) -> None:
        """Encodes units as one text, with something before those that would not begin a piece there."""
        alone = [k for k, u in enumerate(units) if u[-1] == 0]
        before = [b"" if u[0] in _SPACES else b"\n" if u[0] == 0 else b" a" for u in units]
        cores = [b"" if u[-1] == 0 else u[1:] if u[0] == 0 else u for u in units]
        if alone:
            before = [b"" if u[-1] == 0 else x for x, u in zip(before, units, strict=True)]
        ids = self.whole([b"".join([x for pair in zip(before, cores, strict=True) for x in pair])])[0]
        width = np.cumsum(self.widths[ids])
        sizes = np.array([list(map(len, before)), list(map(len, cores))], np.int64)
        stop = np.cumsum(sizes.sum(axis=0))
        low, high = np.searchsorted(width, stop - sizes[1], "right"), np.searchsorted(width, stop, "right")
        at = self.ids.extend(ids) + low
        size = high - low
        for k, own in zip(alone, self.whole([units[k][:-1] for k in alone]), strict=True):  # white space at a text's end, then the end
            at[k], size[k] = self.ids.extend(np.concatenate([own, self.end])), len(own) + 1
        self.at.extend(at)
        self.size.extend(size)

    def _block(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts or parts of them, put together, and where each part's ids end."""
        raw = b"".join(parts)
        data, stops = np.frombuffer(raw + bytes(SHORT), np.uint8), np.cumsum(list(map(len, parts)))
        kind = _KIND[data[: len(raw)]]
        begins = np.ones(len(raw), bool)
        left, right = kind[:-1], kind[1:]
        begins[1:] = ((right & (_SPACE | _ZERO)) != 0) & ((left & _SPACE) == 0) | (((right & _PUNCTUATION) != 0) & ((left & _ALNUM) != 0))
        begins[stops[:-1]] = True
        start = np.flatnonzero(begins)
        if self.table.n > MAX_WORDS:
            self._forget()
        unit = self.table.lookup(raw, data, start, np.diff(start, append=len(raw)), self._learn)
        size = self.size.data[unit]
        ends = np.cumsum(size, dtype=np.int64)
        return gather(self.ids.data, self.at.data[unit], size), ends[np.searchsorted(start, stops) - 1]

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts with their end ids, put together, and where each text's ids end."""
        counts, out = np.zeros(len(texts), np.int64), []
        odd = {k: None for k, t in enumerate(texts) if not self.by_unit or b"\0" in t or any(s in t for s in self.special) or not (t.isascii() or _WIDE_SPACE.search(t) is None)}
        odd = dict(zip(odd, self.whole([texts[k] for k in odd]), strict=True))
        marked = (b"\0" if k in odd or not t else t + b"\0" if t[0] in _SPACES else b"\0" + t + b"\0" for k, t in enumerate(texts))
        for block, owner in in_blocks(marked, BLOCK_BYTES):
            ids, ends = self._block(block)
            np.add.at(counts, owner, np.diff(ends, prepend=0))
            done = 0
            for k, end in zip(owner, ends.tolist(), strict=True):
                if k in odd:  # its only unit here is the end
                    out += [ids[done : end - 1], odd[k]]
                    counts[k] += len(odd[k])
                    done = end - 1
            out.append(ids[done:])
        return np.concatenate(out) if out else np.zeros(0, self.dtype), np.cumsum(counts)


_made: dict[tuple[str, int], Encoder] = {}


def encoder(spec: str, end_id: int = 0) -> Encoder:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # executors run one task a core already
    key = (hashlib.sha256(spec.encode()).hexdigest(), end_id)
    if key not in _made:
        _made.clear()
        _made[key] = Encoder(spec, end_id)
    return _made[key]


def write_store(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every row and writes the store to path (one that Spark can write and all executors can read)."""
    spark = docs.sparkSession
    repo_on_workers(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("kind", T.StringType()), T.StructField("key", T.BinaryType()), T.StructField("ids", T.BinaryType()), T.StructField("doc_id", id_type), T.StructField("row", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("chunks", T.ArrayType(T.BinaryType()))])
    out = pa.schema([(f.name, arrow_type(f.dataType)) for f in schema])

    @freed
    def objects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(spec.value, end_id)
        width = enc.dtype.itemsize
        part, row = TaskContext.get().partitionId() << 33, 0
        for batch in batches:
            own: dict[bytes, bytes] = {}  # a batch's copies are sent on once
            keys, lists = [], []
            ids, stops = enc.encode(blobs(batch.column(1)))
            data, at = ids.tobytes(), 0
            rows = part | (row + np.arange(len(stops)))
            for cuts, stop in zip(chunk_ends(ids, stops), stops.tolist(), strict=True):
                chunks, begin = [], at
                for cut in cuts:
                    piece = data[at * width : (begin + cut) * width]
                    key = address(piece)
                    own.setdefault(key, piece)
                    chunks.append(key)
                    at = begin + cut
                keys.append(row.to_bytes(5, "big") + part.to_bytes(8, "big"))
                lists.append(chunks)
                row += 1
            n, m = len(own), len(rows)
            yield record_batch(out, [["chunk"] * n, list(own), list(own.values()), pa.nulls(n, out.field(3).type), pa.nulls(n, pa.int64()), [len(x) // width for x in own.values()], pa.nulls(n, out.field(6).type)])
            yield record_batch(out, [["recipe"] * m, keys, pa.nulls(m, pa.binary()), batch.column(0), rows, np.diff(stops, prepend=0), lists])

    made = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text")).mapInArrow(objects, schema)
    made.dropDuplicates(["kind", "key"]).write.partitionBy("kind").option("compression", "zstd").parquet(f"{path}/objects")
    _write_recipes(spark, path, schema)


def _objects(spark: SparkSession, path: str, kind: str, schema: T.StructType) -> DataFrame:
    at = f"{path}/objects/kind={kind}"
    fields = T.StructType([f for f in schema if f.name != "kind"])
    there = spark._jvm.org.apache.hadoop.fs.Path(at)
    if not there.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(there):
        return spark.createDataFrame([], fields)
    return spark.read.schema(fields).parquet(at)


def _write_recipes(spark: SparkSession, path: str, schema: T.StructType) -> None:
    """Recipes in ascending document order, in parts; each row has its place, position and root, and a last row the part's.

    Roots of LEAVES documents make a leaf's, those of a part's leaves the part's, and the parts' roots that of the store.
    """
    recipes = _objects(spark, path, "recipe", schema).select("doc_id", "row", "n_tokens", "chunks")
    fields = T.StructType([T.StructField("part", T.IntegerType()), *recipes.schema, T.StructField("place", T.LongType()), T.StructField("position", T.LongType()), T.StructField("root", T.BinaryType()), T.StructField("n_docs", T.LongType())])
    out = pa.schema([(f.name, arrow_type(f.dataType)) for f in fields])

    @freed
    def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, position, n = TaskContext.get().partitionId(), 0, 0
        leaf, leaves = [], []
        for batch in batches:
            sizes = np.array(batch.column(2).to_pylist(), np.int64)
            starts = position + np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else sizes
            roots = [merkle(chunks) for chunks in batch.column(3).to_pylist()]
            for root in roots:
                leaf.append(root)
                if len(leaf) == LEAVES:
                    leaves.append(merkle(leaf))
                    leaf = []
            yield record_batch(out, [[part] * len(sizes), *batch.columns, n + np.arange(len(sizes)), starts, roots, pa.nulls(len(sizes), pa.int64())])
            position, n = position + int(sizes.sum()), n + len(sizes)
        if n:
            yield record_batch(out, [[part], pa.nulls(1, out.field(1).type), [None], [position], pa.nulls(1, out.field(4).type), [None], [None], [merkle([*leaves, *([merkle(leaf)] if leaf else [])])], [n]])

    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-recipes.count() // PART_DOCS))
    recipes.repartitionByRange(parts, "doc_id", "row").sortWithinPartitions("doc_id", "row").mapInArrow(ordered, fields).write.option("compression", "zstd").parquet(f"{path}/recipes")
    ends = spark.read.schema(fields).parquet(f"{path}/recipes").filter("n_docs is not null").orderBy("part").select("part", "n_docs", "n_tokens", "root").collect()  # one row a part
    rows, start = [], 0
    for r in ends:
        rows.append((r["part"], start, r["n_docs"], r["n_tokens"], r["root"]))
        start += r["n_tokens"]
    rows.append((-1, 0, sum(r[2] for r in rows), start, bytearray(merkle([bytes(r[4]) for r in rows]))))
    spark.createDataFrame(rows, "part int, start long, n_docs long, n_tokens long, root binary").coalesce(1).write.parquet(f"{path}/manifest")


def _read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Recipes, chunks, and the manifest."""
    manifest = spark.read.parquet(f"{path}/manifest")
    recipes = spark.read.parquet(f"{path}/recipes").filter("n_docs is null").drop("n_docs")
    schema = T.StructType([T.StructField("kind", T.StringType()), T.StructField("key", T.BinaryType()), T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType())])
    return recipes, _objects(spark, path, "chunk", schema), manifest


def _with_start(recipes: DataFrame, manifest: DataFrame) -> DataFrame:
    """Recipes with the ids of all documents before each: a part's start (a row a part, so broadcast) and the position in it."""
    starts = manifest.select("part", F.col("start").alias("_start"))
    return recipes.join(F.broadcast(starts), "part").withColumn("start", F.col("_start") + F.col("position")).drop("_start")


def check_manifest(spark: SparkSession, path: str) -> None:
    """Raises ValueError unless the recipes give every document's, leaf's and part's root, and these the manifest's."""
    repo_on_workers(spark)
    recipes, _, manifest = _read(spark, path)
    table = {r["part"]: (bytes(r["root"]), r["start"], r["n_docs"], r["n_tokens"]) for r in manifest.collect()}  # one row a part
    kind = pa.schema([("part", pa.int32()), ("leaf", pa.int64()), ("place", pa.int64()), ("root", pa.binary()), ("n_tokens", pa.int64())])

    @freed
    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roots = [merkle(chunks) for chunks in batch.column(2).to_pylist()]
            if roots != batch.column(3).to_pylist():
                raise ValueError("a recipe doesn't match its root")
            place = np.array(batch.column(1).to_pylist(), np.int64)
            yield record_batch(kind, [batch.column(0), place // LEAVES, place, roots, batch.column(4)])

    def level(key: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        made = pa.schema([("part", pa.int32()), (key, pa.int64()), ("root", pa.binary()), ("n", pa.int64()), ("n_tokens", pa.int64())])

        @freed
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield record_batch(made, [batch.column(0), batch.column(1), [merkle([r["root"] for r in rows]) for rows in batch.column(2).to_pylist()], batch.column(3), batch.column(4)])

        return run

    each = recipes.select("part", "place", "chunks", "root", "n_tokens").mapInArrow(documents, "part int, leaf long, place long, root binary, n_tokens long")
    ordered = lambda c: F.array_sort(F.collect_list(F.struct(c, "root"))).alias("rows")  # noqa: E731  at most LEAVES, or a part's leaves
    leaves = each.groupBy("part", "leaf").agg(ordered("place"), F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("n_tokens")).mapInArrow(level("leaf"), "part int, leaf long, root binary, n long, n_tokens long")
    parts = leaves.groupBy("part").agg(F.lit(0).cast("long").alias("all"), ordered("leaf"), F.sum("n").alias("n"), F.sum("n_tokens").alias("n_tokens")).mapInArrow(level("all"), "part int, all long, root binary, n long, n_tokens long")
    found = {r["part"]: (bytes(r["root"]), r["n"], r["n_tokens"]) for r in parts.collect()}  # one row a part
    start, roots = 0, []
    for part in sorted(k for k in table if k >= 0):
        root, at, n, size = table[part]
        if found.pop(part, None) != (root, n, size) or at != start:
            raise ValueError("a part of the recipes doesn't match the manifest")
        start += size
        roots.append(root)
    if found or table[-1][0] != merkle(roots) or table[-1][3] != start:
        raise ValueError("the manifest doesn't match its root")


def crc_join(a: int, b: int, length: int) -> int:
    """crc32 of two byte strings put together, from that of each and the second's length."""
    return _times(_shift(length), a) ^ b if a else b


def _times(a: int, b: int) -> int:
    """Product of two polynomials over GF(2) modulo that of crc32, highest power in the lowest bit."""
    out, bit = 0, 1 << 31
    while a:
        if a & bit:
            out ^= b
            a &= ~bit
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
        bit >>= 1
    return out


_powers: dict[int, int] = {}


def _shift(length: int) -> int:
    """x to the power of 8 * length, modulo the polynomial."""
    if length not in _powers:
        out, base, n = 1 << 31, 1 << 23, length  # one, and x to the 8
        while n:
            if n & 1:
                out = _times(base, out)
            base, n = _times(base, base), n >> 1
        _powers[length] = out
    return _powers[length]


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files, whose manifest is checked first.

    Each stored chunk is checked against its address and its crc32 taken once; a document's crc32 is put together from
    its chunks' in the order of its recipe, so no ids are moved.
    """
    check_manifest(spark, path)
    recipes, chunks, manifest = _read(spark, path)
    recipes = _with_start(recipes, manifest)

    @freed
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        out = pa.schema([("key", pa.binary()), ("n", pa.int64()), ("crc", pa.int64())])
        for batch in batches:
            keys, crcs, sizes = batch.column(0).to_pylist(), [], []
            for key, data, n in zip(keys, batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if address(data) != key:
                    raise ValueError("a stored chunk doesn't match its address")
                crcs.append(zlib.crc32(np.frombuffer(data, f"<u{len(data) // n}").astype("<u4").tobytes()))
                sizes.append(n)
            yield record_batch(out, [keys, sizes, crcs])

    @freed
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([("row", pa.int64()), ("ids_crc32", pa.int64()), ("got", pa.int64())])
        for batch in batches:
            crcs, sizes = [], []
            for parts in batch.column(1).to_pylist():
                crc, total = 0, 0
                for p in parts:
                    if p["crc"] is None:
                        raise ValueError("a chunk of a recipe isn't stored")
                    crc, total = crc_join(crc, p["crc"], 4 * p["n"]), total + p["n"]
                crcs.append(crc)
                sizes.append(total)
            yield record_batch(out, [batch.column(0), crcs, sizes])

    checked = chunks.mapInArrow(sums, "key binary, n long, crc long")
    each = recipes.select("row", F.posexplode("chunks").alias("k", "key"))
    parts = each.join(checked, "key", "left").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("k", "n", "crc"))).alias("parts"))
    crcs = parts.mapInArrow(join, "row long, ids_crc32 long, got long")
    return recipes.select("row", "doc_id", "start").join(crcs, "row").select("doc_id", "start", F.col("got").alias("n_tokens"), "ids_crc32")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start and ids (array of int) of every document, put together from the stored chunks."""
    check_manifest(spark, path)
    recipes, chunks, manifest = _read(spark, path)
    recipes = _with_start(recipes, manifest)
    each = recipes.select("row", F.posexplode("chunks").alias("k", "key")).join(chunks, "key")
    parts = each.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("k", "ids", "n_tokens"))).alias("parts"))

    @freed
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([("row", pa.int64()), ("ids", pa.list_(pa.int32()))])
        for batch in batches:
            yield record_batch(out, [batch.column(0), [np.concatenate([np.frombuffer(p["ids"], f"<u{len(p['ids']) // p['n_tokens']}").astype(np.int32) for p in parts]) for parts in batch.column(1).to_pylist()]])

    return recipes.select("row", "doc_id", "start").join(parts.mapInArrow(join, "row long, ids array<int>"), "row").select("doc_id", "start", "ids")


def verify(spark: SparkSession, path: str) -> bool:
    """Whether the recipes match the manifest, every chunk its address, and every recipe's chunks are there."""
    from pyspark.errors import PySparkException

    try:
        read_digests(spark, path).write.format("noop").mode("overwrite").save()
    except (PySparkException, ValueError):
        return False
    return True


def store_digests(docs: DataFrame, tokenizer_path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the store to the shared folder and reads it back."""
    path = scratch(docs.sparkSession, "tokens")
    write_store(docs, tokenizer_path, path, end_id, id_col, text_col)
    return read_digests(docs.sparkSession, path)
