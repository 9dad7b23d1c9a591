"""Benchmark decontamination over a distributed positional inverted index.

The index is document-partitioned: every row is a segment (an Arrow batch of documents) that holds, for each of its
terms, the sorted positions of that term. It is written to the shared folder. A test window is looked up in a segment
by intersecting the offset-adjusted position lists of its terms, rarest term (over the whole corpus) first; equal
offsets give exact phrases, offsets within `slop` words give proximity matches. Segments never need each other, so
neither a hot source nor a passage that many documents share gathers rows in one task.

Defined results: a null or wordless text has n_words 0 and no hits; a null or wordless item has no window; an item id
that is null reads as 'null'; repeated rows are judged each by itself; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ampliqua.llm.common import arrow_type, blobs, freed, record_batch, repo_on_workers, runs, stored

#: Words of a window, and words by which each term of a proximity match may be off its place.
WINDOW, SLOP = 10, 2
#: Test text is taken in blocks of about this many bytes; a block's windows are sent to every task.
ITEM_BLOCK_BYTES = 8 << 20

_FOLD = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words(data: bytes) -> list[bytes]:
    """[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z; all bytes of a non-ASCII character are word bytes."""
    return data.translate(_FOLD).split()


def _pack(positions: np.ndarray) -> bytes:
    """Differences, as planes of bytes: they compress well."""
    return np.diff(positions, prepend=0).astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<i4").ravel(), dtype=np.int64)


def _bases(n_words: np.ndarray, gap: int) -> np.ndarray:
    """Where each document's positions begin in its segment; gaps keep matches inside a document."""
    return np.concatenate([[0], np.cumsum(n_words + gap)]).astype(np.int64)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: list[bytes] | None = None, gap: int = WINDOW + SLOP) -> DataFrame:
    """Positional index of the documents' terms, one row a segment; vocabulary: only these terms are kept."""
    id_type = docs.schema[id_col].dataType
    schema = T.StructType(
        [
            T.StructField("segment", T.LongType()),
            T.StructField("doc_ids", T.ArrayType(id_type)),
            T.StructField("n_words", T.ArrayType(T.LongType())),
            T.StructField("terms", T.ArrayType(T.BinaryType())),
            T.StructField("counts", T.ArrayType(T.LongType())),
            T.StructField("positions", T.BinaryType()),
        ]
    )
    out = pa.schema([(f.name, arrow_type(f.dataType)) for f in schema])
    known = None if vocabulary is None else {w: k for k, w in enumerate(vocabulary)}

    @freed
    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for k, batch in enumerate(batches):
            ids: dict[bytes, int] | defaultdict = known if known is not None else defaultdict(lambda: len(ids))
            lengths, each = [], []
            for data in blobs(batch.column(1)):
                found = words(data)
                lengths.append(len(found))
                each.append(np.fromiter(map(ids.get, found, [-1] * len(found)) if known is not None else map(ids.__getitem__, found), np.int32, len(found)))
            lengths = np.array(lengths, np.int64)
            base = _bases(lengths, gap)
            terms = np.concatenate(each) if each else np.zeros(0, np.int32)
            place = np.arange(len(terms)) + np.repeat(base[:-1] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) if len(lengths) else terms
            keep = np.flatnonzero(terms >= 0)
            order = keep[np.argsort(terms[keep], kind="stable")]
            starts = runs(terms[order])
            names = vocabulary if known is not None else list(ids)
            yield record_batch(
                out,
                [
                    [part << 32 | k],
                    pa.array([batch.column(0).to_pylist()], out.field(1).type),
                    [lengths],
                    [[names[t] for t in terms[order[starts[:-1]]]]],
                    [np.diff(starts)],
                    [_pack(place[order])],
                ],
            )

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(segments, schema)


def item_windows(items: list[tuple[str, bytes]], window: int = WINDOW) -> tuple[list[bytes], dict[int, np.ndarray], dict[int, list[list[str]]]]:
    """Terms, and by window length: a row of term numbers for each different window, and its items."""
    numbers: dict[bytes, int] = {}
    found: dict[int, dict[tuple, set[str]]] = defaultdict(lambda: defaultdict(set))
    for item, data in items:
        ids = [numbers.setdefault(w, len(numbers)) for w in words(data)]
        n = min(window, len(ids))
        for k in range(len(ids) - n + 1 if n else 0):
            found[n][tuple(ids[k : k + n])].add(item)
    return list(numbers), {n: np.array(list(x), np.int64) for n, x in found.items()}, {n: [sorted(s) for s in x.values()] for n, x in found.items()}


def _near(lists: np.ndarray, wanted: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray]:
    """Which wanted positions the sorted list has within slop, and which exactly."""
    at = np.searchsorted(lists, wanted)
    after = lists[np.minimum(at, len(lists) - 1)]
    before = lists[np.maximum(at - 1, 0)]
    off = np.minimum(np.abs(after - wanted), np.abs(before - wanted))
    return off <= slop, off == 0


def _search(row: dict, vocabulary: dict[bytes, int], rarity: np.ndarray, windows: dict[int, np.ndarray], slop: int, gap: int) -> tuple[np.ndarray, list, np.ndarray, list]:
    """Of one segment: base positions, exact matches (window length, window, positions), hit marks and proximity matches."""
    base = _bases(np.array(row["n_words"], np.int64), gap)
    positions, ends = _unpack(row["positions"]), np.cumsum(row["counts"], dtype=np.int64)
    lists = {vocabulary[t]: positions[e - c : e] for t, c, e in zip(row["terms"], row["counts"], ends, strict=True) if t in vocabulary}
    has = np.zeros(len(vocabulary), bool)
    has[list(lists)] = True
    exact, near, marks = [], [], np.zeros(base[-1] + gap + 1, np.int32)
    for n, rows in windows.items():
        for w in np.flatnonzero(has[rows].all(axis=1)):
            order = np.argsort(rarity[rows[w]], kind="stable")
            starts = lists[rows[w, order[0]]] - order[0]
            same = np.ones(len(starts), bool)
            for k in order[1:]:
                close, equal = _near(lists[rows[w, k]], starts + k, slop)
                starts, same = starts[close], (same & equal)[close]
                if not len(starts):
                    break
            if len(starts):
                near.append((n, w, starts))
                starts = starts[same]
                if len(starts):
                    exact.append((n, w, starts))
                    np.add.at(marks, starts, 1)
                    np.add.at(marks, starts + n, -1)
    return base, exact, np.cumsum(marks) > 0, near


def _blocks(items: DataFrame, item_col: str, text_col: str, block_bytes: int) -> list[DataFrame]:
    named = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    total = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = 1 + int(total // block_bytes)
    return [named if n == 1 else named.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k) for k in range(n)]


def find_matches(index: DataFrame, items: list[tuple[str, bytes]], window: int = WINDOW, slop: int = SLOP, gap: int = WINDOW + SLOP, exact: bool = True) -> DataFrame:
    """Matches of a block of items: doc_id, item_id, position (word number in the document), n_words of the window.

    exact: phrases; else proximity matches, where every word of the window is within slop words of its place.
    """
    names, windows, owners = item_windows(items, window)
    vocabulary, rarity = {w: k for k, w in enumerate(names)}, _rarity(index, names)
    id_type = index.schema["doc_ids"].dataType.elementType
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("item_id", T.StringType()), T.StructField("position", T.LongType()), T.StructField("length", T.LongType())])
    out = pa.schema([(f.name, arrow_type(f.dataType)) for f in schema])

    @freed
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                base, phrases, _, near = _search(row, vocabulary, rarity, windows, slop, gap)
                rows = [(row["doc_ids"][d], item, int(p - base[d]), n) for n, w, starts in (phrases if exact else near) for p, d in zip(starts, np.searchsorted(base, starts, "right") - 1, strict=True) for item in owners[n][w]]
                yield record_batch(out, [[r[k] for r in rows] for k in range(4)])

    return index.mapInArrow(search, schema)


def _rarity(index: DataFrame, names: list[bytes]) -> np.ndarray:
    """Occurrences of each test term in the whole corpus: at most a row for each term of the block."""
    pairs = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.counts").alias("n"))
    wanted = index.sparkSession.createDataFrame([(bytearray(w),) for w in names], "term binary") if names else None
    counts = {} if wanted is None else {bytes(t): n for t, n in pairs.join(wanted, "term", "left_semi").collect()}
    return np.array([counts.get(w, 0) for w in names], np.int64)


def judge(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, slop: int = SLOP, block_bytes: int = ITEM_BLOCK_BYTES) -> DataFrame:
    """Per document row: doc_id, n_words, n_hit (words inside an exact window), n_items, items_sha256, contaminated, n_near.

    n_near counts proximity matches of windows (exact ones among them). Test text is taken in blocks of bounded size:
    with one block the index keeps the block's terms, with more it keeps all terms and is built once for all blocks.
    """
    spark = docs.sparkSession
    repo_on_workers(spark)
    gap, blocks = window + slop, _blocks(items, item_col, item_text, block_bytes)
    read = lambda b: [(r["item"], r["text"].encode()) for r in b.collect()]  # noqa: E731  a block is bounded
    first = read(blocks[0])
    vocabulary = sorted({w for _, data in first for w in words(data)}) if len(blocks) == 1 else None
    index = stored(spark, build_index(docs, id_col, text_col, vocabulary, gap), "postings")
    parts = [_judge_block(index, first if k == 0 else read(b), window, slop, gap) for k, b in enumerate(blocks)]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    if len(parts) > 1:
        found = found.groupBy("segment", "ordinal").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.collect_list("marks").alias("marks"), F.flatten(F.collect_list("items")).alias("items"), F.sum("n_near").alias("n_near"))
    else:
        found = found.withColumn("marks", F.array("marks"))
    id_type = index.schema["doc_ids"].dataType.elementType
    schema = T.StructType([T.StructField("doc_id", id_type), *(T.StructField(n, T.LongType()) for n in ("n_words", "n_hit", "n_items")), T.StructField("items_sha256", T.StringType()), T.StructField("contaminated", T.BooleanType()), T.StructField("n_near", T.LongType())])
    out = pa.schema([(f.name, arrow_type(f.dataType)) for f in schema])

    @freed
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits, items_, digests = [], [], []
            for marks, names in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                n = max(map(len, marks), default=0)
                bits = np.zeros(n, np.uint8)
                for m in marks:
                    bits[: len(m)] |= np.frombuffer(m, np.uint8)
                hits.append(int(np.unpackbits(bits).sum()))
                each = sorted(set(names))
                items_.append(len(each))
                digests.append(hashlib.sha256(",".join(each).encode()).hexdigest())
            yield record_batch(out, [batch.column(0), batch.column(1), hits, items_, digests, [h > 0 for h in hits], batch.column(4)])

    return found.select("doc_id", "n_words", "marks", "items", "n_near").mapInArrow(finish, schema)


def _judge_block(index: DataFrame, items: list[tuple[str, bytes]], window: int, slop: int, gap: int) -> DataFrame:
    """Of each document and one block of items: a bit for each word that is hit, the items found, and proximity matches."""
    names, windows, owners = item_windows(items, window)
    vocabulary, rarity = {w: k for k, w in enumerate(names)}, _rarity(index, names)
    id_type = index.schema["doc_ids"].dataType.elementType
    schema = T.StructType([T.StructField("segment", T.LongType()), T.StructField("ordinal", T.LongType()), T.StructField("doc_id", id_type), T.StructField("n_words", T.LongType()), T.StructField("marks", T.BinaryType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("n_near", T.LongType())])
    out = pa.schema([(f.name, arrow_type(f.dataType)) for f in schema])

    @freed
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                base, exact, marks, near = _search(row, vocabulary, rarity, windows, slop, gap)
                n = len(row["doc_ids"])
                found: list[set[str]] = [set() for _ in range(n)]
                for length, w, starts in exact:
                    for d in np.unique(np.searchsorted(base, starts, "right") - 1):
                        found[d].update(owners[length][w])
                close = np.zeros(n, np.int64)
                for _, _, starts in near:
                    # a start may lie before its document by up to slop words: the first document's never does so by a gap
                    np.add.at(close, np.clip(np.searchsorted(base, starts + slop, "right") - 1, 0, n - 1), 1)
                bits = [np.packbits(marks[base[d] : base[d] + row["n_words"][d]]).tobytes() if found[d] else b"" for d in range(n)]
                yield record_batch(out, [[row["segment"]] * n, range(n), pa.array(row["doc_ids"], out.field(2).type), row["n_words"], bits, [sorted(x) for x in found], close])

    return index.mapInArrow(search, schema)
