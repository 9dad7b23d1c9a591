"""BAM files in parallel: read in splits at block borders, written by ranges and joined, indexed and read by interval.

A BAM file is a row of compressed blocks that all begin with the same 16 bytes. Spark's text source, with these as its line
separator, hands out whole blocks of any split from any store. A split's first record is found by its form: a place from
which records follow each other to the end of what is looked at. That is no guess in the end: what stands before it must
be just the rest of the last record of the splits before, from the file's header on, or reading fails.

Writing sorts by range, packs the records of each part into blocks, and lets Spark's committer keep only what whole tasks
wrote; the parts are then joined behind the header, as a stream, under a temporary name that is changed at the end.

Defined results: columns are those of a SAM file (positions from 1, `*` for what is missing); nulls are written as if they
were missing; repeated records stay; no records give a file with a header alone; columns of other names are ignored. A cigar
of over 65,535 operations is kept in the tag that the format has for it. Of the tags cs is kept, and others are not.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ampliqua.functions import strings
from ampliqua.schemas import ALIGNMENTS
from ampliqua.session import bounded_batches, scratch

#: Fixed values of the format: what a block begins with, the last block, letters of the 4-bit bases and of operations.
START = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0"
BASES, OPERATIONS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
#: Bytes of a block before compression, at most, and of what the search for a first record looks at.
BLOCK, LOOK = 0xFF00, 1 << 20
#: Bytes of blocks that an interval may name to be read by the driver.
INTERVAL_BYTES = 64 << 20

_FIXED = struct.Struct("<iiiBBHHHiiii")
_TO_BASE = str.maketrans("0123456789abcdef", BASES)
_FROM_BASE = {ord(b): f"{k:x}" for k, b in enumerate(BASES)} | {ord(b.lower()): f"{k:x}" for k, b in enumerate(BASES)}
_QUALITY = bytes(min(k + 33, 126) for k in range(256))
_PHRED = bytes(max(k - 33, 0) for k in range(256))
_NAMES = [f.name for f in ALIGNMENTS]


class BamError(ValueError):
    """A file that is no BAM file, or a damaged one."""


def deflated(data: bytes) -> bytes:
    """A block."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    return START + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def inflated(rest: bytes) -> bytes:
    """What is in a block, given without its first 16 bytes."""
    size = struct.unpack_from("<H", rest)[0] + 1 - len(START)
    if size != len(rest):
        raise BamError(f"a block of {size} bytes has {len(rest)}")
    data = zlib.decompress(rest[2:-8], -15)
    if struct.unpack_from("<II", rest, len(rest) - 8) != (zlib.crc32(data), len(data)):
        raise BamError("a block's sum is wrong")
    return data


def header_of(data: bytes) -> tuple[str, list[tuple[str, int]], int] | None:
    """Text, references with their lengths, and the header's size; None if there are more bytes to it."""
    if data[:4] != b"BAM\1"[: len(data[:4])]:
        raise BamError("no BAM file")
    try:
        n = struct.unpack_from("<i", data, 4)[0]
        at = 12 + n
        refs = []
        for _ in range(struct.unpack_from("<i", data, 8 + n)[0]):
            k = struct.unpack_from("<i", data, at)[0]
            size = struct.unpack_from("<i", data, at + 4 + k)[0]
            refs.append((data[at + 4 : at + 3 + k].decode(), size))
            at += 8 + k
    except struct.error:
        return None
    return (data[8 : 8 + n].rstrip(b"\0").decode(), refs, at) if at <= len(data) else None


def header_bytes(text: str, refs: Sequence[tuple[str, int]]) -> bytes:
    out = [b"BAM\1", struct.pack("<i", len(text.encode())), text.encode(), struct.pack("<i", len(refs))]
    for name, size in refs:
        out += [struct.pack("<i", len(name.encode()) + 1), name.encode() + b"\0", struct.pack("<i", size)]
    return b"".join(out)


def looks_like_a_record(data: bytes, at: int, n_refs: int) -> bool:
    """Whether the fixed fields at this place can be a record's, and its name is one."""
    if at + 36 > len(data):
        return False
    size, ref, pos, name, _, _, ops, _, bases, other, next_pos, _ = _FIXED.unpack_from(data, at)
    if not (32 < size < 1 << 29 and -1 <= ref < n_refs and -1 <= other < n_refs and pos >= -1 and next_pos >= -1 and name and bases >= 0):
        return False
    if 32 + name + 4 * ops + (bases + 1) // 2 + bases > size:
        return False
    end = at + 36 + name
    return end > len(data) or (data[end - 1] == 0 and all(33 <= c <= 126 for c in data[at + 36 : end - 1]))


def first_record(data: bytes, n_refs: int) -> int | None:
    """Where the first record begins: from there on one follows another to the end of these bytes."""
    for start in range(len(data)):
        at = start
        while looks_like_a_record(data, at, n_refs):
            at += 4 + struct.unpack_from("<i", data, at)[0]
        if at > start and at + 36 > len(data):
            return start
    return None


def records_end(data: bytes | bytearray, at: int) -> int:
    """Where the last whole record ends."""
    while at + 4 <= len(data) and at + 4 + (size := struct.unpack_from("<i", data, at)[0]) <= len(data):
        if size < 32:
            raise BamError("a record of no size")
        at += 4 + size
    return at


_WIDTH = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}


def tags_of(data: bytes) -> dict[str, bytes]:
    """Text of Z and H tags, bytes of the others."""
    out, at = {}, 0
    while at + 3 <= len(data):
        name, kind = data[at : at + 2].decode("latin-1"), chr(data[at + 2])
        at += 3
        if kind in "ZH":
            end = data.index(b"\0", at)
            out[name] = data[at:end]
            at = end + 1
        else:
            size = _WIDTH[kind] if kind != "B" else 5 + _WIDTH[chr(data[at])] * struct.unpack_from("<i", data, at + 1)[0]
            out[name] = data[at : at + size]
            at += size
    return out


def _cigar(values: Sequence[int]) -> str:
    return "".join(f"{v >> 4}{OPERATIONS[v & 15]}" for v in values) or "*"


def decoded(data: bytes | bytearray, at: int, refs: Sequence[str]) -> tuple:
    """A record's columns."""
    size, ref, pos, n_name, mapq, _, n_ops, flag, n_bases, other, next_pos, tlen = _FIXED.unpack_from(data, at)
    end, at = at + 4 + size, at + 36
    name = bytes(data[at : at + n_name - 1]).decode()
    at += n_name
    ops = struct.unpack_from(f"<{n_ops}I", data, at)
    at += 4 * n_ops
    half = (n_bases + 1) // 2
    seq = bytes(data[at : at + half]).hex().translate(_TO_BASE)[:n_bases] or "*"
    qual = bytes(data[at + half : at + half + n_bases])
    quality = "*" if not qual or qual[0] == 255 else qual.translate(_QUALITY).decode()
    tags = tags_of(bytes(data[at + half + n_bases : end]))
    if n_ops == 2 and ops[0] == (n_bases << 4 | 4) and ops[1] & 15 == 3 and "CG" in tags:
        ops = struct.unpack_from(f"<{struct.unpack_from('<i', tags['CG'], 1)[0]}I", tags["CG"], 5)
    mate = "*" if other < 0 else "=" if other == ref else refs[other]
    return name, flag, refs[ref] if ref >= 0 else "*", pos + 1, mapq, _cigar(ops), mate, next_pos + 1, tlen, seq, quality, tags.get("cs", b"").decode()


def bin_of(begin: int, end: int) -> int:
    """The least bin of the index's scheme that holds the whole interval (from 0, end exclusive)."""
    end -= 1
    for shift, first in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
        if begin >> shift == end >> shift:
            return first + (begin >> shift)
    return 0


def encoded(row: Sequence, refs: dict[str, int]) -> bytes:
    """A record of these columns; an error if a name is none of the references'."""
    name, flag, rname, pos, mapq, cigar, rnext, pnext, tlen, seq, qual, cs = row
    number = lambda r: -1 if r in (None, "*", "") else refs[r]
    try:
        ref = number(rname)
        other = ref if rnext == "=" else number(rnext)
    except KeyError as error:
        raise BamError(f"{error.args[0]} is not in the header") from None
    seq = "" if seq in (None, "*") else seq
    ops = [int(n) << 4 | OPERATIONS.index(op) for n, op in re.findall(r"(\d+)([MIDNSHP=X])", cigar or "")]
    begin = int(pos or 0) - 1
    span = sum(v >> 4 for v in ops if v & 15 in (0, 2, 3, 7, 8))
    tags = b"csZ" + cs.encode() + b"\0" if cs else b""
    if len(ops) > 0xFFFF:
        tags += b"CGBI" + struct.pack(f"<i{len(ops)}I", len(ops), *ops)
        ops = [len(seq) << 4 | 4, span << 4 | 3]
    digits = seq.translate(_FROM_BASE)
    if re.search("[^0-9a-f]", digits):
        digits = "".join(_FROM_BASE.get(ord(c), "f") for c in seq)
    quality = b"\xff" * len(seq) if qual in (None, "", "*") or len(qual) != len(seq) else qual.encode("latin-1", "replace").translate(_PHRED)
    label = (name or "*").encode()[:254] + b"\0"
    body = struct.pack("<iiBBHHHiiii", ref, begin, len(label), min(int(mapq or 0), 255), bin_of(max(begin, 0), max(begin, 0) + max(span, 1)), len(ops), int(flag or 0), len(seq), other, int(pnext or 0) - 1, int(tlen or 0))
    body += label + struct.pack(f"<{len(ops)}I", *ops) + bytes.fromhex(digits + "0" * (len(digits) % 2)) + quality + tags
    return struct.pack("<i", len(body)) + body


def _blocks(spark: SparkSession, path: str) -> DataFrame:
    """file, start (of the split), data (a block without its first 16 bytes); in each split in the file's order."""
    bounded_batches(spark)
    raw = spark.read.option("lineSep", START.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("data")).filter("octet_length(data) > 0")


def read_header(spark: SparkSession, path: str) -> tuple[str, list[tuple[str, int]]]:
    """Text, and references with their lengths, of a file."""
    n = 2
    while True:
        rows = _blocks(spark, path).filter("start = 0").limit(n).collect()
        if not rows:
            raise BamError(f"{path}: no BAM file")
        found = header_of(b"".join(inflated(bytes(r["data"])) for r in rows))
        if found or len(rows) < n:
            if not found:
                raise BamError(f"{path}: the header has no end")
            return found[0], found[1]
        n *= 16


class _Split:
    """The inflated blocks of one split, as they come: whole records are taken off at the front."""

    def __init__(self, file: str, start: int, n_refs: int) -> None:
        self.file, self.start, self.n_refs = file, start, n_refs
        self.data, self.head, self.known = bytearray(), b"", False
        self.compressed, self.marks = 0, []  # bytes of the blocks so far; places in data where blocks begin, and in the split

    def add(self, rest: bytes) -> None:
        self.marks.append((len(self.data), self.compressed))
        self.compressed += len(rest) + len(START)
        self.data += inflated(rest)

    def ready(self, last: bool) -> bool:
        """Whether it is known where records begin; else more bytes are needed."""
        if self.known:
            return True
        if not self.start:
            found = header_of(bytes(self.data))
            at = found[2] if found else None
        else:
            at = first_record(bytes(self.data), self.n_refs) if last or len(self.data) >= LOOK else None
        if at is None:
            return False
        self.known = True
        self.head = bytes(self.data[:at]) if self.start else b""
        self.cut(at)
        return True

    def cut(self, at: int) -> None:
        del self.data[:at]
        self.marks = [(m - at, c) for m, c in self.marks]
        before = [k for k, m in enumerate(self.marks) if m[0] <= 0]
        self.marks = self.marks[before[-1] if before else 0 :]

    def offset(self, at: int) -> int:
        """The place of a byte as block and place within, the block counted from the split's first."""
        m, c = [x for x in self.marks if x[0] <= at][-1] if self.marks else (0, self.compressed)
        return c << 16 | (at - m)


def _splits(batches: Iterator[pa.RecordBatch], n_refs: int) -> Iterator[tuple[_Split, bool]]:
    """Splits with whole records in their data, some at a time; True with the last of a split."""
    now: _Split | None = None
    for batch in batches:
        for file, start, rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is None or (now.file, now.start) != (file, start):
                if now is not None:
                    now.ready(True)
                    yield now, True
                now = _Split(file, start, n_refs)
            now.add(rest)
        if now is not None and now.ready(False):
            yield now, False
    if now is not None:
        now.ready(True)
        yield now, True


def _edges(pdf: pd.DataFrame, refs: Sequence[str]) -> pd.DataFrame:
    """The records of one file that lie over borders of splits, put together; an error if anything is left."""
    out, rest, at = [], b"", 0
    for start, head, tail in sorted(zip(pdf["start"], pdf["head"], pdf["tail"], strict=True), key=lambda x: x[0]):
        if (start == 0) != (at == 0):
            raise BamError("the first block is not at the file's beginning")
        at += 1
        rest += bytes(head)
        if tail is None:  # a split without a record's beginning
            continue
        end = records_end(rest, 0)
        if end != len(rest) or (rest and records_end(rest[:-1], 0)):
            raise BamError(f"records do not meet at byte {start}")
        if rest:
            out.append(decoded(rest, 0, refs))
        rest = bytes(tail)
    if rest:
        raise BamError("the last record has no end")
    return pd.DataFrame(out, columns=_NAMES)


def read_bam(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Header lines (value), and alignments, of one file."""
    text, references = read_header(spark, path)
    refs = [n for n, _ in references]
    schema = pa.schema([("start", pa.int64()), ("file", pa.string()), ("head", pa.binary()), ("tail", pa.binary()), *((f.name, pa.int32() if f.dataType.typeName() == "integer" else pa.string()) for f in ALIGNMENTS)])
    kinds = "start long, file string, head binary, tail binary, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ALIGNMENTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for split, last in _splits(batches, len(refs)):
            end, at, rows = records_end(split.data, 0) if split.known else 0, 0, []
            while at < end:
                rows.append((None, None, None, None, *decoded(split.data, at, refs)))
                at += 4 + struct.unpack_from("<i", split.data, at)[0]
            split.cut(end)
            if last:
                head, tail = (split.head, bytes(split.data)) if split.known else (bytes(split.data), None)
                rows.append((split.start, split.file, head, tail, *[None] * len(_NAMES)))
            columns = list(zip(*rows, strict=True)) or [[] for _ in schema]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    every = _blocks(spark, path).mapInArrow(run, kinds)
    edges = every.filter("file is not null").select("file", "start", "head", "tail").groupBy("file").applyInPandas(lambda pdf: _edges(pdf, refs), ALIGNMENTS)
    header = spark.createDataFrame([(x,) for x in text.splitlines()], "value string")
    return header, every.filter("file is null").select(*_NAMES).unionByName(edges)


def references_of(header: Sequence[str]) -> list[tuple[str, int]]:
    """Names and lengths of a header's @SQ lines."""
    out = []
    for line in header:
        if line.startswith("@SQ"):
            fields = dict(x.split(":", 1) for x in line.split("\t")[1:])
            out.append((fields["SN"], int(fields["LN"])))
    return out


def write_bam(header: DataFrame, alignments: DataFrame, path: str, parts: int | None = None) -> None:
    """One file, sorted by coordinates, in place of any that is there; reads without a place come last."""
    spark = alignments.sparkSession
    bounded_batches(spark)
    lines = [x for x in dict.fromkeys(r["value"] for r in header.collect()) if not x.startswith("@HD")]  # a line a reference or program
    references = references_of(lines)
    numbers = {n: k for k, (n, _) in enumerate(references)}
    text = "\n".join(["@HD\tVN:1.6\tSO:coordinate", *lines]) + "\n"
    have = {c.lower() for c in alignments.columns}
    rows = alignments.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in ALIGNMENTS))
    place = F.array_position(F.array(*map(F.lit, [n for n, _ in references])).cast("array<string>"), F.col("rname"))
    order = [F.coalesce(F.nullif(place, F.lit(0)), F.lit(1 << 40)).alias("_ref"), F.col("pos"), F.col("qname"), F.col("flag")]
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # amplicon reads begin at the same position: names part them
    sorted_ = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[bytes] = []
        size = 0

        def blocks() -> Iterator[bytes]:
            data = b"".join(waiting)
            for k in range(0, len(data), BLOCK):
                yield deflated(data[k : k + BLOCK])[1:]

        def out(found: list[bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], names=["value"])

        for batch in batches:
            found: list[bytes] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                record = encoded(row, numbers)
                if size and size + len(record) > BLOCK:
                    found += blocks()
                    waiting, size = [], 0
                waiting.append(record)
                size += len(record)
            yield out(found)
        if waiting:
            yield out(list(blocks()))

    folder = scratch(spark, "bam")
    # a block's first byte is the separator after the one before it
    sorted_.mapInArrow(pack, "value binary").select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\x1f").text(folder)
    data = header_bytes(text, references)
    _join(spark, folder, b"".join(deflated(data[k : k + BLOCK]) for k in range(0, len(data), BLOCK)), deflated(b""), path)


def _join(spark: SparkSession, folder: str, first: bytes, last: bytes, path: str) -> None:
    """Streams the parts behind the header into a new file, and gives it its name."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    source = jvm.org.apache.hadoop.fs.Path(folder)
    from_ = source.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    parts = sorted((s.getPath() for s in from_.listStatus(source) if s.getPath().getName().startswith("part-") and s.getLen()), key=lambda p: p.getName())
    hidden = jvm.org.apache.hadoop.fs.Path(at.getParent(), f"_{at.getName()}-{uuid.uuid4().hex}")
    stream = files.create(hidden, True)
    try:
        stream.write(bytearray(first + (b"\x1f" if parts else b"")))
        for part in parts:
            inp = from_.open(part)
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(inp, stream, 1 << 20, False)
            inp.close()
        stream.write(bytearray(last[1:] if parts else last))
        stream.close()
        files.delete(at, False)
        files.rename(hidden, at)
    finally:
        stream.close()
        files.delete(hidden, False)
        from_.delete(source, True)


def reads_of(alignments: DataFrame) -> DataFrame:
    """read_ord, identifier, qname, sequence, quality of the primary alignments and unmapped reads, as they came off the machine."""
    rows = alignments.filter((F.col("flag").bitwiseAND(F.lit(0x900)) == 0) & (F.col("seq") != "*"))
    back = F.col("flag").bitwiseAND(F.lit(16)) != 0
    quality = F.when(F.col("qual") == "*", F.repeat(F.lit("I"), F.length("seq"))).otherwise(F.when(back, F.reverse("qual")).otherwise(F.col("qual")))
    return rows.select(F.monotonically_increasing_id().alias("read_ord"), F.concat(F.lit("@"), "qname").alias("identifier"), "qname", F.when(back, strings.revcomp(F.col("seq"))).otherwise(F.col("seq")).alias("sequence"), quality.alias("quality"))


# -- index -------------------------------------------------------------------------------------------------------------


def extent(data: bytes | bytearray, at: int) -> tuple[int, int, int, int]:
    """A record's size, reference, first place, and the place after its last one."""
    size, ref, pos, n_name, _, _, n_ops = _FIXED.unpack_from(data, at)[:7]
    ops = struct.unpack_from(f"<{n_ops}I", data, at + 36 + n_name)
    return size, ref, pos, pos + max(1, sum(v >> 4 for v in ops if v & 15 in (0, 2, 3, 7, 8)))


def write_index(spark: SparkSession, path: str) -> str:
    """path.bai: bins with their chunks, and the first place of each 16,384 bases. Every task sums up its own splits."""
    _, references = read_header(spark, path)
    n_refs = len(references)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks: dict[tuple[int, int], list[list[int]]] = {}
        linear: dict[tuple[int, int], int] = {}
        first = None  # where the split's first record begins
        kinds = [pa.string(), *[pa.int64()] * 4, pa.binary(), pa.binary()]
        for split, last in _splits(batches, n_refs):
            end, at = records_end(split.data, 0) if split.known else 0, 0
            begun = split.offset(0)
            while at < end:
                size, ref, pos, stop = extent(split.data, at)
                a, b = split.offset(at), split.offset(at + 4 + size)
                at += 4 + size
                if ref < 0:
                    continue
                own = chunks.setdefault((ref, bin_of(pos, stop)), [])
                if own and own[-1][1] >> 16 == a >> 16:
                    own[-1][1] = b
                else:
                    own.append([a, b])
                for w in range(pos >> 14, (stop - 1 >> 14) + 1):
                    linear[ref, w] = min(linear.get((ref, w), a), a)
            split.cut(end)
            if first is None and split.known:
                first = begun
            if last:
                rows = [("chunk", r, k, a, b, None, None) for (r, k), own in chunks.items() for a, b in own]
                rows += [("linear", r, w, a, 0, None, None) for (r, w), a in linear.items()]
                head, tail = (split.head, bytes(split.data)) if split.known else (bytes(split.data), None)
                rows.append(("split", split.compressed, 0, first if split.known else 0, split.offset(0) if split.known else 0, head, tail))
                chunks, linear, first = {}, {}, None
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([split.start] * len(rows), pa.int64()), *columns], names=["start", "kind", "ref", "k", "a", "b", "head", "tail"])

    # rows by bins and windows, not records; and what lies over the borders of splits
    found = _blocks(spark, path).mapInArrow(run, "start long, kind string, ref long, k long, a long, b long, head binary, tail binary").collect()
    base, at = {}, 0
    splits = sorted((r for r in found if r["kind"] == "split"), key=lambda r: r["start"])
    for r in splits:
        base[r["start"]] = at << 16
        at += r["ref"]
    bins: dict[int, dict[int, list[list[int]]]] = {}
    windows: dict[int, dict[int, int]] = {}
    for r in found:
        a, b = base[r["start"]] + r["a"], base[r["start"]] + r["b"]
        if r["kind"] == "chunk":
            bins.setdefault(r["ref"], {}).setdefault(r["k"], []).append([a, b])
        elif r["kind"] == "linear":
            own = windows.setdefault(r["ref"], {})
            own[r["k"]] = min(own.get(r["k"], a), a)
    rest, begun = b"", 0
    for r in splits:
        rest += bytes(r["head"])
        if r["tail"] is None:  # a split without a record's beginning
            continue
        if rest:
            _, ref, pos, stop = extent(rest, 0)
            if ref >= 0:
                bins.setdefault(ref, {}).setdefault(bin_of(pos, stop), []).append([begun, base[r["start"]] + r["a"]])
                own = windows.setdefault(ref, {})
                for w in range(pos >> 14, (stop - 1 >> 14) + 1):
                    own[w] = min(own.get(w, begun), begun)
        rest, begun = bytes(r["tail"]), base[r["start"]] + r["b"]
    out = [b"BAI\1", struct.pack("<i", n_refs)]
    for ref in range(n_refs):
        out.append(struct.pack("<i", len(bins.get(ref, {}))))
        for k, chunks in sorted(bins.get(ref, {}).items()):
            merged: list[list[int]] = []
            for a, b in sorted(chunks):
                if merged and merged[-1][1] >> 16 >= a >> 16:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            out.append(struct.pack("<Ii", k, len(merged)) + b"".join(struct.pack("<QQ", *c) for c in merged))
        own = windows.get(ref, {})
        offsets, last = [], 0
        for w in range(max(own, default=-1) + 1):
            last = own.get(w, last)
            offsets.append(last)
        out.append(struct.pack(f"<i{len(offsets)}Q", len(offsets), *offsets))
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(f"{path}.bai")
    stream = target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(target, True)
    stream.write(bytearray(b"".join(out)))
    stream.close()
    return f"{path}.bai"


def _bytes(spark: SparkSession, path: str, begin: int = 0, end: int | None = None) -> bytes:
    """Some bytes of a file, by the driver."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    size = files.getFileStatus(at).getLen()
    end = size if end is None else min(end, size)
    stream = files.open(at)
    try:
        stream.seek(begin)
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, end - begin)) if end > begin else b""
    finally:
        stream.close()


def read_index(data: bytes) -> list[tuple[dict[int, list[tuple[int, int]]], list[int]]]:
    """Of each reference: chunks by bin, and the linear index."""
    if data[:4] != b"BAI\1":
        raise BamError("no index")
    at, out = 8, []
    for _ in range(struct.unpack_from("<i", data, 4)[0]):
        bins = {}
        n, at = struct.unpack_from("<i", data, at)[0], at + 4
        for _ in range(n):
            k, m = struct.unpack_from("<Ii", data, at)
            flat = struct.unpack_from(f"<{2 * m}Q", data, at + 8)
            bins[k] = list(zip(flat[::2], flat[1::2], strict=True))
            at += 8 + 16 * m
        n, at = struct.unpack_from("<i", data, at)[0], at + 4
        out.append((bins, list(struct.unpack_from(f"<{n}Q", data, at))))
        at += 8 * n
    return out


def chunks_of(bins: dict[int, list[tuple[int, int]]], linear: list[int], begin: int, end: int) -> list[tuple[int, int]]:
    """Places of the records that may reach into the interval (from 0, end exclusive), merged where blocks meet."""
    wanted = {0}
    for shift, first in ((26, 1), (23, 9), (20, 73), (17, 585), (14, 4681)):
        wanted.update(range(first + (begin >> shift), first + (end - 1 >> shift) + 1))
    least = linear[min(begin >> 14, len(linear) - 1)] if linear else 0
    out: list[list[int]] = []
    for a, b in sorted(c for k in wanted for c in bins.get(k, []) if c[1] > least):
        if out and out[-1][1] >> 16 >= a >> 16:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def read_interval(spark: SparkSession, path: str, rname: str, begin: int, end: int) -> tuple[DataFrame, int]:
    """Alignments that overlap rname:begin-end (from 1, both inclusive), and the number of blocks opened (-1: all).

    The index names the blocks, and the driver reads just these if they are few bytes; a wider interval is a scan.
    """
    _, references = read_header(spark, path)
    refs = [n for n, _ in references]
    bins, linear = read_index(_bytes(spark, f"{path}.bai"))[refs.index(rname)]
    chunks = chunks_of(bins, linear, begin - 1, end)
    inside = (F.col("rname") == rname) & (F.col("pos") <= end) & (F.col("pos") + F.greatest(F.lit(1), strings.aligned_length(F.col("cigar"))) > begin)
    if sum((b >> 16) - (a >> 16) + (1 << 16) for a, b in chunks) > INTERVAL_BYTES:
        return read_bam(spark, path)[1].filter(inside), -1
    rows, opened = [], 0
    for a, b in chunks:
        raw, at, data, places = _bytes(spark, path, a >> 16, (b >> 16) + (1 << 16)), 0, b"", {}
        while at < len(raw) and (a >> 16) + at <= b >> 16:
            size = struct.unpack_from("<H", raw, at + 16)[0] + 1
            places[(a >> 16) + at] = len(data)
            data += inflated(raw[at + 16 : at + size])
            opened += 1
            at += size
        stop = places.get(b >> 16, len(data)) + (b & 0xFFFF)
        k = a & 0xFFFF
        while k < min(stop, len(data)):
            rows.append(decoded(data, k, refs))
            k += 4 + struct.unpack_from("<i", data, k)[0]
    return spark.createDataFrame(rows, ALIGNMENTS).filter(inside), opened
