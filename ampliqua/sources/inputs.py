"""Reads from files or folders, each file read as what its content is, whatever its name says.

Only the first bytes of a file are looked at by the driver. FASTA, FASTQ and SAM come plain or gzipped, BAM as it is. Files
whose gzip suffix tells the truth go through Spark's text reader; the others, which it would misread, are read whole, one
a row, and cut into lines in the task (up to 2 GB each).

Defined results: indexes, hidden and empty files are left out; a file of another kind is an error, and so are inputs
without any read file; reads of all files are put together, repeated names stay.
"""

from __future__ import annotations

import gzip
import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ampliqua.functions import strings
from ampliqua.session import bounded_batches
from ampliqua.sources import bam, files
from ampliqua.store import files_of

#: Bytes that tell a file's kind.
LOOK = 1 << 16
_FIELDS = ["identifier", "qname", "sequence", "quality"]
_SAM_HEADER = re.compile(rb"@(HD|SQ|RG|PG|CO)\t")


@dataclass(frozen=True)
class Input:
    """A file, what it holds, and whether it is gzipped."""

    path: str
    kind: str
    gzipped: bool

    @property
    def plain_reader(self) -> bool:
        """Whether Spark's text reader, which goes by the suffix, reads it right."""
        return self.gzipped == self.path.endswith(".gz")


def kind_of(head: bytes) -> tuple[str, bool]:
    """FASTA, FASTQ, SAM or BAM, and whether it is gzipped, by the first bytes; an empty name for anything else."""
    gzipped = head[:2] == b"\x1f\x8b"
    if gzipped:
        try:
            head = zlib.decompressobj(31).decompress(head, LOOK)
        except zlib.error:
            return "", True
    text = head.lstrip(b"\r\n ")
    if head[:4] == b"BAM\1":
        return "BAM", gzipped
    if text[:1] == b">":
        return "FASTA", gzipped
    if _SAM_HEADER.match(text) or re.match(rb"[!-~]+\t\d+\t[^\t]+\t\d+\t\d+\t(\*|(\d+[MIDNSHPX=])+)\t", text):
        return "SAM", gzipped
    return ("FASTQ" if text[:1] == b"@" else ""), gzipped


def inputs(spark: SparkSession, paths: Sequence[str]) -> list[Input]:
    """The read files among these files and folders."""
    out = []
    for path, size, _ in files_of(spark, paths):
        name = path.rsplit("/", 1)[-1]
        if not size or name[0] in "._" or re.search(r"\.(fai|bai|csi|gzi)$", name):
            continue
        kind, gzipped = kind_of(bam._bytes(spark, path, 0, LOOK))
        if not kind:
            raise ValueError(f"{path} is neither FASTA, FASTQ, SAM nor BAM")
        out.append(Input(path, kind, gzipped))
    if not out:
        raise ValueError(f"no reads in {', '.join(paths)}")
    return out


def _whole(batches: Iterator[pd.DataFrame], kind: str) -> Iterator[pd.DataFrame]:
    """Reads of whole files (content)."""
    for pdf in batches:
        for content in pdf["content"]:
            data = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
            rows = []
            if kind == "FASTA":
                for block in ("\n" + data.decode()).split("\n>")[1:]:
                    name, _, body = block.partition("\n")
                    seq = re.sub(r"\s", "", body).upper()
                    rows.append(("@" + name.strip(), seq, "I" * len(seq)))
            else:
                lines = data.decode().splitlines()
                rows = [(a, b, d) for a, b, d in zip(lines[::4], lines[1::4], lines[3::4], strict=False)]
            for low in range(0, len(rows), 10_000):
                yield pd.DataFrame(rows[low : low + 10_000], columns=["identifier", "sequence", "quality"])


def read(spark: SparkSession, found: Sequence[Input]) -> DataFrame:
    """read_ord, identifier, qname, sequence, quality of all the files."""
    bounded_batches(spark)
    parts = []
    for kind in ("FASTQ", "FASTA"):
        plain = [i.path for i in found if i.kind == kind and i.plain_reader]
        odd = [i.path for i in found if i.kind == kind and not i.plain_reader]
        if plain:
            parts.append(files.read_fastq(spark, plain) if kind == "FASTQ" else files.fasta_as_fastq(files.read_fasta(spark, plain)))
        if odd:
            rows = spark.read.format("binaryFile").load(odd).select("content").mapInPandas(lambda b, kind=kind: _whole(b, kind), "identifier string, sequence string, quality string")
            parts.append(rows.withColumn("qname", strings.qname(F.col("identifier"))))
    for i in found:
        if i.kind == "SAM" and not i.plain_reader:
            raise ValueError(f"{i.path}: a gzipped SAM file needs the suffix .gz, and only such a file")
        if i.kind in ("SAM", "BAM"):
            parts.append(bam.reads_of((bam.read_bam if i.kind == "BAM" else files.read_sam)(spark, i.path)[1]))
    out = parts[0].select(*_FIELDS)
    for p in parts[1:]:
        out = out.unionByName(p.select(*_FIELDS))
    return out.select(F.monotonically_increasing_id().alias("read_ord"), *_FIELDS)
