"""Readers and writers: FASTA, FASTQ, SAM, BED6, token tables, batch manifests; plain or gzip.

Everything is read by Spark's text reader, so any store that Spark reads will do; gzip is told by the suffix there. A text
file's records of several lines are cut by a line separator that only stands before a record.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ampliqua.functions import strings
from ampliqua.schemas import ALIGNMENTS, BED, MANIFEST_OPTIONAL, MANIFEST_REQUIRED, TOKENS


class BedError(ValueError):
    """A BED file that can't be used."""


def read_fasta(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """ord, name (sanitised), sequence (upper-case), of wrapped or single lines; ord follows the file."""
    one = spark.read.option("lineSep", "\n>").text(paths if isinstance(paths, str) else list(paths))
    rows = one.withColumn("value", F.regexp_replace("value", "^>", "")).filter(F.trim("value") != "").withColumn("ord", F.monotonically_increasing_id())
    head = F.regexp_extract("value", r"^([^\r\n]*)", 1)
    return rows.select("ord", strings.sanitize(F.split(F.trim(head), r"\s+")[0]).alias("name"), F.upper(F.regexp_replace(F.regexp_replace("value", r"^[^\r\n]*", ""), r"\s", "")).alias("sequence"))


def alleles(spark: SparkSession, path: str) -> DataFrame:
    """allele_ord, allele, allele_key, sequence; an error unless names differ and one is `control`."""
    rows = read_fasta(spark, path)
    found = rows.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("name").alias("names"), F.count_if(F.col("name") == "control").alias("control"), F.count_if(F.col("sequence") == "").alias("empty")).first()
    if not found["n"] or found["n"] != found["names"] or not found["control"] or found["empty"]:
        raise ValueError("an allele file needs different names, one of them 'control', and a sequence for each")
    return rows.select(F.col("ord").cast("int").alias("allele_ord"), F.col("name").alias("allele"), strings.allele_key(F.col("name")).alias("allele_key"), "sequence")


def read_fastq(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """read_ord, identifier, qname, sequence, quality of four-line records; large plain files are split among tasks.

    Files are cut before each line that begins with '@'. That may be a quality line: the piece before it then lacks its
    fourth line and takes this one, also where the two lie in neighbouring blocks of a file.
    """
    raw = spark.read.option("lineSep", "\n@").text(paths if isinstance(paths, str) else list(paths))
    raw = raw.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_block_length").alias("length"))
    pieces = raw.mapInPandas(_records, "kind string, file string, at long, identifier string, sequence string, quality string")
    tails, heads = pieces.filter("kind = 'tail'"), pieces.filter("kind = 'head'").select("file", "at", F.col("quality").alias("_q"))
    joined = tails.join(heads, ["file", "at"]).withColumn("quality", F.col("_q"))
    fields = ["identifier", "sequence", "quality"]
    rows = pieces.filter("kind = 'whole'").select(*fields).union(joined.select(*fields))
    return rows.select(F.monotonically_increasing_id().alias("read_ord"), "identifier", strings.qname(F.col("identifier")).alias("qname"), "sequence", "quality")


def _records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole records, and pieces at a block's ends (at: where the block begins or ends)."""
    names = ["kind", "file", "at", "identifier", "sequence", "quality"]
    block, open_ = None, None
    for pdf in batches:
        out = []
        for value, *here in zip(pdf["value"], pdf["file"], pdf["start"], pdf["length"], strict=True):
            if here != block:
                if open_:
                    out.append(("tail", block[0], block[1] + block[2], *open_, ""))
                block, open_, first = here, None, True
            value = value.removeprefix("@") if first and not here[1] else value  # the others' '@' went with the separator
            lines = [x.rstrip("\r") for x in value.rstrip("\n").split("\n")]
            if open_:
                out.append(("whole", here[0], 0, *open_, "@" + lines[0]))
                open_ = None
            elif len(lines) >= 4:
                out.append(("whole", here[0], 0, "@" + lines[0], lines[1], lines[3]))
            elif len(lines) == 3:
                open_ = ("@" + lines[0], lines[1])
            elif first and lines[0]:
                out.append(("head", here[0], here[1], "", "", "@" + lines[0]))
            first = False
        yield pd.DataFrame(out, columns=names)
    if open_:
        yield pd.DataFrame([("tail", block[0], block[1] + block[2], *open_, "")], columns=names)


def fasta_as_fastq(fasta: DataFrame, quality: str = "I") -> DataFrame:
    return fasta.select(F.col("ord").alias("read_ord"), F.concat(F.lit("@"), "name").alias("identifier"), F.col("name").alias("qname"), "sequence", F.repeat(F.lit(quality), F.length("sequence")).alias("quality"))


def detect_format(spark: SparkSession, path: str) -> str:
    """FASTA or FASTQ by its first lines."""
    head = [r["value"] for r in spark.read.text(path).limit(3).collect()]
    if head and head[0].startswith(">"):
        return "FASTA"
    if len(head) == 3 and head[0].startswith("@") and head[2].startswith("+"):
        return "FASTQ"
    raise ValueError(f"{path} is neither FASTA nor FASTQ")


def read_reads(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Reads of several files, FASTA ones with made-up qualities."""
    kinds = {p: detect_format(spark, p) for p in paths}
    parts = [read_fastq(spark, p) if kinds[p] == "FASTQ" else fasta_as_fastq(read_fasta(spark, p)) for p in paths]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def validate_reads(reads: DataFrame, first: int = 100) -> None:
    """An error unless the first reads all have a name, a sequence and a quality."""
    bad = reads.limit(first).filter((F.coalesce("qname", F.lit("")) == "") | (F.coalesce("sequence", F.lit("")) == "") | (F.length("sequence") != F.length("quality"))).count()
    if bad or not reads.limit(1).count():
        raise ValueError("reads without names, sequences or qualities")


def downsample(reads: DataFrame, most: int, factor: int = 1, seed: int = 1) -> DataFrame:
    """Reads of so many names, those with the least hash; nothing goes while there are no more than factor times as many reads."""
    if reads.limit(most * factor + 1).count() <= most * factor:
        return reads
    few = reads.select("qname").distinct().orderBy(F.xxhash64("qname", F.lit(seed)), "qname").limit(most)  # names alone are ranked
    return reads.join(few, "qname", "left_semi").select(*reads.columns)


def read_sam(spark: SparkSession, paths: str | Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Header lines (value), and alignments; the cs tag is the field that begins with `cs:Z:`."""
    lines = spark.read.text(paths if isinstance(paths, str) else list(paths)).filter(F.trim("value") != "")
    f = F.split("value", "\t")
    cs = F.regexp_extract("value", r"\tcs:Z:([^\t]*)", 1)
    body = lines.filter(~F.col("value").startswith("@")).select(*(f[k].cast(ALIGNMENTS.fields[k].dataType).alias(ALIGNMENTS.fields[k].name) for k in range(11)), cs.alias("cs"))
    return lines.filter(F.col("value").startswith("@")), body


def mapped(alignments: DataFrame) -> DataFrame:
    return alignments.filter(F.col("seq") != "*")


def primary(alignments: DataFrame) -> DataFrame:
    """Without supplementary alignments."""
    return alignments.filter(F.col("flag").bitwiseAND(F.lit(2048)) == 0)


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """Checked BED6 intervals in the file's order; the fifth column is the chromosome's size. Comments and track lines are skipped."""
    lines = spark.read.text(path).withColumn("ord", F.monotonically_increasing_id()).withColumn("value", F.trim("value"))
    lines = lines.filter((F.col("value") != "") & ~F.col("value").startswith("#") & ~F.col("value").startswith("track"))
    f = F.split("value", "\t")
    rows = lines.select("ord", F.size(f).alias("n"), *(F.get(f, F.lit(k)).try_cast(t.dataType).alias(t.name) for k, t in enumerate(BED)))
    bad = rows.filter("n <> 6 or start is null or end is null or chrom_size is null or start < 0 or end <= start or chrom_size <= 0 or strand not in ('+', '-')").limit(1).collect()
    if bad or not rows.limit(1).count():
        raise BedError(f"{path}: six tab-separated columns are needed: chrom, start, end, name, chromosome size, strand")
    return rows.orderBy("ord").drop("ord", "n")


def bed_coordinates(spark: SparkSession, path: str, genome: str = ""):
    """The first interval."""
    from ampliqua.schemas import GenomeCoordinates

    r = read_bed(spark, path).first()
    return GenomeCoordinates(genome or r["name"], r["chrom"], r["start"], r["end"], r["strand"], r["chrom_size"])


def chromosome_size(spark: SparkSession, path: str, chrom: str) -> int:
    """From a two-column table of sizes."""
    row = spark.read.schema("chrom string, size long").option("sep", "\t").csv(path).filter(F.col("chrom") == chrom).first()
    if row is None:
        raise ValueError(f"{chrom} isn't in {path}")
    return row["size"]


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Batch rows, all strings, trimmed; rows with an empty required cell go; unknown columns are ignored."""
    raw = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    raw = raw.toDF(*[c.replace("﻿", "").strip() for c in raw.columns])
    if missing := [c for c in MANIFEST_REQUIRED if c not in raw.columns]:
        raise ValueError(f"{path} lacks the columns {', '.join(missing)}")
    named = [c for c in (*MANIFEST_REQUIRED, *MANIFEST_OPTIONAL) if c in raw.columns]
    rows = raw.select(*(F.nullif(F.trim(c), F.lit("")).alias(c) for c in named)).na.drop(subset=list(MANIFEST_REQUIRED)).dropDuplicates()
    if several := rows.groupBy("name").agg(F.countDistinct("allele").alias("n")).filter("n > 1").limit(1).collect():
        raise ValueError(f"{several[0]['name']}: one allele file is needed for each name")
    return rows


def manifest_tasks(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What runs first (controls) and then (samples that are no control of their own), each once; BED wins over genome."""
    extra = [c for c in MANIFEST_OPTIONAL if c in rows.columns]
    if "bed" in extra and "genome" in extra:
        rows = rows.withColumn("genome", F.when(F.col("bed").isNull(), F.col("genome")))
    controls = rows.select("name", F.col("control").alias("sample"), "control", "allele", *extra).distinct()
    return controls, rows.filter("sample <> control").select("name", "sample", "control", "allele", *extra).distinct()


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Token rows of JSON lines (QNAME, RNAME, MIDSV, STRAND, PRESET)."""
    raw = spark.read.schema("QNAME string, RNAME string, MIDSV string, STRAND string, PRESET string").json(path)
    cols = [F.lit(None).cast("string").alias("sample"), F.col("RNAME").alias("allele"), F.monotonically_increasing_id().alias("read_ord"), F.col("QNAME").alias("qname"), F.col("STRAND").alias("strand"), F.col("PRESET").alias("preset"), F.split("MIDSV", ",").alias("tokens")]
    return raw.select(*cols).to(T.StructType([T.StructField(f.name, f.dataType) for f in TOKENS]))


def write_fastq(reads: DataFrame, path: str, gzip: bool = True) -> None:
    reads.select(strings.fastq_record(F.col("identifier"), F.col("sequence"), F.col("quality")).alias("value")).write.option("compression", "gzip" if gzip else "none").text(path)


def write_fasta(rows: DataFrame, path: str, name: str = "name") -> None:
    """A folder for each sequence (key=...), named by the hash of its name."""
    rows.select(strings.allele_key(F.col(name)).alias("key"), strings.wrap(F.col(name), F.col("sequence")).alias("value")).write.partitionBy("key").text(path)


def write_sam(header: DataFrame, alignments: DataFrame, path: str) -> None:
    """SAM text sorted over all parts, the header in the first: the parts in the order of their names are the file."""
    fields = [f.name for f in ALIGNMENTS][:11]
    body = alignments.select(F.lit(1).alias("k"), "rname", "pos", F.concat_ws("\t", *(F.col(c).cast("string") for c in fields)).alias("value"))
    head = header.select(F.lit(0).alias("k"), F.lit("").alias("rname"), F.lit(0).alias("pos"), "value").distinct()
    head.union(body).orderBy("k", "rname", "pos").select("value").write.text(path)
