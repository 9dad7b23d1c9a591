"""Where a sequence lies in a genome: an index of the genome's minimisers, and a vote of diagonals by a join.

The FASTA file is read in splits; a task counts bases within its split, and the places of splits in chromosomes are sums over
splits. The index has a row a minimiser, in folders by hash, sorted within, so that a search reads it once for any number
of sequences. A sequence's minimisers, of both strands, are joined to it; hits on about one diagonal vote for a place.

Defined results: a name's first word is the chromosome; letters other than A, C, G, T are in no hit; a sequence without any
place, or with two equally good ones, is an error where one place is asked for; short sequences of fewer than 19 bases have
no hit; repeated sequences are found each.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ampliqua.align.mapper import _TURN, K, W, minimisers, minimisers_of
from ampliqua.schemas import GenomeCoordinates
from ampliqua.session import bounded_batches, materialize

#: Folders of the index; bases that a task looks at together; bases by which diagonals of one place may differ.
BUCKETS, CHUNK, SLACK = 64, 1 << 20, 512
#: Share of the best place's votes from which another place is equally good.
ALIKE = 0.95
#: Minimisers of the sequences sought that are broadcast at most; more are joined by shuffles.
BROADCAST = 2_000_000
_KINDS = "file string, start long, seg int, name string, at long, hash long"


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Minimisers by split and segment (what lies between two names), and a row with the length of each segment."""
    names = ["file", "start", "seg", "name", "at", "hash"]
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64()]

    def rows(file: str, start: int, seg: int, name: str | None, at: np.ndarray, h: np.ndarray | None) -> pa.RecordBatch:
        n = len(at)
        same = [pa.repeat(pa.scalar(v, t), n) for v, t in zip((file, start, seg, name), kinds, strict=False)]
        return pa.RecordBatch.from_arrays([*same, pa.array(at, pa.int64()), pa.nulls(n, pa.int64()) if h is None else pa.array(h.view(np.int64))], names=names)

    here, seg, name = None, 0, None
    text, done, last = bytearray(), 0, -1  # bases that are not all looked at yet, those before them, and the last place told

    def look(final: bool) -> Iterator[pa.RecordBatch]:
        nonlocal done, last
        if len(text) >= K:
            h, at = minimisers(np.frombuffer(bytes(text).upper(), np.uint8))
            new = at + done > last  # places rise; what is looked at twice may tell the last one again
            if new.any():
                yield rows(*here, seg, None, at[new] + done, h[new])
                last = int(at[-1]) + done
        keep = 0 if final else min(len(text), K + W - 2)
        done += len(text) - keep
        del text[: len(text) - keep]
        if final:
            yield rows(*here, seg, name or "", np.array([done]), None)

    for batch in batches:
        for file, start, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (file, start) != here:
                if here is not None:
                    yield from look(True)
                here, seg, name, done, last = (file, start), 0, None, 0, -1
            if line.startswith(">"):
                yield from look(True)
                seg, name, done, last = seg + 1, (line[1:].split() or [""])[0], 0, -1
                continue
            text += line.strip().encode("latin-1", "replace")
            if len(text) >= CHUNK:
                yield from look(False)
    if here is not None:
        yield from look(True)


def write_index(spark: SparkSession, fasta: str, path: str) -> None:
    """path/seeds (bucket, hash, chrom, pos from 0) and path/sizes (chrom, size)."""
    bounded_batches(spark)
    lines = spark.read.text(fasta).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
    made = materialize(lines.mapInArrow(_seeds, _KINDS), "seeds")
    places, size, last = [], {}, None  # a row a split and a chromosome
    for r in made.filter("hash is null").orderBy("file", "start", "seg").collect():
        if r["seg"]:
            last = (r["file"], r["name"])
            size[last] = 0
        elif last is None or last[0] != r["file"]:
            if r["at"]:
                raise ValueError(f"{r['file']} has bases before the first name")
            continue
        places.append((r["file"], r["start"], r["seg"], last[1], size[last]))
        size[last] += r["at"]
    where = spark.createDataFrame(places, "file string, start long, seg int, chrom string, base long")
    seeds = made.filter("hash is not null").join(F.broadcast(where), ["file", "start", "seg"])
    rows = seeds.select(F.pmod("hash", F.lit(BUCKETS)).cast("int").alias("bucket"), "hash", "chrom", (F.col("base") + F.col("at")).alias("pos"))
    rows.repartition("bucket").sortWithinPartitions("bucket", "hash").write.partitionBy("bucket").parquet(f"{path}/seeds")
    spark.createDataFrame([(n, s) for (_, n), s in size.items()], "chrom string, size long").coalesce(1).write.parquet(f"{path}/sizes")


def _wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Minimisers of sequences and of their other strands, those of many sequences together."""
    for batch in batches:
        names, raws = batch.column(0), [(s or "").upper().encode() for s in batch.column(1).to_pylist()]
        low = 0
        while low < len(raws):
            high, bases = low, 0
            while high < len(raws) and (high == low or bases + len(raws[high]) <= CHUNK):
                bases += len(raws[high])
                high += 1
            for strand in "+-":
                part = [np.frombuffer(r if strand == "+" else r[::-1].translate(_TURN), np.uint8) for r in raws[low:high]]
                h, at, number = minimisers_of(part)
                length = np.array([len(p) for p in part], np.int64)[number] if len(number) else number
                yield pa.RecordBatch.from_arrays([names.take(pa.array(number + low)), pa.repeat(pa.scalar(strand), len(at)), pa.array(length), pa.array(at), pa.array(h.view(np.int64))], names=["name", "strand", "length", "q", "hash"])
            low = high


def locate(spark: SparkSession, index: str, sequences: DataFrame, least: float = 0.1) -> DataFrame:
    """name, chrom, start (from 0), end, strand, votes, size of every place that at least this share of a sequence's minimisers votes for.

    sequences: name, sequence. Diagonals that differ by up to SLACK are one place, so indels of a sequence don't split it.
    """
    bounded_batches(spark)
    want = sequences.select(F.col("name").cast("string").alias("name"), F.col("sequence").cast("string").alias("sequence")).mapInArrow(_wanted, "name string, strand string, length long, q long, hash long").withColumn("bucket", F.pmod("hash", F.lit(BUCKETS)).cast("int"))
    want = materialize(want, "wanted-seeds")
    few = want.count() <= BROADCAST
    hits = spark.read.parquet(f"{index}/seeds").join(F.broadcast(want) if few else want, ["bucket", "hash"]).withColumn("d", F.col("pos") - F.col("q"))
    # neighbours on the diagonals of a strand: a new place begins after a step of more than SLACK
    diagonals = hits.groupBy("name", "length", "strand", "chrom", "d").agg(F.collect_set("q").alias("qs"), F.min("q").alias("low"), F.max("q").alias("high"))
    order = Window.partitionBy("name", "strand", "chrom").orderBy("d")
    step = (F.col("d") - F.lag("d").over(order) > SLACK).cast("int")
    placed = diagonals.withColumn("place", F.sum(F.coalesce(step, F.lit(0))).over(order))
    votes = placed.groupBy("name", "length", "strand", "chrom", "place").agg(F.size(F.array_distinct(F.flatten(F.collect_list("qs")))).alias("votes"), F.min_by("d", "low").alias("first"), F.max_by("d", "high").alias("last"))
    total = want.groupBy("name", "strand").agg(F.count_distinct("q").alias("n"))
    found = votes.join(F.broadcast(total) if few else total, ["name", "strand"]).filter(F.col("votes") >= least * F.col("n"))
    sizes = spark.read.parquet(f"{index}/sizes")
    return found.join(F.broadcast(sizes), "chrom").select("name", "chrom", F.greatest(F.lit(0), "first").alias("start"), F.least("size", F.col("last") + F.col("length")).alias("end"), "strand", "votes", "size")


def coordinates(spark: SparkSession, index: str, sequence: str, genome: str = "") -> GenomeCoordinates:
    """The one best place of a sequence."""
    found: Sequence = locate(spark, index, spark.createDataFrame([("x", sequence)], "name string, sequence string")).orderBy(F.desc("votes")).limit(2).collect()
    if not found:
        raise ValueError("the sequence isn't in the genome")
    if len(found) > 1 and found[1]["votes"] >= ALIKE * found[0]["votes"]:  # at borders of splits some votes are missing
        raise ValueError("the sequence has several equally good places in the genome")
    r = found[0]
    return GenomeCoordinates(genome or "genome", r["chrom"], r["start"], r["end"], r["strand"], r["size"])
