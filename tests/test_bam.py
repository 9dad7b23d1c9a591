"""BAM files: round trips over many splits, records over borders, failed writes, the index, and files of other writers."""

import os
import random
import re
import struct

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ampliqua.schemas import ALIGNMENTS
from ampliqua.sources import bam, files

REFS = [("control", 5000), ("chr2", 400_000)]
HEADER = ["@SQ\tSN:control\tLN:5000", "@SQ\tSN:chr2\tLN:400000", "@PG\tID:x"]


def made(n, seed=1):
    rng, out = random.Random(seed), []
    for k in range(n):
        m = rng.choice((0, 1, 7, 150, 300))
        seq = "".join(rng.choices("ACGTN", k=m)) or "*"
        ref, size = rng.choice([*REFS, ("*", 0)])
        pos = rng.randint(1, size) if size else 0
        cigar = f"{m}M" if size and m else "*"
        if m > 20 and size:
            cigar = f"5S{m - 12}M3D4I3M"
        out.append((f"read{k}/{rng.randint(0, 9)}", rng.choice((0, 16, 2048, 4)), ref, pos, rng.randint(0, 60), cigar, rng.choice(("*", "=", "control" if ref == "chr2" else "chr2")) if size else "*", rng.randint(0, 5000), rng.randint(-900, 900), seq, "".join(chr(rng.randint(33, 90)) for _ in range(m)) if m and rng.random() < 0.7 else "*", "=ACGT*ag" if rng.random() < 0.5 else ""))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, ALIGNMENTS)


def head(spark):
    return spark.createDataFrame([(x,) for x in HEADER], "value string")


def rows_of(df):
    return sorted(tuple(r) for r in df.select(*[f.name for f in ALIGNMENTS]).collect())


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "200k", "spark.sql.files.openCostInBytes": "1k"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k in keys:
        spark.conf.unset(k)


def test_round_trip_over_many_splits(spark, tmp_path, small_splits):
    rows = made(20_000)
    path = f"{tmp_path}/a.bam"
    bam.write_bam(head(spark), frame(spark, rows).withColumn("extra", F.lit(1)).repartition(5), path, 3)
    header, body = bam.read_bam(spark, path)
    assert [r["value"] for r in header.collect()] == ["@HD\tVN:1.6\tSO:coordinate", *HEADER]
    assert body.rdd.getNumPartitions() > 5 and rows_of(body) == sorted(rows)
    assert [f for f in os.listdir(tmp_path) if not f.startswith(".")] == ["a.bam"]
    data = b"".join(bam.inflated(x) for x in open(path, "rb").read().split(bam.START)[1:])
    at, order = bam.header_of(data)[2], []
    while at < len(data):
        r = bam.decoded(data, at, [n for n, _ in REFS])
        order.append(({"control": 0, "chr2": 1}.get(r[2], 2), r[3]))
        at += 4 + struct.unpack_from("<i", data, at)[0]
    assert order == sorted(order) and len(order) == len(rows)
    files.write_sam(head(spark), body, f"{tmp_path}/sam")
    assert rows_of(files.read_sam(spark, f"{tmp_path}/sam")[1].withColumn("cs", F.lit(""))) == sorted((*r[:11], "") for r in rows)


def foreign(path, rows, block):
    """A file as other writers make it: records run over the borders of blocks."""
    data = bam.header_bytes("\n".join(HEADER) + "\n", REFS) + b"".join(bam.encoded(r, {n: k for k, (n, _) in enumerate(REFS)}) for r in rows)
    with open(path, "wb") as f:
        f.write(b"".join(bam.deflated(data[k : k + block]) for k in range(0, len(data), block)) + bam.deflated(b""))


@pytest.mark.parametrize("block", [30_011, 700])
def test_records_over_borders_of_blocks_and_splits(spark, tmp_path, small_splits, block):
    rows = made(6000, 3) + [("long", 0, "control", 1, 60, "400000M", "*", 0, 0, "ACGTN" * 80_000, "*", "")] + made(3000, 4)
    path = f"{tmp_path}/b.bam"
    foreign(path, rows, block)
    assert rows_of(bam.read_bam(spark, path)[1]) == sorted(rows)


def test_damaged_files_are_told(spark, tmp_path, small_splits):
    rows, path = made(5000, 5), f"{tmp_path}/c.bam"
    foreign(path, rows, 20_000)
    data = open(path, "rb").read()
    for name, broken in (("cut", data[: len(data) // 2]), ("changed", data[:100_000] + bytes([data[100_000] ^ 1]) + data[100_001:]), ("none", b"no such thing")):
        with open(f"{tmp_path}/{name}.bam", "wb") as f:
            f.write(broken)
        with pytest.raises((PySparkException, ValueError)):
            bam.read_bam(spark, f"{tmp_path}/{name}.bam")[1].count()


def test_a_failed_write_leaves_what_was_there(spark, tmp_path):
    path = f"{tmp_path}/d.bam"
    bam.write_bam(head(spark), frame(spark, made(50)), path)
    before = open(path, "rb").read()
    bad = frame(spark, made(500, 2) + [("x", 0, "chr9", 1, 0, "1M", "*", 0, 0, "A", "*", "")])
    with pytest.raises(PySparkException, match="chr9 is not in the header"):
        bam.write_bam(head(spark), bad, path)
    assert open(path, "rb").read() == before and [f for f in os.listdir(tmp_path) if not f.startswith(".")] == ["d.bam"]


def test_empty_null_and_huge_records(spark, tmp_path):
    path = f"{tmp_path}/e.bam"
    bam.write_bam(head(spark), frame(spark, []), path)
    assert bam.read_bam(spark, path)[1].count() == 0 and bam.read_header(spark, path)[1] == REFS
    cigar = "1M1I" * 40_000
    rows = [(None,) * 12, ("many", 0, "control", 1, 60, cigar, "*", 0, 0, "AC" * 40_000, "*", ""), ("twice", 0, "control", 2, 1, "2M", "*", 0, 0, "AC", "II", "=AC"), ("twice", 0, "control", 2, 1, "2M", "*", 0, 0, "AC", "II", "=AC")]
    bam.write_bam(head(spark), frame(spark, rows), path)
    assert rows_of(bam.read_bam(spark, path)[1]) == sorted([("*", 0, "*", 0, 0, "*", "*", 0, 0, "*", "*", ""), *rows[1:]])


@pytest.mark.parametrize("own", [True, False])
def test_index_and_interval(spark, tmp_path, small_splits, own):
    rows, path = [r for r in made(20_000, 7)], f"{tmp_path}/f.bam"
    if own:
        bam.write_bam(head(spark), frame(spark, rows), path, 3)
    else:
        rows = sorted(rows, key=lambda r: (["control", "chr2", "*"].index(r[2]), r[3]))
        foreign(path, rows, 20_011)
    bam.write_index(spark, path)
    total = bam._blocks(spark, path).count()
    length = {r[:6]: sum(int(n) for n, op in re.findall(r"(\d+)([MDN])", r[5])) for r in rows}
    for ref, a, b in (("chr2", 100_000, 101_000), ("control", 1, 50), ("chr2", 399_990, 400_000), ("chr2", 16_384, 16_385)):
        got, opened = bam.read_interval(spark, path, ref, a, b)
        want = [r for r in rows if r[2] == ref and r[3] <= b and r[3] + max(1, length[r[:6]]) > a]
        assert rows_of(got) == sorted(want)
        # the finest bins have 16,384 bases: all of control is one of them; records over their borders are in wider ones
        assert 0 < opened < (total / 3 if ref == "chr2" else total / 2)
    assert struct.unpack_from("<i", open(f"{path}.bai", "rb").read(), 4)[0] == 2


def test_reads_of_alignments(spark):
    rows = [("a", 16, "control", 1, 60, "2M", "*", 0, 0, "AC", "IJ", ""), ("a", 2064, "control", 9, 60, "2M", "*", 0, 0, "AC", "IJ", ""), ("b", 4, "*", 0, 0, "*", "*", 0, 0, "GG", "*", ""), ("c", 0, "control", 1, 60, "2M", "*", 0, 0, "*", "*", "")]
    got = {(r["qname"], r["sequence"], r["quality"]) for r in bam.reads_of(frame(spark, rows)).collect()}
    assert got == {("a", "GT", "JI"), ("b", "GG", "II")}
