"""Inputs by content, kept tables, and batches: controls once, samples side by side."""

import gzip

import pytest
from pyspark.sql import functions as F

from ampliqua import cli, jobs, pipeline, runlog, store
from ampliqua.session import materialize
from ampliqua.sources import bam, files, genome, inputs, synthetic


def fastq(reads):
    return "".join(f"{i}\n{s}\n+\n{q}\n" for i, s, q in reads)


def test_folders_with_misnamed_files(spark, tmp_path):
    own = [(f"@r{k} x", "ACGT" * (k + 1), "I" * 4 * (k + 1)) for k in range(5)]
    text = fastq(own).encode()
    (tmp_path / "in" / "deep").mkdir(parents=True)
    at = tmp_path / "in"
    (at / "a.fastq").write_bytes(text)
    (at / "b.fastq").write_bytes(gzip.compress(text))
    (at / "c.fq.gz").write_bytes(gzip.compress(text))
    (at / "deep" / "d.gz").write_bytes(text)
    (at / "e.txt").write_bytes(b">r0\nACG\nT\n>r9\nTT\n")
    (at / "f.gz").write_bytes(b">r8\r\nACG\r\n")
    (at / "g.bam").write_bytes(b"\n".join([b"@SQ\tSN:control\tLN:9", b"s\t16\tcontrol\t1\t60\t2M\t*\t0\t0\tAC\tIJ"]))
    header = spark.createDataFrame([("@SQ\tSN:control\tLN:9",)], "value string")
    rows = spark.createDataFrame([("m", 0, "control", 1, 60, "2M", "AC", "IJ")], "qname string, flag int, rname string, pos int, mapq int, cigar string, seq string, qual string")
    bam.write_bam(header, rows, f"{at}/h.sam")
    for name in ("x.fai", ".hidden", "_SUCCESS"):
        (at / name).write_text("no reads")
    (at / "empty.fq").write_text("")
    found = inputs.inputs(spark, [str(at)])
    assert sorted((i.path.rsplit("/", 1)[1], i.kind, i.gzipped) for i in found) == [("a.fastq", "FASTQ", False), ("b.fastq", "FASTQ", True), ("c.fq.gz", "FASTQ", True), ("d.gz", "FASTQ", False), ("e.txt", "FASTA", False), ("f.gz", "FASTA", False), ("g.bam", "SAM", False), ("h.sam", "BAM", True)]
    got = sorted((r["qname"], r["sequence"], r["quality"]) for r in inputs.read(spark, found).collect())
    want = [(i[1:].split()[0], s, q) for i, s, q in own] * 4 + [("r0", "ACGT", "IIII"), ("r9", "TT", "II"), ("r8", "ACG", "III"), ("s", "GT", "JI"), ("m", "AC", "IJ")]
    assert got == sorted(want)
    (at / "other.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match=r"other\.csv"):
        inputs.inputs(spark, [str(at)])
    with pytest.raises(ValueError, match="no reads"):
        inputs.inputs(spark, [str(at / "empty.fq")])


def test_kept_tables(spark, tmp_path):
    made = []

    def build():
        made.append(1)
        return spark.range(5).withColumn("x", F.lit("a"))

    key = store.key_of("a", {"b": 1})
    assert key != store.key_of("a", {"b": 2})
    for _ in range(2):
        assert store.kept(spark, f"{tmp_path}/kept", "t", key, build).count() == 5
    assert len(made) == 1

    def broken():
        return spark.range(5).select(F.raise_error(F.lit("stopped")).alias("id"))

    with pytest.raises(Exception, match="stopped"):
        store.kept(spark, f"{tmp_path}/kept", "t", "other", broken).count()
    assert store.kept(spark, f"{tmp_path}/kept", "t", "other", build).count() == 5 and len(made) == 2
    (tmp_path / "f").write_text("abc")
    before = store.files_of(spark, [str(tmp_path / "f")])
    (tmp_path / "f").write_text("abcd")
    assert before != store.files_of(spark, [str(tmp_path / "f")]) and before[0][1] == 3


def test_tasks_side_by_side(spark):
    seen = {}

    def good(name):
        seen[name] = spark.sparkContext.getLocalProperty("spark.jobGroup.id"), spark.sparkContext.getLocalProperty("spark.scheduler.pool")
        spark.range(100).count()
        assert spark.sparkContext.statusTracker().getJobIdsForGroup(name)

    def bad():
        spark.range(10).select(F.raise_error(F.lit("broken sample"))).collect()

    errors = jobs.side_by_side(spark, [("one", lambda: good("one")), ("two", bad), ("three", lambda: good("three"))], 2)
    assert errors[0] == errors[2] == "" and "broken sample" in errors[1]
    assert seen == {"one": ("one", "one"), "three": ("three", "three")}
    assert jobs.side_by_side(spark, []) == []


def test_a_batch_aligns_its_control_once(spark, tmp_path, monkeypatch):
    c = synthetic.control_sequence(160)
    sub = synthetic.substituted(c, 80)
    write = lambda name, df: (tmp_path / name).write_text(fastq([(r["identifier"], r["sequence"], r["quality"]) for r in df.collect()]))
    write("control.fq", synthetic.reads(spark, [(c, 1.0)], 30, 3, 0.002))
    for k in range(2):
        write(f"s{k}.fq", synthetic.reads(spark, [(c, 0.5), (sub, 0.5)], 30, k, 0.002))
    (tmp_path / "a.fa").write_text(f">control\n{c}\n")
    lines = [f"{tmp_path}/{s},{tmp_path}/control.fq,{tmp_path}/a.fa,run" for s in ("s0.fq", "s1.fq", "none.fq")]
    (tmp_path / "m.csv").write_text("sample,control,allele,name\n" + "\n".join(lines) + "\n")
    calls = []
    real = pipeline.control_tokens
    monkeypatch.setattr(cli, "control_tokens", lambda *a: calls.append(a) or real(*a))
    status = {r["sample"]: r["status"] for r in cli.run_batch(spark, f"{tmp_path}/m.csv", f"{tmp_path}/out", workers=3).collect()}
    assert sorted(status.values()) == ["done", "done", "failed"] and len(calls) == 1
    made = [n for n in status if status[n] == "done"]
    assert all(bam.read_bam(spark, f"{tmp_path}/out/{n}/bam/all.bam")[1].count() == 30 for n in made)
    (tmp_path / "one.csv").write_text("sample,control,allele,name\n" + lines[0] + "\n")
    again = cli.run_batch(spark, f"{tmp_path}/one.csv", f"{tmp_path}/again", cache=f"{tmp_path}/out/cache").collect()
    assert [r["status"] for r in again] == ["done"] and len(calls) == 1
    assert files.read_manifest(spark, f"{tmp_path}/m.csv").count() == 3
    log = spark.read.json(f"{tmp_path}/out/{made[0]}/log").collect()
    assert {r["stage"]: r["rows"] for r in log}["genome"] == 30 and all(r["seconds"] > 0 for r in log)


def turn(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def test_places_in_a_genome(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(genome, "CHUNK", 3000)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        repeat = synthetic.control_sequence(2500, 50)
        one, two = synthetic.control_sequence(60_000, 51), synthetic.control_sequence(30_000, 52)
        chroms = {"chr1": one[:20_000] + repeat + one[20_000:] + "N" * 500, "chr2": two[:9000] + turn(repeat) + two[9000:].lower(), "chrM": synthetic.control_sequence(300, 53)}
        with open(tmp_path / "g.fa", "w") as f:
            for name, seq in chroms.items():
                f.write(f">{name} some words\n" + "\n".join(seq[k : k + 70] for k in range(0, len(seq), 70)) + "\n")
        genome.write_index(spark, f"{tmp_path}/g.fa", f"{tmp_path}/index")
        assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/index/sizes").collect()} == {(n, len(s)) for n, s in chroms.items()}
        upper = {n: s.upper() for n, s in chroms.items()}
        seeds = spark.read.parquet(f"{tmp_path}/index/seeds")
        assert seeds.groupBy("chrom").count().count() == 3 and seeds.select("chrom", "pos").distinct().count() == seeds.count()
        rows = [("plus", upper["chr1"][5000:8000]), ("minus", turn(upper["chr2"][15_000:17_500])), ("edited", upper["chr1"][40_000:41_000] + upper["chr1"][41_040:42_500]), ("over", upper["chr1"][19_000:23_500]), ("repeat", repeat), ("none", synthetic.control_sequence(800, 99)), ("short", "ACGT"), ("null", None)]
        got = {}
        for r in genome.locate(spark, f"{tmp_path}/index", spark.createDataFrame(rows, "name string, sequence string"), 0.6).collect():
            got.setdefault(r["name"], set()).add((r["chrom"], r["start"], r["end"], r["strand"]))

        def brute(seq):
            return {(n, s.find(x), s.find(x) + len(x), strand) for n, s in upper.items() for strand, x in (("+", seq), ("-", turn(seq))) if x in s}

        assert all(got[n] == brute(s) for n, s in rows if n in ("plus", "minus", "over", "repeat")) and len(got["repeat"]) == 2
        assert got["edited"] == {("chr1", 40_000, 42_500, "+")} and not {"none", "short", "null"} & set(got)
        where = genome.coordinates(spark, f"{tmp_path}/index", rows[1][1], "mm")
        assert (where.chrom, where.start, where.end, where.strand, where.chrom_size) == ("chr2", 15_000, 17_500, "-", 32_500)
        for bad in (repeat, rows[5][1]):
            with pytest.raises(ValueError):
                genome.coordinates(spark, f"{tmp_path}/index", bad)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_log_of_a_run_costs_no_job(spark):
    def jobs_of(group, log):
        spark.sparkContext.setJobGroup(group, group)
        df = spark.range(7).filter("id <> 3")
        if log:
            with runlog.recording() as inner:
                materialize(df, "stage one")
                materialize(df.limit(0), "none")
            rows = inner.rows
        else:
            materialize(df, "stage one")
            materialize(df.limit(0), "none")
            rows = []
        n = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return n, rows

    plain, _ = jobs_of("plain", False)
    logged, rows = jobs_of("logged", True)
    assert plain == logged and [r[:2] for r in rows] == [("stage one", 6), ("none", 0)]


def test_minimisers_of_many_sequences_come_together():
    import numpy as np
    import pyarrow as pa

    from ampliqua.align.mapper import minimisers

    sequences = [synthetic.control_sequence(n, n) if n else None for n in (300, 0, 14, 15, 17, 18, 19, 40, 301)] + ["ACGT" * 5 + "N" * 9 + "ACGTTGCA" * 4] * 2
    batch = pa.RecordBatch.from_arrays([pa.array([f"s{k}" for k in range(len(sequences))]), pa.array(sequences, pa.string())], names=["name", "sequence"])
    found = list(genome._wanted([batch]))
    assert len(found) == 2  # a strand each
    for part, strand in zip(found, "+-", strict=True):
        got = {}
        for name, n, q, h in zip(*(part.column(c).to_pylist() for c in ("name", "length", "q", "hash")), strict=True):
            got.setdefault(name, []).append((n, q, h))
        for k, s in enumerate(sequences):
            s = s or ""
            h, at = minimisers(np.frombuffer((s if strand == "+" else turn(s)).encode(), np.uint8))
            assert got.get(f"s{k}", []) == [(len(s), int(a), int(x)) for a, x in zip(at, h.view(np.int64), strict=True)]


def test_customers_are_numbered_by_ranges(spark):
    from ampliqua.plans import runs

    keys = [(k % 3, (k * 7919) % 1009) for k in range(600)]
    numbered, sizes = runs._numbered(spark.createDataFrame(keys, "n_regionkey int, c_custkey long"))
    want = {(r, c, k) for g in range(3) for k, (r, c) in enumerate(sorted(x for x in keys if x[0] == g))}
    assert {tuple(r) for r in numbered.collect()} == want and {tuple(r) for r in sizes.collect()} == {(g, 200) for g in range(3)}
