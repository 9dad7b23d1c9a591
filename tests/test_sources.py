"""Readers, writers and the end-to-end run on synthetic reads."""

import gzip

import pytest
from pyspark.sql import functions as F

from ampliqua.cli import export, run_batch, summarise
from ampliqua.functions.strings import safe_name
from ampliqua.pipeline import allele_table, genotype, knockin_positions
from ampliqua.report import summary, vcf
from ampliqua.schemas import RunConfig
from ampliqua.sources import bam, files, synthetic
from ampliqua.streaming import ingest


def test_fasta_and_fastq(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">control some text\nacgt\nACG\n>flox\nTTTT\n")
    a = files.alleles(spark, f"{tmp_path}/a.fa").orderBy("allele_ord").collect()
    assert [(r["allele"], r["sequence"]) for r in a] == [("control", "ACGTACG"), ("flox", "TTTT")]
    (tmp_path / "b.fa").write_text(">x\nACGT\n")
    with pytest.raises(ValueError):
        files.alleles(spark, f"{tmp_path}/b.fa")
    with gzip.open(tmp_path / "r.fq.gz", "wt") as f:
        f.write("@r1 x=1\nACGT\n+\n@III\n@r2\nAC\n+\nII\n")
    r = files.read_fastq(spark, f"{tmp_path}/r.fq.gz").orderBy("read_ord").collect()
    assert [(x["qname"], x["sequence"], x["quality"]) for x in r] == [("r1", "ACGT", "@III"), ("r2", "AC", "II")]
    big = "".join(f"@r{k}\n{'ACGT' * 5}\n+\n{'@' if k % 3 else 'I'}{'I' * 19}\n" for k in range(4000))
    (tmp_path / "big.fq").write_text(big)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    big_rows = files.read_fastq(spark, f"{tmp_path}/big.fq")
    assert big_rows.select("qname").distinct().count() == big_rows.filter("length(quality) = 20 and length(sequence) = 20").count() == 4000
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert files.detect_format(spark, f"{tmp_path}/a.fa") == "FASTA" and files.detect_format(spark, f"{tmp_path}/r.fq.gz") == "FASTQ"
    both = files.read_reads(spark, [f"{tmp_path}/a.fa", f"{tmp_path}/r.fq.gz"])
    files.validate_reads(both)
    assert both.count() == 4 and files.downsample(both, 2).count() == 2 and files.downsample(both, 2, 4).count() == 4
    files.write_fastq(both, f"{tmp_path}/out")
    assert files.read_fastq(spark, f"{tmp_path}/out").count() == 4


def test_sam_bed_and_manifest(spark, tmp_path):
    (tmp_path / "x.sam").write_text("@SQ\tSN:control\tLN:10\nr1\t0\tcontrol\t1\t60\t4M\t*\t0\t0\tACGT\tIIII\tNM:i:0\tcs:Z:=ACGT\nr2\t2048\tcontrol\t1\t60\t4M\t*\t0\t0\t*\t*\n")
    head, body = files.read_sam(spark, f"{tmp_path}/x.sam")
    assert head.count() == 1 and body.orderBy("qname").first()["cs"] == "=ACGT"
    assert files.mapped(body).count() == 1 and files.primary(body).count() == 1
    files.write_sam(head, body, f"{tmp_path}/sam")
    assert spark.read.text(f"{tmp_path}/sam").first()["value"].startswith("@SQ")
    (tmp_path / "a.bed").write_text("#c\ntrack x\nchr1\t10\t20\tmm39\t1000\t-\nchr2\t1\t2\tmm39\t9\t+\n")
    where = files.bed_coordinates(spark, f"{tmp_path}/a.bed")
    assert (where.chrom, where.start, where.end, where.strand, where.chrom_size) == ("chr1", 10, 20, "-", 1000)
    (tmp_path / "b.bed").write_text("chr1\t10\t20\n")
    with pytest.raises(files.BedError):
        files.read_bed(spark, f"{tmp_path}/b.bed")
    (tmp_path / "m.csv").write_text("sample, control, allele, name, note\n s1 , c ,a.fa,n,x\nc,c,a.fa,n,x\n,,,,\n")
    m = files.read_manifest(spark, f"{tmp_path}/m.csv")
    first, then = files.manifest_tasks(m)
    assert m.count() == 2 and first.count() == 1 and [r["sample"] for r in then.collect()] == ["s1"]


def test_genotyping_recovers_the_mixture(spark, tmp_path):
    c = synthetic.control_sequence(240)
    sub = synthetic.substituted(c, 120)
    sample = synthetic.reads(spark, [(c, 0.5), (sub, 0.5)], 60, 2, 0.002)
    control = synthetic.reads(spark, [(c, 1.0)], 50, 3, 0.002)
    result = genotype(sample, control, RunConfig("s", "s", "control", {"control": c}))
    found = {r["sequence"]: r["percent"] for r in result.consensus.collect()}
    assert set(found) == {c, sub} and all(25 < p < 75 for p in found.values())
    variants = result.variants.collect()
    assert [(v["pos"], v["ref"], v["alt"]) for v in variants] == [(121, c[120], sub[120])]
    rows = summary.with_allele_type(summary.result_rows(result.reads, "s"))
    assert {r["Allele type"] for r in summary.distinct(rows).collect()} == {"control", "control with indels"}
    vcf.write(result.variants, f"{tmp_path}/vcf")
    lines = [r["value"] for r in spark.read.text(f"{tmp_path}/vcf").collect()]
    assert lines[0].startswith("##fileformat") and any("TYPE=SUB" in x for x in lines)


def test_streaming_counts(spark, tmp_path):
    reads = spark.createDataFrame([("s", "control", 1, "r1", "+", "p", ["=A", "-C"]), ("s", "control", 2, "r2", "-", "p", ["=A", "=C"])], "sample string, allele string, read_ord long, qname string, strand string, preset string, tokens array<string>")
    reads.write.parquet(f"{tmp_path}/in")
    q = ingest.start(ingest.running_counts(ingest.token_stream(spark, f"{tmp_path}/in")), f"{tmp_path}/out", f"{tmp_path}/state")
    q.processAllAvailable()
    q.stop()
    got = {(r["pos"], r["match"], r["del"]) for r in spark.read.parquet(f"{tmp_path}/out").filter(F.col("version") == 0).collect()}
    assert got == {(0, 2, 0), (1, 1, 1)}


def test_genotyping_of_a_knockin_with_error_reads(spark, tmp_path):
    c = synthetic.control_sequence(240, 5)
    flox = synthetic.inserted(c, 120, "ACGTTGCATGCCTAGGATTACAGCATGCAA")
    sample = synthetic.reads(spark, [(c, 0.5), (flox, 0.5)], 60, 2, 0.002)
    control = synthetic.reads(spark, [(c, 1.0)], 50, 3, 0.002)
    short = [F.concat(F.lit("short"), n).alias(n) if n == "qname" else F.substring(n, 1, 90).alias(n) if n in ("sequence", "quality") else F.col(n) for n in sample.columns]
    sample, control = (df.unionByName(df.filter("read_ord < 16").select(*short)) for df in (sample, control))
    config = RunConfig("s", "s", "control", {"control": c, "flox": flox})
    result = genotype(sample, control, config)
    found = {(r["allele"], r["sequence"]): r["percent"] for r in result.consensus.collect()}
    assert set(found) == {("control", c), ("flox", flox)} and all(25 < p < 75 for p in found.values())
    assert result.reads.filter("qname like 'short%'").count() == 0  # unknown stretches: reads with errors
    assert {r["pos"] for r in knockin_positions(allele_table(spark, config.alleles)).collect()} & set(range(120, 150))
    export(result, f"{tmp_path}/out", "s", config)
    header, rows = bam.read_bam(spark, f"{tmp_path}/out/s/bam/all.bam")
    assert header.count() == 2 and rows.select("qname").distinct().count() >= 60
    assert {r["qname"][:5] for r in bam.read_bam(spark, f"{tmp_path}/out/s/bam/sequence_error.bam")[1].collect()} == {"short"}
    named = bam.read_bam(spark, f"{tmp_path}/out/s/bam/{safe_name(result.consensus.filter(F.col('allele') == 'flox').first()['name'])}.bam")[1]
    assert 0 < named.select("qname").distinct().count() <= 100
    table = summarise(spark, f"{tmp_path}/out", ["s"])
    assert {r["Allele type"] for r in table.collect()} == {"control", "flox"}
    assert "<svg" in spark.read.text(f"{tmp_path}/out/summary/chart", wholetext=True).first()[0]


def test_a_missing_file_fails_its_sample_alone(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">control\n" + synthetic.control_sequence(120) + "\n")
    (tmp_path / "m.csv").write_text(f"sample,control,allele,name\n{tmp_path}/none,{tmp_path}/nothing,{tmp_path}/a.fa,one\n")
    status = run_batch(spark, f"{tmp_path}/m.csv", f"{tmp_path}/out").collect()
    assert [(r["sample"], r["status"]) for r in status] == [("one/none", "failed")] and "none" in status[0]["error"]
