"""Command line: one sample against a control, or a batch manifest."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ampliqua import jobs, runlog, store
from ampliqua.functions import strings
from ampliqua.operators import alignments
from ampliqua.pipeline import Result, control_tokens, genotype
from ampliqua.report import html, summary, vcf
from ampliqua.schemas import RunConfig
from ampliqua.session import materialize, session
from ampliqua.sources import bam, files, inputs
from ampliqua.sources import genome as genomes


def export(result: Result, out: str, sample: str, config: RunConfig | None = None) -> None:
    """Result rows, FASTA, VCF, pages, and BAM files (all alignments, reads with errors, some reads of each allele) under out/sample."""
    at = f"{out}/{sample}"
    rows = summary.result_rows(result.reads, sample)
    rows.write.mode("overwrite").json(f"{at}/reads")
    result.consensus.write.mode("overwrite").parquet(f"{at}/consensus")
    files.write_fasta(result.consensus.select("name", "sequence"), f"{at}/fasta")
    vcf.write(result.variants, f"{at}/vcf")
    html.write(result.consensus.select("name", "tokens", F.lit(None).cast("array<string>").alias("variant")), f"{at}/html")
    if result.alignments is not None and config is not None:
        spark, where = result.reads.sparkSession, config.coordinates
        fields = result.alignments.withColumns({"rnext": F.lit("*"), "pnext": F.lit(0), "tlen": F.lit(0)})
        header = alignments.genome_header(spark.createDataFrame([(f"@SQ\tSN:control\tLN:{len(config.alleles['control'])}",)], "value string"), where)
        found = materialize(alignments.to_genome(fields, where), "genome")
        parts = {"all": found}
        if result.errors is not None:
            parts["sequence_error"] = found.join(result.errors, "qname", "left_semi")
        named = alignments.by_allele(alignments.sample_reads(found.join(result.reads.select("qname", "label").distinct(), "qname"), keys=["label"]), result.reads)
        for r in result.consensus.select("name").collect():  # a row an allele
            parts[strings.safe_name(r["name"])] = named.filter(F.col("name") == r["name"])
        for name, part in parts.items():
            bam.write_bam(header, part, f"{at}/bam/{name}.bam")
            bam.write_index(spark, f"{at}/bam/{name}.bam")


def summarise(spark: SparkSession, out: str, samples: Sequence[str]) -> DataFrame:
    """A row for each allele of each sample, written under out/summary with a chart."""
    rows = spark.read.json([f"{out}/{s}/reads" for s in samples])
    found = materialize(summary.distinct(summary.with_allele_type(rows)), "summary")
    found.write.mode("overwrite").option("header", True).csv(f"{out}/summary/table")
    page = html.bar_chart([r.asDict() for r in found.collect()])  # a row an allele
    spark.createDataFrame([(page,)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/summary/chart")
    return found


def run_one(spark: SparkSession, sample: Sequence[str], control: Sequence[str], allele: str, name: str, out: str, bed: str | None = None, no_filter: bool = False, cache: str | None = None, genome: str | None = None) -> Result:
    """A sample against its control: files or folders of FASTA, FASTQ, SAM or BAM.

    cache: where the control's tokens are kept; genome: an index (sources.genome) in which the control is looked up, if
    there is no BED file. Rows and seconds of every stage are written under log.
    """
    table = files.alleles(spark, allele)
    sequences = {r["allele"]: r["sequence"] for r in table.orderBy("allele_ord").collect()}
    where = files.bed_coordinates(spark, bed) if bed else genomes.coordinates(spark, genome, sequences["control"]) if genome else None
    config = RunConfig(name, name, "control", sequences, where, no_filter)
    reads = [inputs.read(spark, inputs.inputs(spark, paths)) for paths in (sample, control)]
    for r in reads:
        files.validate_reads(r)
    made = None
    if cache:
        key = store.key_of(store.files_of(spark, control), sequences, config.cap_control)
        made = store.kept(spark, cache, "control", key, lambda: control_tokens(reads[1], config))
    with runlog.recording() as log:
        result = genotype(*reads, config, made)
        export(result, out, name, config)
    log.table(spark).coalesce(1).write.mode("overwrite").json(f"{out}/{name}/log")
    return result


def run_batch(spark: SparkSession, manifest: str, out: str, no_filter: bool = False, workers: int = 4, cache: str | None = None) -> DataFrame:
    """All samples of a manifest; sample, status and error of each. The summary of those that ended well is written.

    Controls are aligned first, each once, and their tokens kept under cache (out/cache). Samples run side by side, each
    in a scheduler pool and a job group of its own (fair sharing needs spark.scheduler.mode=FAIR): one that fails cancels
    what is left of its own jobs.
    """
    cache = cache or f"{out}/cache"
    rows = files.manifest_tasks(files.read_manifest(spark, manifest))[1].orderBy("name", "sample").collect()
    tasks = [(f"{r['name']}/{strings.safe_name(r['sample'].rstrip('/').split('/')[-1])}", r.asDict()) for r in rows]

    def first(task: dict) -> None:
        alleles = {r["allele"]: r["sequence"] for r in files.alleles(spark, task["allele"]).orderBy("allele_ord").collect()}
        config = RunConfig("", "", "control", alleles)
        key = store.key_of(store.files_of(spark, [task["control"]]), alleles, config.cap_control)
        store.kept(spark, cache, "control", key, lambda: control_tokens(inputs.read(spark, inputs.inputs(spark, [task["control"]])), config))

    errors: dict[str, str] = {}
    for name, t in tasks:
        try:
            store.files_of(spark, [t["sample"]])
        except OSError as error:
            errors[name] = f"{error}: no such file"
    here = [(n, t) for n, t in tasks if n not in errors]
    controls = {(t["control"], t["allele"]): t for _, t in here}
    lost = {(t["control"], t["allele"]): e for (_, t), e in zip(controls.items(), jobs.side_by_side(spark, [(f"control {t['control']}", lambda t=t: first(t)) for t in controls.values()], workers), strict=True) if e}
    errors |= {n: lost[t["control"], t["allele"]] for n, t in here if (t["control"], t["allele"]) in lost}
    ready = [(n, t) for n, t in here if n not in errors]
    failed = jobs.side_by_side(spark, [(n, lambda n=n, t=t: run_one(spark, [t["sample"]], [t["control"]], t["allele"], n, out, t.get("bed"), no_filter, cache, t.get("genome"))) for n, t in ready], workers)
    errors |= {n: e for (n, _), e in zip(ready, failed, strict=True) if e}
    status = [(n, "failed" if n in errors else "done", errors.get(n, "")) for n, _ in tasks]
    if done := [name for name, state, _ in status if state == "done"]:
        summarise(spark, out, done)
    return spark.createDataFrame(status, "sample string, status string, error string")


def main(argv: Sequence[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="ampliqua", description=__doc__)
    sub = parser.add_subparsers(dest="mode", required=True)
    one = sub.add_parser("run")
    for flag in ("sample", "control", "allele", "name"):
        one.add_argument(f"--{flag}", required=True)
    one.add_argument("--bed")
    one.add_argument("--genome")
    indexed = sub.add_parser("index-genome")
    indexed.add_argument("--fasta", required=True)
    indexed.add_argument("--index", required=True)
    indexed.add_argument("--master")
    batch = sub.add_parser("batch")
    batch.add_argument("--file", required=True)
    batch.add_argument("--workers", type=int, default=4)
    for p in (one, batch):
        p.add_argument("--out", default="results")
        p.add_argument("--cache")
        p.add_argument("--master")
        p.add_argument("--no-filter", action="store_true")
    args = parser.parse_args(argv)
    spark = session(master=args.master, **{"spark.scheduler.mode": "FAIR"})
    if args.mode == "index-genome":
        genomes.write_index(spark, args.fasta, args.index)
        return 0
    if args.mode == "run":
        run_one(spark, args.sample.split(","), args.control.split(","), args.allele, args.name, args.out, args.bed, args.no_filter, args.cache, args.genome)
        return 0
    status = run_batch(spark, args.file, args.out, args.no_filter, args.workers, args.cache)
    status.show(truncate=False)
    return int(status.filter("status <> 'done'").count() > 0)


if __name__ == "__main__":
    raise SystemExit(main())
