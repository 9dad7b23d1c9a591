"""Genotyping of a sample against its control: reads or alignments in, consensus alleles, variants and read results out.

Every stage is a table written to the shared folder, as the later ones use it several times.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ampliqua.align.mapper import align
from ampliqua.operators import alignments, classify, cluster, consensus, errors, kmers, lift, profile, sv
from ampliqua.report import vcf
from ampliqua.schemas import RunConfig
from ampliqua.session import materialize
from ampliqua.sources import files


@dataclass
class Result:
    """Read results, consensus alleles, variant records; if the sample came as reads: its alignments to the control, and the names of reads with errors."""

    reads: DataFrame
    consensus: DataFrame
    variants: DataFrame
    alignments: DataFrame | None = None
    errors: DataFrame | None = None


def allele_table(spark, alleles: dict[str, str]) -> DataFrame:
    rows = [(k, name, seq) for k, (name, seq) in enumerate(alleles.items())]
    return spark.createDataFrame(rows, "allele_ord int, allele string, sequence string")


def tokens_of(reads: DataFrame, alleles: DataFrame, name: str) -> DataFrame:
    """allele, allele_ord, qname, strand, preset, tokens of reads on all alleles, by the built-in aligner."""
    return tokens_of_alignments(align(reads, alleles), alleles, name)


def tokens_of_alignments(found: DataFrame, alleles: DataFrame, name: str) -> DataFrame:
    made = alignments.finish_tokens(alignments.to_tokens(alignments.of_best_preset(found), alleles), alleles)
    return materialize(made.join(F.broadcast(alleles.select("allele", "allele_ord")), "allele"), f"tokens-{name}")


def bases(alleles: DataFrame) -> DataFrame:
    return alleles.select("allele", F.posexplode(F.split("sequence", "")).alias("pos", "base")).filter("base <> ''")


def knockin_positions(alleles: DataFrame) -> DataFrame:
    """allele, pos: what alleles have more than the control, found by aligning the control's sequence to each."""
    one = alleles.filter("allele = 'control'").select(F.lit("control").alias("qname"), "sequence", F.lit(None).cast("string").alias("quality"))
    others = alleles.filter("allele <> 'control'")
    return materialize(profile.knockin_loci(alignments.to_tokens(align(one, others), others), ["allele"]), "knockin")


def without_error_reads(sample: DataFrame, control: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Both token tables without reads whose unknown stretches are sequencing errors, as they lie on the control allele, and those of the sample's (qname)."""
    judged = errors.control_errors(control.filter("allele = 'control'").select("qname", "tokens"))
    judged = materialize(judged, "control-errors")
    wrong = materialize(errors.sample_errors(sample.filter("allele = 'control'").select("qname", "tokens"), judged).filter("error").select("qname", "error"), "sample-errors")
    return errors.kept(sample, wrong)[0], errors.kept(control, judged)[0], wrong.select("qname").distinct()


def control_tokens(control: DataFrame, config: RunConfig) -> DataFrame:
    """Tokens of the control's reads on the configuration's alleles: the same for all its samples."""
    return tokens_of(files.downsample(control, config.cap_control), allele_table(control.sparkSession, config.alleles), "control")


def genotype(sample: DataFrame, control: DataFrame, config: RunConfig, made: DataFrame | None = None) -> Result:
    """From READS tables; see genotype_tokens. More reads than the configuration's caps are sampled by name.

    made: the control's tokens, if they are there already (control_tokens).
    """
    spark = sample.sparkSession
    sample, control = files.downsample(sample, config.cap_sample), files.downsample(control, config.cap_control)
    table = allele_table(spark, config.alleles)
    found = materialize(align(sample, table), "alignments")
    one, two, wrong = without_error_reads(tokens_of_alignments(found, table, "sample"), tokens_of(control, table, "control") if made is None else made)
    one, two = materialize(one, "sample-kept"), materialize(two, "control-kept")
    loci = materialize(profile.locus_pipeline(one, two, bases(table), ["allele"], knockin_positions(table)), "variant-loci")
    new = []
    own = loci.filter("allele = 'control'").select("pos", "muts")
    for kind in sv.KINDS:
        new += sv.detect(one.filter("allele = 'control'"), two.filter("allele = 'control'"), own, config.alleles | {n: s for n, _, s in new}, kind)
    if new:
        names = [df.select("qname").distinct() for df in (one, two)]
        table = allele_table(spark, config.alleles | {n: s for n, _, s in new})
        one, two = tokens_of(sample.join(names[0], "qname", "left_semi"), table, "sample-sv"), tokens_of(control.join(names[1], "qname", "left_semi"), table, "control-sv")
    result = genotype_tokens(one, two, table, config, {n: t for n, t, _ in new})
    result.alignments, result.errors = found.filter("rname = 'control'"), wrong
    return result


def consensus_loci(rows: DataFrame, control: DataFrame, alleles: DataFrame, knockin: DataFrame, no_filter: bool = False) -> DataFrame:
    """allele, label, pos, muts: loci of each cluster against the control reads that are like its allele's, thresholds from the data."""
    chosen = []
    for r in rows.select("allele").distinct().collect():  # an amplicon has a few alleles
        own, other = rows.filter(F.col("allele") == r["allele"]), control.filter(F.col("allele") == r["allele"])
        if not no_filter and other.limit(1).count():
            other = errors.normal_reads(own, materialize(errors.n_filtered(other), "few-unknown"))
        chosen.append(materialize(other, "like"))
    like = reduce(DataFrame.unionByName, chosen)
    return profile.locus_pipeline(rows, like, bases(alleles), ["allele", "label"], knockin, None, consensus=True)


def genotype_tokens(sample: DataFrame, control: DataFrame, alleles: DataFrame, config: RunConfig, variants: dict[str, list[str]] | None = None) -> Result:
    """Reads classified, clustered within their allele, called, merged and named."""
    spark = sample.sparkSession
    knockin = knockin_positions(alleles)
    loci = materialize(profile.locus_pipeline(sample, control, bases(alleles), ["allele"], knockin), "loci")
    chosen = materialize(classify.classify(sample, config.no_filter, config.min_reads), "classified")
    labelled = []
    lengths = {r["allele"]: r["n"] for r in alleles.select("allele", F.length("sequence").alias("n")).collect()}
    strand = sample.filter("allele = 'control'").agg(F.count_if(F.col("strand") == "+"), F.count_if(F.col("strand") == "-")).first()
    for allele, length in lengths.items():  # an amplicon has a few alleles
        own, other, here = chosen.filter(F.col("allele") == allele), control.filter(F.col("allele") == allele), loci.filter(F.col("allele") == allele).select("pos", "muts")
        n, m = own.count(), other.count()
        if not n:
            continue
        few = n < max(config.min_reads, n * 0.005) or not here.limit(1).count()
        if few:
            labelled.append(own.select("allele", "qname", F.lit(0).alias("label")))
            continue
        each = [kmers.kmers(df.select("allele", "qname", "strand", F.posexplode("tokens").alias("pos", "tok")), ["allele", "qname"], here, length).join(F.broadcast(here.select("pos")), "pos", "left_semi") for df in (own, other)]
        score = materialize(kmers.scores(each[0], each[1], n, max(m, 1), here, knockin.filter(F.col("allele") == allele).select("pos")), "scores")
        vectors = [kmers.vectors(kmers.annotate(e, score, lim), ["allele", "qname", "strand"]) for e, lim in zip(each, (None, here), strict=True)]
        labelled.append(cluster.label_reads(vectors[0], vectors[1], (strand[0] or 0, strand[1] or 0), read="qname").select("allele", "qname", "label"))
    labels = labelled[0]
    for part in labelled[1:]:
        labels = labels.unionByName(part)
    labels = materialize(cluster.global_labels(labels), "labels")
    rows = consensus.add_shares(chosen.join(labels, ["allele", "qname"]))
    rows = materialize(consensus.rescale(consensus.drop_minor_labels(rows, config.no_filter, config.min_reads)), "clustered")
    top = consensus.per_label(rows, config.cap_label)
    each = top.select("allele", "label", F.posexplode("tokens").alias("pos", "tok"))
    called_loci = materialize(consensus_loci(top, control, alleles, knockin, config.no_filter), "consensus-loci")
    matrix = consensus.weight_matrix(each, ["allele", "label"], called_loci, bases(alleles))
    called = consensus.call(matrix, ["allele", "label"])
    if variants:
        extra = spark.createDataFrame([(n, t) for n, t in variants.items()], "allele string, tokens array<string>")
        called = consensus.overlay_variants(called, extra)
    called = called.join(F.broadcast(rows.select("label", "percent").distinct()), "label")
    merged, mapping = consensus.merge_equal(materialize(called, "called"))
    named = materialize(consensus.names(merged, alleles), "consensus")
    reads = consensus.apply_labels(rows, mapping, named)
    return Result(reads, named, vcf.variants(lift.on_control(named, alleles), config.coordinates))
