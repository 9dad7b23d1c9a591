"""Structural-variant alleles: runs in reads, starts that belong together, clusters, and the alleles they predict."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ampliqua.functions import tokens as K
from ampliqua.operators import windows
from ampliqua.operators.cluster import counted, optimise, with_labels
from ampliqua.operators.consensus import PREDICTED
from ampliqua.operators.stats import damerau_levenshtein
from ampliqua.session import materialize

KINDS = ("deletion", "inversion", "insertion")


def runs(positions: DataFrame, kind: str, loci: DataFrame, read: Sequence[str], least: int = 10) -> DataFrame:
    """read, start, size: runs of deleted (at deletion loci) or inverted tokens, or sizes of insertions (at insertion loci)."""
    if kind == "inversion":
        rows = positions.filter(K.is_lower(F.col("tok")))
    else:
        op = "-" if kind == "deletion" else "+"
        rows = positions.filter(F.col("tok").startswith(op)).join(F.broadcast(loci.filter(F.array_contains("muts", op)).select("pos")), "pos", "left_semi")
    if kind == "insertion":
        return rows.select(*read, F.col("pos").alias("start"), K.insertion_size(F.col("tok")).cast("int").alias("size")).filter(F.col("size") >= least)
    found = windows.islands(rows, list(read), "pos").groupBy(*read, "island").agg(F.min("pos").alias("start"), F.count(F.lit(1)).cast("int").alias("size"))
    return found.filter(F.col("size") >= least).drop("island")


def converted(found: DataFrame, coverage: int, read: Sequence[str], gap: int = 5) -> DataFrame:
    """found with starts replaced by the commonest of their session; sessions without enough reads go."""
    places = found.groupBy("start").agg(F.count(F.lit(1)).alias("_n"))  # a row a position: starts, not reads, are put in order
    w = Window.partitionBy(F.lit(0)).orderBy("start")
    numbered = places.withColumn("_new", F.when(F.col("start") - F.lag("start").over(w) <= gap, 0).otherwise(1)).withColumn("session", F.sum("_new").over(w))
    enough = numbered.groupBy("session").agg(F.sum("_n").alias("_all"), F.min(F.struct((-F.col("_n")).alias("n"), F.col("start").alias("s")))["s"].alias("_mode")).filter(F.col("_all") > max(5, coverage * 0.05))
    mapping = numbered.join(enough, "session").select("start", "_mode")
    return found.join(mapping, "start").select(*read, F.col("_mode").alias("start"), "size")


def features(found: DataFrame, read: str, starts: list[int]) -> DataFrame:
    """read and a column for each start: the size there, 0 without one."""
    wide = found.groupBy(read).pivot("start", starts).agg(F.first("size"))
    return wide.na.fill(0)


def cluster(sample: DataFrame, control: DataFrame, n_sample: int, n_control: int, read: str) -> DataFrame:
    """read, label of the sample's reads with a variant; labels with too few reads are -1. sample, control: read, start, size.

    A read is a vector of sizes by start (of several at one start the largest), one without variants a vector of zeros.
    Equal vectors are counted, and clustered by aggregates.
    """
    starts = sorted(r["start"] for df in (sample, control) for r in df.select("start").distinct().collect())  # places of the allele
    starts = list(dict.fromkeys(starts))

    def wide(df: DataFrame) -> DataFrame:
        sizes = df.groupBy(F.col(read).cast("string").alias(read), "start").agg(F.max("size").cast("double").alias("size"))
        sizes = sizes.groupBy(read).agg(F.map_from_entries(F.collect_list(F.struct("start", "size"))).alias("_sizes"))
        return sizes.select(read, F.transform(F.lit(starts), lambda s: F.coalesce(F.element_at("_sizes", s), F.lit(0.0))).alias("scores"))

    if not starts:
        return sample.select(F.col(read).cast("string").alias(read), F.lit(-1).alias("label"))
    own, other = materialize(wide(sample), "sizes"), wide(control)
    rest = [max(n - df.count(), 0) for n, df in ((n_sample, own), (n_control, other))]
    zeros = sample.sparkSession.range(2).select(F.array_repeat(F.lit(0.0), len(starts)).alias("scores"), F.when(F.col("id") == 0, float(rest[0])).otherwise(float(rest[1])).alias("w"), (F.col("id") == 1).alias("control")).filter("w > 0")
    parts = [counted(df).withColumn("control", F.lit(c)) for df, c in ((own, False), (other, True))]
    vectors = optimise(materialize(parts[0].unionByName(parts[1]).unionByName(zeros), "size-vectors"))
    vectors = materialize(vectors.filter("not control").select("scores", "w", "label"), "labelled-sizes")
    large = [r["label"] for r in vectors.groupBy("label").agg(F.sum("w").alias("n")).filter(F.col("n") > max(0.05 * n_sample, 5)).collect()]  # a row a cluster
    return with_labels(own, vectors.groupBy("scores").agg(F.min("label").alias("label"))).select(read, F.when(F.col("label").isin(large), F.col("label")).otherwise(-1).cast("int").alias("label"))


def consensus(labelled: DataFrame, positions: DataFrame, kind: str, control: str, read: str) -> DataFrame:
    """label, tokens: the commonest size at each start of a label, set in the control's tokens. labelled: read, label, start, size."""
    n = labelled.select("label", read).distinct().groupBy("label").agg(F.count(F.lit(1)).alias("_reads"))
    sized = labelled.groupBy("label", "start", "size").agg(F.count(F.lit(1)).alias("n"))
    none = sized.groupBy("label", "start").agg(F.sum("n").alias("_with")).join(n, "label").select("label", "start", F.lit(0).alias("size"), (F.col("_reads") - F.col("_with")).alias("n"))
    modal = sized.select("label", "start", "size", "n").union(none).groupBy("label", "start").agg(F.max(F.struct("n", "size"))["size"].alias("size")).filter("size > 0")
    if kind == "insertion":
        texts = positions.withColumnRenamed("pos", "start").join(labelled.select(read, "label", "start").distinct(), [read, "start"]).join(F.broadcast(modal), ["label", "start"])
        same = texts.filter(K.insertion_size(F.col("tok")) == F.col("size"))
        modal = windows.modal(same, ["label", "start"], "tok", "tok").select("label", "start", F.lit(1).alias("size"), "tok")
    else:
        modal = modal.withColumn("tok", F.lit(None).cast("string"))
    sets = modal.groupBy("label").agg(F.collect_list(F.struct("start", "size", "tok")).alias("_v"))
    base = F.lit(control)
    hit = lambda i: F.filter(F.col("_v"), lambda v: (v["start"] <= i) & (i < v["start"] + v["size"]))

    def token(i):
        letter = F.substring(base, i + 1, F.lit(1))
        inside = F.size(hit(i)) > 0
        changed = {"deletion": F.concat(F.lit("-"), letter), "inversion": F.lower(F.concat(F.lit("="), letter)), "insertion": F.get(hit(i), F.lit(0))["tok"]}[kind]
        return F.when(inside, changed).otherwise(F.concat(F.lit("="), letter))

    made = sets.select("label", F.transform(F.sequence(F.lit(0), F.lit(len(control) - 1)), token).alias("tokens"))
    ends = F.element_at("tokens", 1).startswith("-") | F.element_at("tokens", -1).startswith("-")
    return made.filter(~ends).withColumn("sequence", K.sequence_of(F.col("tokens")))


def unique(found: list[tuple[int, str]], known: dict[str, str], least: int = 10) -> list[int]:
    """Labels whose sequence differs by at least `least` edits from all known alleles and from those kept before it."""
    kept: list[tuple[int, str]] = []
    for label, seq in found:
        if all(damerau_levenshtein(seq, other, least) >= least for other in [*known.values(), *(s for _, s in kept)]):
            kept.append((label, seq))
    return [label for label, _ in kept]


def predicted_names(labels: Sequence[int], known: Sequence[str], kind: str) -> dict[int, str]:
    """Names like deletion01_predicted, with more digits where a known allele would clash."""
    digits = 2
    while True:
        made = {label: f"{kind}{k:0{digits}}{PREDICTED}" for k, label in enumerate(labels, 1)}
        if not set(made.values()) & set(known):
            return made
        digits += 1


def detect(sample: DataFrame, control: DataFrame, loci: DataFrame, alleles: dict[str, str], kind: str, read: str = "qname") -> list[tuple[str, list[str], str]]:
    """(name, tokens, sequence) of the alleles that a kind of variant predicts. sample, control: read, tokens on the control allele."""
    n_sample, n_control = sample.count(), control.count()
    each = [df.select(read, F.posexplode("tokens").alias("pos", "tok")) for df in (sample, control)]
    found = [materialize(converted(materialize(runs(p, kind, loci, [read]), "runs"), n, [read]), "starts") for p, n in zip(each, (n_sample, n_control), strict=True)]
    if not found[0].limit(1).count():
        return []
    labels = materialize(cluster(*found, n_sample, n_control, read), "variant-labels")
    labelled = found[0].join(labels, read).filter("label >= 0")
    rows = consensus(labelled, each[0], kind, alleles["control"], read).orderBy("label").collect()  # one row an allele
    keep = set(unique([(r["label"], r["sequence"]) for r in rows], alleles))
    names = predicted_names([r["label"] for r in rows if r["label"] in keep], list(alleles), kind)
    return [(names[r["label"]], list(r["tokens"]), r["sequence"]) for r in rows if r["label"] in keep]
