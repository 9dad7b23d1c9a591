"""Read shares of clusters, position weight matrices, and the consensus alleles they give."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ampliqua.functions import tokens as K
from ampliqua.functions.sequential import overlay_udf
from ampliqua.operators import windows

PREDICTED = "_predicted"


def add_labels(reads: DataFrame, labels: DataFrame, on: str = "read_ord") -> DataFrame:
    return reads.join(labels.select(on, "label"), on)


def label_counts(rows: DataFrame, label: str = "label") -> DataFrame:
    return rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def add_shares(rows: DataFrame, label: str = "label", keys: Sequence[str] = (), digits: int = 3) -> DataFrame:
    """rows with readnum (of the label) and percent (of all rows of the key); counts are aggregated, then joined back."""
    n = rows.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("readnum"))
    total = n.groupBy(*keys).agg(F.sum("readnum").alias("_all"))
    n = n.join(total, list(keys)) if keys else n.crossJoin(total)  # a single row
    n = n.withColumn("percent", F.round(100 * F.col("readnum") / F.col("_all"), digits)).drop("_all")
    return rows.drop("readnum", "percent").join(F.broadcast(n), [*keys, label])


def drop_minor_labels(rows: DataFrame, no_filter: bool = False, least: int = 5, share: float = 0.005, label: str = "label") -> DataFrame:
    """Labels with fewer than max(least, share of the rows) reads dropped."""
    if no_filter:
        return rows
    n = label_counts(rows, label)
    limit = n.agg(F.greatest(F.lit(least), F.floor(F.sum("n") * share)).alias("_limit"))
    return rows.join(F.broadcast(n.crossJoin(limit).filter("n >= _limit").select(label)), label, "left_semi")


def rescale(rows: DataFrame, label: str = "label", digits: int = 3) -> DataFrame:
    """Percents of the labels that are left, scaled to 100 in all."""
    each = rows.select(label, "percent").distinct()
    total = each.agg(F.sum("percent").alias("_all"))
    new = each.crossJoin(total).select(label, F.round(F.try_divide(F.col("percent") * 100, F.col("_all")), digits).alias("_new"))
    return rows.join(F.broadcast(new), label).withColumn("percent", F.col("_new")).drop("_new")


def per_label(rows: DataFrame, most: int = 1000, seed: int = 1, label: str = "label", read: str = "qname", order: Sequence[Column] = ()) -> DataFrame:
    """At most so many rows a label: the first in the given order, else those with the least hash of the read and seed."""
    order = list(order) or [F.xxhash64(F.col(read).cast("string"), F.lit(seed)), F.col(read)]
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(label).orderBy(*order))).filter(F.col("_k") <= most).drop("_k")


def first_of_label(rows: DataFrame, label: int, most: int = 1000, order: str = "read_ord") -> DataFrame:
    return rows.filter(F.col("label") == label).orderBy(order).limit(most)


def weight_matrix(positions: DataFrame, keys: Sequence[str], loci: DataFrame | None, reference: DataFrame, pos: str = "pos", tok: str = "tok") -> DataFrame:
    """keys, pos, tok, pct: token percents; mutations that are no locus count as the reference base.

    loci: keys, pos, muts; reference: pos, base (or with keys). Unknown tokens go unless a position has no others; the rest
    are scaled to 100.
    """
    shared = [k for k in keys if k in reference.columns]
    rows = positions.join(F.broadcast(reference), [*shared, pos], "left")
    muts: Column = F.array().cast("array<string>")
    if loci is not None:
        on = [k for k in keys if k in loci.columns]
        rows = rows.join(F.broadcast(loci.select(*on, pos, "muts")), [*on, pos], "left")
        muts = F.coalesce("muts", muts)
    op = K.operator(F.col(tok))
    called = F.when(op.isin("+", "-", "*") & ~F.array_contains(muts, op), F.concat(F.lit("="), "base")).otherwise(F.col(tok))
    n = rows.withColumn(tok, called).groupBy(*keys, pos, tok).agg(F.count(F.lit(1)).alias("n"))
    at = Window.partitionBy(*keys, pos)
    known = n.withColumn("_k", F.sum(F.when(~F.col(tok).isin("=N", "=n"), 1).otherwise(0)).over(at)).filter((F.col("_k") == 0) | ~F.col(tok).isin("=N", "=n"))
    return known.withColumn("pct", F.col("n") * 100 / F.sum("n").over(at)).drop("n", "_k")


def call(matrix: DataFrame, keys: Sequence[str], pos: str = "pos", tok: str = "tok") -> DataFrame:
    """keys, tokens, sequence: the likeliest token of every position; of equal ones the least."""
    top = matrix.groupBy(*keys, pos).agg(F.min(F.struct((-F.col("pct")).alias("p"), F.col(tok).alias("t")))["t"].alias("t"))
    lists = top.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(pos, "t"))), lambda x: x["t"]).alias("tokens"))
    return lists.withColumn("sequence", K.sequence_of(F.col("tokens")))


def overlay_variants(consensus: DataFrame, variants: DataFrame) -> DataFrame:
    """consensus (allele, ..., tokens) with the tokens of structural-variant alleles (allele, variant) marked in."""
    both = consensus.join(F.broadcast(variants.select("allele", F.col("tokens").alias("_v"))), "allele", "left")
    made = both.withColumn("tokens", F.when(F.col("_v").isNotNull(), overlay_udf("tokens", "_v")).otherwise(F.col("tokens"))).drop("_v")
    return made.withColumn("sequence", K.sequence_of(F.col("tokens")))


def merge_equal(consensus: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Alleles with the same sequence as one, percents added, ranked 1..n by percent; and old label -> new label.

    consensus: allele, label, percent, sequence and others; the first label's row stays.
    """
    first = F.min_by(F.struct(*[c for c in consensus.columns if c != "percent"]), F.col("label"))
    groups = consensus.groupBy("allele", "sequence").agg(first.alias("_row"), F.sum("percent").alias("percent"), F.collect_list("label").alias("_labels"))
    ranked = windows.ranked(groups.select("_row.*", "percent", "_labels"), [F.desc("percent"), F.col("label")], "_new")
    mapping = ranked.select(F.explode("_labels").alias("label"), F.col("_new").alias("new_label"))
    return ranked.drop("_labels", "label").withColumnRenamed("_new", "label"), mapping


def apply_labels(rows: DataFrame, mapping: DataFrame, names: DataFrame) -> DataFrame:
    """Reads with their merged label, its name and percent, and the reads of all old labels that went into it."""
    new = rows.join(mapping, "label").drop("label", "percent", "readnum").withColumnRenamed("new_label", "label")
    n = new.groupBy("label").agg(F.count(F.lit(1)).alias("readnum"))
    return new.join(n.join(names.select("label", "name", "percent"), "label"), "label")


def names(consensus: DataFrame, alleles: DataFrame, suffix: str = PREDICTED) -> DataFrame:
    """consensus with name: allele{label}|{allele or unassigned}|{intact, indels or kind of variant}|{percent}%."""
    digits = F.lit(max(2, len(str(consensus.count()))))
    predicted = F.col("allele").endswith(suffix)
    kind = F.when(predicted, F.regexp_extract("allele", "^(deletion|inversion|insertion)", 1)).when(F.col("sequence") == F.col("_ref"), "intact").otherwise("indels")
    both = consensus.join(F.broadcast(alleles.select("allele", F.col("sequence").alias("_ref"))), "allele", "left")
    number = F.when(F.length(F.col("label").cast("string")) >= digits, F.col("label").cast("string")).otherwise(F.lpad(F.col("label").cast("string"), digits, F.lit("0")))
    named = F.concat(F.lit("allele"), number, F.lit("|"), F.when(predicted, "unassigned").otherwise(F.col("allele")), F.lit("|"), kind, F.lit("|"), F.col("percent").cast("string"), F.lit("%"))
    return both.withColumn("name", named).drop("_ref")
