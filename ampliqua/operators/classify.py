"""Assigning reads to alleles by match score, and re-assigning those of alleles that too few reads support."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ampliqua.functions.tokens import match_score
from ampliqua.operators.profile import rank_first
from ampliqua.session import materialize


def score(tokens: DataFrame) -> DataFrame:
    """tokens (joined or as an array) of all alleles at once, with their match score."""
    array = dict(tokens.dtypes)["tokens"].startswith("array")
    return tokens.withColumn("score", match_score(F.array_join("tokens", ",") if array else F.col("tokens")).cast("double"))


def best(scores: DataFrame, read: str = "qname") -> DataFrame:
    """The row of each read's best allele; of equal ones the first allele's."""
    return rank_first(scores, [read], F.desc("score"), F.asc("allele_ord"))


def allele_counts(scores: DataFrame, read: str = "qname") -> DataFrame:
    """allele, allele_ord, n: reads by best allele."""
    return best(scores, read).groupBy("allele", "allele_ord").agg(F.count(F.lit(1)).alias("n"))


def minor(counts: DataFrame, threshold: int = 5) -> DataFrame:
    return counts.filter(F.col("n") < threshold)


def major(counts: DataFrame, threshold: int = 5) -> DataFrame:
    return counts.filter(F.col("n") >= threshold)


def most_major(counts: DataFrame) -> DataFrame:
    """The allele with the most reads; of equal ones the first."""
    return counts.orderBy(F.desc("n"), "allele_ord").limit(1)


def split_by_minor(scores: DataFrame, minor_alleles: DataFrame, read: str = "qname") -> tuple[DataFrame, DataFrame]:
    """All rows of the reads whose best allele isn't, and is, a minor one."""
    few = best(scores, read).join(F.broadcast(minor_alleles.select("allele")), "allele", "left_semi").select(read)
    return scores.join(few, read, "left_anti"), scores.join(few, read, "left_semi")


def merge_minor(scores: DataFrame, threshold: int = 5, read: str = "qname") -> DataFrame:
    """scores with minor alleles barred from the reads that chose them, least supported allele first.

    A read then takes its next best allele; an allele that reaches the threshold this way is kept from then on. Reads with
    no allele left take the one that most reads have. Each step is written, so that plans stay short; alleles are few.
    """
    counts = allele_counts(scores, read)
    few = [r["allele"] for r in minor(counts, threshold).orderBy("n", "allele_ord").collect()]
    if not few:
        return scores
    top = most_major(counts).first()["allele"]
    kept, rest = split_by_minor(scores, minor(counts, threshold), read)
    rest, raised = materialize(rest, "minor"), set()
    for allele in few:
        if allele in raised:
            continue
        chosen = best(rest, read).filter(F.col("allele") == allele).select(read).withColumn("_hit", F.lit(True))
        barred = F.col("_hit").isNotNull() & (F.col("allele") == allele)
        rest = rest.join(chosen, read, "left").withColumn("score", F.when(barred, float("-inf")).otherwise(F.col("score"))).drop("_hit")
        rest = materialize(rest, "minor")
        raised |= {r["allele"] for r in major(allele_counts(rest, read), threshold).collect()}
    lost = F.col("score") == float("-inf")
    order = scores.filter(F.col("allele") == top).agg(F.min("allele_ord")).first()[0]
    rest = rest.withColumn("allele", F.when(lost, top).otherwise(F.col("allele"))).withColumn("allele_ord", F.when(lost, order).otherwise(F.col("allele_ord")))
    return kept.unionByName(rest)


def classify(tokens: DataFrame, no_filter: bool = False, threshold: int = 5, read: str = "qname") -> DataFrame:
    """One row a read, of its allele."""
    scored = score(tokens)
    return best(scored if no_filter else merge_minor(scored, threshold, read), read).drop("score")
