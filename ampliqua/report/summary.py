"""Result rows, their summary over samples, and the paths of the alleles' pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ampliqua.functions.strings import allele_type_label, percent_label

RESULT_KEYS = ("QNAME", "RNAME", "MIDSV", "STRAND", "PRESET", "ALLELE", "LABEL", "READNUM", "PERCENT", "NAME")


def result_rows(rows: DataFrame, sample: str) -> DataFrame:
    """The report's seven columns of read-level results; label, allele and type come from the name's parts."""
    parts = F.split(F.regexp_replace("name", "[|]", "_"), "_")
    n = F.size(parts)
    return rows.select(
        F.lit(sample).alias("Sample"),
        F.col("qname").alias("Read ID"),
        F.initcap(parts[0]).alias("Label"),
        F.array_join(F.slice(parts, F.lit(2), n - 3), "_").alias("Allele"),
        F.element_at(parts, -2).alias("Type"),
        percent_label(F.element_at(parts, -1)).alias("Percent of reads"),
        F.col("strand").alias("Strand"),
    )


def with_allele_type(rows: DataFrame) -> DataFrame:
    return rows.withColumn("Allele type", allele_type_label(F.col("Allele"), F.col("Type")))


def distinct(rows: DataFrame) -> DataFrame:
    """One row for what all reads of an allele share, by sample and label."""
    return rows.drop("Read ID", "Strand").distinct().orderBy("Sample", "Label")


def attach_paths(rows: DataFrame, files: DataFrame, exact: Sequence[str], loose: Sequence[str]) -> DataFrame:
    """rows with path: of the file that agrees in the exact keys, else in the loose ones, whatever the case; else ''."""
    def keyed(keys: Sequence[str], name: str) -> DataFrame:
        return files.groupBy(*(F.lower(k).alias(f"_{k}") for k in keys)).agg(F.min("path").alias(name))

    out = rows
    for keys, name in ((exact, "_exact"), (loose, "_loose")):
        right = keyed(keys, name)
        on = [F.lower(F.col(k)) == F.col(f"_{k}") for k in keys]
        out = out.join(right, on, "left").drop(*(f"_{k}" for k in keys))
    return out.withColumn("path", F.coalesce("_exact", "_loose", F.lit(""))).drop("_exact", "_loose")


def ordered_types(kinds: Sequence[str]) -> list[str]:
    """Allele types for the chart's legend: control first, then intact alleles, those with indels, then the rest, by name."""
    rank = lambda k: (k != "control", k.endswith(" with indels"), k.split(" ")[0] == "unassigned", k)
    return sorted(set(kinds), key=rank)
