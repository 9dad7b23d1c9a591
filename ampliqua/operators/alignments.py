"""Alignment records: the best preset of a read, tokens from cs tags, trimming of split alignments, genome coordinates."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ampliqua.functions import strings
from ampliqua.functions import tokens as K
from ampliqua.functions.sequential import cs_to_tokens, join_split_alignments, repair_indels_udf
from ampliqua.operators.profile import rank_first
from ampliqua.schemas import GenomeCoordinates


def best_preset(alignments: DataFrame, preferred: str = "map-ont") -> DataFrame:
    """qname, preset: the one whose alignments span most; of equal ones the preferred, then the first by name."""
    spans = alignments.groupBy("qname", "preset").agg(F.sum(strings.aligned_length(F.col("cigar"))).alias("_n"))
    return rank_first(spans, ["qname"], F.desc("_n"), F.desc(F.col("preset") == preferred), F.asc("preset")).select("qname", "preset")


def of_best_preset(alignments: DataFrame, preferred: str = "map-ont") -> DataFrame:
    return alignments.join(best_preset(alignments, preferred), ["qname", "preset"])


def to_tokens(alignments: DataFrame, alleles: DataFrame) -> DataFrame:
    """allele, qname, strand, preset, tokens: one list a read from all its alignments on an allele.

    A read's other strand is an inversion; positions no alignment covers are unknown. Groups are single reads.
    """
    keep = ["rname", "qname", "flag", "pos", "cs", "preset"]
    rows = alignments.select(*[c for c in keep if c in alignments.columns], *([] if "preset" in alignments.columns else [F.lit("").alias("preset")]))
    rows = rows.join(F.broadcast(alleles.select(F.col("allele").alias("rname"), F.length("sequence").alias("length"))), "rname")
    first = rows.groupBy("rname", "qname", "length").agg(F.sort_array(F.collect_list(F.struct((F.col("flag").bitwiseAND(F.lit(2048)) != 0).alias("extra"), "pos", "flag", "cs", "preset"))).alias("a"))

    def run(batches):
        for pdf in batches:
            out = []
            for rname, qname, length, parts in zip(pdf["rname"], pdf["qname"], pdf["length"], pdf["a"], strict=True):
                lists = [(int(p["flag"]) & 16, cs_to_tokens(p["cs"], int(p["pos"]), int(length))) for p in parts]
                out.append((rname, qname, "-" if int(parts[0]["flag"]) & 16 else "+", parts[0]["preset"], join_split_alignments(lists, int(length))))
            yield pd.DataFrame(out, columns=["allele", "qname", "strand", "preset", "tokens"])

    return first.mapInPandas(run, "allele string, qname string, strand string, preset string, tokens array<string>")


def finish_tokens(tokens: DataFrame, alleles: DataFrame, most_unknown: float = 95.0) -> DataFrame:
    """Inner unknown stretches as deletions, reads with too many unknown positions dropped, false indels repaired."""
    both = tokens.join(F.broadcast(alleles.select("allele", F.col("sequence").alias("_ref"))), "allele")
    fixed = both.withColumn("tokens", K.internal_n_to_deletion(F.col("tokens"), F.col("_ref"))).drop("_ref")
    return fixed.filter(K.n_percent(F.col("tokens")) < most_unknown).withColumn("tokens", repair_indels_udf("tokens"))


_OPS = re.compile(r"(\d+)([MIDNSHPX=])")
#: Bases by which long shared stretches are found.
SEED = 12


def microhomology(before: str, after: str) -> int:
    """The longest proper end of the one that is the beginning of the other."""
    most = min(len(before), len(after)) - 1
    if most >= SEED:  # longer ones begin where the first bases of the other are found
        at = before.find(after[:SEED], len(before) - most)
        while at >= 0:
            if after.startswith(before[at:]):
                return len(before) - at
            at = before.find(after[:SEED], at + 1)
    return next((n for n in range(min(most, SEED - 1), 0, -1) if before.endswith(after[:n])), 0)


def clipped(cigar: str, sequence: str) -> str:
    ops = _OPS.findall(cigar)
    if sequence == "*" or not ops:
        return sequence
    head = int(ops[0][0]) if ops[0][1] == "S" else 0
    tail = int(ops[-1][0]) if ops[-1][1] == "S" and len(ops) > 1 else 0
    return sequence[head : len(sequence) - tail]


def mutations_before(ops: Sequence[tuple[int, str]], n: int) -> int:
    """Bases of operations other than M that end before the first n bases do."""
    total = bad = 0
    for size, op in ops:
        total += size
        if total >= n:
            break
        bad += size * (op != "M")
    return bad


def trim_head(ops: Sequence[tuple[int, str]], n: int) -> tuple[list[tuple[int, str]], int]:
    """Operations without the first n read bases, and the deleted bases that went with them."""
    rest, left, deleted = list(ops), n, 0
    while left > 0 and rest:
        size, op = rest.pop(0)
        if op == "D":
            deleted += size
        elif size > left:
            rest.insert(0, (size - left, op))
            left = 0
        else:
            left -= size
    return rest, deleted


def _text(ops: Sequence[tuple[int, str]]) -> str:
    return "".join(f"{n}{op}" for n, op in ops)


def trim_pair(one: dict, two: dict) -> None:
    """Takes a shared stretch off whichever of two neighbouring alignments is worse there, in place."""
    seqs = [clipped(a["cigar"], a["seq"]) for a in (one, two)]
    n = microhomology(*seqs)
    if not n:
        return
    ops = [[(int(k), op) for k, op in _OPS.findall(a["cigar"]) if op not in "SH"] for a in (one, two)]
    quals = [clipped(a["cigar"], a["qual"]) for a in (one, two)]
    if mutations_before(ops[1], n) >= mutations_before(ops[0][::-1], n):
        rest, deleted = trim_head(ops[1], n)
        two |= {"cigar": _text(rest), "pos": two["pos"] + n + deleted, "seq": seqs[1][n:], "qual": quals[1] if quals[1] == "*" else quals[1][n:]}
    else:
        rest, _ = trim_head(ops[0][::-1], n)
        one |= {"cigar": _text(rest[::-1]), "seq": seqs[0][:-n], "qual": quals[0] if quals[0] == "*" else quals[0][:-n]}


_TRIMMED = ["pos", "cigar", "seq", "qual"]


def _trim_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of qname and pos, with neighbours of a read trimmed; a read's rows may lie in several batches."""

    def made(parts: list[pa.RecordBatch], end: int | None) -> tuple[pa.RecordBatch, list[str | None]]:
        parts = [*parts[:-1], parts[-1].slice(0, end)] if end is not None else parts
        whole = parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        return whole, whole.column("qname").to_pylist()

    def trimmed(whole: pa.RecordBatch, names: list[str | None]) -> pa.RecordBatch:
        pairs = [k for k in range(1, len(names)) if names[k] == names[k - 1] and names[k] is not None]
        if not pairs:
            return whole
        columns = {c: whole.column(c).to_pylist() for c in _TRIMMED}
        for k in pairs:
            one, two = ({c: v[j] for c, v in columns.items()} for j in (k - 1, k))
            trim_pair(one, two)
            for c, v in columns.items():
                v[k - 1], v[k] = one[c], two[c]
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else whole.column(f.name) for f in whole.schema], schema=whole.schema)

    kept: list[pa.RecordBatch] = []  # the rows of the last read, which may go on
    for batch in batches:
        if not batch.num_rows:
            continue
        names = batch.column("qname").to_pylist()
        start = len(names) - 1
        while start and names[start] is not None and names[start - 1] == names[start]:
            start -= 1
        if start or kept and (names[0] is None or kept[-1].column("qname")[-1].as_py() != names[0]):
            if start:
                yield trimmed(*made([*kept, batch], start))
            else:
                yield trimmed(*made(kept, None))
            kept = []
        kept.append(batch.slice(start))
    if kept:
        yield trimmed(*made(kept, None))


def trim_microhomology(alignments: DataFrame) -> DataFrame:
    """Mapped alignments; of a read's several, neighbours by position no longer share bases. Rows without a name are reads of their own."""
    rows = alignments.filter(F.col("seq") != "*")
    alone = F.when(F.col("qname").isNull(), F.rand(1))  # such rows are dealt to all tasks
    others = [c for c in ("flag", "cigar", "seq") if c in rows.columns]
    ordered = rows.withColumn("_alone", alone).repartition("qname", "_alone").drop("_alone").sortWithinPartitions("qname", "pos", *others)
    return ordered.mapInArrow(_trim_batches, rows.schema)


def revcomp_alignments(alignments: DataFrame, end: int) -> DataFrame:
    """Alignments as seen from the other strand of a region that ends there."""
    turned = F.array_join(F.reverse(strings.cigar_ops(F.col("cigar"))), "")
    return alignments.withColumns({"pos": F.lit(end) - (F.col("pos") + strings.aligned_length(F.col("cigar"))) + 2, "flag": strings.reverse_flag(F.col("flag")), "cigar": turned, "seq": strings.revcomp(F.col("seq")), "qual": F.reverse("qual")})


def to_genome(alignments: DataFrame, where: GenomeCoordinates | None) -> DataFrame:
    """Trimmed alignments in the chromosome's coordinates, positions from 1."""
    rows = trim_microhomology(alignments)
    if where is not None and where.chrom and where.chrom_size:
        rows = revcomp_alignments(rows, where.end) if where.strand == "-" else rows.withColumn("pos", F.col("pos") + (where.start - 1))
        rows = rows.withColumn("rname", F.lit(where.chrom))
    return rows.withColumn("pos", F.when(F.col("pos") == 0, 1).otherwise(F.col("pos")).cast("int"))


def genome_header(header: DataFrame, where: GenomeCoordinates | None) -> DataFrame:
    if where is None or not where.chrom or not where.chrom_size:
        return header
    return header.withColumn("value", F.when(F.col("value").startswith("@SQ"), f"@SQ\tSN:{where.chrom}\tLN:{where.chrom_size}").otherwise(F.col("value")))


def by_allele(alignments: DataFrame, results: DataFrame) -> DataFrame:
    """Alignments with the allele name of their read, without the cs tag."""
    return alignments.drop("cs").join(results.select("qname", "name").distinct(), "qname")


def sample_reads(alignments: DataFrame, most: int = 100, seed: int = 1, keys: Sequence[str] = ()) -> DataFrame:
    """All alignments of at most so many reads (by key), those with the least hash."""
    names = alignments.select(*keys, "qname").distinct()
    order: list[Column] = [F.xxhash64("qname", F.lit(seed)), F.col("qname")]
    if keys:
        few = names.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_k") <= most).drop("_k")
    else:
        few = names.orderBy(*order).limit(most)
    return alignments.join(few, [*keys, "qname"], "left_semi")
