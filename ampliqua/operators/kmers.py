"""Mutation 3-mers of reads, their percents in sample and control, and the reads' scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ampliqua.functions import tokens as K
from ampliqua.operators import windows

NONE = "@,@,@"


def kmers(positions: DataFrame, read: Sequence[str], loci: DataFrame, length: int, keep_size: bool = False) -> DataFrame:
    """positions (read, pos, tok) with kmer: previous, own and next token, `@` where the operator is no locus there.

    loci: pos, muts. An insertion at a locus is written short; the token after it sees the short form, the one before it the
    long one unless it is itself an insertion. Both ends, and positions without loci, have none.
    """
    w = Window.partitionBy(*read).orderBy("pos")
    p = positions.join(F.broadcast(loci.select("pos", "muts")), "pos", "left").withColumn("muts", F.coalesce("muts", F.array().cast("array<string>")))
    short = K.compress_insertion(F.col("tok"), keep_size)
    inner = (F.col("pos") > 0) & (F.col("pos") < length - 1) & (F.size("muts") > 0)
    p = p.withColumn("_own", F.when(inner & F.col("tok").startswith("+"), short).otherwise(F.col("tok")))
    around = {"_pt": F.lag("_own").over(w), "_pm": F.lag("muts").over(w), "_nt": F.lead("tok").over(w), "_nm": F.lead("muts").over(w)}
    p = p.withColumns(around)
    nxt = F.when(F.col("tok").startswith("+"), K.compress_insertion(F.col("_nt"), keep_size)).otherwise(F.col("_nt"))
    mask = lambda t, m: F.coalesce(K.mask_neighbour(t, m), F.lit("@"))
    made = F.concat_ws(",", mask(F.col("_pt"), F.col("_pm")), F.col("_own"), mask(nxt, F.col("_nm")))
    hit = inner & F.array_contains("muts", K.operator(F.col("tok")))
    return p.withColumn("kmer", F.when(hit, made).otherwise(NONE)).drop("_own", "_pt", "_pm", "_nt", "_nm", "muts")


def counts(rows: DataFrame, keys: Sequence[str] = (), kmer: str = "kmer", pos: str = "pos") -> DataFrame:
    return rows.groupBy(*keys, pos, kmer).agg(F.count(F.lit(1)).alias("n"))


def percents(counted: DataFrame, coverage: DataFrame | int, keys: Sequence[str] = (), digits: int = 3) -> DataFrame:
    """counted with pct, of the reads; coverage: their number, by key or for all."""
    if isinstance(coverage, DataFrame):
        counted = counted.join(F.broadcast(coverage), list(keys))
        return counted.withColumn("pct", F.round(F.col("n") * 100 / F.col("coverage"), digits)).drop("coverage", "n")
    return counted.withColumn("pct", F.round(F.col("n") * 100 / F.lit(coverage), digits)).drop("n")


def subtract(sample: DataFrame, control: DataFrame, keys: Sequence[str] = (), knockin: DataFrame | None = None, kmer: str = "kmer", pos: str = "pos") -> DataFrame:
    """Sample percents less the control's where that is positive; at knock-in positions the sample's own."""
    on = [*keys, pos, kmer]
    both = sample.join(control.select(*on, F.col("pct").alias("_c")), on, "left")
    free: Column = F.lit(False)
    if knockin is not None:
        both = both.join(F.broadcast(knockin.select(pos).distinct().withColumn("_k", F.lit(True))), pos, "left")
        free = F.coalesce("_k", F.lit(False))
    pct = F.when(free, F.col("pct")).otherwise(F.col("pct") - F.coalesce("_c", F.lit(0.0)))
    return both.withColumn("pct", pct).filter(free | (F.col("pct") > 0)).select(*on, "pct")


def common_errors_dropped(rows: DataFrame, limit: float = 0.5) -> DataFrame:
    return rows.filter(F.col("pct") > limit)


def centre(kmer: Column) -> Column:
    return F.split(kmer, ",")[1]


def matches_dropped(rows: DataFrame, kmer: str = "kmer") -> DataFrame:
    return rows.filter(~centre(F.col(kmer)).startswith("="))


def level_insertions(rows: DataFrame, loci: DataFrame, keys: Sequence[str] = (), kmer: str = "kmer", pos: str = "pos") -> DataFrame:
    """Insertion k-mers of neighbouring insertion loci take the largest percent among them. loci: keys, pos of insertions."""
    island = windows.islands(loci.select(*keys, pos).distinct(), list(keys), pos) if keys else windows.islands(loci.select(pos).distinct().withColumn("_a", F.lit(0)), ["_a"], pos).drop("_a")
    both = rows.join(F.broadcast(island), [*keys, pos], "left")
    is_ins = centre(F.col(kmer)).startswith("+")
    top = F.max(F.when(is_ins, F.col("pct"))).over(Window.partitionBy(*keys, "island"))
    return both.withColumn("pct", F.when(is_ins & F.col("island").isNotNull(), top).otherwise(F.col("pct"))).drop("island")


def scores(sample: DataFrame, control: DataFrame, n_sample: int, n_control: int, loci: DataFrame, knockin: DataFrame | None = None) -> DataFrame:
    """pos, kmer, score from the reads' k-mers."""
    diff = subtract(percents(counts(sample), n_sample), percents(counts(control), n_control), knockin=knockin)
    ins = loci.filter(F.array_contains("muts", "+")).select("pos")
    return matches_dropped(level_insertions(common_errors_dropped(diff), ins)).select("pos", "kmer", F.col("pct").alias("score"))


def annotate(rows: DataFrame, score: DataFrame, loci: DataFrame | None = None, kmer: str = "kmer", pos: str = "pos") -> DataFrame:
    """rows with each k-mer's score, 0 if it has none; loci (pos, muts) given, as for controls: 0 where the centre is a locus."""
    out = rows.join(F.broadcast(score), [pos, kmer], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    if loci is None:
        return out
    out = out.join(F.broadcast(loci.select(pos, F.col("muts").alias("_m"))), pos, "left")
    return out.withColumn("score", F.when(F.array_contains("_m", K.operator(centre(F.col(kmer)))), 0.0).otherwise(F.col("score"))).drop("_m")


def vectors(annotated: DataFrame, read: Sequence[str], pos: str = "pos") -> DataFrame:
    """read, scores: by position, an array a read."""
    return annotated.groupBy(*read).agg(F.transform(F.array_sort(F.collect_list(F.struct(pos, "score"))), lambda x: x["score"]).alias("scores"))
