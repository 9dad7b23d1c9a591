"""Indel profiles of samples and controls, and the loci at which they differ.

Tables are long: (keys, pos, mut, n, pct). Tokens are exploded once; everything after works on positions, so it is small.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ampliqua.functions import tokens as K
from ampliqua.operators import windows
from ampliqua.schemas import MUTATIONS
from ampliqua.session import materialize


def explode_tokens(reads: DataFrame, keys: Sequence[str], tokens: str = "tokens") -> DataFrame:
    """keys, pos (from 0), tok: a row for each token."""
    return reads.select(*keys, F.posexplode(tokens).alias("pos", "tok"))


def count_indels(positions: DataFrame, keys: Sequence[str], pos: str = "pos", tok: str = "tok") -> DataFrame:
    """keys, pos, match, ins, del, sub: tokens by operator; unknown and inverted tokens don't count."""
    t = F.col(tok)
    kept = positions.filter(~K.is_n_tag(t) & ~K.is_lower(t))
    return kept.groupBy(*keys, pos).agg(*(F.count_if(K.operator(t) == op).alias(n) for op, n in (("=", "match"), ("+", "ins"), ("-", "del"), ("*", "sub"))))


def normalize(counts: DataFrame, keys: Sequence[str], pos: str = "pos") -> DataFrame:
    """keys, pos, mut, n, pct: each kind's share of itself and the matches, in percent."""
    each = F.explode(F.array(*(F.struct(F.lit(op).alias("mut"), F.col(n).alias("n")) for op, n in (("+", "ins"), ("-", "del"), ("*", "sub")))))
    rows = counts.select(*keys, pos, "match", each.alias("x")).select(*keys, pos, "match", "x.mut", "x.n")
    pct = F.when(F.col("n") + F.col("match") > 0, 100.0 * F.col("n") / (F.col("n") + F.col("match"))).otherwise(0.0)
    return rows.select(*keys, pos, "mut", "n", pct.alias("pct"))


def profile(reads: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts and percents of a token table."""
    return normalize(count_indels(explode_tokens(reads, keys), keys), keys)


def against_control(sample: DataFrame, control: DataFrame, keys: Sequence[str], pos: str = "pos") -> DataFrame:
    """keys, pos, mut, sample, control: percents, the control's held at the sample's where it is larger, 0 where it has none."""
    right = control.select(*keys, pos, "mut", F.col("pct").alias("control"))
    joined = sample.select(*keys, pos, "mut", F.col("pct").alias("sample")).join(right, [*keys, pos, "mut"], "left")
    return joined.withColumn("control", F.least("sample", F.coalesce("control", F.lit(0.0))))


def cosine_distance(x: Column, y: Column) -> Column:
    """1 minus the cosine of two arrays; 0 if one is empty, 1 if one has no length."""
    dot = F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    norm = lambda a: F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v * v))
    size = norm(x) * norm(y)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).when(size == 0, 1.0).otherwise(1 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot / (size + 2.220446049250313e-16))))


def dissimilar(pairs: DataFrame, keys: Sequence[str], pos: str = "pos", consensus: bool = False) -> DataFrame:
    """pairs with `dissimilar`: over 20 points more than the control (in consensus mode, only above 50), or a look-ahead of ten
    positions whose cosine distance hangs on the first of them."""
    both = windows.look_ahead(windows.look_ahead(pairs, [*keys, "mut"], pos, "sample", 10, "_x"), [*keys, "mut"], pos, "control", 10, "_y")
    tail = lambda c: F.slice(F.col(c), F.lit(2), F.greatest(F.size(c) - 1, F.lit(0)))
    rest = both.withColumn("_d", cosine_distance(F.col("_x"), F.col("_y"))).withColumn("_t", cosine_distance(tail("_x"), tail("_y")))
    jump = (F.col("sample") > 50) if consensus else F.lit(True)
    # the ratio is only looked at beyond 0.05, so it has a denominator
    near = F.when(F.col("_d") <= 0.05, False).otherwise(F.col("_d") / (F.col("_d") + F.col("_t")) > 0.9)
    return rest.withColumn("dissimilar", F.when(F.col("sample") - F.col("control") > 20, jump).otherwise(near)).drop("_x", "_y", "_d", "_t")


def anomalies(pairs: DataFrame, keys: Sequence[str], thresholds: DataFrame | dict[str, float] | float = 0.1, pos: str = "pos", consensus: bool = False) -> DataFrame:
    """keys, pos, mut of the loci where the sample exceeds the control by more than the threshold, and is dissimilar.

    thresholds: for all, by kind, or a table of keys, mut and threshold. The boundary is the one that a classifier would learn
    from noise below and above the threshold; stats.detector() trains one.
    """
    if isinstance(thresholds, DataFrame):
        near = dissimilar(pairs, keys, pos, consensus).filter("dissimilar").join(thresholds, [*keys, "mut"])
        return near.filter(F.col("sample") - F.col("control") > F.col("threshold")).select(*keys, pos, "mut")
    limit = F.lit(thresholds) if isinstance(thresholds, (int, float)) else F.create_map(*(F.lit(x) for kv in thresholds.items() for x in kv))[F.col("mut")]
    return dissimilar(pairs, keys, pos, consensus).filter("dissimilar").filter(F.col("sample") - F.col("control") > limit).select(*keys, pos, "mut")


def add_everywhere(loci: DataFrame, positions: DataFrame, keys: Sequence[str], pos: str = "pos") -> DataFrame:
    """Loci with the positions (knock-in, say) added for every kind."""
    more = positions.select(*keys, pos, F.explode(F.array(*map(F.lit, MUTATIONS))).alias("mut"))
    return loci.select(*keys, pos, "mut").union(more).distinct()


def without(loci: DataFrame, errors: DataFrame, keys: Sequence[str], pos: str = "pos") -> DataFrame:
    return loci.join(errors.select(*keys, pos, "mut").distinct(), [*keys, pos, "mut"], "left_anti")


def merged(one: DataFrame, two: DataFrame, keys: Sequence[str], pos: str = "pos") -> DataFrame:
    return one.select(*keys, pos, "mut").union(two.select(*keys, pos, "mut")).distinct()


def fill_indel_gaps(loci: DataFrame, keys: Sequence[str], pos: str = "pos") -> DataFrame:
    """Gaps between insertion and between deletion loci filled (see windows.fill_gaps); substitutions stay as they are."""
    indels = windows.fill_gaps(loci.filter(F.col("mut").isin("+", "-")), [*keys, "mut"], pos)
    return indels.select(*keys, pos, "mut").union(loci.filter("mut = '*'").select(*keys, pos, "mut")).distinct()


def transpose(loci: DataFrame, keys: Sequence[str], length: int | None = None, pos: str = "pos") -> DataFrame:
    """keys, pos, muts: the sorted kinds at each position; with a length, of every position from 0."""
    sets = loci.groupBy(*keys, pos).agg(F.array_sort(F.collect_set("mut")).alias("muts"))
    if length is None:
        return sets
    every = loci.select(*keys).distinct() if keys else loci.sparkSession.range(1).select()
    every = every.withColumn(pos, F.explode(F.sequence(F.lit(0), F.lit(length - 1))))
    return every.join(sets, [*keys, pos], "left").withColumn("muts", F.coalesce("muts", F.array().cast("array<string>")))


def repeat_spans(bases: DataFrame, keys: Sequence[str], pos: str = "pos", base: str = "base", least: int = 4, letters: str = "ACGTN") -> DataFrame:
    """keys, start, stop (exclusive): runs of one base of at least that length."""
    rows = windows.islands(bases.filter(F.col(base).isin(*letters)), [*keys, base], pos)
    found = rows.groupBy(*keys, base, "island").agg(F.min(pos).alias("start"), (F.max(pos) + 1).alias("stop"))
    return found.filter(F.col("stop") - F.col("start") >= least).select(*keys, "start", "stop")


def repeat_spans_of(rows: DataFrame, keys: Sequence[str], text: str, least: int = 4, letters: str = "ACGTN") -> DataFrame:
    """keys, start, stop (exclusive) of the runs in whole texts; letters: as in a regular expression's brackets. keys are unique.

    Runs are marked within the text, and only what lies between marks is counted: a row a run, not a row a letter.
    """
    mark = "\0"
    marked = F.regexp_replace(F.translate(text, mark, "\1"), rf"([{letters}])\1{{{least - 1},}}", f"{mark}$0{mark}")
    pieces = rows.select(*keys, F.posexplode(F.transform(F.split(marked, mark), F.length)).alias("_k", "_n"))
    stop = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_k"))
    return pieces.withColumn("stop", stop).filter("_k % 2 = 1").select(*keys, (F.col("stop") - F.col("_n")).cast("int").alias("start"), F.col("stop").cast("int").alias("stop"))


def homopolymer_errors(pairs: DataFrame, spans: DataFrame, loci: DataFrame, keys: Sequence[str], pos: str = "pos") -> DataFrame:
    """keys, pos, mut in runs whose sample and control look alike (cosine over 0.8): sequencing errors, with the place after the run.

    Runs with loci on both sides are left out. A control value of 3 or more is taken as the sample's.
    """
    has = loci.select(*keys, F.col(pos).alias("_p")).distinct()
    before = spans.join(has.withColumn("start", F.col("_p") + 1).drop("_p"), [*keys, "start"], "left_semi").select(*keys, "start", "stop")
    both = before.join(has.withColumn("stop", F.col("_p") - 1).drop("_p"), [*keys, "stop"], "left_semi")
    spans = spans.join(both, [*keys, "start", "stop"], "left_anti").withColumn("_pos", F.explode(F.sequence("start", F.expr("stop - 1"))))
    rows = pairs.withColumn("_pos", F.col(pos)).join(spans, [*keys, "_pos"]).withColumn("_c", F.when(F.col("control") >= 3, F.col("sample")).otherwise(F.col("control")))
    cosine = F.try_divide(F.sum(F.col("sample") * F.col("_c")), F.sqrt(F.sum(F.col("sample") * F.col("sample")) * F.sum(F.col("_c") * F.col("_c"))))
    alike = rows.groupBy(*keys, "mut", "start", "stop").agg(cosine.alias("_cos")).filter(F.col("_cos") > 0.8)
    return alike.select(*keys, "mut", F.explode(F.sequence("start", "stop")).alias(pos)).distinct()


def _by_kind(rows: DataFrame, keys: Sequence[str], pos: str, wanted: Callable[[pd.DataFrame], np.ndarray]) -> DataFrame:
    """keys, pos, mut of the positions that a function of a key's rows of one kind (a row a position) picks."""
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (*keys, pos, "mut"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf.sort_values(pos, kind="stable")
        return own[wanted(own)][[*keys, pos, "mut"]]

    return rows.groupBy(*keys, "mut").applyInPandas(run, schema)


def insample_errors(percents: DataFrame, keys: Sequence[str], sigma: float = 2.0, n_train: int = 150, pos: str = "pos") -> DataFrame:
    """keys, pos, mut where a sample's own percents leave the band that a Gaussian process finds at both ends of the sequence."""
    from ampliqua.operators.stats import gaussian_process_outliers

    def wanted(own: pd.DataFrame) -> np.ndarray:
        values = np.zeros(int(own[pos].max()) + 1)
        values[own[pos]] = own["pct"]
        return np.isin(own[pos].to_numpy(), gaussian_process_outliers(values, n_train, sigma=sigma))

    return _by_kind(percents.select(*keys, pos, "mut", "pct"), keys, pos, wanted)


def network_anomalies(pairs: DataFrame, keys: Sequence[str], limit: float = 0.1, pos: str = "pos", consensus: bool = False) -> DataFrame:
    """As anomalies(), by a small network trained on each kind's control values with noise below and above the threshold."""
    from ampliqua.operators.stats import detect, detector

    def wanted(own: pd.DataFrame) -> np.ndarray:
        sample, control = own["sample"].to_numpy(float), own["control"].to_numpy(float)
        return detect(detector(control, limit), sample, control) & own["dissimilar"].to_numpy(bool)

    return _by_kind(dissimilar(pairs, keys, pos, consensus).select(*keys, pos, "mut", "sample", "control", "dissimilar"), keys, pos, wanted)


def strand_counts(reads: DataFrame, loci: DataFrame, keys: Sequence[str], tokens: str = "tokens") -> DataFrame:
    """keys, pos, mut, plus, minus: reads of each strand that show the mutation; only loci are exploded."""
    at = loci.groupBy(*keys).agg(F.collect_set(F.struct("pos", "mut")).alias("_loci"))
    rows = reads.join(F.broadcast(at) if keys else at, list(keys)) if keys else reads.crossJoin(at)  # one row a key
    each = rows.select(*keys, "strand", tokens, F.explode("_loci").alias("_l")).filter(F.get(F.col(tokens), F.col("_l.pos")).startswith(F.col("_l.mut")))
    return each.groupBy(*keys, F.col("_l.pos").alias("pos"), F.col("_l.mut").alias("mut")).agg(F.count_if(F.col("strand") == "+").alias("plus"), F.count_if(F.col("strand") == "-").alias("minus"))


def ratio_biased(plus: Column, minus: Column, low: float = 0.2, high: float = 0.8) -> Column:
    """The share of plus reads isn't strictly between low and high."""
    share = F.try_divide(plus, plus + minus)
    return F.coalesce(~((share > low) & (share < high)), F.lit(False))


def knockin_loci(aligned: DataFrame, keys: Sequence[str], tokens: str = "tokens") -> DataFrame:
    """keys, pos: where the control, aligned to an allele, shows deletions: what the allele has more."""
    return explode_tokens(aligned, keys, tokens).filter(F.col("tok").startswith("-")).select(*keys, "pos")


def onehot_percent(positions: DataFrame, keys: Sequence[str], pos: str = "pos", tok: str = "tok") -> DataFrame:
    """keys, pos, mut, p: mutations per match at each position, 0 where nothing matches."""
    t = F.col(tok)
    counts = positions.groupBy(*keys, pos).agg(F.count_if(t.startswith("=")).alias("match"), *(F.count_if(t.startswith(op)).alias(n) for op, n in (("+", "ins"), ("-", "del"), ("*", "sub"))))
    each = F.explode(F.array(*(F.struct(F.lit(op).alias("mut"), F.col(n).alias("n")) for op, n in (("+", "ins"), ("-", "del"), ("*", "sub")))))
    return counts.select(*keys, pos, "match", each.alias("x")).select(*keys, pos, "x.mut", F.when(F.col("match") > 0, F.col("x.n") / F.col("match")).otherwise(0.0).alias("p"))


def mask_weights(percents: DataFrame, limit: float = 0.5) -> DataFrame:
    """percents with weight: 0 for what most reads show, else the share itself."""
    return percents.withColumn("weight", F.when(F.col("p") > limit, 0.0).otherwise(F.col("p")))


def masked_sums(positions: DataFrame, weights: DataFrame, read: str, pos: str = "pos", tok: str = "tok") -> DataFrame:
    """read, mut, value: each read's mutations summed by weight."""
    shown = positions.withColumn("mut", K.operator(F.col(tok))).filter(F.col("mut").isin(*MUTATIONS))
    return shown.join(F.broadcast(weights), [pos, "mut"]).groupBy(read, "mut").agg(F.sum("weight").alias("value"))


def _spread(df: DataFrame, keys: Sequence[str], every: DataFrame) -> DataFrame:
    """df, which may lack some of the keys, for each of their values: of a few labels an allele."""
    have = [k for k in keys if k in df.columns]
    return df if len(have) == len(keys) else df.join(F.broadcast(every), have)


def locus_pipeline(sample: DataFrame, control: DataFrame, sequence: DataFrame, keys: Sequence[str], knockin: DataFrame | None = None, thresholds: dict[str, float] | float | None = 0.1, consensus: bool = False) -> DataFrame:
    """keys, pos, muts: mutation loci of a sample's token table against its control's. sequence: keys, pos, base of the alleles.

    Control, sequence and knockin may lack keys that only the sample has (labels). thresholds: None takes them from the data.
    """
    from ampliqua.operators.stats import data_thresholds, strand_biased_loci

    every = sample.select(*keys).distinct()
    known = [k for k in keys if k in control.columns]
    # both are used several times below, and have a row a position and kind
    pairs = materialize(against_control(profile(sample, keys), _spread(profile(control, known), keys, every), keys), "pairs")
    loci = anomalies(pairs, keys, data_thresholds(pairs, keys) if thresholds is None else thresholds, consensus=consensus)
    if knockin is not None:
        loci = add_everywhere(loci, _spread(knockin, keys, every), keys)
    loci = materialize(loci, "candidates")
    spans = repeat_spans(sequence, [k for k in keys if k in sequence.columns])
    errors = homopolymer_errors(pairs, _spread(spans, keys, every), loci, keys)
    loci = without(without(loci, errors, keys), strand_biased_loci(sample, loci, keys), keys)
    return transpose(fill_indel_gaps(loci, keys), keys)


def rank_first(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_k = 1").drop("_k")
