"""Clustering of reads within an allele, and the repair of clusters that only one strand supports.

Equal vectors are counted first, so the tables here hold a row a different vector with its weight; every step is an
aggregate over such a table, and the driver holds centres and moments of clusters alone. No step gathers an allele's reads.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ampliqua.operators.stats import fisher_exact
from ampliqua.session import materialize

#: Weight of all control reads beside a sample's, at most; share of the control that makes a cluster one of its own.
CONTROL_WEIGHT, OWN_SHARE = 1000.0, 0.01
#: Different vectors up to which a table of labels is broadcast to the reads.
BROADCAST_VECTORS = 100_000


@dataclass
class Moments:
    """Of a cluster: weight, that of its control rows, mean, sum of squared lengths."""

    weight: float
    control: float
    mean: np.ndarray
    squares: float

    @property
    def spread(self) -> float:
        """Sum of squared distances from the mean."""
        return max(self.squares - self.weight * float(self.mean @ self.mean), 0.0)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _literal(v: np.ndarray) -> Column:
    return F.lit([float(x) for x in v])


def _distance(v: Column, centre: np.ndarray) -> Column:
    """Squared."""
    return F.aggregate(F.zip_with(v, _literal(centre), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def counted(rows: DataFrame, *sums: Column) -> DataFrame:
    """scores (of doubles), w: how many rows have them; and these sums."""
    return rows.groupBy(F.col("scores").cast("array<double>").alias("scores")).agg(F.count(F.lit(1)).cast("double").alias("w"), *sums)


def moments(rows: DataFrame, by: Column | str = "label") -> dict[int, Moments]:
    """rows: scores, w, control."""
    v = F.col("scores")
    found = rows.groupBy((F.col(by) if isinstance(by, str) else by).alias("label")).agg(
        F.sum("w").alias("w"),
        F.sum(F.when(F.col("control"), F.col("w")).otherwise(0.0)).alias("c"),
        Summarizer.mean(array_to_vector(v), F.col("w")).alias("mean"),
        F.sum(F.col("w") * _dot(v, v)).alias("squares"),
    )
    return {r[0]: Moments(r["w"], r["c"], r["mean"].toArray(), r["squares"]) for r in found.collect()}  # a row a cluster


def halves(rows: DataFrame, mean: np.ndarray, rounds: int = 20) -> tuple[np.ndarray, np.ndarray] | None:
    """Centres of two clusters: Lloyd's rounds from the vector farthest from the mean and the one farthest from it; None if all are equal."""
    v = F.col("scores")
    centres = []
    for origin in range(2):
        d = _distance(v, centres[0] if origin else mean)
        far = rows.agg(F.max(F.struct(d.alias("d"), v)).alias("far")).first()["far"]
        if far is None or not far["d"] > 1e-12:
            return None
        centres.append(np.array(far["scores"]))
    for _ in range(rounds):
        found = moments(rows, (_distance(v, centres[1]) < _distance(v, centres[0])).cast("int"))
        new = [found[k].mean for k in (0, 1)]
        moved = max(float(((a - b) ** 2).sum()) for a, b in zip(new, centres, strict=True))
        centres = new
        if moved <= 1e-12:
            break
    return centres[0], centres[1]


def silhouettes(rows: DataFrame, found: dict[int, Moments]) -> DataFrame:
    """rows (scores, w, label) with silhouette: of squared distances, from the clusters' moments; 0 for a row alone in its cluster and where there is but one."""
    v = F.col("scores")
    if len(found) < 2:
        return rows.withColumn("silhouette", F.lit(0.0))
    own, other = F.lit(0.0), []
    for k, m in sorted(found.items()):
        mean = F.greatest(_dot(v, v) - 2 * _dot(v, _literal(m.mean)) + F.lit(m.squares / m.weight), F.lit(0.0))
        # the mean over a row's own cluster leaves the row itself out
        own = F.when(F.col("label") == k, mean * (m.weight / max(m.weight - 1, 1e-9))).otherwise(own)
        other.append(F.when(F.col("label") != k, mean))
    alone = F.col("label").isin([k for k, m in found.items() if m.weight <= 1])
    each = rows.withColumn("_a", own).withColumn("_b", F.least(*other))
    value = F.when(alone | (F.greatest("_a", "_b") <= 0), 0.0).otherwise((F.col("_b") - F.col("_a")) / F.greatest("_a", "_b"))
    return each.withColumn("silhouette", value).drop("_a", "_b")


def silhouette(rows: DataFrame, found: dict[int, Moments]) -> float:
    """Mean of all rows' silhouettes; -1 for a single cluster."""
    if len(found) < 2:
        return -1.0
    total = silhouettes(rows, found).agg(F.sum(F.col("w") * F.col("silhouette")), F.sum("w")).first()
    return float(total[0] / total[1]) if total[1] else -1.0


def optimise(rows: DataFrame, most: int = 50) -> DataFrame:
    """rows (scores, w, control) with label: bisecting means, a cluster more as long as the silhouette rises and the control stays in one.

    The cluster with the largest spread is split. The control counts as split when more than one cluster holds over 1 % of it.
    """
    best = rows.withColumn("label", F.lit(0))
    found, score = moments(best), -np.inf
    control = sum(m.control for m in found.values())
    for k in range(1, most):
        j = max(found, key=lambda x: (found[x].spread, -x), default=None)
        pair = halves(best.filter(F.col("label") == j), found[j].mean) if j is not None and found[j].spread > 1e-9 else None
        if pair is None:
            break
        v = F.col("scores")
        split = F.when((F.col("label") == j) & (_distance(v, pair[1]) < _distance(v, pair[0])), k).otherwise(F.col("label"))
        new = materialize(best.withColumn("label", split), "split")
        parts = moments(new)
        risen = silhouette(new, parts)
        if risen <= score or sum(m.control > OWN_SHARE * control for m in parts.values()) > 1 and control:
            break
        best, found, score = new, parts, risen
    return best


def control_core(rows: DataFrame) -> DataFrame:
    """The larger of two clusters of control rows (scores, w, control), with a bounded weight in all."""
    whole = moments(rows.withColumn("label", F.lit(0)))
    if not whole:
        return rows
    pair, v, weight = halves(rows, whole[0].mean), F.col("scores"), whole[0].weight
    if pair is not None:
        second = _distance(v, pair[1]) < _distance(v, pair[0])
        sides = moments(rows, second.cast("int"))
        larger = max(sides, key=lambda k: (sides[k].weight, -k))
        rows, weight = rows.filter(second if larger else ~second), sides[larger].weight
    return rows.withColumn("w", F.col("w") * min(1.0, CONTROL_WEIGHT / weight))


def biased(plus: int, minus: int, all_plus: int, all_minus: int) -> bool:
    n = plus + minus
    return bool(n) and not 0.2 < plus / n < 0.8 and fisher_exact(plus, minus, all_plus, all_minus) < 0.01


def repair(rows: DataFrame, all_plus: int, all_minus: int, rounds: int = 1000) -> DataFrame:
    """rows (scores, w, plus, label), vectors of strand-biased clusters labelled by a tree trained on the unbiased ones, until none is left or all are biased."""
    for _ in range(rounds):
        counts = rows.groupBy("label").agg(F.sum("plus").alias("plus"), F.sum("w").alias("n")).collect()  # a row a cluster
        off = {r["label"] for r in counts if biased(int(r["plus"]), int(r["n"] - r["plus"]), all_plus, all_minus)}
        good = sorted({r["label"] for r in counts} - off)
        if not good or not off:
            return rows
        move = F.col("label").isin(sorted(off))
        if len(good) == 1:
            rows = rows.withColumn("label", F.lit(good[0]))
            continue
        number = F.element_at(F.create_map(*(x for k, g in enumerate(good) for x in (F.lit(g), F.lit(float(k))))), F.col("label"))
        model = DecisionTreeClassifier(featuresCol="_x", labelCol="_y", weightCol="w", predictionCol="_p", maxDepth=20, maxBins=256, minInfoGain=0.0, seed=1).fit(
            rows.filter(~move).select(array_to_vector("scores").alias("_x"), number.alias("_y"), "w")
        )
        told = F.get(F.lit(good), F.col("_p").cast("int"))
        made = model.transform(rows.withColumn("_x", array_to_vector("scores"))).withColumn("label", F.when(move, told).otherwise(F.col("label")))
        rows = materialize(made.select(*rows.columns), "repaired")
    return rows


def with_labels(reads: DataFrame, vectors: DataFrame) -> DataFrame:
    """reads (with scores) joined to the labels of their vectors; a table of few vectors is broadcast, so that a common vector is no hot key."""
    few = vectors.select("scores", "label")
    if few.count() <= BROADCAST_VECTORS:
        few = F.broadcast(few)
    return reads.withColumn("scores", F.col("scores").cast("array<double>")).join(few, "scores")


def label_reads(sample: DataFrame, control: DataFrame, baseline: tuple[int, int], allele: str = "allele", read: str = "read_ord") -> DataFrame:
    """read, allele, label (from 0 within the allele). sample, control: allele, scores (array); sample also read and strand.

    An allele without a score other than 0 is one cluster; without control reads nothing bounds the number of clusters but
    the silhouette.
    """
    made = []
    for r in sample.select(allele).distinct().collect():  # an amplicon has a few alleles
        own, other = (df.filter(F.col(allele).eqNullSafe(r[0])) for df in (sample, control))
        plus = F.count_if(F.col("strand") == "+").alias("plus")
        vectors = materialize(counted(own, plus).withColumn("control", F.lit(False)), "vectors")
        if vectors.filter(F.exists("scores", lambda x: x != 0)).limit(1).count():
            core = control_core(materialize(counted(other).select("scores", "w", F.lit(0).cast("long").alias("plus"), F.lit(True).alias("control")), "control-vectors"))
            both = materialize(vectors.unionByName(core), "both-vectors")
            vectors = repair(optimise(both).filter("not control"), *baseline)
        else:
            vectors = vectors.withColumn("label", F.lit(0))
        made.append(with_labels(own, materialize(vectors, "vector-labels")).select(allele, read, F.col("label").cast("int").alias("label")))
    if not made:
        return sample.select(allele, read, F.lit(0).alias("label"))
    whole = made[0]
    for part in made[1:]:
        whole = whole.unionByName(part)
    return whole


def global_labels(labels: DataFrame, allele: str = "allele") -> DataFrame:
    """Labels numbered on from one allele to the next, from 1."""
    groups = labels.select(allele, "label").distinct()
    from pyspark.sql import Window

    ranked = groups.withColumn("_new", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(allele, "label")).cast("int"))  # a row a cluster
    return labels.join(F.broadcast(ranked), [allele, "label"]).drop("label").withColumnRenamed("_new", "label")
