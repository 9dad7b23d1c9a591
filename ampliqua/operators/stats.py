"""Statistics that Spark's library lacks, in numpy over small aggregates, and operators that apply them by group."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _tail(x: int, step: int, row: int, col: int, n: int, last: int) -> float:
    """Likelihoods of x, x + step, ... up to last as multiples of x's own, while they matter: they fall, ever faster."""
    total, now, k = 1.0, 1.0, 0
    while x + step * k != last and now > 1e-18 * total:
        at = x + step * np.arange(k, min(k + 4096, abs(last - x)), dtype=float)
        rest = n - row - col
        ratio = (row - at) * (col - at) / ((at + 1) * (rest + at + 1)) if step > 0 else at * (rest + at) / ((row - at + 1) * (col - at + 1))
        terms = now * np.cumprod(ratio)
        total, now, k = total + float(terms.sum()), float(terms[-1]), k + len(at)
    return total


def fisher_exact(a: int, b: int, c: int, d: int) -> float:
    """Two-sided p-value of a 2x2 table: all tables with the same margins that are no likelier.

    Both tails are summed from where they begin, by the ratio of neighbours: time and space follow the spread of the
    distribution (the root of the counts), not the counts.
    """
    n, row, col = a + b + c + d, a + b, a + c
    low, high = max(0, row + col - n), min(row, col)
    if low == high:
        return 1.0
    lg = math.lgamma
    log = lambda x: -(lg(x + 1) + lg(row - x + 1) + lg(col - x + 1) + lg(n - row - col + x + 1))
    mode, most = (row + 1) * (col + 1) // (n + 2), log(a) + 1e-7
    margins = lg(row + 1) + lg(n - row + 1) + lg(col + 1) + lg(n - col + 1) - lg(n + 1)
    if log(mode) <= most:
        return 1.0
    total = 0.0
    for step, end in ((-1, low), (1, high)):
        if log(end) > most:
            continue
        near, far = 0, abs(end - mode)  # the first place beyond the mode that is no likelier
        while far - near > 1:
            mid = (near + far) // 2
            near, far = (near, mid) if log(mode + step * mid) <= most else (mid, far)
        at = mode + step * far
        total += math.exp(log(at) + margins) * _tail(at, step, row, col, n, end)
    return float(min(1.0, total))


@F.pandas_udf(T.DoubleType())
def fisher_udf(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series([fisher_exact(*map(int, r)) for r in zip(a, b, c, d, strict=True)])


def biased(counts: DataFrame, level: float = 0.01) -> DataFrame:
    """counts (plus, minus, all_plus, all_minus) with p_value and biased: the ratio is off and the test says so."""
    from ampliqua.operators.profile import ratio_biased

    p = fisher_udf("plus", "minus", "all_plus", "all_minus")
    return counts.withColumn("p_value", p).withColumn("biased", ratio_biased(F.col("plus"), F.col("minus")) & (F.col("p_value") < level))


def strand_biased_loci(reads: DataFrame, loci: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, pos, mut whose reads' strands differ from those of all reads."""
    from ampliqua.operators.profile import strand_counts

    whole = reads.groupBy(*keys).agg(F.count_if(F.col("strand") == "+").alias("all_plus"), F.count_if(F.col("strand") == "-").alias("all_minus"))
    counts = strand_counts(reads, loci, keys)
    counts = counts.join(F.broadcast(whole), list(keys)) if keys else counts.crossJoin(whole)
    return biased(counts).filter("biased").select(*keys, "pos", "mut")


def strand_biased_labels(rows: DataFrame, baseline: DataFrame, label: str = "label") -> DataFrame:
    """label, biased: of each cluster against the baseline's (all_plus, all_minus, one row)."""
    n = rows.groupBy(label).agg(F.count_if(F.col("strand") == "+").alias("plus"), F.count_if(F.col("strand") == "-").alias("minus"))
    return biased(n.crossJoin(baseline)).select(label, "biased", "p_value")


def two_means(values: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Centres (ascending) and labels of two clusters; in one dimension the exact optimum, else Lloyd's from the extremes."""
    x = np.asarray(values, float)
    if x.ndim == 1 or x.shape[1] == 1:
        flat = x.ravel()
        s = np.sort(flat)
        n = len(s)
        if n < 2 or s[0] == s[-1]:
            return np.array([s[0], s[0]] if n else [0.0, 0.0]), np.zeros(n, int)
        sums, squares = np.cumsum(s), np.cumsum(s * s)
        k = np.arange(1, n)
        cost = squares[k - 1] - sums[k - 1] ** 2 / k + (squares[-1] - squares[k - 1]) - (sums[-1] - sums[k - 1]) ** 2 / (n - k)
        at = int(cost.argmin()) + 1
        centres = np.array([s[:at].mean(), s[at:].mean()])
        return centres, (np.abs(flat - centres[1]) < np.abs(flat - centres[0])).astype(int)
    order = np.argsort(x @ np.linalg.svd(x - x.mean(0), full_matrices=False)[2][0])
    centres = x[order[[0, -1]]]
    labels = np.zeros(len(x), int)
    for _ in range(rounds):
        new = ((x - centres[1]) ** 2).sum(1) < ((x - centres[0]) ** 2).sum(1)
        if (new == labels.astype(bool)).all() and _:
            break
        labels = new.astype(int)
        centres = np.array([x[labels == j].mean(0) if (labels == j).any() else centres[j] for j in (0, 1)])
    order = np.lexsort(centres.T[::-1])
    return centres[order], np.argsort(order)[labels]


def two_centres(values: np.ndarray, times: np.ndarray) -> tuple[float, float]:
    """Centres of the best two clusters of different values that occur so many times each."""
    order = np.argsort(values)
    v, n = np.asarray(values, float)[order], np.asarray(times, float)[order]
    if len(v) < 2:
        return (v[0], v[0]) if len(v) else (0.0, 0.0)
    count, total, square = np.cumsum(n), np.cumsum(n * v), np.cumsum(n * v * v)
    left, rest = (count[:-1], total[:-1], square[:-1]), (count[-1] - count[:-1], total[-1] - total[:-1], square[-1] - square[:-1])
    at = int(sum(q - s * s / c for c, s, q in (left, rest)).argmin())
    return left[1][at] / left[0][at], rest[1][at] / rest[0][at]


def threshold(differences: np.ndarray, least: float = 10.0, times: np.ndarray | None = None) -> float:
    """Between two clusters of sample-control differences: the mean of the centres, at least `least`."""
    return float(max(np.mean(two_centres(differences, np.ones(len(differences)) if times is None else times)), least))


def data_thresholds(pairs: DataFrame, keys: Sequence[str], least: float = 10.0) -> DataFrame:
    """keys, mut, threshold, from pairs (sample, control); equal differences are counted before they meet in a task."""
    fields = ", ".join(f"`{k}` {dict(pairs.dtypes)[k]}" for k in keys)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([[*(pdf[k].iloc[0] for k in keys), pdf["mut"].iloc[0], threshold(pdf["_d"].to_numpy(), least, pdf["_n"].to_numpy())]], columns=[*keys, "mut", "threshold"])

    counted = pairs.groupBy(*keys, "mut", (F.col("sample") - F.col("control")).alias("_d")).agg(F.count(F.lit(1)).alias("_n"))
    return counted.groupBy(*keys, "mut").applyInPandas(run, f"{fields + ', ' if fields else ''}mut string, threshold double")


def local_outlier(train: np.ndarray, test: np.ndarray, neighbours: int = 20, limit: float = 1.5) -> np.ndarray:
    """Whether each test value is an inlier (True) of the one-dimensional training values by its local outlier factor."""
    train, test = np.sort(np.asarray(train, float)), np.asarray(test, float)
    k = min(neighbours, len(train) - 1)
    if k < 1:
        return np.ones(len(test), bool)

    def nearest(x: np.ndarray, own: bool) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(train, x)
        window = np.clip(at[:, None] + np.arange(-k - 1, k + 1), 0, len(train) - 1)
        d = np.abs(train[window] - x[:, None])
        first = np.concatenate([np.ones((len(x), 1), bool), window[:, 1:] != window[:, :-1]], axis=1)
        d = np.where(first, d, np.inf)
        order = np.argsort(d, axis=1, kind="stable")[:, int(own) : k + int(own)]
        return np.take_along_axis(window, order, 1), np.take_along_axis(d, order, 1)

    near, dist = nearest(train, True)
    reach = dist[:, -1]
    density = 1 / (np.maximum(dist, reach[near]).mean(1) + 1e-10)
    near_t, dist_t = nearest(test, False)
    own = 1 / (np.maximum(dist_t, reach[near_t]).mean(1) + 1e-10)
    return density[near_t].mean(1) / own <= limit


def normal_controls(sample: DataFrame, control: DataFrame, read: str = "qname") -> DataFrame:
    """Control reads whose masked sums (read, mut, value) look like the sample's for every kind of mutation."""
    both = sample.select(F.lit(False).alias("c"), F.col(read).cast("string").alias("r"), "mut", "value").union(control.select(F.lit(True), F.col(read).cast("string"), "mut", "value"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        test = pdf[pdf["c"]]
        ok = local_outlier(pdf.loc[~pdf["c"], "value"].to_numpy(), test["value"].to_numpy()) if (~pdf["c"]).any() else np.ones(len(test), bool)
        return pd.DataFrame({"r": test["r"].to_numpy(), "ok": ok})

    judged = both.groupBy("mut").applyInPandas(run, "r string, ok boolean")
    return judged.groupBy(F.col("r").alias(read)).agg(F.every("ok").alias("ok")).filter("ok").select(read)


def gaussian_process_outliers(values: np.ndarray, n_train: int = 150, scale: float = 10.0, noise: float = 5.0, sigma: float = 2.0) -> np.ndarray:
    """Positions outside mean +- sigma deviations of a Gaussian process fitted to both ends of the sequence."""
    y = np.asarray(values, float)
    if len(y) <= 2 * n_train:
        return np.zeros(0, int)
    train = np.concatenate([y[:n_train], y[-n_train:]])
    mean, spread = train.mean(), train.std() or 1.0
    x, at = np.arange(len(train), dtype=float), np.arange(len(y), dtype=float)
    kernel = lambda a, b: np.exp(-0.5 * ((a[:, None] - b[None, :]) / scale) ** 2)
    inverse = np.linalg.inv(kernel(x, x) + noise * np.eye(len(x)))
    cross = kernel(at, x)
    centre = cross @ inverse @ ((train - mean) / spread) * spread + mean
    deviation = np.sqrt(np.maximum(1 + noise - np.einsum("ij,jk,ik->i", cross, inverse, cross), 0)) * spread
    return np.flatnonzero(np.abs(y - centre) > sigma * deviation)


def silhouette(x: np.ndarray, labels: np.ndarray) -> float:
    """Exact mean silhouette with Euclidean distances, row blocks at a time."""
    x, labels = np.asarray(x, float), np.asarray(labels)
    kinds, where = np.unique(labels, return_inverse=True)
    if len(kinds) < 2:
        return -1.0
    size, total = np.bincount(where), 0.0
    square = (x * x).sum(1)
    for at in range(0, len(x), 512):
        d = np.sqrt(np.maximum(square[at : at + 512, None] + square[None, :] - 2 * x[at : at + 512] @ x.T, 0))
        sums = np.stack([d[:, where == j].sum(1) for j in range(len(kinds))], axis=1)
        own, r = where[at : at + 512], np.arange(len(d))
        a = sums[r, own] / np.maximum(size[own] - 1, 1)
        means = sums / size
        means[r, own] = np.inf
        b = means.min(1)
        total += np.where(size[own] == 1, 0, (b - a) / np.maximum(np.maximum(a, b), 1e-300)).sum()
    return float(total / len(x))


def bisecting_means(x: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """Labels of k clusters: the one with the largest spread is split in two until there are k."""
    x, labels = np.asarray(x, float), np.zeros(len(x), int)
    for new in range(1, k):
        spread = [((x[labels == j] - x[labels == j].mean(0)) ** 2).sum() if (labels == j).sum() > 1 else 0 for j in range(new)]
        j = int(np.argmax(spread))
        if not spread[j]:
            break
        rows = np.flatnonzero(labels == j)
        labels[rows[two_means(x[rows])[1] == 1]] = new
    return labels


class Tree:
    """A decision tree grown until its leaves are pure or can't be split: the split with the least Gini impurity, of equal ones the first."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 40) -> None:
        kinds, counts = np.unique(y, return_counts=True)
        self.label, self.feature = kinds[counts.argmax()], -1
        if len(kinds) < 2 or not depth:
            return
        one = (y[:, None] == kinds).astype(float)
        best = np.inf
        for k in range(x.shape[1]):
            order = np.argsort(x[:, k], kind="stable")
            v, left = x[order, k], np.cumsum(one[order], axis=0)[:-1]
            cut = np.flatnonzero(v[1:] > v[:-1])
            if not len(cut):
                continue
            left, right = left[cut], one.sum(axis=0) - left[cut]
            impure = (left.sum(1) - (left**2).sum(1) / left.sum(1)) + (right.sum(1) - (right**2).sum(1) / right.sum(1))
            if impure.min() < best - 1e-12:
                best, at = impure.min(), cut[impure.argmin()]
                self.feature, self.limit = k, (v[at] + v[at + 1]) / 2
        if self.feature >= 0:
            low = x[:, self.feature] <= self.limit
            self.low, self.high = Tree(x[low], y[low], depth - 1), Tree(x[~low], y[~low], depth - 1)

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.label)
        if self.feature >= 0:
            low = x[:, self.feature] <= self.limit
            out[low], out[~low] = self.low.predict(x[low]), self.high.predict(x[~low])
        return out


def damerau_levenshtein(a: str, b: str, limit: int | None = None) -> int:
    """Edit distance with insertions, deletions, substitutions and transpositions of letters that are moved apart later."""
    if limit is not None and abs(len(a) - len(b)) >= limit:
        return abs(len(a) - len(b))
    last: dict[str, int] = {}
    top = len(a) + len(b)
    d = {(-1, -1): top}
    for i in range(len(a) + 1):
        d[i, -1], d[i, 0] = top, i
    for j in range(len(b) + 1):
        d[-1, j], d[0, j] = top, j
    for i in range(1, len(a) + 1):
        match = 0
        for j in range(1, len(b) + 1):
            k, m = last.get(b[j - 1], 0), match
            same = a[i - 1] == b[j - 1]
            if same:
                match = j
            d[i, j] = min(d[i - 1, j - 1] + (not same), d[i, j - 1] + 1, d[i - 1, j] + 1, d[k - 1, m - 1] + (i - k - 1) + 1 + (j - m - 1))
        last[a[i - 1]] = i
    return d[len(a), len(b)]


@F.pandas_udf(T.IntegerType())
def edit_distance_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([damerau_levenshtein(x, y) for x, y in zip(a, b, strict=True)], dtype="int32")


def detector(control: np.ndarray, limit: float, seed: int = 1, n: int = 4000, steps: int = 400) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """A small network (one hidden layer) that tells noise below `limit` from mutations above it; weights for detect()."""
    rng = np.random.default_rng(seed)
    base = np.concatenate([rng.uniform(0, 100, n), np.asarray(control, float)])
    x = np.concatenate([np.stack([base, np.clip(base + rng.uniform(0, limit, len(base)), 0, 100)], 1), np.stack([base, np.clip(base + rng.uniform(limit, 100, len(base)), 0, 100)], 1)])
    y = np.repeat([0.0, 1.0], len(base))
    w1, b1, w2, b2 = rng.normal(0, 0.5, (2, 5)), np.zeros(5), rng.normal(0, 0.5, 5), 0.0
    w1[1], w1[0] = np.abs(w1[1]), -np.abs(w1[1])  # begins with differences of the two
    params, m, v = [w1, b1, w2, np.array([b2])], None, None
    z = np.stack([x[:, 0], x[:, 1]], 1) / 10
    for t in range(1, steps + 1):
        h = np.maximum(z @ params[0] + params[1], 0)
        p = 1 / (1 + np.exp(-np.clip(h @ params[2] + params[3][0], -30, 30)))
        g = (p - y) / len(y)
        dh = np.outer(g, params[2]) * (h > 0)
        grads = [z.T @ dh, dh.sum(0), h.T @ g, np.array([g.sum()])]
        m = [0.9 * a + 0.1 * b for a, b in zip(m or [0] * 4, grads, strict=True)]
        v = [0.99 * a + 0.01 * b * b for a, b in zip(v or [0] * 4, grads, strict=True)]
        params = [a - 0.1 * (b / (1 - 0.9**t)) / (np.sqrt(c / (1 - 0.99**t)) + 1e-8) for a, b, c in zip(params, m, v, strict=True)]
    return params[0], params[1], params[2], float(params[3][0])


def detect(model: tuple, sample: np.ndarray, control: np.ndarray) -> np.ndarray:
    w1, b1, w2, b2 = model
    h = np.maximum(np.stack([control, sample], 1) / 10 @ w1 + b1, 0)
    return h @ w2 + b2 > 0
