"""Quality classifier by positive-unlabelled learning.

Trusted positives are texts labelled good; every text counts as unlabelled, whatever its label. A linear model over
whole-text statistics minimises the non-negative unbiased risk pi R_P(+) + max(0, R_U(-) - pi R_P(-)) of the squared loss,
with a ridge. That risk depends on the data through the first and second moments of positives and unlabelled rows alone,
so it is minimised exactly from sums over all rows, which each task adds up for its share. The class prior pi is the least
ratio of unlabelled to positive mass above any score of a positive-against-unlabelled model, from histograms of all rows.

Defined results: null and empty texts are scored (their statistics are zero); a null doc_id is never held out and has no
label; an id with several labels is a positive if one of them is 1; without positives in the training folds every score is
0.5; repeated rows each get a row; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ampliqua.llm.common import arrow_type, blobs, crc_mod, freed, record_batch, repo_on_workers, stored

#: Ridge; bins of the histograms of scores, and the score at their end; ids that are broadcast at most (more are joined by shuffles).
RIDGE, BINS, REACH, BROADCAST_IDS = 0.03, 8192, 8.0, 1_000_000
#: Folds by crc32 of the id as text; labels of the held-out one are never read.
FOLDS, HELD_OUT = 3, 1

_SYMBOLS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_CLASSES = [*([c] for c in _SYMBOLS), list(range(48, 58)), list(range(65, 91)), list(range(97, 123)), [32], [10], list(range(128, 256)), [*range(10), *range(11, 32), 127]]
_MAP = np.zeros((256, len(_CLASSES)))
for _k, _c in enumerate(_CLASSES):
    _MAP[_c, _k] = 1
#: The statistics of a text: shares of character classes, then words and lines.
N_FEATURES = 2 * len(_CLASSES) + 9


def features(data: bytes) -> np.ndarray:
    """Statistics of a whole text, each of them in a bounded range."""
    out = np.zeros(N_FEATURES, np.float32)
    n = len(data)
    if not n:
        return out
    share = (np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ _MAP) / n
    words, lines = data.split(), data.split(b"\n")
    k = len(_CLASSES)
    out[:k] = np.log1p(1000 * share)
    out[k : 2 * k] = np.sqrt(share)
    m = len(words)
    if m:
        letters = n - int(data.count(b" ")) - len(lines) + 1
        longest = max(map(len, words))
        out[2 * k :] = [
            np.log1p(m) / 10,
            np.log1p(letters / m),
            len(set(words)) / m,
            np.log1p(m) * (1 - len(set(words)) / m),
            len(set(lines)) / len(lines),
            np.log1p(len(lines)) / 10,
            np.log1p(n / len(lines)) / 10,
            np.log1p(longest) / 10,
            len(set(zip(words[::2], words[1::2]))) / max(1, m // 2),  # noqa: B905  an odd last word has no partner
        ]
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """About 2 p - 1 for the probability p of being good: the least squared loss lies there."""
        return extended(x, self.mean, self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(2 * self.margin(x), -60, 60)))


def extended(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Scaled, within four deviations (lest a text of one word, say, outweigh everything by its length alone), and a one."""
    return np.column_stack([np.clip((x - mean) / scale, -4, 4), np.ones(len(x))])


@dataclass
class Moments:
    """Of extended rows: their number, and the sum of each row's products with itself (the last row sums the rows)."""

    n: int
    products: np.ndarray

    @property
    def second(self) -> np.ndarray:
        return self.products / self.n

    @property
    def first(self) -> np.ndarray:
        return self.products[-1] / self.n

    def loss(self, w: np.ndarray, label: int) -> float:
        """Mean squared loss (1 - label * w x)^2 / 4."""
        return float(w @ self.second @ w - 2 * label * (w @ self.first) + 1) / 4


def risk(w: np.ndarray, positive: Moments, unlabelled: Moments, prior: float) -> tuple[float, float]:
    """The two parts of the unbiased risk: of positives, and of negatives (which may come out below zero)."""
    return prior * positive.loss(w, 1), unlabelled.loss(w, -1) - prior * positive.loss(w, -1)


def fit(positive: Moments, unlabelled: Moments, prior: float, ridge: float = RIDGE) -> np.ndarray:
    """Weights that minimise prior R_P(+) + max(0, R_U(-) - prior R_P(-)) + ridge |w|^2 / 2.

    The maximum is that over t in [0, 1] of t times the negative part, and for each t the least is a linear system's
    solution; the best t is 1, or the one where the negative part is zero.
    """
    eye = ridge * np.eye(len(positive.products))

    def least(t: float) -> np.ndarray:
        return np.linalg.solve((1 - t) * prior * positive.second / 2 + t * unlabelled.second / 2 + eye, (prior * (1 + t) * positive.first - t * unlabelled.first) / 2)

    low, high = (1.0, 1.0) if risk(least(1.0), positive, unlabelled, prior)[1] >= 0 else (0.0, 1.0)
    while high - low > 1e-12:
        t = (low + high) / 2
        low, high = (t, high) if risk(least(t), positive, unlabelled, prior)[1] >= 0 else (low, t)
    return least(low)


def against(positive: Moments, unlabelled: Moments, ridge: float = 1e-3) -> np.ndarray:
    """Least squares of positives against unlabelled rows."""
    return np.linalg.solve(positive.second + unlabelled.second + ridge * np.eye(len(positive.products)), positive.first - unlabelled.first)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among the unlabelled, from histograms: the least mass ratio above a score, with a margin for chance.

    The scores tried leave 98 to 30 percent of the positives above them.
    """
    above = lambda h: np.cumsum(h[::-1])[::-1] / h.sum()
    p, u = above(positive), above(unlabelled)
    tried = (p <= 0.98) & (p >= 0.3)
    if not tried.any():
        return 0.99
    p, u = p[tried], u[tried]
    margin = 2.5 * np.sqrt(u * (1 - u) / unlabelled.sum()) + 2.5 * np.sqrt(p * (1 - p) / positive.sum())
    return float(np.clip(((u + margin) / p).min(), 0.01, 0.99))


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """doc_id, x (float32 statistics as bytes) of every row, and row (the value of row_col) if there is one."""
    repo_on_workers(docs.sparkSession)
    names = [("doc_id", id_col)] + ([("row", row_col)] if row_col else [])
    schema = T.StructType([T.StructField("x", T.BinaryType()), *(T.StructField(n, docs.schema[c].dataType) for n, c in names)])
    out = pa.schema([(f.name, arrow_type(f.dataType)) for f in schema])

    @freed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield record_batch(out, [[features(d).tobytes() for d in blobs(batch.column(0))], *batch.columns[1:]])

    return docs.select(F.col(text_col).cast("string").alias("_text"), *(F.col(c).alias(n) for n, c in names)).mapInArrow(run, schema)


def _summed(stats: DataFrame, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray | None:
    """Sum over batches of rows of what part gives for their statistics: by task, then in two steps. None without rows."""
    out = pa.schema([("total", pa.binary())])

    @freed
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if len(batch):
                own = part(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.float32).reshape(-1, N_FEATURES).astype(np.float64))
                total = own if total is None else total + own
        if total is not None:
            yield record_batch(out, [[total.astype(np.float64).tobytes()]])

    @freed
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for data in batch.column(0).to_pylist():
                own = np.frombuffer(data, np.float64)
                total = own if total is None else total + own
        if total is not None:
            yield record_batch(out, [[total.tobytes()]])

    groups = max(1, round(stats.rdd.getNumPartitions() ** 0.5))
    found = stats.select("x").mapInArrow(each, "total binary").repartition(groups).mapInArrow(add, "total binary").repartition(1).mapInArrow(add, "total binary").collect()  # one row
    return np.frombuffer(bytes(found[0]["total"]), np.float64) if found else None


def train(stats: DataFrame, labels: DataFrame, label_col: str = "quality") -> Model | None:
    """The model, from statistics (doc_id, x) and labels (doc_id, 1 where trusted); rows of the held-out fold take no part."""
    spark = stats.sparkSession
    open_ = F.coalesce(crc_mod(F.col("doc_id"), FOLDS) != HELD_OUT, F.lit(False))
    good = labels.filter(open_ & (F.col(label_col) == 1)).select("doc_id").distinct()
    pool = stats.filter(open_)
    positive = stored(spark, pool.join(F.broadcast(good) if good.count() <= BROADCAST_IDS else good, "doc_id", "left_semi"), "positives")
    sums = _summed(pool, lambda x: np.concatenate([[len(x)], x.sum(axis=0), (x * x).sum(axis=0)]))
    if sums is None:
        return None
    mean, square = sums[1:].reshape(2, -1) / sums[0]
    scale = np.sqrt(np.maximum(square - mean * mean, 0)) + 1e-3

    def products(x: np.ndarray) -> np.ndarray:
        z = extended(x, mean, scale)
        return np.concatenate([[len(z)], (z.T @ z).ravel()])

    moments = [None if m is None else Moments(int(m[0]), m[1:].reshape(N_FEATURES + 1, -1)) for m in (_summed(positive, products), _summed(pool, products))]
    if moments[0] is None or moments[1] is None:
        return None
    w = against(*moments)
    bins = lambda x: np.bincount(((np.clip(extended(x, mean, scale) @ w, -REACH, REACH) + REACH) * ((BINS - 1) / (2 * REACH))).astype(int), minlength=BINS).astype(float)
    prior = estimate_prior(_summed(positive, bins), _summed(pool, bins))
    return Model(mean, scale, fit(*moments, prior), prior)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", row_col: str | None = None) -> DataFrame:
    """Per document row: doc_id, held_out, score (probability-like, of being good), predicted (1 from 0.5 on); row if row_col is given."""
    stats = stored(docs.sparkSession, statistics(docs, id_col, text_col, row_col), "statistics")
    model = train(stats, labels, label_col)
    schema = T.StructType([T.StructField("score", T.DoubleType()), *(f for f in stats.schema if f.name != "x")])
    out = pa.schema([(f.name, arrow_type(f.dataType)) for f in schema])

    @freed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.float32).reshape(-1, N_FEATURES)
            yield record_batch(out, [model.score(x.astype(np.float64)) if model else np.full(len(x), 0.5), *batch.columns[1:]])

    held = F.coalesce(crc_mod(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out")
    return stats.select("x", *stats.columns[1:]).mapInArrow(run, schema).select("doc_id", held, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *stats.columns[2:])
