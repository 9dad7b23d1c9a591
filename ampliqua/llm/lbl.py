"""Language-model scores: an exact smoothed unigram base, and a log-bilinear model trained with noise contrast.

Corpus counts cover every training token: each task counts its words, the counts are summed by word. Words are 64-bit
hashes. For scoring, the commonest words (a bounded number) are sent to all tasks; the rest of a text's words are joined
to their counts, so no shuffle carries a common word.

Every word has a class, so every token of every text is predicted from its context: the commonest words are a class each,
the others are dealt by their endings (the commonest last three bytes, else the commonest last two, else one class for the
rest), and 'end' is a class. The model predicts the next class from the two before it: the sum of their vectors, weighted
by position, times each class's vector, plus its bias. It is trained in numpy on all training texts, in shards by a hash of
their content (half of them in each of two rounds), by noise-contrastive estimation on the counted n-grams of each block;
after a round the shards' results are averaged by tokens. So a table gives the same scores however it is split. Normalisers of all contexts come from batched matrix products. Within its class a word
has its smoothed share of the class's count.

Defined results: a null or empty text is just the end token; a null id is not held out; without training texts every token
has the base probability 1; repeated rows each get a row; extra columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ampliqua.llm.common import arrow_type, blobs, crc_mod, freed, record_batch, repo_on_workers, stored, word_hashes

#: Folds by crc32 of the id as text, and the one that is not learned from.
FOLDS, HELD_OUT = 5, 1
#: Words sent to all tasks at most; classes of a word each, of three last bytes and of two; size of vectors.
HOT_WORDS, OWN, LAST_THREE, LAST_TWO, SIZE = 300_000, 254, 512, 256, 24
#: Training: rounds of averaging, n-grams of a step, noise classes, rate, largest weight of an n-gram.
ROUNDS, STEP, NOISE, RATE, HEAVIEST = 2, 192, 24, 0.5, 16
#: Passes over the n-grams of a block.
PASSES = 1
#: Training tokens of a shard, about, and of a block whose n-grams are counted together.
SHARD_TOKENS, BLOCK_TOKENS = 2_000_000, 1 << 20
_END, _OTHER = 0, 1


def words_and_endings(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of several texts: hashes of their words, the last three bytes of each as a number, and the words of each text."""
    each = [word_hashes(t) for t in texts]
    data = np.frombuffer(bytes(8) + b"\n".join(texts).lower() + b"\n", np.uint8)
    solid = np.concatenate([[False] * 8, (data[8:] != 32) & ((data[8:] < 9) | (data[8:] > 13))])
    ends = np.flatnonzero(solid[:-1] & ~solid[1:]) + 1
    starts = np.flatnonzero(solid[1:] & ~solid[:-1]) + 1
    last = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))[ends - 8] >> np.uint64(40)
    short = np.array([24, 16, 8, 0], np.uint64)[np.minimum(ends - starts, 3)]
    return np.concatenate(each) if each else np.zeros(0, np.uint64), (last >> short).astype(np.int32), np.array(list(map(len, each)), np.int64)


def last_two(ending: np.ndarray) -> np.ndarray:
    """The last two bytes, of three."""
    return np.where(ending >= 1 << 16, ending >> 8, ending)


def _held(column: str) -> Column:
    return F.coalesce(crc_mod(F.col(column), FOLDS) == HELD_OUT, F.lit(False))


def count_words(docs: DataFrame) -> DataFrame:
    """word, ending, c: how often each word stands in the rows of (held_out, _text) that aren't held out."""

    @freed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([("word", pa.int64()), ("ending", pa.int32()), ("c", pa.int64())])
        for batch in batches:
            hashes, endings, _ = words_and_endings(blobs(batch.column(0)))
            words, at, counts = np.unique(hashes, return_index=True, return_counts=True)
            yield record_batch(out, [words.view(np.int64), endings[at], counts])

    rows = docs.filter(~F.col("held_out")).select("_text").mapInArrow(run, "word long, ending int, c long")
    return rows.groupBy("word").agg(F.min("ending").alias("ending"), F.sum("c").alias("c"))


def hot_words(vocabulary: DataFrame, most: int = HOT_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The commonest words by bins of the count's logarithm, as many bins as hold `most` words; sorted by word."""
    size = F.floor(F.log2(F.col("c").cast("double")) * 8)
    bins = sorted((tuple(r) for r in vocabulary.groupBy(size.alias("b")).count().collect()), reverse=True)  # a few hundred at most
    low, total = None, 0
    for b, n in bins:
        total += n
        if total > most:
            break
        low = b
    if low is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found = vocabulary.filter(size >= low).select("word", "c").toArrow()
    word, c = (found.column(k).to_numpy().astype(np.int64) for k in ("word", "c"))
    order = np.argsort(word)
    return word[order], c[order]


class Classes:
    """The classes of words: 'end', 'other', one for each of some words, of some triples and some pairs of last bytes."""

    def __init__(self, words: list[tuple[int, int]], three: list[tuple[int, int, int]], two: list[tuple[int, int, int]], n_ends: int, other: tuple[int, int]) -> None:
        """words: (word, count); three, two: (ending, count, different words); other: count and different words."""
        self.words, self.n_own = np.array([w for w, _ in words], np.int64), len(words)
        self.three, self.three_number = self._sorted([e for e, _, _ in three], 2 + len(words))
        self.two = np.full(1 << 16, _OTHER, np.uint16)
        self.two[[e for e, _, _ in two]] = 2 + len(words) + len(three) + np.arange(len(two))
        self.counts = np.array([n_ends, other[0], *(c for _, c in words), *(c for _, c, _ in three), *(c for _, c, _ in two)], np.float64)
        different = np.array([0, other[1], *(1 for _ in words), *(n for _, _, n in three), *(n for _, _, n in two)], np.float64)
        #: What the logarithm of a word's count is reduced by within its class: nothing where the class is the word.
        self.within = np.log10(self.counts + 0.5 * (different + 1))
        self.within[[_END, *range(2, 2 + len(words))]] = 0.0

    @staticmethod
    def _sorted(keys: list[int], first: int) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(keys, kind="stable")
        return np.array(keys, np.int64)[order], (first + order).astype(np.uint16)

    def by_ending(self, ending: np.ndarray) -> np.ndarray:
        """Classes of words that aren't classes of their own."""
        out = self.two[last_two(ending)]
        if len(self.three):
            at = np.minimum(np.searchsorted(self.three, ending), len(self.three) - 1)
            out = np.where(self.three[at] == ending, self.three_number[at], out)
        return out


def choose_classes(vocabulary: DataFrame, hot: tuple[np.ndarray, np.ndarray], n_words: int, distinct: int, n_ends: int) -> Classes:
    """Classes by the counts of all training words; only a bounded number of rows comes to the driver."""
    top = np.lexsort((hot[0], -hot[1]))[:OWN]
    words = [(int(hot[0][k]), int(hot[1][k])) for k in top]
    rest = vocabulary.filter(~F.col("word").isin([w for w, _ in words])) if words else vocabulary
    sums = [F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")]
    best = lambda df, key, most: [tuple(r) for r in df.groupBy(key).agg(*sums).orderBy(F.desc("c"), key).limit(most).collect()]
    three = best(rest, "ending", LAST_THREE)
    pair = F.when(F.col("ending") >= 1 << 16, F.shiftright("ending", 8)).otherwise(F.col("ending"))
    two = best((rest.filter(~F.col("ending").isin([e for e, _, _ in three])) if three else rest).withColumn("pair", pair), "pair", LAST_TWO)
    other = (n_words - sum(c for _, c in words) - sum(c for _, c, _ in three + two), distinct - len(words) - sum(n for _, _, n in three + two))
    return Classes(words, three, two, n_ends, other)


class Model:
    """Vectors of context classes, weights of the two positions, vectors and biases of the classes to predict."""

    def __init__(self, counts: np.ndarray, seed: int = 1) -> None:
        rng, n = np.random.default_rng(seed), len(counts)
        self.noise = (counts + 1.0) / (counts + 1.0).sum()
        self.context = rng.normal(0, 0.1, (n, SIZE)).astype(np.float32)
        self.place = np.full((2, SIZE), 0.5, np.float32)
        self.target = rng.normal(0, 0.1, (n, SIZE)).astype(np.float32)
        self.bias = np.log(self.noise).astype(np.float32)

    def parts(self) -> list[np.ndarray]:
        return [self.context, self.place, self.target, self.bias]

    def pack(self) -> bytes:
        return np.concatenate([p.ravel() for p in self.parts()]).tobytes()

    def unpack(self, data: bytes) -> None:
        flat, at = np.frombuffer(data, np.float32), 0
        for p in self.parts():
            p[...] = flat[at : at + p.size].reshape(p.shape)
            at += p.size

    def predicted(self, before: np.ndarray) -> np.ndarray:
        """Vectors predicted from pairs of classes (the nearer one first)."""
        return self.context[before[:, 0]] * self.place[0] + self.context[before[:, 1]] * self.place[1]

    def _margins(self, near: np.ndarray, far: np.ndarray, target: np.ndarray, word: np.ndarray, drawn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Predicted vectors; by how much each example, and each noise class after its context, is likelier than as noise."""
        q, level = near * self.place[0] + far * self.place[1], self.bias - np.log(len(drawn) * self.noise).astype(self.bias.dtype)
        own = np.einsum("ij,ij->i", q, target) + level[word]
        return q, np.clip(own, -30, 30), np.clip(q @ self.target[drawn].T + level[drawn], -30, 30)

    def contrast(self, before: np.ndarray, word: np.ndarray, weight: np.ndarray, drawn: np.ndarray) -> float:
        """The objective: the weighted logarithm of telling the examples from the noise, and the noise from them."""
        _, own, others = self._margins(self.context[before[:, 0]], self.context[before[:, 1]], self.target[word], word, drawn)
        return float(-(weight * (np.log1p(np.exp(-own)) + np.log1p(np.exp(others)).sum(1))).sum())

    def gradients(self, before: np.ndarray, word: np.ndarray, weight: np.ndarray, drawn: np.ndarray) -> list[np.ndarray]:
        """Of the objective, by each of the parts."""
        n, m = len(self.noise), len(word)
        near, far, target, noise = self.context[before[:, 0]], self.context[before[:, 1]], self.target[word], self.target[drawn]
        q, own, others = self._margins(near, far, target, word, drawn)
        own = weight / (1 + np.exp(own))
        np.exp(-others, out=others)
        others += 1
        np.divide(-weight[:, None], others, out=others)
        dq = own[:, None] * target + others @ noise
        moved = np.concatenate([own[:, None] * q, others.T @ q])
        d_target = _rows(np.concatenate([word, drawn]), moved, n)
        d_bias = np.bincount(word, own, n).astype(self.bias.dtype)
        np.add.at(d_bias, drawn, others.sum(0))
        both = np.empty((2 * m, dq.shape[1]), dq.dtype)
        np.multiply(dq, self.place[0], out=both[:m])
        np.multiply(dq, self.place[1], out=both[m:])
        d_context = _rows(np.concatenate([before[:, 0], before[:, 1]]), both, n)
        return [d_context, np.stack([np.einsum("ij,ij->j", dq, near), np.einsum("ij,ij->j", dq, far)]), d_target, d_bias]

    def train(self, before: np.ndarray, word: np.ndarray, weight: np.ndarray, passes: int = 1, seed: int = 2, sums: list[np.ndarray] | None = None) -> list[np.ndarray]:
        """Noise-contrastive estimation with Adagrad, whose sums of squares it gives back; each step's examples share the noise."""
        rng, sums = np.random.default_rng(seed), sums or [np.full(p.shape, 1e-2, np.float32) for p in self.parts()]
        share = np.cumsum(self.noise)
        for _ in range(passes):
            order = rng.permutation(len(word))
            for at in range(0, len(order), STEP):
                k = order[at : at + STEP]
                g = weight[k].astype(np.float32)
                drawn = np.searchsorted(share, rng.random(NOISE) * share[-1], "right")
                for p, s, d in zip(self.parts(), sums, self.gradients(before[k], word[k], g / g.sum(), drawn), strict=True):
                    step = d * d
                    s += step
                    np.sqrt(s, out=step)
                    np.divide(d, step, out=step)
                    step *= np.float32(RATE)
                    p += step
        return sums

    def normalisers(self) -> np.ndarray:
        """Logarithms of the sums over all classes, for every pair of context classes."""
        n = len(self.noise)
        out = np.empty((n, n), np.float32)
        for a in range(n):
            q = self.context[a] * self.place[0] + self.context * self.place[1]
            z = q @ self.target.T + self.bias
            top = z.max(axis=1, keepdims=True)
            out[a] = (np.log(np.exp(z - top).sum(axis=1)) + top[:, 0])
        return out

    def log_probabilities(self, before: np.ndarray, word: np.ndarray, normalisers: np.ndarray) -> np.ndarray:
        """Natural logarithms, of each class after its pair."""
        out = np.empty(len(word), np.float64)
        for at in range(0, len(word), 1 << 16):
            b, w = before[at : at + (1 << 16)], word[at : at + (1 << 16)]
            out[at : at + (1 << 16)] = np.einsum("ij,ij->i", self.predicted(b), self.target[w]) + self.bias[w] - normalisers[b[:, 0], b[:, 1]]
        return out


def _rows(index: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of the values by row number."""
    out = np.zeros((n, values.shape[1]), values.dtype)
    if len(index):
        order = np.argsort(index.astype(np.uint16), kind="stable")  # a radix sort; there are at most 1,024 classes
        index = index[order]
        starts = np.concatenate([[0], np.flatnonzero(np.diff(index)) + 1])
        out[index[starts]] = np.add.reduceat(values[order], starts, axis=0)
    return out


def contexts(tokens: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each token of texts in a row: the two tokens before it in its text, 'end' where there is none."""
    before = np.full((len(tokens), 2), _END, np.int64)
    if len(tokens) > 1:
        place = np.arange(len(tokens)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        before[1:, 0] = np.where(place[1:] >= 1, tokens[:-1], _END)
        before[2:, 1] = np.where(place[2:] >= 2, tokens[:-2], _END)
    return before


def _tokens(docs: DataFrame, hot: tuple[np.ndarray, np.ndarray], classes: Classes) -> DataFrame:
    """Per row: its number, classes of its tokens (with the end), sums over hot words, other words with their counts."""
    id_type = docs.schema["doc_id"].dataType
    names = [("row", T.LongType()), ("doc_id", id_type), ("held_out", T.BooleanType()), ("n_tokens", T.LongType()), ("hot_known", T.LongType()), ("hot_sum", T.DoubleType()), ("own_sum", T.DoubleType()), ("within", T.DoubleType()), ("ids", T.BinaryType()), ("words", T.ArrayType(T.LongType())), ("times", T.ArrayType(T.IntegerType()))]
    schema = T.StructType([T.StructField(*x) for x in names])
    out = pa.schema([(f.name, arrow_type(f.dataType)) for f in schema])
    spark = docs.sparkSession
    own = np.zeros(len(hot[0]), np.uint16)  # the class of a word that is one
    own[np.searchsorted(hot[0], classes.words)] = np.arange(2, 2 + classes.n_own)
    sent = spark.sparkContext.broadcast((hot[0], hot[1], own, classes))

    @freed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done = TaskContext.get().partitionId() << 33, 0
        keys, counts, own_class, by = sent.value
        logs = np.log10(counts + 0.5)
        for batch in batches:
            hashes, endings, n = words_and_endings(blobs(batch.column(2)))
            words, m = hashes.view(np.int64), len(n)
            doc = np.repeat(np.arange(m), n)
            at = np.minimum(np.searchsorted(keys, words), max(len(keys) - 1, 0))
            is_hot = keys[at] == words if len(keys) else np.zeros(len(words), bool)
            value = np.where(is_hot, logs[at], 0.0) if len(keys) else np.zeros(len(words))
            alone = np.where(is_hot, own_class[at], 0) if len(keys) else np.zeros(len(words), np.uint16)
            ids = np.where(alone > 0, alone, by.by_ending(endings)).astype(np.uint16)
            ends = np.cumsum(n)
            cold = np.flatnonzero(~is_hot)
            order = cold[np.lexsort((words[cold], doc[cold]))]
            w, d = words[order], doc[order]
            starts = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (d[1:] != d[:-1])])) if len(w) else np.zeros(0, np.int64)
            times = np.diff(np.concatenate([starts, [len(w)]])).astype(np.int32)
            offsets = np.concatenate([[0], np.cumsum(np.bincount(d[starts], minlength=m))]).astype(np.int32)
            yield record_batch(
                out,
                [
                    part | (done + np.arange(m)),
                    batch.column(0),
                    batch.column(1),
                    n + 1,
                    np.bincount(doc, is_hot, m).astype(np.int64),
                    np.bincount(doc, value, m),
                    np.bincount(doc, value * (alone > 0), m),
                    np.bincount(doc, by.within[ids], m),
                    [np.append(ids[e - k : e], np.uint16(_END)).tobytes() for e, k in zip(ends, n, strict=True)],
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(w[starts])).cast(out.field(9).type),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(times)).cast(out.field(10).type),
                ],
            )
            done += m

    return docs.select("doc_id", "held_out", "_text").mapInArrow(run, schema)


def _batch_tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data = column.to_pylist()
    return np.frombuffer(b"".join(data), np.uint16).astype(np.int64), np.array([len(x) // 2 for x in data], np.int64)


def _learned(own: Model, texts: list[np.ndarray], seed: int, sums: list[np.ndarray] | None) -> tuple[list[np.ndarray] | None, int]:
    """Trains on the counted n-grams of these texts; Adagrad's sums, and the steps made."""
    n, ids, lengths = len(own.noise), np.concatenate(texts).astype(np.int64), np.array(list(map(len, texts)), np.int64)
    before = contexts(ids, lengths)
    grams, counts = np.unique((before[:, 0] * n + before[:, 1]) * n + ids, return_counts=True)
    times = -(-counts // HEAVIEST)  # a common n-gram is several examples, lest one step be all its
    every, weight = np.repeat(grams, times), np.repeat(counts / times, times)
    sums = own.train(np.stack([every // (n * n), every // n % n], axis=1), every % n, weight, PASSES, seed, sums)
    return sums, PASSES * -(-len(every) // STEP)


def train_model(tokens: DataFrame, model: Model, n_tokens: int, rounds: int = ROUNDS, shard_tokens: int = SHARD_TOKENS, block_tokens: int = BLOCK_TOKENS) -> Model:
    """A model is trained on each shard of the texts (ids), in each round on other ones; shards are averaged by their tokens.

    Shards, rounds and the order of texts follow from a hash of the texts' ids, the number of shards from n_tokens (of
    training), and averages are summed in the order of shards: so the same rows give the same model, however they are split.
    """
    spark, shards = tokens.sparkSession, max(1, round(n_tokens / shard_tokens))
    groups = max(1, round(shards**0.5))
    kind = "shard long, parts binary, n double"
    out = pa.schema([("shard", pa.int64()), ("parts", pa.binary()), ("n", pa.float64())])

    @freed
    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, own, sums, steps, total, texts, filled = None, None, None, 0, 0, [], 0

        def done() -> pa.RecordBatch:
            nonlocal sums
            if texts:
                sums, _ = _learned(own, texts, 2 + steps + (shard << 20), sums)
            return record_batch(out, [[shard], [own.pack()], [float(total)]])

        for batch in batches:
            for now, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if now != shard:
                    if shard is not None:
                        yield done()
                    shard, own, sums, steps, total, texts, filled = now, pickle.loads(pickle.dumps(sent.value)), None, 0, 0, [], 0
                texts.append(np.frombuffer(data, np.uint16))
                total, filled = total + len(texts[-1]), filled + len(texts[-1])
                if filled >= block_tokens:
                    sums, made = _learned(own, texts, 2 + steps + (shard << 20), sums)
                    steps, texts, filled = steps + made, [], 0
        if shard is not None:
            yield done()

    @freed
    def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, total, weight = None, None, 0.0
        for batch in batches:
            for shard, data, w in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard % groups != group and group is not None:
                    yield record_batch(out, [[group], [(total / weight).astype(np.float32).tobytes()], [weight]])
                    total, weight = None, 0.0
                group = shard % groups
                part = np.frombuffer(data, np.float32).astype(np.float64) * w
                total, weight = part if total is None else total + part, weight + w
        if total is not None:
            yield record_batch(out, [[group], [(total / weight).astype(np.float32).tobytes()], [weight]])

    h = F.xxhash64("ids")
    rows = tokens.filter(~F.col("held_out")).select("ids", h.alias("h"), F.pmod(h, F.lit(rounds)).alias("turn"), F.pmod(F.shiftright(h, 8), F.lit(shards)).alias("shard"))
    for turn in range(rounds):
        sent = spark.sparkContext.broadcast(model)
        dealt = rows.filter(F.col("turn") == turn).select("shard", "ids", "h").repartition(2 * shards, "shard").sortWithinPartitions("shard", "h", "ids")
        found = dealt.select("shard", "ids").mapInArrow(learn, kind)
        found = found.withColumn("_g", F.col("shard") % groups).repartition(groups, "_g").sortWithinPartitions("_g", "shard").select("shard", "parts", "n").mapInArrow(average, kind).collect()
        if not found:
            continue
        found = sorted(found, key=lambda r: r["shard"])  # a model a group: the root of the number of shards
        total = sum(np.frombuffer(r["parts"], np.float32).astype(np.float64) * r["n"] for r in found)
        model.unpack((total / sum(r["n"] for r in found)).astype(np.float32).tobytes())
    return model


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 probabilities of the text)."""
    spark = docs.sparkSession
    repo_on_workers(spark)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("_text")).withColumn("held_out", _held("doc_id"))
    vocabulary = stored(spark, count_words(docs), "words")
    n_words, distinct = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    n_ends = docs.filter(~F.col("held_out")).count()
    n_all, v_all = n_words + n_ends, distinct + (n_ends > 0)
    hot = hot_words(vocabulary)
    classes = choose_classes(vocabulary, hot, n_words, distinct, n_ends)
    tokens = stored(spark, _tokens(docs, hot, classes), "tokens")
    model = train_model(tokens, Model(classes.counts), n_all)
    sent = spark.sparkContext.broadcast((model, model.normalisers()))
    rest = tokens.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    rest = rest.join(vocabulary, "word", "left").groupBy("row").agg(F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("rest_sum"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("rest_known"))
    out = pa.schema([("row", pa.int64()), ("model_score", pa.float64())])

    @freed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, normalisers = sent.value
        for batch in batches:
            ids, lengths = _batch_tokens(batch.column(1))
            p = own.log_probabilities(contexts(ids, lengths), ids, normalisers)
            yield record_batch(out, [batch.column(0), np.bincount(np.repeat(np.arange(len(lengths)), lengths), p, len(lengths)) / np.log(10)])

    modelled = tokens.select("row", "ids").mapInArrow(run, "row long, model_score double")
    whole = tokens.select("row", "doc_id", "held_out", "n_tokens", "hot_known", "hot_sum", "own_sum", "within").join(modelled, "row").join(rest, "row", "left")
    end = float(np.log10(n_ends + 0.5))
    total = float(np.log10(n_all + 0.5 * (v_all + 1)))
    counts = F.col("hot_sum") + F.coalesce("rest_sum", F.lit(0.0))
    return whole.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("hot_known") + F.coalesce("rest_known", F.lit(0)) + int(n_ends > 0)).alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (counts + end - F.col("n_tokens") * total).alias("base_score"),
        (F.col("model_score") + counts - F.col("own_sum") - F.col("within")).alias("score"),
    )

