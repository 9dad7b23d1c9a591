"""Spelling variants: all pairs of words at one edit, by errata tries over a heavy-path decomposition.

The different words, sorted by range into parts, are a trie: a node is a run of words with a common prefix, and only the
nodes above the borders between parts lie in several of them. At every node the child with most words is the heavy one. A
word leaves the heavy path at few nodes (the logarithm of the number of words, at most), and there its light subtree is
merged into what stands beside it, small into large, as errata: with the character of its edge skipped (meets words that
lack it), replaced by the heavy one (meets the heavy subtree), with the heavy one put before it (meets words that have it
more), and with any character there (meets the other light subtrees). Two terminals that coincide are a pair of words with
one deletion, insertion or replacement; every pair comes up at one node only, as a deletion within a run of equal characters
is made at the run's end. Terminals meet by a shuffle on their text.

Defined results: a null or empty text has no words; a null doc_id counts as the text `null`; repeated rows count each; no
documents or no words give no rows; extra columns are ignored; texts of any length are read in parts that end at blanks.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ampliqua.llm.common import blobs, freed, repo_on_workers, stored
from ampliqua.llm.wordtable import parts

#: Code points of a word at least; occurrences at least; how many times more frequent a form is than its variant.
LEAST_LENGTH, LEAST_COUNT, RATIO = 7, 2, 10
#: Words of a part of the sorted list, about; words that a task counts before it passes them on; bytes read at once.
PART_WORDS, COUNTED, PART_BYTES = 50_000, 300_000, 4 << 20
#: One in so many occurrences (by a hash of document and word) loses a character.
DAMAGE = 31
#: Kinds of terminals: a word, an errata that looks for a word, one that meets its like.
WORD, LOOK, MEET = 0, 1, 2


def damaged(word: str, prefix_crc: int, damage: int = DAMAGE) -> str:
    """The word, without one code point if the hash of `<doc_id>:<word>` says so."""
    h = zlib.crc32(word.encode(), prefix_crc)
    if h % damage:
        return word
    k = h % len(word)
    return word[:k] + word[k + 1 :]


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, damage: int = DAMAGE) -> DataFrame:
    """word, n: runs of letters (A-Z lower-cased, some of them damaged) of at least so many code points and occurrences."""
    repo_on_workers(docs.sparkSession)
    run_of_letters = re.compile(rf"[a-zÀ-ÿ]{{{least},}}")

    def flush(total: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    @freed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), blobs(batch.column(1)), strict=True):
                start = zlib.crc32(f"{name}:".encode())
                for part in parts(data.lower(), PART_BYTES):  # bytes: only ASCII letters
                    for word, n in Counter(run_of_letters.findall(part.decode())).items():
                        word = damaged(word, start, damage)
                        if len(word) >= least:
                            total[word] += n
                if len(total) >= COUNTED:
                    yield flush(total)
                    total = Counter()
        yield flush(total)

    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def common(a: str, b: str) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low = 0
    while n - low > 1:
        mid = (low + n) // 2
        if a[:mid] == b[:mid]:
            low = mid
        else:
            n = mid
    return low


def light_edges(words: list[str], cut: dict[str, tuple[str, int]]) -> Iterator[tuple[int, int, str, bool]]:
    """Where words leave the heavy path: word's number, depth, heavy character, and whether there are other light children.

    words: sorted and different; cut: heavy child and number of children of each node that also has words elsewhere. A word
    that ends at a node with children comes up with its length as depth.
    """
    stack = [(0, len(words), 0)] if words else []
    while stack:
        low, high, depth = stack.pop()
        first = words[low]
        known = cut.get(first[:depth])
        if known is None:
            if high - low == 1:
                continue
            depth = common(first, words[high - 1])
        prefix, at, children = first[:depth], low, []
        ends_here = len(first) == depth
        at += ends_here
        while at < high:
            c = words[at][depth]
            end = bisect_left(words, prefix + chr(ord(c) + 1), at, high)
            children.append((c, at, end))
            at = end
        heavy, n = known or (max(children, key=lambda x: x[2] - x[1])[0], len(children))
        if ends_here and heavy:
            yield low, depth, heavy, False
        for c, begin, end in children:
            if c != heavy:
                for k in range(begin, end):
                    yield k, depth, heavy, n > 2
            stack.append((begin, end, depth + 1))


def terminals(words: list[str], cut: dict[str, tuple[str, int]], least: int = LEAST_LENGTH) -> Iterator[tuple[str, int, int]]:
    """Errata of sorted words: text, the word's number, kind. No word is shorter than least."""
    for k, depth, heavy, others in light_edges(words, cut):
        word = words[k]
        before, after = word[:depth], word[depth + 1 :]
        if depth == len(word):
            yield before + heavy, k, LOOK
            continue
        if len(word) > least and word[depth : depth + 1] != after[:1]:
            yield before + after, k, LOOK
        yield before + heavy + after, k, LOOK
        yield before + heavy + word[depth:], k, LOOK
        if others:
            yield f"{before}\0{after}", k, MEET


def _cut_nodes(parted: DataFrame) -> dict[str, tuple[str, int]]:
    """Heavy child and number of children of the nodes above borders: at most a border's common prefix has characters each."""
    ends = parted.groupBy("part").agg(F.min("word").alias("a"), F.max("word").alias("b")).orderBy("part").collect()  # a row a part
    nodes = {x["b"][:k] for x, y in zip(ends, ends[1:], strict=False) for k in range(common(x["b"], y["a"]) + 1)}
    if not nodes:
        return {}
    shared = parted.sparkSession.sparkContext.broadcast(nodes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for word in batch.column(0).to_pylist():
                for k in range(len(word)):
                    if word[:k] not in shared.value:
                        break
                    total[word[: k + 1]] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["child", "n"])

    children = parted.select("word").mapInArrow(run, "child string, n long").groupBy("child").agg(F.sum("n").alias("n"))
    found: dict[str, list[tuple[int, str]]] = {x: [] for x in nodes}
    for r in children.collect():  # children of the nodes above borders
        found[r["child"][:-1]].append((-r["n"], r["child"][-1]))
    return {x: (min(c)[1] if c else "", len(c)) for x, c in found.items()}


def near_words(counted: DataFrame, least: int = LEAST_LENGTH, part_words: int = PART_WORDS) -> DataFrame:
    """word, n, n_near (words at one edit), near and near_n: the most frequent of them (of equal ones the first).

    counted: different words with n, none shorter than least.
    """
    spark = counted.sparkSession
    repo_on_workers(spark)
    counted = stored(spark, counted.select("word", "n"), "words")
    ranged = counted.repartitionByRange(max(1, -(-counted.count() // part_words)), "word")
    parted = stored(spark, ranged.withColumn("part", F.spark_partition_id()), "sorted-words")
    cut = spark.sparkContext.broadcast(_cut_nodes(parted))

    def errata(table: pa.Table) -> pa.Table:
        table = table.sort_by("word")  # UTF-8 sorts by code point
        words = table.column("word").to_pylist()
        texts, owner, kind = [], [], []
        for text, k, which in terminals(words, cut.value, least):
            texts.append(text)
            owner.append(k)
            kind.append(which)
        at = pa.array(owner, pa.int64())
        return pa.table({"key": pa.array(texts, pa.string()), "kind": pa.array(kind, pa.int32()), "word": table.column("word").take(at), "n": table.column("n").take(at)})

    made = parted.groupBy("part").applyInArrow(errata, "key string, kind int, word string, n long")
    made = made.unionByName(counted.select(F.col("word").alias("key"), F.lit(WORD).alias("kind"), "word", "n"))
    group = Window.partitionBy("key")
    order = group.orderBy("kind", F.desc("n"), "word")
    me = F.struct("kind", "n", "word")
    met = made.select("word", "kind", F.row_number().over(order).alias("k"), F.lead(me).over(order).alias("next"), F.first(me).over(order).alias("first"), F.count(F.lit(1)).over(group).alias("size"))
    met = met.filter("size > 1 and (kind <> 1 or first.kind = 0)")
    other: Column = F.when((F.col("kind") != LOOK) & (F.col("k") == 1), F.col("next")).otherwise(F.col("first"))
    each = met.select("word", F.when(F.col("kind") == LOOK, 1).otherwise(F.col("size") - 1).alias("c"), F.struct((-other["n"]).alias("n"), other["word"].alias("word")).alias("other"))
    best = each.groupBy("word").agg(F.sum("c").alias("n_near"), F.min("other").alias("other"))
    return counted.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("other.word").alias("near"), (-F.col("other.n")).alias("near_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the end of the chain of forms (word, form). Chains are halved in each round."""
    spark = forms.sparkSession
    now = stored(spark, forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        now = stored(spark, now.join(step, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "roots")
        if not now.filter("moved").limit(1).count():
            return now.select("word", "root")
        now = now.drop("moved")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ratio: int = RATIO, least: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, damage: int = DAMAGE, part_words: int = PART_WORDS) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the documents.

    form: the most frequent word at one edit, if it is ratio times as frequent at least; root: where the chain of forms ends.
    """
    spark = docs.sparkSession
    near = near_words(count_words(docs, id_col, text_col, least, least_count, damage), least, part_words)
    has = F.col("near_n") >= ratio * F.col("n")
    named = stored(spark, near.select("word", "n", "n_near", F.when(has, F.col("near")).alias("form"), F.when(has, F.col("near_n")).alias("form_n")), "variants")
    ends = roots(named.filter("form is not null"))
    return named.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
