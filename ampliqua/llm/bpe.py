"""BPE encoding and decoding of whole texts with a prefix-sharing trie of their words.

A BPE encoding has a state that does not look ahead: the last token of each prefix. Words that share a prefix share its
states, so the distinct words of a block of texts form a trie (sorted, their order is its depth-first order) and every
node's last token is found once from its ancestors': it is the one vocabulary token that ends there and may follow the
last token before it. Walking back from a word's end gives its ids.

Texts are cut into units (at white space, and where ASCII punctuation follows an ASCII letter or digit: words always end
there). A worker numbers the units of a block in a hash table and only new ones reach the trie. It is a single pass
without a shuffle; blocks and tables are bounded, so memory does not follow the input.

Defined results: a null or empty text has no ids and decodes to ''; repeated rows each get a row; extra columns are
ignored.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ampliqua.llm.common import arrow_type, blobs, freed, record_batch, repo_on_workers
from ampliqua.llm.wordtable import SHORT, Arena, WordTable, gather, in_blocks

#: Different units of text and compatible pairs of tokens remembered by a worker, and bytes of a block.
MAX_UNITS, MAX_PAIRS, BLOCK_BYTES = 600_000, 600_000, 1 << 19

#: Characters for which lower-casing, NFC and the classes L, N and white space are the same everywhere.
_PLAIN = re.compile("[^\t\n\r -~\xa1-ɏ]")
_SPACE, _PUNCTUATION, _ALNUM = 1, 2, 4
_KIND = np.zeros(256, np.uint8)
_KIND[list(b"\t\n\r ")] = _SPACE
_KIND[[c for c in range(33, 127) if not chr(c).isalnum()]] = _PUNCTUATION
_KIND[[c for c in range(33, 127) if chr(c).isalnum()]] = _ALNUM


def byte_letters() -> dict[int, str]:
    """The character by which byte-level vocabularies write each byte: itself if printable in Latin-1, else from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class TrieBpe:
    """A word BPE with an end-of-word mark, from the JSON of a tokenizers file."""

    def __init__(self, spec: str) -> None:
        self.spec = spec
        data = json.loads(spec)
        model, self.end = data["model"], data["model"]["end_of_word_suffix"] or ""
        if not self.end or data["decoder"] is not None:
            raise ValueError("a BPE with an end-of-word suffix and without a decoder is needed")
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = [a + b for a, b in merges]
        base = [t for t in model["vocab"] if len(t.removesuffix(self.end) or t) == 1]
        names = base + made  # a token's number: later merges have larger ones
        number = {t: k for k, t in enumerate(names)}
        if len(number) != len(names):
            raise ValueError("a token is made by two merges")
        self.first_made = len(base)
        self.parts = [(-1, -1)] * len(base) + [(number[a], number[b]) for a, b in merges]
        self.merge = {(number[a], number[b]): number[m] for (a, b), m in zip(merges, made, strict=True)}
        self.ids = [model["vocab"][t] for t in names]
        self.names = names
        self.by_id = {k: t for t, k in model["vocab"].items()} | {x["id"]: x["content"] for x in data["added_tokens"]}
        self.pairs: dict[int, bool] = {}
        valid: list[bool] = []
        for k, (a, b) in enumerate(self.parts):
            valid.append(a < 0 or (valid[a] and valid[b] and self._may_follow(a, b, k)))
        self.inner = {t: k for t, k in number.items() if valid[k] and not (t.endswith(self.end) and len(t) > len(self.end))}
        self.final = {t.removesuffix(self.end): k for t, k in number.items() if valid[k] and t.endswith(self.end) and len(t) > len(self.end)}
        self.prefixes = {t[:k] for t in [*self.inner, *self.final] for k in range(1, len(t) + 1)}
        self.widths = [len(t.removesuffix(self.end) or t) for t in names]
        special = [x["content"] for x in data["added_tokens"]]
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.letters = {b: c for b, c in byte_letters().items() if chr(b) != c}
        split = next(x["pattern"]["Regex"] for x in data["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.word = regex.compile(split)
        self.id_of = np.array(self.ids, np.uint32)
        shown = [t.encode() + b" " for t in names]
        self.shown, self.shown_size = np.frombuffer(b"".join(shown), np.uint8), np.array(list(map(len, shown)), np.int64)
        self.shown_at = np.cumsum(self.shown_size) - self.shown_size
        self._forget()

    def _forget(self) -> None:
        self.table, self.numbers = WordTable(), Arena(np.int32)
        self.at, self.size = Arena(np.int64), Arena(np.int64)

    @functools.cached_property
    def library(self):
        """The tokenizers library's, for what only it splits: made when first needed."""
        from tokenizers import Tokenizer

        made = Tokenizer.from_str(self.spec)
        made.no_truncation()
        made.no_padding()
        return made

    def _may_follow(self, a: int, b: int, limit: int = 1 << 60) -> bool:
        """Whether the text of a and b encodes to just these two: take back merges, latest first, and look for one across."""
        while True:
            if self.merge.get((a, b), 1 << 60) < limit:
                return False
            if a > b and a >= self.first_made:
                limit, a = a, self.parts[a][1]
            elif b >= self.first_made:
                limit, b = b + 1, self.parts[b][0]  # of equal merges the left one comes first
            else:
                return True

    def encode_words(self, words: set[str]) -> dict[str, list[int]]:
        """Token numbers of each word (in byte letters), depth first through the trie of all of them."""
        if len(self.pairs) > MAX_PAIRS:
            self.pairs.clear()
        inner, final, prefixes, pairs, widths = self.inner, self.final, self.prefixes, self.pairs, self.widths
        out, before = {}, ""
        states, alive = [0], [0]  # by depth: the last token; where the longest suffix that begins some token starts
        for word in sorted(words):
            n = len(word)
            shared, most = 0, min(n, len(before)) - 1
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del states[shared + 1 :], alive[shared + 1 :]
            for end in range(shared + 1, n + 1):
                table = inner if end < n else final
                from_ = alive[end - 1]
                while word[from_:end] not in prefixes:
                    from_ += 1
                for start in range(from_, end):
                    t = table.get(word[start:end])
                    if t is not None:
                        if not start:
                            break
                        key = states[start] << 20 | t
                        ok = pairs.get(key)
                        if ok is None:
                            ok = pairs[key] = self._may_follow(states[start], t)
                        if ok:
                            break
                else:
                    raise ValueError(f"no token ends {word[:end]!r}")
                if end < n:
                    states.append(t)
                    alive.append(from_)
            at, found = n, []
            while True:
                found.append(t)
                at -= widths[t]
                if not at:
                    break
                t = states[at]
            found.reverse()
            out[word], before = found, word
        return out

    def _words(self, unit: str) -> list[str]:
        """Byte letters of the words of a unit."""
        if _PLAIN.search(unit):
            return self._library_words(unit)
        low = unit.lower()
        words = [low] if low.isalpha() else self.word.findall(low)
        return words if unit.isascii() else [w.encode().decode("latin-1").translate(self.letters) for w in words]

    def _library_words(self, text: str) -> list[str]:
        return [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))]

    def _learn(self, units: list[bytes]) -> None:
        """Token numbers of new units."""
        words = [self._words(u.decode()) for u in units]
        known = self.encode_words({w for ws in words for w in ws})
        found = [known[ws[0]] if len(ws) == 1 else [t for w in ws for t in known[w]] for ws in words]
        size = np.fromiter(map(len, found), np.int64, len(found))
        at = self.numbers.extend(np.fromiter(itertools.chain.from_iterable(found), np.int32, int(size.sum())))
        self.at.extend(at + np.cumsum(size) - size)
        self.size.extend(size)

    def _block(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token numbers of texts or parts of them, put together, and where each part's end."""
        raw = b"".join(parts)
        if not raw:
            return np.zeros(0, np.int32), np.zeros(len(parts), np.int64)
        data, stops = np.frombuffer(raw + bytes(SHORT), np.uint8), np.cumsum(list(map(len, parts)))
        kind = _KIND[data[: len(raw)]]
        left, solid = kind[:-1], (kind & _SPACE) == 0
        begins = solid.copy()
        begins[1:] &= ~solid[:-1] | (((kind[1:] & _PUNCTUATION) != 0) & ((left & _ALNUM) != 0))
        edges = stops[stops < len(raw)]
        begins[edges] = solid[edges]
        ends = solid.copy()
        ends[:-1] &= ~solid[1:] | begins[1:]
        start = np.flatnonzero(begins)
        if self.table.n > MAX_UNITS:
            self._forget()
        unit = self.table.lookup(raw, data, start, np.flatnonzero(ends) + 1 - start, self._learn)
        size = self.size.data[unit]
        total = np.concatenate([[0], np.cumsum(size)])
        return gather(self.numbers.data, self.at.data[unit], size), total[np.searchsorted(start, stops)]

    def _odd(self, text: str) -> tuple[bytes, bytes]:
        """Ids and decoded text of a text with special tokens or zero characters."""
        ids, names = [], []
        for part in self.special.split(text) if self.special else [text]:
            if self.special and self.special.fullmatch(part):
                ids.append(self.library.token_to_id(part))
                names.append(part)
                continue
            words = self._library_words(part)
            known = self.encode_words(set(words))
            ids += [self.ids[t] for w in words for t in known[w]]
            names += [self.names[t] for w in words for t in known[w]]
        return np.array(ids, "<u4").tobytes(), " ".join(names).encode()

    def encode_block(self, texts: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """For each text: its ids as little-endian unsigned 32-bit integers, and its decoded text."""
        odd = {k for k, t in enumerate(texts) if b"\0" in t or (self.special and b"<|" in t and self.special.search(t.decode()))}
        ids, names, now = [], [], 0
        for block, owner in in_blocks((b"" if k in odd else t for k, t in enumerate(texts)), BLOCK_BYTES):
            numbers, stops = self._block(block)
            every_id = self.id_of[numbers].astype("<u4").tobytes()
            size = self.shown_size[numbers]
            every_name = gather(self.shown, self.shown_at[numbers], size).tobytes()
            stops = np.concatenate([[0], stops])
            reach = np.concatenate([[0], np.cumsum(size)])[stops].tolist()
            for k, a, b, c, d in zip(owner, stops[:-1].tolist(), stops[1:].tolist(), reach[:-1], reach[1:], strict=True):
                if k != now:
                    yield self._odd(texts[now].decode()) if now in odd else (b"".join(ids), b"".join(names)[:-1])
                    ids, names, now = [], [], k
                ids.append(every_id[4 * a : 4 * b])
                names.append(every_name[c:d])
        if texts:
            yield self._odd(texts[now].decode()) if now in odd else (b"".join(ids), b"".join(names)[:-1])

    def decode(self, ids: list[int]) -> str:
        """As the library decodes without a decoder: the tokens' names, parted by spaces; unknown ids are left out."""
        return " ".join([self.by_id[i] for i in ids if i in self.by_id])


_made: dict[str, TrieBpe] = {}


def tokenizer(spec: str) -> TrieBpe:
    """One for each worker process."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _made:
        _made.clear()
        _made[key] = TrieBpe(spec)
    return _made[key]


def _run(docs: DataFrame, path: str, id_col: str, text_col: str, fields: list[T.StructField], make) -> DataFrame:
    spark = docs.sparkSession
    repo_on_workers(spark)
    with open(path, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *fields])
    out = pa.schema([(f.name, arrow_type(f.dataType)) for f in schema])

    @freed
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(spec.value)
        for batch in batches:
            made = [make(i, d) for i, d in bpe.encode_block(blobs(batch.column(1)))]
            yield record_batch(out, [batch.column(0), *([m[k] for m in made] for k in range(len(fields)))])

    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text")).mapInArrow(rows, schema)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, n_tokens, ids (array of int) and decoded text of every row; path: a tokenizers file."""
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]
    return _run(docs, path, id_col, text_col, fields, lambda i, d: (len(i) // 4, np.frombuffer(i, "<u4").astype(np.int32), d.decode()))


def digest(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit integers) and decoded_sha256 of every row."""
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return _run(docs, path, id_col, text_col, fields, lambda i, d: (len(i) // 4, hashlib.sha256(i).hexdigest(), hashlib.sha256(d).hexdigest()))


def decode(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The id and text (decoded) of rows of ids; null ids decode to ''."""
    spark = rows.sparkSession
    repo_on_workers(spark)
    with open(path, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    schema = T.StructType([T.StructField(id_col, rows.schema[id_col].dataType), T.StructField("text", T.StringType())])
    out = pa.schema([(f.name, arrow_type(f.dataType)) for f in schema])

    @freed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(spec.value)
        for batch in batches:
            yield record_batch(out, [batch.column(0), [bpe.decode(x or []) for x in batch.column(1).to_pylist()]])

    return rows.select(id_col, ids_col).mapInArrow(run, schema)
