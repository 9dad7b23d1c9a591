"""Personal data in whole texts: fixed patterns, and a skip-chain conditional random field that adds what they miss.

The patterns give the base spans, which stay: to the field they are observed labels. Its hidden variables are all other
tokens with a digit or an '@', in every text, and what is similar to a base span: the local part of an address, a number
that ends in the same eight digits. Base spans of several words are a node a word. All nodes of a text form one chain, with
other weights where they stand side by side than where words lie between; occurrences of the same or a similar token are
joined by skip links to the previous one and to the last one observed, however distant. Loopy sum-product message passing
over the fields of many texts at once, until the messages settle, gives each node's probabilities. So a number that the
patterns lose because another one touches it is found by its shape and its neighbours, and one sure occurrence carries its
label to the others of its document.

The weights are fitted by pseudo-likelihood on all documents, which needs only how often each configuration of features and
neighbouring labels occurs. Base spans are learned with their evidence hidden, once where they stand and once in a short
form, linked to themselves; those of one word also as if another token touched them, where the patterns lose numbers and no
text can show it. Tokens similar to a base span have no known label and are left out; that an ordinary word may
equal an address's local part is learned from words of the same texts, taken as if they did.

Defined results: a null or empty text has no spans; equal spans of one kind are one; repeated rows each get a row; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ampliqua.llm.common import arrow_type, freed, record_batch, repo_on_workers, texts

KINDS = ("email", "ip", "card", "phone")
#: Rounds of messages at most, and the largest change at which they have settled; least probability of an added span.
ROUNDS, SETTLED, SURE = 200, 1e-7, 0.9
#: Nodes whose messages are passed together (about), and links of a step.
MAX_NODES, STEP = 50_000, 1 << 16
#: Digits in which numbers must end alike to be similar; characters between nodes that stand side by side, at most.
ENDING, NEAR = 8, 3
#: One in so many different words stands for those that an address's local part may equal by chance, in the fit.
CONTRAST = 16

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9@]")
_SPACE = re.compile(r"\s")
_TRIM = ".,;:!?()[]{}<>\"'"
_DIGITS = re.compile(r"[0-9](?:[ ().-]{0,3}[0-9])*")
_NAME = re.compile(r"[A-Za-z0-9._%+-]+")
_WORD = re.compile(r"[A-Za-z]+")
_PART = re.compile(r"\S+")
_JOINT = re.compile(r"[ ().-]{1,3}")
#: Digits that a number of a kind holds at most.
_LENGTH = {"card": 19, "phone": 15}

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2]) + sum((2 * int(d) - 9 * (d > "4")) for d in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind that pass its test; offsets in code points, end exclusive."""
    out: list[Span] = []
    at, floor = text.find("@"), 0
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            floor = m.end()
        at = text.find("@", max(at + 1, floor))
    if _MARK.search(text) is None:
        return out
    if "." in text:
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(g.lstrip("0")) <= 3 and int(g[-3:]) <= 255 for g in m.groups())]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m.group()) <= 15]
    return out


def listed(spans: list[Span]) -> str:
    """kind:start:end by kind, then start, joined by commas."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def similar_key(token: str) -> str:
    """Equal for similar tokens: addresses and their local parts, numbers that end alike."""
    name = token.partition("@")[0].lower()
    digits = "".join(c for c in name if c.isdigit())
    return digits[-ENDING:] if len(digits) >= ENDING and not any(c.isalpha() for c in name) else name


def _apart(spans: list[tuple[int, int]], taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans that overlap none of those taken (in order, themselves perhaps overlapping) and none before them."""
    out, at, end, reach = [], 0, 0, 0
    for a, b in sorted(set(spans), key=lambda s: (s[0], -s[1])):
        while at < len(taken) and taken[at][0] < b:
            reach = max(reach, taken[at][1])
            at += 1
        if a >= end and a >= reach:
            out.append((a, b))
            end = b
    return out


Node = tuple[int, int, str | None, int, int]


def nodes(text: str, base: list[Span]) -> list[Node]:
    """Start, end, key, base label and number of mentions of the field's tokens, in order and apart.

    A base span gives a node a word, the last one with the span's key. Mentions are counted for names alone, else 1.
    One pass over the text for each: local parts, numbers, tokens.
    """
    if _MARK.search(text) is None:
        return []
    rows: list[Node] = []
    end = 0
    for kind, a, b in sorted(base, key=lambda s: (s[1], -s[2])):
        words = [(a + m.start(), a + m.end()) for m in _PART.finditer(text[a:b])]
        for x, y in words:
            if x >= end:
                rows.append((x, y, similar_key(text[a:b]) if y == words[-1][1] else None, KINDS.index(kind) + 1, 1))
                end = y
    spans = [r[:2] for r in rows]
    names = {text[a:b].partition("@")[0].lower() for k, a, b in base if k == "email"}
    numbers = {similar_key(text[a:b]) for k, a, b in base if k != "email"}
    similar: list[tuple[int, int]] = []
    if names:
        for m in _NAME.finditer(text):
            for b in {m.end(), m.start() + len(m.group().rstrip("._%+-"))}:
                if text[m.start() : b].lower() in names and text[b : b + 1] != "@":
                    similar.append((m.start(), b))
    if numbers:
        similar += [m.span() for m in _DIGITS.finditer(text) if similar_key(m.group()) in numbers]
    similar = _apart(similar, spans)
    mentions = Counter(text[a:b].lower() for a, b in similar)
    rows += [(a, b, similar_key(text[a:b]), 0, mentions[text[a:b].lower()]) for a, b in similar]
    others: list[tuple[int, int]] = []
    seen = 0
    for m in _MARK.finditer(text):
        if m.start() < seen:
            continue
        start = m.start()
        while start > seen and not text[start - 1].isspace():
            start -= 1
        stop = _SPACE.search(text, m.end())
        seen = stop.start() if stop else len(text)
        a, b = start, seen
        while a < b and text[a] in _TRIM and not (text[a] == "(" and ")" in text[a:b]):
            a += 1
        while b > a and text[b - 1] in _TRIM and not (text[b - 1] == ")" and "(" in text[a:b]):
            b -= 1
        if a < b:
            others.append((a, b))
    rows += [(a, b, similar_key(text[a:b]), 0, 1) for a, b in _apart(others, sorted(spans + similar))]
    return sorted(rows)


#: Features of a token: shapes only, nothing that repeats the patterns' tests.
_SHAPES = [re.compile(p) for p in (r"@", r"^\+", r"^[0-9]+$", r"^[0-9]{1,3}(\.[0-9]{1,3})+$", r"\.", r"[A-Za-z]", r"^[A-Za-z]", r"[()]", r"-", r"^[0-9a-f]{24,}$", r"=|/|_|:", r"\.[a-z]{2,4}$", r"[^\x00-\x7f]")]
N_FEATURES = len(_SHAPES) + 18


def token_features(token: str, mentions: int = 1) -> bytes:
    """Shapes; whether a number passes a kind's test as it stands; of plain words their length and how often they occur."""
    number = "".join(c for c in token if c.isascii() and c.isdigit())
    digits, plain = len(number), token.isalpha()
    size = [digits == 0, 1 <= digits <= 3, 4 <= digits <= 7, 8 <= digits <= 12, 13 <= digits <= 15, 16 <= digits <= 19, digits > 19]
    m = _IP.fullmatch(token)
    tests = [16 <= digits <= 19 and luhn(number), bool(m) and all(len(g.lstrip("0")) <= 3 and int(g[-3:]) <= 255 for g in m.groups())]
    word = [plain, plain and len(token) <= 2, plain and 3 <= len(token) <= 4, plain and 5 <= len(token) <= 7, plain and mentions == 1, plain and 2 <= mentions <= 3, plain and mentions > 3]
    return bytes([1, *(bool(p.search(token)) for p in _SHAPES), *size, len(token) > 30, *tests, *word])


def short_form(kind: str, span: str) -> str:
    """How a second mention may leave something of a base span out."""
    digits = "".join(c for c in span if c.isdigit())
    return {"email": span.partition("@")[0], "ip": span, "card": digits, "phone": f"{digits[-10:-7]}-{digits[-7:-4]}-{digits[-4:]}" if len(digits) >= 10 else digits}[kind]


class Graph:
    """The fields of several texts as one: features and evidence of nodes, links between them."""

    def __init__(self) -> None:
        self.features = bytearray()
        self.evidence: list[int] = []
        self.similar: list[bool] = []
        self.spans: list[tuple[int, int, int]] = []
        #: Links of the chain between nodes side by side, those over words between, and skip links.
        self.chain: list[tuple[int, int]] = []
        self.far: list[tuple[int, int]] = []
        self.skip: list[tuple[int, int]] = []

    def add(self, number: int, text: str, base: list[Span]) -> None:
        rows = nodes(text, base)
        sure = {key for _, _, key, label, _ in rows if label}
        last: dict[str, int] = {}
        observed: dict[str, int] = {}
        before = None
        for a, b, key, label, mentions in rows:
            node = len(self.evidence)
            self.features += token_features(text[a:b], mentions)
            self.evidence.append(label)
            self.similar.append(not label and key in sure)
            self.spans.append((number, a, b))
            if before is not None:
                (self.chain if a - before <= NEAR else self.far).append((node - 1, node))
            before = b
            if key is None:
                continue
            if key in last:
                self.skip.append((last[key], node))
                if observed.get(key, last[key]) != last[key]:
                    self.skip.append((observed[key], node))
            last[key] = node
            if label:
                observed[key] = node

    def matrix(self) -> np.ndarray:
        return np.frombuffer(bytes(self.features), np.uint8).reshape(-1, N_FEATURES)


class Field:
    """Weights: of features (by label), of the chain near and far (label by label), and of each label's agreement over a skip link."""

    def __init__(self, unary: np.ndarray, chain: np.ndarray, skip: np.ndarray, far: np.ndarray | None = None) -> None:
        self.unary, self.chain, self.skip = unary, chain, skip
        self.far = np.zeros_like(chain) if far is None else far

    @classmethod
    def empty(cls) -> Field:
        n = len(KINDS) + 1
        return cls(np.zeros((N_FEATURES, n)), np.zeros((n, n)), np.zeros(n))

    def marginals(self, graph: Graph, rounds: int = ROUNDS) -> np.ndarray:
        """Probabilities of the labels of each node, by damped loopy sum-product until it settles; nodes with evidence keep it."""
        n, size = len(self.skip), len(graph.evidence)
        seen = np.array(graph.evidence)
        unary = graph.matrix().astype(np.float64) @ self.unary
        unary[seen > 0] = -50
        unary[np.flatnonzero(seen), seen[seen > 0]] = 50
        source, target, back, parts, at = [], [], [], [], 0
        for links, weight in ((graph.chain, self.chain), (graph.far, self.far), (graph.skip, np.diag(self.skip))):
            e = np.array(links, int).reshape(-1, 2)
            k = np.arange(len(e))
            source += [e[:, 0], e[:, 1]]
            target += [e[:, 1], e[:, 0]]
            back += [at + len(e) + k, at + k]
            parts += [(x + y, min(x + y + STEP, x + len(e)), w) for x, w in ((at, weight), (at + len(e), weight.T)) for y in range(0, len(e), STEP)]
            at += 2 * len(e)
        source, target, back = map(np.concatenate, (source, target, back))
        message, belief = np.zeros((at, n)), unary
        for _ in range(rounds if at else 0):
            new = np.empty_like(message)
            for a, b, weight in parts:
                to = (belief[source[a:b]] - message[back[a:b]])[:, :, None] + weight
                top = to.max(axis=1, keepdims=True)
                out = np.log(np.exp(to - top).sum(axis=1)) + top[:, 0]
                new[a:b] = 0.5 * message[a:b] + 0.5 * (out - out.mean(axis=1, keepdims=True))
            change, message = np.abs(new - message).max(), new
            belief = unary + np.stack([np.bincount(target, message[:, j], size) for j in range(n)], axis=1)
            if change <= SETTLED:
                break
        p = np.exp(belief - belief.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


#: No neighbour on that side.
_NONE = 255


def _configuration(features: bytes, left: tuple[int, int], right: tuple[int, int], around: np.ndarray, label: int) -> bytes:
    return features + bytes([*left, *right]) + around.astype("<u4").tobytes() + bytes([label])


def configurations(values: list[str]) -> Counter:
    """How often each configuration occurs in these texts: features, label and nearness before and after, labels over skip links, own label.

    Of tokens similar to a base span only the contrast counts: words that stand for local parts equal to ordinary ones.
    """
    out: Counter = Counter()
    # a second mention stands among other tokens, as most do; a number that the patterns lose is touched by one
    n_labels, alone, among, touched = len(KINDS) + 1, (_NONE, 0), (0, 0), (0, 1)
    linked = np.eye(n_labels, dtype=np.int64)
    for text in values:
        base = base_spans(text)
        g = Graph()
        g.add(0, text, base)
        n = len(g.evidence)
        left, right, around = [alone] * n, [alone] * n, np.zeros((n, n_labels), np.int64)
        for links, near in ((g.chain, 1), (g.far, 0)):
            for a, b in links:
                left[b], right[a] = (g.evidence[a], near), (g.evidence[b], near)
        for a, b in g.skip:
            around[a, g.evidence[b]] += 1
            around[b, g.evidence[a]] += 1
        rows = g.matrix()
        for k in range(n):
            if not g.similar[k]:
                out[_configuration(rows[k].tobytes(), left[k], right[k], around[k], g.evidence[k])] += 1
        for kind, a, b in base:
            mark = KINDS.index(kind) + 1
            for again in (text[a:b], short_form(kind, text[a:b])):
                out[_configuration(token_features(again), among, among, linked[mark], mark)] += 1
            if _SPACE.search(text, a, b) is None:
                for sides in ((touched, among), (among, touched)):
                    out[_configuration(token_features(text[a:b]), *sides, np.zeros(n_labels, np.int64), mark)] += 1
        if any(kind == "email" for kind, _, _ in base):
            email = KINDS.index("email") + 1
            names = {text[a:b].partition("@")[0].lower() for k, a, b in base if k == "email"}
            for word, times in Counter(w.lower() for w in _WORD.findall(text)).items():
                if word not in names and zlib.crc32(word.encode()) % CONTRAST == 0:
                    out[_configuration(token_features(word, times), among, among, linked[email], 0)] += times
    return out


def fit(found: dict[bytes, int], steps: int = 300, rate: float = 0.1, decay: float = 1e-4) -> Field:
    """Pseudo-likelihood: each node's label given its features and its neighbours' labels; Adam on all configurations at once."""
    field, n = Field.empty(), len(KINDS) + 1
    if not found:
        return field
    keys = sorted(found)
    rows = np.frombuffer(b"".join(keys), np.uint8).reshape(len(keys), -1)
    weight = np.array([found[k] for k in keys], np.float64)
    weight /= weight.sum()
    x = rows[:, :N_FEATURES].astype(np.float64)
    around = np.ascontiguousarray(rows[:, N_FEATURES + 4 : -1]).view("<u4").astype(np.float64)
    one = np.eye(n)[rows[:, -1]]
    left, right = (np.vstack([np.eye(n), np.zeros((256 - n, n))])[rows[:, N_FEATURES + k]] for k in (0, 2))
    near_l, near_r = (rows[:, N_FEATURES + k : N_FEATURES + k + 1].astype(np.float64) for k in (1, 3))
    sides = [(left * near_l, right * near_r), (left * (1 - near_l), right * (1 - near_r))]
    weights = [field.unary, field.chain, field.far, field.skip]
    m, v = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for t in range(1, steps + 1):
        z = x @ field.unary + around * field.skip
        for (l, r), w in zip(sides, (field.chain, field.far), strict=True):
            z += l @ w + r @ w.T
        p = np.exp(z - z.max(axis=1, keepdims=True))
        g = (p / p.sum(axis=1, keepdims=True) - one) * weight[:, None]
        slopes = [x.T @ g, *(l.T @ g + (r.T @ g).T for l, r in sides), (around * g).sum(axis=0)]
        for k, d in enumerate(slopes):
            d = d + decay * weights[k]
            m[k], v[k] = 0.9 * m[k] + 0.1 * d, 0.99 * v[k] + 0.01 * d * d
            weights[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-9)
    return field


def train(docs: DataFrame, text_col: str = "text") -> Field:
    """Fitted on all documents. The driver gets a row for each different configuration: shapes, not texts."""
    repo_on_workers(docs.sparkSession)
    text = F.col(text_col).cast("string")
    out = pa.schema([("configuration", pa.binary()), ("n", pa.int64())])

    @freed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            total.update(configurations(texts(batch.column(0))))
        yield record_batch(out, [list(total), list(total.values())])

    each = docs.filter(text.rlike("[0-9@]")).select(text.alias("_text")).mapInArrow(run, "configuration binary, n long")
    rows = each.groupBy("configuration").agg(F.sum("n").alias("n")).toArrow()
    return fit(dict(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True)))


def label(values: list[str], field: Field) -> list[tuple[list[Span], list[Span]]]:
    """Of each text: its base spans, and the spans that the field adds; parts of a number side by side are one span."""
    graph, found = Graph(), []

    def add_spans() -> None:
        if graph.evidence:
            p = field.marginals(graph)
            best = p.argmax(axis=1)
            before = -2
            for node in np.flatnonzero((best > 0) & (p.max(axis=1) >= SURE) & (np.array(graph.evidence) == 0)):
                k, a, b = graph.spans[node]
                kind, more = KINDS[best[node] - 1], found[k][1]
                if before == node - 1 and graph.spans[before][0] == k and more[-1][0] == kind and _JOINT.fullmatch(values[k], more[-1][2], a) and sum(c.isdigit() for c in values[k][more[-1][1] : b]) <= _LENGTH.get(kind, 0):
                    more[-1] = (kind, more[-1][1], b)
                else:
                    more.append((kind, a, b))
                before = node

    for k, text in enumerate(values):
        base = base_spans(text)
        found.append((base, []))
        if field.unary.any():
            graph.add(k, text, base)
            if len(graph.evidence) >= MAX_NODES:
                add_spans()
                graph = Graph()
    add_spans()
    return found


def _map(docs: DataFrame, field: Field | None, id_col: str, text_col: str, fields: list[T.StructField], make) -> DataFrame:
    field = field or train(docs, text_col)
    repo_on_workers(docs.sparkSession)
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *fields])
    out = pa.schema([(f.name, arrow_type(f.dataType)) for f in schema])

    @freed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(1).to_pylist()
            rows = [make(v, base, more) for v, (base, more) in zip(values, label([v or "" for v in values], field), strict=True)]
            yield record_batch(out, [batch.column(0), *([r[k] for r in rows] for k in range(len(fields)))])

    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text")).mapInArrow(run, schema)


def find(docs: DataFrame, field: Field | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document row: the id, spans (array of kind, start, end, base: found by a pattern)."""
    kind = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType())]))
    return _map(docs, field, id_col, text_col, [T.StructField("spans", kind)], lambda _, base, more: ([{"kind": k, "start": a, "end": b, "base": is_base} for spans, is_base in ((base, True), (more, False)) for k, a, b in spans],))


def digest(docs: DataFrame, field: Field | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document row: the id, n_email, n_ip, n_card, n_phone and base_sha256 of the base spans, all spans, n_added."""
    fields = [*(T.StructField(f"n_{k}", T.LongType()) for k in KINDS), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_added", T.LongType())]
    return _map(docs, field, id_col, text_col, fields, lambda _, base, more: (*(sum(s[0] == k for s in base) for k in KINDS), hashlib.sha256(listed(base).encode()).hexdigest(), listed(base + more), len(more)))


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span (those that overlap as one) replaced by its kind in brackets."""
    out, at, end = [], 0, 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= end:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = end = max(end, b)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, field: Field | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document row: the id, text with personal data masked (null stays null), n_masked."""
    fields = [T.StructField("text", T.StringType()), T.StructField("n_masked", T.LongType())]
    return _map(docs, field, id_col, text_col, fields, lambda v, base, more: (None if v is None else masked(v, base + more), len(base) + len(more)))
