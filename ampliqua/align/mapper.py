"""Alignments of reads to alleles, split where a read jumps: primary and supplementary records as SAM has them.

Minimisers of the alleles are an index that every task gets (alleles are the few sequences of an amplicon; the number of
bases is checked). A read's minimisers, of both strands, give hits; hits that rise together give chains. A chain ends where
the allele has LONGEST_DELETION more bases than the read; a longer insertion stays within its chain. Of a read's chains on
an allele the best is taken, and then each that mostly covers what those before it left open. What lies in a gap of a chain
cuts it there: an inverted stretch gives the parts before and after it, and itself on the other strand. Gaps between hits
and ends are aligned with affine costs, those of all reads of a batch together.

Records: the part with most bases is primary, the others are supplementary (flag 2048); sequences are whole, with soft
clips; the cs tag is in its long form. A read that fits two places equally well has mapping quality 0 and is left out.

Defined results: reads without a chain, empty and null ones give no record; letters other than A, C, G, T match nothing but
themselves and are in no hit; repeated reads and names are aligned each; no alleles or no reads give no records.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ampliqua.align.affine import Runs, between, merged, onwards

#: Length of a hit and the number of neighbours that a minimiser is the least of.
K, W = 15, 5
#: Bases that the allele may have more than the read within a chain; hits that a hit looks back on; least score of a chain.
LONGEST_DELETION, BACK, LEAST_SCORE = 500, 64, 40
#: Bases without a hit, on both sides, from which a gap of a chain counts as open.
OPEN_GAP = 30
#: Hits that are chained together, distances whose costs are looked up, bases of reads that are mapped together, reads of a batch.
HITS, TABLE, BASES, READS = 1 << 17, 1 << 16, 1 << 21, 1024
#: Tasks a core that reads are dealt to, tasks that share the reads of one sequence, and bytes of records that a task keeps.
TASKS, SPREAD, KNOWN = 4, 8, 64 << 20
#: Bases of all alleles, at most.
MOST_BASES = 50_000_000

_CODE = np.full(256, 4, np.uint8)
for _k, _c in enumerate(b"ACGT"):
    _CODE[_c] = _k
_TURN = bytes.maketrans(b"ACGTN", b"TGCAN")
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def minimisers(sequence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the minimisers of a sequence (bytes)."""
    code = _CODE[sequence]
    n = len(code) - K + 1
    if n < 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    value = np.zeros(n, np.uint64)
    for t in range(K):
        value = value << np.uint64(2) | (code[t : t + n] & 3).astype(np.uint64)
    h = (value + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    odd = np.concatenate([[0], np.cumsum(code > 3)])
    h[odd[K:] > odd[:-K]] = _NONE
    width = min(W, n)
    at = np.unique(np.lib.stride_tricks.sliding_window_view(h, width).argmin(axis=1) + np.arange(n - width + 1))
    at = at[h[at] != _NONE]
    return h[at], at


def minimisers_of(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and places of the minimisers of several sequences, and the number of the sequence of each, in order."""
    lengths = np.array([len(s) for s in sequences], np.int64)
    long = np.flatnonzero(lengths >= K + W - 1)
    found = [(*minimisers(sequences[k]), k) for k in np.flatnonzero((lengths >= K) & (lengths < K + W - 1)).tolist()]
    out = [(h, at, np.full(len(at), k)) for h, at, k in found]
    if len(long):
        code = _CODE[np.concatenate([sequences[k] for k in long])]
        n = len(code) - K + 1
        value = np.zeros(n, np.uint64)
        for t in range(K):
            value = value << np.uint64(2) | (code[t : t + n] & 3).astype(np.uint64)
        h = (value + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        odd = np.concatenate([[0], np.cumsum(code > 3)])
        h[odd[K:] > odd[:-K]] = _NONE
        least, at = h[: n - W + 1].copy(), np.arange(n - W + 1)
        for t in range(1, W):
            less = h[t : n - W + 1 + t] < least
            least[less] = h[t : n - W + 1 + t][less]
            at[less] = np.flatnonzero(less) + t
        ends = np.cumsum(lengths[long])
        owner = np.repeat(np.arange(len(long)), lengths[long])
        at = at[np.arange(n - W + 1) + K + W - 1 <= ends[owner[: n - W + 1]]]  # windows within a sequence; their places rise
        at = at[np.concatenate([[True], at[1:] != at[:-1]])]
        at = at[h[at] != _NONE]
        out.append((h[at], at - (ends - lengths[long])[owner[at]], long[owner[at]]))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h, at, number = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.argsort(number, kind="stable")
    return h[order], at[order], number[order]


class Index:
    """Minimisers of several sequences, sorted by hash."""

    def __init__(self, sequences: list[tuple[str, str]]) -> None:
        self.names = [n for n, _ in sequences]
        self.bytes = [np.frombuffer(s.upper().encode(), np.uint8) for _, s in sequences]
        found = [minimisers(s) for s in self.bytes]
        h = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.hash = h[order]
        self.place = np.concatenate([f[1] for f in found])[order] if found else np.zeros(0, np.int64)
        self.owner = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])[order]

    def hits(self, sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Number of the sequence that was looked up, number of the indexed one, place there, and place in the first."""
        h, at, number = minimisers_of(sequences)
        low, high = np.searchsorted(self.hash, h), np.searchsorted(self.hash, h, "right")
        n = high - low
        where = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.repeat(number, n), self.owner[where], self.place[where], np.repeat(at, n)


@dataclass
class Chain:
    """Hits that rise together: places in the allele and in the read as it is turned."""

    score: float
    ref: np.ndarray
    read: np.ndarray
    turned: bool

    def span(self, length: int) -> tuple[int, int]:
        """First and last place + 1 in the read as it came."""
        a, b = int(self.read[0]), int(self.read[-1]) + K
        return (length - b, length - a) if self.turned else (a, b)

    def cuts(self) -> np.ndarray:
        """Numbers of hits after which a gap is open."""
        return ((self.read[1:] - self.read[:-1] >= K + OPEN_GAP) & (self.ref[1:] - self.ref[:-1] >= K + OPEN_GAP)).nonzero()[0]

    def blocks(self, length: int) -> list[tuple[int, int]]:
        """What the parts between open gaps cover of the read as it came."""
        cuts = self.cuts()
        return [c.span(length) for c in self.parts(cuts)] if len(cuts) else [self.span(length)]

    def covered(self) -> int:
        """Bases of the hits."""
        return K + int(np.minimum(np.minimum(np.diff(self.ref), np.diff(self.read)), K).sum())

    def parts(self, cuts: np.ndarray) -> list[Chain]:
        edges = [0, *(cuts + 1).tolist(), len(self.ref)]
        return [Chain(self.score, self.ref[a:b], self.read[a:b], self.turned) for a, b in zip(edges, edges[1:], strict=False) if b > a]


def _gap_costs(off: np.ndarray) -> np.ndarray:
    return np.where(off > 0, 0.5 * np.log2(off + 1.0) + 0.01 * K * np.minimum(off, LONGEST_DELETION), 0)


def _scores(groups: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each group of hits (places in the allele and in the read, in order): the best score of a chain that ends in
    each hit, and the hit before it or -1. A step takes the hits of one number of all groups, the largest groups first."""
    size = np.array([len(r) for r, _ in groups])
    ref, read = (np.zeros((int(size[0]), len(groups)), np.int64) for _ in range(2))
    for g, (x, y) in enumerate(groups):
        ref[: len(x), g], read[: len(y), g] = x, y
    furthest = int(ref.max() + read.max())
    table = _gap_costs(np.arange(furthest + 1)) if furthest < TABLE else None
    score, back = np.full(ref.shape, float(K)), np.full(ref.shape, -1)
    live = np.searchsorted(-size, -np.arange(len(ref)), "left")  # groups with more hits than that
    for i in range(1, len(ref)):
        j, g = max(0, i - BACK), int(live[i])
        x, y = ref[i, :g] - ref[j:i, :g], read[i, :g] - read[j:i, :g]
        off = np.abs(x - y)
        gain = score[j:i, :g] + np.minimum(np.minimum(x, y), K) - (_gap_costs(off) if table is None else table[off])
        gain[(x <= 0) | (y <= 0) | (x - y > LONGEST_DELETION)] = -1
        best = gain.argmax(axis=0)
        top = gain[best, np.arange(g)]
        better = np.flatnonzero(top > score[i, :g])
        score[i, better], back[i, better] = top[better], j + best[better]
    for g, n in enumerate(size.tolist()):
        yield score[:n, g], back[:n, g]


def _walked(ref: np.ndarray, read: np.ndarray, turned: bool, score: np.ndarray, back: np.ndarray) -> list[Chain]:
    """Chains of hits, the best first; no hit is in two."""
    order, scores, before = np.argsort(-score, kind="stable").tolist(), score.tolist(), back.tolist()
    used, out = [False] * len(scores), []
    for end in order:
        if used[end]:
            continue
        path, i = [], end
        while i >= 0 and not used[i]:
            path.append(i)
            used[i] = True
            i = before[i]
        total = scores[end] - (scores[i] if i >= 0 else 0)
        if total >= LEAST_SCORE and len(path) > 1:
            where = np.array(path[::-1])
            out.append(Chain(total, ref[where], read[where], turned))
    return sorted(out, key=lambda c: -c.score)


def chains(groups: list[tuple[np.ndarray, np.ndarray, bool]]) -> list[list[Chain]]:
    """Chains of each group of hits: places in the allele and in the read, and whether the read is turned."""
    out: list[list[Chain]] = [[] for _ in groups]
    sorted_groups = {}
    for k, (ref, read, _) in enumerate(groups):
        if len(ref) > 1:  # a hit alone is no chain
            order = np.lexsort((read, ref))
            sorted_groups[k] = (ref[order], read[order])
    todo = sorted(sorted_groups, key=lambda k: -len(sorted_groups[k][0]))
    low = 0
    while low < len(todo):
        high = low + max(1, HITS // len(sorted_groups[todo[low]][0]))
        part = todo[low:high]
        for k, found in zip(part, _scores([sorted_groups[k] for k in part]), strict=True):
            out[k] = _walked(*sorted_groups[k], groups[k][2], *found)
        low = high
    return out


def _overlap(span: tuple[int, int], blocks: list[tuple[int, int]]) -> int:
    return sum(max(0, min(span[1], b) - max(span[0], a)) for a, b in blocks)


def chosen(found: list[Chain], length: int) -> tuple[list[Chain], int]:
    """Parts of the chains that a read's records are made of, and the mapping quality of the best."""
    taken: list[Chain] = []
    blocks: list[list[tuple[int, int]]] = []
    rival = 0.0
    for chain in sorted(found, key=lambda c: -c.score):
        span = chain.span(length)
        inside = [_overlap(span, b) for b in blocks]
        if 2 * sum(inside) > span[1] - span[0]:
            if inside and inside[0] * 2 > span[1] - span[0]:
                rival = max(rival, chain.score)
            continue
        taken.append(chain)
        blocks.append(chain.blocks(length))
    if not taken:
        return [], 0
    quality = int(60 * min(1.0, len(taken[0].ref) / 10) * (1 - min(1.0, rival / taken[0].score)) + 0.5)
    out = []
    for chain in taken:
        others = [c.span(length) for c in taken if c is not chain]
        cuts = [k for k in chain.cuts().tolist() if any(_inside(s, chain, k, length) for s in others)] if others else []
        out += [p for p in chain.parts(np.array(cuts, np.int64)) if p.covered() >= LEAST_SCORE] if cuts else [chain]
    return out, quality


def _inside(span: tuple[int, int], chain: Chain, k: int, length: int) -> bool:
    """Whether most of the span lies in the gap after the chain's hit k."""
    a, b = int(chain.read[k]) + K, int(chain.read[k + 1])
    a, b = (length - b, length - a) if chain.turned else (a, b)
    return 2 * (min(b, span[1]) - max(a, span[0])) > span[1] - span[0]


@dataclass
class Record:
    """A part of a read on an allele: places of its first bases, and runs of operations."""

    owner: int
    turned: bool
    quality: int
    ref_at: int = 0
    read_at: int = 0
    runs: Runs = field(default_factory=list)

    def aligned(self) -> int:
        return sum(n for op, n in self.runs if op == "M")

    def read_end(self) -> int:
        return self.read_at + sum(n for op, n in self.runs if op != "D")

    def cigar(self, length: int) -> str:
        return "".join(f"{n}{op}" for op, n in [("S", self.read_at), *self.runs, ("S", length - self.read_end())] if n)

    def cs(self, ref: np.ndarray, read: np.ndarray) -> str:
        """The long form: =ACGT, *ac (allele, read), -acg, +acg."""
        out, i, j = [], self.ref_at, self.read_at
        for op, n in self.runs:
            if op == "D":
                out.append("-" + ref[i : i + n].tobytes().decode().lower())
            elif op == "I":
                out.append("+" + read[j : j + n].tobytes().decode().lower())
            else:
                a, b = ref[i : i + n].tobytes().decode(), read[j : j + n].tobytes().decode()
                wrong = [*np.flatnonzero(ref[i : i + n] != read[j : j + n]).tolist(), n]
                begin = 0
                for w in wrong:
                    if w > begin:
                        out.append("=" + a[begin:w])
                    if w < n:
                        out.append("*" + (a[w] + b[w]).lower())
                    begin = w + 1
            i += n * (op != "I")
            j += n * (op != "D")
        return "".join(out)


def _joined(part: Chain) -> Iterator[tuple[int, int, int]]:
    """Stretches of a part without a gap: places in the allele and in the read, and length; what overlaps one before is cut or left out."""
    dx, dy = part.ref[1:] - part.ref[:-1], part.read[1:] - part.read[:-1]
    edges = [0, *(((dx != dy) | (dx > K)).nonzero()[0] + 1).tolist(), len(part.ref)]
    i = j = n = 0
    for a, b in zip(edges, edges[1:], strict=False):
        x, y, last = int(part.ref[a]), int(part.read[a]), int(part.ref[b - 1])
        if n and x - i == y - j and x <= i + n:  # it goes on from the one before
            n = last + K - i
            continue
        if n and (x < i + n or y < j + n):
            fits = np.flatnonzero((part.ref[a:b] >= i + n) & (part.read[a:b] >= j + n))
            if not len(fits):
                continue
            x, y = int(part.ref[a + fits[0]]), int(part.read[a + fits[0]])
        if n:
            yield i, j, n
        i, j, n = x, y, last + K - x
    yield i, j, n


def _chained(index: Index, reads: list[bytes]) -> Iterator[tuple[list[np.ndarray], list[tuple[int, list[Chain]]]]]:
    """Of each read: its bytes as it came and turned, and its chains on each allele; as many reads together as have BASES bases."""
    low = 0
    while low < len(reads):
        high, bases = low, 0
        while high < len(reads) and (high == low or bases + len(reads[high]) <= BASES):
            bases += len(reads[high])
            high += 1
        both = [[np.frombuffer(raw, np.uint8), np.frombuffer(raw[::-1].translate(_TURN), np.uint8)] for raw in reads[low:high]]
        number, owner, ref, read = index.hits([s for pair in both for s in pair])
        order = np.lexsort((number & 1, owner, number >> 1))
        number, owner, ref, read = number[order], owner[order], ref[order], read[order]
        edges = np.flatnonzero((np.diff(number) != 0) | (np.diff(owner) != 0)) + 1
        starts = [0, *edges.tolist(), len(number)] if len(number) else [0]
        groups = [(ref[a:b], read[a:b], bool(number[a] & 1)) for a, b in zip(starts, starts[1:], strict=False)]
        found: list[dict[int, list[Chain]]] = [{} for _ in both]
        for a, own in zip(starts, chains(groups), strict=False):
            if own:
                found[int(number[a]) >> 1].setdefault(int(owner[a]), []).extend(own)
        yield from ((pair, list(own.items())) for pair, own in zip(both, found, strict=True))
        low = high


def map_reads(index: Index, reads: list[bytes]) -> list[list[tuple[Record, np.ndarray]]]:
    """Of each read: its records, primary ones first for each allele, with the read's bytes as the record has them."""
    out: list[list[tuple[Record, np.ndarray]]] = []
    gaps, gap_owner, ends, end_owner = [], [], [], []
    for both, by_owner in _chained(index, reads):
        records: list[tuple[Record, np.ndarray]] = []
        for owner, found in by_owner:
            ref = index.bytes[owner]
            parts, quality = chosen(found, len(both[0]))
            if not quality:
                continue
            for part in parts:
                read = both[part.turned]
                record = Record(owner, part.turned, quality, int(part.ref[0]), int(part.read[0]))
                i, j = record.ref_at, record.read_at
                for x, y, n in _joined(part):
                    if record.runs:
                        gap_owner.append((record, len(record.runs)))
                        gaps.append((ref[i:x], read[j:y]))
                        record.runs.append(("?", 0))
                    record.runs.append(("M", n))
                    i, j = x + n, y + n
                ends += [(ref[: record.ref_at][::-1], read[: record.read_at][::-1]), (ref[i:], read[j:])]
                end_owner += [(record, True), (record, False)]
                records.append((record, read))
        out.append(records)
    filled: dict[int, dict[int, Runs]] = {}
    for (record, k), runs in zip(gap_owner, between(gaps), strict=True):
        filled.setdefault(id(record), {})[k] = runs
    for records in out:
        for record, _ in records:
            own = filled.get(id(record), {})
            record.runs = [r for k, x in enumerate(record.runs) for r in own.get(k, [x])]
    for (record, left), runs in zip(end_owner, onwards(ends), strict=True):
        if left:
            record.ref_at -= sum(n for op, n in runs if op != "I")
            record.read_at -= sum(n for op, n in runs if op != "D")
            record.runs = runs[::-1] + record.runs
        else:
            record.runs = record.runs + runs
    for records in out:
        for record, _ in records:
            record.runs = merged(record.runs)
        records.sort(key=lambda r: (r[0].owner, -r[0].aligned(), r[0].ref_at))
    return out


def align(reads: DataFrame, alleles: DataFrame, preset: str = "map-ont", batch: int = READS) -> DataFrame:
    """Alignments of reads (qname, sequence, quality) to each allele that they belong to, a row a record."""
    size = alleles.agg(F.sum(F.length("sequence"))).first()[0] or 0
    if size > MOST_BASES:
        raise ValueError(f"{size} bases of alleles: at most {MOST_BASES} can be indexed in a task")
    few = reads.sparkSession.sparkContext.broadcast([(r["allele"], r["sequence"]) for r in alleles.select("allele", "sequence").collect()])
    names = ["qname", "flag", "rname", "pos", "mapq", "cigar", "seq", "qual", "cs", "preset"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = Index(few.value)
        known: dict[str, list[tuple]] = {}  # records of sequences: reads of an amplicon repeat
        held = 0
        for pdf in batches:
            for low in range(0, len(pdf), batch):
                part, rows = pdf.iloc[low : low + batch], []
                texts = [(s or "").upper() for s in part["sequence"]]
                new = [t for t in dict.fromkeys(texts) if t not in known]
                for text, records in zip(new, map_reads(index, [t.encode() for t in new]), strict=True):
                    made, last = [], None
                    for record, read in records:
                        flag = 16 * record.turned + 2048 * (record.owner == last)
                        last = record.owner
                        made.append((flag, index.names[record.owner], record.ref_at + 1, record.quality, record.cigar(len(text)), read.tobytes().decode(), record.cs(index.bytes[record.owner], read)))
                    known[text] = made
                    held += 1000 + len(text) + sum(1000 + len(m[5]) + len(m[6]) for m in made)
                for name, text, quality in zip(part["qname"], texts, part["quality"], strict=True):
                    for flag, rname, pos, mapq, cigar, seq, cs in known[text]:
                        rows.append((name, flag, rname, pos, mapq, cigar, seq, quality[::-1] if flag & 16 and quality != "*" else quality, cs, preset))
                if held > KNOWN:
                    known, held = {}, 0
                yield pd.DataFrame(rows, columns=names)

    # a small or packed file is one split; equal sequences meet in few tasks, but never all in one
    dealt = reads.repartition(TASKS * reads.sparkSession.sparkContext.defaultParallelism, F.xxhash64("sequence"), F.pmod(F.xxhash64("qname"), F.lit(SPREAD)))
    return dealt.select("qname", "sequence", F.coalesce("quality", F.lit("*")).alias("quality")).mapInPandas(run, "qname string, flag int, rname string, pos int, mapq int, cigar string, seq string, qual string, cs string, preset string")
