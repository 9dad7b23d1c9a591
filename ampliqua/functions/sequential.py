"""Token rewrites that carry state from one position to the next: plain Python, and pandas UDFs around it."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_COMPLEMENT = str.maketrans("ACGTNacgtn", "TGCANtgcan")


def repair_indels(tokens: list[str]) -> list[str]:
    """An insertion that restores just the bases deleted before it (`-C,+C|=T`) becomes matches (`=C,=T`)."""
    out = list(tokens)
    k = len(out) - 1
    while k >= 0:
        *added, anchor = out[k].split("|")
        n = len(added)
        before = out[k - n : k] if out[k].startswith("+") and 0 < n <= k else []
        if before and [t[:1] for t in before] == ["-"] * n and [t.lstrip("-") for t in before] == [a.lstrip("+") for a in added]:
            out[k - n : k + 1] = ["=" + t.lstrip("-") for t in before] + [anchor]
            k -= n
        k -= 1
    return out


def reverse_complement_tokens(tokens: list[str]) -> list[str]:
    """Tokens of the other strand: an insertion moves on to the token that follows it there."""
    out: list[str] = []
    carried: list[str] = []
    for t in reversed(tokens):
        *added, anchor = t.split("|")
        own = anchor.translate(_COMPLEMENT)
        out.append("|".join([*carried, own]))
        carried = [a.translate(_COMPLEMENT) for a in reversed(added)]
    if carried:  # nothing follows the last token: the insertion stays with it
        out[-1] = "|".join([*carried, out[-1]])
    return out


def cs_to_tokens(cs: str, pos: int, length: int, reverse_inverted: bool = False) -> list[str]:
    """Tokens of a long cs tag (`=AC*ag-t+gg`) of an alignment that begins at pos (1-based) on a reference of that length."""
    out: list[str] = ["=N"] * (pos - 1)
    pending: list[str] = []
    for op, body in re.findall(r"([=*+~-])([A-Za-z0-9]+)", cs):
        if op == "+":
            pending += ["+" + b for b in body.upper()]
            continue
        made = ["*" + body.upper()] if op == "*" else [op + b for b in body.upper()] if op in "=-" else ["=N"] * int(re.sub(r"\D", "", body))
        if pending and made:
            made[0], pending = "|".join([*pending, made[0]]), []
        out += made
    out += ["=N"] * (length - len(out))
    out = out[:length]
    return [t.lower() for t in out] if reverse_inverted else out


def join_split_alignments(parts: list[tuple[int, list[str]]], length: int) -> list[str]:
    """One token list from several alignments of a read (strand flag, tokens): the first to know a position gives it.

    Parts on the other strand than the first are inversions: lower case.
    """
    out = ["=N"] * length
    main = parts[0][0] if parts else 0
    for strand, tokens in parts:
        for k, t in enumerate(tokens[:length]):
            if out[k] == "=N" and t != "=N":
                out[k] = t if strand == main else t.lower()
    return out


def runs(flags: list[bool]) -> Iterator[tuple[int, int]]:
    """Inclusive ranges of consecutive true values."""
    for on, group in groupby(enumerate(flags), key=lambda x: x[1]):
        if on:
            where = [k for k, _ in group]
            yield where[0], where[-1]


def inversion_ranges(tokens: list[str]) -> list[tuple[int, int]]:
    return list(runs([t.islower() for t in tokens]))


def insertion_ranges(tokens: list[str]) -> list[tuple[int, int]]:
    """In expanded coordinates; each range is shifted by the ends of those before it."""
    out, shift = [], 0
    for k, t in enumerate(tokens):
        if t.startswith("+"):
            out.append((k + shift, k + shift + t.count("|") - 1))
            shift += out[-1][1]
    return out


def overlay(consensus: list[str], variant: list[str]) -> list[str]:
    """A structural-variant allele's deletions, inversions and insertions marked in the consensus called on that allele."""
    out: list[str] = []
    at = 0  # in the consensus: it lacks what the variant deletes, and has what it inserts
    for k, v in enumerate(variant):
        if v.startswith("-"):
            out.append(v)
            continue
        if at >= len(consensus):
            break
        if v.startswith("+"):
            stop, added = at + v.count("|"), []
            for c in consensus[at:stop]:
                *ins, anchor = c.split("|")
                added += ins + ([] if anchor.startswith("-") else ["+" + anchor[-1]])
            at = min(stop, len(consensus))
            while at < len(consensus) and consensus[at].startswith("-"):
                at += 1
            out.append("|".join([*added, consensus[at] if at < len(consensus) else "=N"]))
        elif v.islower():
            out.append(consensus[at].lower())
        else:
            out.append(consensus[at])
        at += 1
    return out


def between_deletions(variant: list[str]) -> list[tuple[int, int]]:
    """Inclusive ranges of what stands between two deletion runs."""
    deleted = list(runs([t.startswith("-") for t in variant]))
    return [(a[1] + 1, b[0] - 1) for a, b in zip(deleted, deleted[1:], strict=False)]


def deletion_ends(variant: list[str]) -> list[int]:
    """First positions after each deletion run that something follows."""
    return [b + 1 for _, b in runs([t.startswith("-") for t in variant]) if b + 1 < len(variant)]


def insertion_like(ranges: list[list[str]], least: int = 10) -> list[bool]:
    """Whether each range lacks `least` matches in a row; the count runs on from one range to the next."""
    out, count = [], 0
    for tokens in ranges:
        found = False
        for t in tokens:
            count = count + 1 if t.startswith("=") else 0
            if count >= least:
                found = True
                break
        out.append(not found)
    return out


def insertions_within_deletion(consensus: list[str], variant: list[str]) -> list[str]:
    """Short stretches between deletion runs are insertions: deleted where they stood, inserted after the runs."""
    out, spans = list(consensus), between_deletions(variant)
    spans = [s for s in spans if s[0] <= s[1] < len(out)]
    kinds = insertion_like([out[a : b + 1] for a, b in spans])
    ends, pending = deletion_ends(variant), []
    for (a, b), is_insertion in zip(spans, kinds, strict=True):
        if is_insertion:
            pending += ["+" + t[-1] for t in out[a : b + 1] if not t.startswith("-")]
            out[a : b + 1] = ["-" + t[1:] for t in variant[a : b + 1]]
            continue
        if pending:
            out[a], pending = "|".join([*pending, out[a]]), []
    if pending and ends:
        k = ends[-1]
        while k < len(out) and out[k].startswith("-"):
            k += 1
        if k < len(out):
            out[k] = "|".join([*pending, out[k]])
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def repair_indels_udf(tokens: pd.Series) -> pd.Series:
    return tokens.map(lambda t: repair_indels(list(t)), na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def reverse_complement_udf(tokens: pd.Series) -> pd.Series:
    return tokens.map(lambda t: reverse_complement_tokens(list(t)), na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def overlay_udf(consensus: pd.Series, variant: pd.Series) -> pd.Series:
    return pd.Series([None if c is None or v is None else insertions_within_deletion(overlay(list(c), list(v)), list(v)) if any(t.startswith("-") for t in v) else overlay(list(c), list(v)) for c, v in zip(consensus, variant, strict=True)])
