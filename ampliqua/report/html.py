"""Coloured pages of consensus alleles."""

from __future__ import annotations

import html
import re
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ampliqua.functions.sequential import insertion_ranges, inversion_ranges

#: Classes of the spans and their colours.
COLOURS = {"Ins": "#e9a3a3", "Del": "#8fc7e8", "Sub": "#a4d8a4", "Inv": "#d7b8ea", "Ins_Allele": "#f6d7d7"}
_TAG = re.compile(r"(<[^>]+>)")


def mark_ranges(tokens: list[str], ranges: list[tuple[int, int]], css: str) -> list[str]:
    """Tokens with a span of that class opened before the first and closed after the last of each range."""
    out = list(tokens)
    for a, b in ranges:
        if a < len(out):
            out[a] = f"<span class='{css}'>{out[a]}"
            b = min(b, len(out) - 1)
            out[b] = f"{out[b]}</span>"
    return out


def split_tags(marked: list[str]) -> list[str]:
    """Tags and tokens as elements of their own."""
    return [part for text in marked for part in _TAG.split(text) if part]


def _class(part: str) -> str:
    """What neighbours are drawn together: tags and insertions stand alone."""
    if part.startswith("<"):
        return "tag"
    if part.islower():
        return "inverted"
    return {"+": "Ins", "*": "Sub", "-": "Del"}.get(part[0], "plain")


def _drawn(kind: str, token: str) -> str:
    if kind == "Ins":
        *added, anchor = token.split("|")
        return f"<span class='Ins'>{''.join(a[-1] for a in added)}</span>{anchor[-1]}"
    return token[-1]


def paragraph(parts: list[str]) -> str:
    """Tags as they are; runs of substitutions and of deletions as one span; inverted tokens in upper case."""
    out = []
    for kind, group in groupby(parts, _class):
        run = list(group)
        if kind == "tag":
            out += run
        elif kind == "inverted":
            for t in (x.upper() for x in run):
                own = _class(t)
                out.append(f"<span class='{own}'>{t[-1]}</span>" if own in ("Sub", "Del") else _drawn(own, t))
        elif kind in ("Sub", "Del"):
            out.append(f"<span class='{kind}'>{''.join(t[-1] for t in run)}</span>")
        else:
            out += [_drawn(kind, t) for t in run]
    return "<p class='p_seq'>" + "".join(out) + "</p>"


def page(tokens: list[str], variant: list[str] | None, title: str, note: str = "") -> str:
    """A document of the consensus tokens; a structural-variant allele's inversions and insertions are marked."""
    marked = tokens
    if variant:
        marked = mark_ranges(marked, inversion_ranges(variant), "Inv")
        marked = mark_ranges(marked, insertion_ranges(variant), "Ins_Allele")
    style = "".join(f".{k}{{background:{c}}}" for k, c in COLOURS.items()) + ".p_seq{font-family:monospace;word-break:break-all}"
    legend = " ".join(f"<span class='{k}'>{k.replace('_', ' ')}</span>" for k in COLOURS)
    head = f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title><style>{style}</style></head>"
    return f"{head}<body><h1>{html.escape(title)}</h1><p>{html.escape(note)}</p><p>{legend}</p>{paragraph(split_tags(marked))}</body></html>"


@F.pandas_udf(T.StringType())
def page_udf(tokens: pd.Series, variant: pd.Series, title: pd.Series) -> pd.Series:
    return pd.Series([page(list(t), None if v is None else list(v), n) for t, v, n in zip(tokens, variant, title, strict=True)])


def pages(consensus: DataFrame) -> DataFrame:
    """name, html; consensus: name, tokens, variant (tokens of the structural-variant allele, or null)."""
    return consensus.select("name", page_udf("tokens", "variant", "name").alias("html"))


def write(consensus: DataFrame, path: str) -> None:
    pages(consensus).select(F.regexp_replace("name", "[|]", "_").alias("name"), F.col("html").alias("value")).write.partitionBy("name").text(path)


def bar_chart(summary: list[dict], title: str = "Alleles") -> str:
    """Stacked bars of percent by sample, one colour an allele type, as SVG in a page."""
    from ampliqua.report.summary import ordered_types

    kinds = ordered_types([r["Allele type"] for r in summary])
    samples = sorted({r["Sample"] for r in summary})
    colour = {k: f"hsl({int(360 * i / max(len(kinds), 1))},55%,65%)" for i, k in enumerate(kinds)}
    shapes, w = [], 60
    for x, s in enumerate(samples):
        y = 300.0
        for k in kinds:
            share = sum(float(str(r["Percent of reads"]).rstrip("%")) for r in summary if r["Sample"] == s and r["Allele type"] == k)
            if share:
                y -= 3 * share
                shapes.append(f"<rect x='{20 + x * (w + 20)}' y='{y:.1f}' width='{w}' height='{3 * share:.1f}' fill='{colour[k]}'><title>{html.escape(f'{s} {k} {share:.1f}%')}</title></rect>")
        shapes.append(f"<text x='{20 + x * (w + 20)}' y='318' font-size='11'>{html.escape(s)}</text>")
    keys = "".join(f"<li style='color:{colour[k]}'>{html.escape(k)}</li>" for k in kinds)
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><svg width='{40 + len(samples) * (w + 20)}' height='330'>{''.join(shapes)}</svg><ul>{keys}</ul></body></html>"
