"""Tokens of an allele's own coordinates lifted to the control's: a token list through a coordinate map.

The map is a token list itself: the allele's sequence as aligned to the control, end to end. Composing the two is a join of
positions: a base of the allele that the control has too gives its token there, with the control's base as reference; one
that the control lacks becomes an inserted base before the next position; what the allele lacks is deleted. In inverted
stretches of the map (lower case) the allele runs backwards, on the other strand.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ampliqua.align.affine import Runs, between
from ampliqua.align.mapper import _TURN, Index, Record, map_reads
from ampliqua.operators.consensus import PREDICTED


def _tokens(runs: Runs, ref: np.ndarray, read: np.ndarray, i: int, j: int) -> tuple[list[str], str]:
    """Tokens of a stretch of the control from i on, and inserted bases that nothing in it follows."""
    out, waiting = [], ""
    for op, n in runs:
        if op == "I":
            waiting += read[j : j + n].tobytes().decode()
        for k in range(n if op != "I" else 0):
            x, y = chr(ref[i + k]), chr(read[j + k]) if op == "M" else ""
            token = "-" + x if op == "D" else "=" + x if x == y else "*" + x + y
            out.append("|".join(["+" + b for b in waiting] + [token]))
            waiting = ""
        i += n * (op != "I")
        j += n * (op != "D")
    return out, waiting


def _ordered(records: list[tuple[Record, np.ndarray]], length: int) -> list[tuple[Record, int, int, int, int]]:
    """Records that rise in control and allele alike, the largest first choice: with their spans in both."""
    kept: list[tuple[Record, int, int, int, int]] = []
    for record, _ in records:
        end = record.read_end()
        a, b = (length - end, length - record.read_at) if record.turned else (record.read_at, end)
        span = (record.ref_at, record.ref_at + sum(n for op, n in record.runs if op != "I"), a, b)
        if all((span[1] <= s[1] and span[3] <= s[3]) or (span[0] >= s[2] and span[2] >= s[4]) for s in kept):
            kept.append((record, *span))
    return sorted(kept, key=lambda s: s[1])


def whole_tokens(index: Index, sequence: str) -> list[str]:
    """The sequence's tokens on the indexed control, with all its bases in them but those that follow the control's last.

    Stretches between records, and before and after them, are aligned end to end; without any record the whole is.
    """
    ref, raw = index.bytes[0], sequence.upper().encode()
    read, turned = np.frombuffer(raw, np.uint8), np.frombuffer(raw[::-1].translate(_TURN), np.uint8)
    records = [r for r in map_reads(index, [raw])[0] if r[0].owner == 0]
    out: list[str] = []
    waiting, i, j = "", 0, 0

    def add(tokens: list[str], more: str) -> None:
        nonlocal waiting
        if tokens and waiting:
            tokens[0] = "|".join([*("+" + b for b in waiting), tokens[0]])
            waiting = ""
        out.extend(tokens)
        waiting += more

    for record, r0, r1, a0, a1 in [*_ordered(records, len(raw)), (None, len(ref), len(ref), len(raw), len(raw))]:
        add(*_tokens(between([(ref[i:r0], read[j:a0])])[0], ref, read, i, j))
        if record is not None:
            tokens, more = _tokens(record.runs, ref, turned if record.turned else read, r0, record.read_at)
            add([t.lower() for t in tokens] if record.turned else tokens, more)
        i, j = r1, a1
    return out


def control_tokens(alleles: DataFrame) -> DataFrame:
    """allele, tokens of each allele (allele, sequence) on the allele named control. Alleles are a few sequences."""
    control = [r["sequence"] for r in alleles.filter("allele = 'control'").select("sequence").collect()]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = Index([("control", control[0])])
        for pdf in batches:
            yield pd.DataFrame({"allele": pdf["allele"], "tokens": [whole_tokens(index, s) for s in pdf["sequence"]]})

    return alleles.select("allele", "sequence").mapInPandas(run, "allele string, tokens array<string>")


def coordinate_map(maps: DataFrame) -> DataFrame:
    """allele, c (control position from 0), x (its base), kind, a (the allele's position), k, turned: from token lists (allele, tokens).

    kind: M, a base of both; D, one of the control alone (no a); I, the k-th base of the allele alone, before position c.
    """
    each = maps.select("allele", F.posexplode("tokens").alias("c", "tok"))
    pieces = F.split("tok", "[|]")
    anchor = F.element_at(pieces, -1)
    each = each.withColumns({"x": F.upper(F.substring(anchor, 2, 1)), "n": F.size(pieces) - 1, "has": (~anchor.startswith("-")).cast("int"), "turned": anchor.rlike("[a-z]")})
    order = Window.partitionBy("allele").orderBy("c")
    each = each.withColumn("size", F.col("n") + F.col("has"))
    each = each.withColumn("a0", F.sum("size").over(order) - F.col("size"))
    each = each.withColumn("run", F.sum((F.col("turned") != F.coalesce(F.lag("turned").over(order), F.lit(False))).cast("int")).over(order))
    run = Window.partitionBy("allele", "run")
    first, total = F.min("a0").over(run), F.sum("size").over(run)
    # within an inverted stretch the allele runs backwards
    each = each.withColumn("a0", F.when(F.col("turned"), 2 * first + total - F.col("a0") - F.col("size")).otherwise(F.col("a0")))
    at_anchor = F.when(F.col("has") == 1, F.when(F.col("turned"), F.col("a0")).otherwise(F.col("a0") + F.col("n")))
    main = each.select("allele", "c", "x", F.when(F.col("has") == 1, "M").otherwise("D").alias("kind"), at_anchor.cast("int").alias("a"), F.lit(0).alias("k"), "turned")
    extra = each.filter("n > 0").select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k"))
    place = F.when(F.col("turned"), F.col("a0") + F.col("has") + F.col("n") - 1 - F.col("k")).otherwise(F.col("a0") + F.col("k"))
    return main.union(extra.select("allele", "c", "x", F.lit("I").alias("kind"), place.cast("int").alias("a"), "k", "turned"))


def _bases(pieces: Column) -> Column:
    return F.array_join(F.transform(pieces, lambda p: F.substring(p, -1, 1)), "")


def lift(tokens: DataFrame, maps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, tokens on the control, of token lists (keys, allele, tokens) through their allele's map (allele, tokens).

    Alleles without a map give no row. Positions that a list doesn't reach are unknown; bases that follow the control's last
    position are left out.
    """
    where = coordinate_map(maps)
    parts = F.split("tok", "[|]")
    rows = tokens.select(*keys, "allele", F.posexplode("tokens").alias("a", "tok")).withColumns({"own": F.element_at(parts, -1), "ins": _bases(F.slice(parts, 1, F.size(parts) - 1))})
    rows = rows.join(where.filter("a is not null"), ["allele", "a"])
    turn = lambda c: F.reverse(F.translate(c, "ACGTacgt", "TGCAtgca"))
    base = F.upper(F.substring("own", -1, 1))
    base = F.when(F.col("own").startswith("-"), "").otherwise(F.when(F.col("turned"), turn(base)).otherwise(base))
    ins = F.upper(F.when(F.col("turned"), turn(F.col("ins"))).otherwise(F.col("ins")))
    rows = rows.withColumns({"y": base, "ins": ins})
    composed = F.when(F.upper("own") == "=N", "=N").when(F.col("y") == "", F.concat(F.lit("-"), "x")).when(F.col("y") == F.col("x"), F.concat(F.lit("="), "x")).otherwise(F.concat(F.lit("*"), "x", "y"))
    composed = F.when(F.col("turned"), F.lower(composed)).otherwise(composed)
    text = lambda c: F.when(F.col("turned"), F.lower(c)).otherwise(c)
    none = F.lit(None)
    piece = "struct<rank:int,k:int,bases:string>"
    anchors = rows.filter("kind = 'M'").select(*keys, "c", composed.alias("tok"), none.cast("string").alias("rest"), none.cast(piece).alias("piece"))
    own = rows.filter("kind = 'M' and ins <> ''").select(*keys, (F.col("c") + F.col("turned").cast("int")).alias("c"), none.cast("string"), none.cast("string"), F.struct(F.when(F.col("turned"), -1).otherwise(1).alias("rank"), F.lit(0).alias("k"), text(F.col("ins")).alias("bases")))
    added = F.when(F.col("turned"), F.concat("y", "ins")).otherwise(F.concat("ins", "y"))
    extra = rows.filter("kind = 'I'").select(*keys, "c", none.cast("string"), none.cast("string"), F.struct(F.lit(0).alias("rank"), "k", text(added).alias("bases")))
    frame = tokens.select(*keys, "allele").join(where.filter("kind <> 'I'"), "allele").select(*keys, "c", none.cast("string"), F.when(F.col("kind") == "D", F.concat(F.lit("-"), "x")).otherwise("=N"), none.cast(piece))
    every = frame.toDF(*anchors.columns).union(anchors).union(own).union(extra)
    at = every.groupBy(*keys, "c").agg(F.coalesce(F.max("tok"), F.max("rest")).alias("tok"), F.array_join(F.transform(F.array_sort(F.collect_list("piece")), lambda p: p["bases"]), "").alias("ins")).filter("tok is not null")
    prefixed = F.concat(F.array_join(F.transform(F.filter(F.split("ins", ""), lambda b: b != ""), lambda b: F.concat(F.lit("+"), b, F.lit("|"))), ""), F.col("tok"))
    lists = at.select(*keys, F.struct("c", prefixed.alias("t")).alias("x")).groupBy(*keys).agg(F.array_sort(F.collect_list("x")).alias("x"))
    return lists.select(*keys, F.transform("x", lambda x: x["t"]).alias("tokens"))


def on_control(consensus: DataFrame, alleles: DataFrame) -> DataFrame:
    """name, tokens of consensus alleles (name, allele, tokens) on the control: lists of user alleles are lifted.

    Predicted alleles have control coordinates already, and so has the control.
    """
    stays = (F.lower("allele") == "control") | F.col("allele").endswith(PREDICTED)
    others = alleles.filter(~stays)
    if not others.limit(1).count():
        return consensus.select("name", "tokens")
    maps = control_tokens(alleles).filter(~stays)
    lifted = lift(consensus.filter(~stays), maps, ["name"])
    return consensus.filter(stays).select("name", "tokens").unionByName(lifted)
