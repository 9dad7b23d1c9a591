"""Variant records of consensus alleles, in local and in genomic coordinates, and VCF text."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ampliqua.functions.strings import revcomp_text
from ampliqua.schemas import GenomeCoordinates

#: Insertions of more bases are symbolic.
LARGE = 50
#: INFO keys that come first, and the header's lines.
FIRST_KEYS = ("SVTYPE", "TYPE", "SVLEN", "SEQ", "QNAME")
HEADER = ["##fileformat=VCFv4.3", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO"]
SCHEMA = "chrom string, pos int, id string, ref string, alt string, info map<string,string>, ord int"


def _kind(token: str) -> str:
    if any(c.islower() for c in token):
        return "inverted"
    if token == "=N":
        return "unknown"
    return {"-": "deleted", "*": "substituted", "+": "inserted"}.get(token[0], "match")


def _base(token: str) -> str:
    anchor = token.rpartition("|")[2]
    return anchor[1].upper() if len(anchor) > 1 else "N"


def events(tokens: list[str]) -> Iterator[tuple[str, int, list[str]]]:
    """Kind, first position (from 1) and tokens: runs of inverted, unknown or deleted ones, and each other mutation by itself."""
    kind, start, run = "", 0, []
    for pos, token in enumerate(tokens, 1):
        now = _kind(token)
        if run and now != kind:
            yield kind, start, run
            run = []
        if now in ("inverted", "unknown", "deleted"):
            if not run:
                kind, start = now, pos
            run.append(token)
        elif now != "match":
            yield now, pos, [token]
    if run:
        yield kind, start, run


def records(tokens: list[str], name: str, chrom: str = "control") -> list[dict]:
    """Records in local coordinates, in the order of their first tokens."""
    out = []

    def add(pos: int, ref: str, alt: str, **info: object) -> None:
        out.append({"chrom": chrom, "pos": pos, "id": name, "ref": ref, "alt": alt, "info": {k: str(v) for k, v in info.items()}})

    for kind, pos, run in events(tokens):
        bases = "".join(map(_base, run))
        if kind == "inverted":
            add(pos, bases[0], "<INV>", SVTYPE="INV", SVLEN=len(run), SEQ=bases, QNAME=name)
        elif kind == "unknown":
            add(pos, "N", "<DEL>", SVTYPE="DEL", TYPE="DEL", SVLEN=-len(run), SEQ="N" * len(run), QNAME=name)
        elif kind == "deleted":
            add(pos, bases[0], "<DEL>", SVTYPE="DEL", TYPE="DEL", SVLEN=-len(run), SEQ=bases, QNAME=name, END=pos + len(run) - 1)
        elif kind == "substituted":
            add(pos, bases, run[0][2:].upper() or bases, TYPE="SUB", QNAME=name)
        else:
            *parts, anchor = run[0].split("|")
            seq = "".join(p[1:] for p in parts).upper()
            left = _base(tokens[pos - 2]) if pos > 1 else bases
            more = {"SEQ": seq} if seq else {}
            add(pos - (pos > 1), left, "<INS>" if len(seq) > LARGE else left + seq, TYPE="INS", SVLEN=len(seq), QNAME=name, **more, _RIGHT=pos, _BASE=bases)
            if anchor.startswith("*") and anchor[2:].upper() not in ("", bases):
                add(pos, bases, anchor[2:].upper(), TYPE="SUB", QNAME=name)
    return out


def _turned(sequence: str) -> str:
    return revcomp_text("".join(c for c in sequence.upper() if c in "ACGTN"))


def to_genome(record: dict, where: GenomeCoordinates, one_based: bool = False) -> dict:
    """A record in the chromosome's coordinates; on the minus strand with its bases turned and an insertion's other anchor.

    On the plus strand a position is start + local - 1, one less than VCF's counting from a 0-based start; one_based adds it.
    """
    out, info = dict(record), dict(record["info"])
    out |= {"chrom": where.chrom, "info": info}
    pos, end = record["pos"], int(info.get("END", record["pos"]))
    if where.strand != "-":
        shift = where.start - 1 + one_based
        out["pos"] = pos + shift
        if "END" in info:
            info["END"] = str(end + shift)
        return out
    turn = lambda p: where.end - p + 1
    kind = info.get("TYPE") or info.get("SVTYPE", "")
    seq = _turned(info.get("SEQ", ""))
    if kind == "INS":
        ref = _turned(info.get("_BASE", record["ref"])) or "N"
        out |= {"pos": turn(int(info.get("_RIGHT", pos))), "ref": ref, "alt": "<INS>" if record["alt"] == "<INS>" else ref + seq}
    elif kind in ("DEL", "INV"):
        out |= {"pos": turn(end), "ref": seq[:1] or _turned(record["ref"]) or "N"}
        info["END"] = str(turn(pos))
    else:
        alt = record["alt"]
        out |= {"pos": turn(pos), "ref": _turned(record["ref"]) or "N", "alt": alt if alt.startswith("<") else _turned(alt) or "N"}
    if seq:
        info["SEQ"] = seq
    return out


def info_text(info: dict[str, str]) -> str:
    """Keys in order of precedence, then by name; those that begin with '_' stay inside; '%' is escaped."""
    public = {k: v for k, v in info.items() if not k.startswith("_")}
    order = [k for k in FIRST_KEYS if k in public] + sorted(k for k in public if k not in FIRST_KEYS)
    return ";".join(f"{k}={public[k].replace('%', '%25')}" for k in order) or "."


def line(record: dict) -> str:
    info = dict(record["info"])
    if "END" not in info and "DEL" in (info.get("SVTYPE"), info.get("TYPE")) and "SVLEN" in info:
        info["END"] = str(record["pos"] + abs(int(info["SVLEN"])) - 1)
    return "\t".join([record["chrom"], str(record["pos"]), record["id"].replace("%", "%25"), record["ref"], record["alt"], ".", "PASS", info_text(info)])


def variants(consensus: DataFrame, where: GenomeCoordinates | None = None, chrom: str = "control") -> DataFrame:
    """Records of consensus alleles (name, tokens): chrom, pos, id, ref, alt, info, ord (within the allele)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for name, tokens in zip(pdf["name"], pdf["tokens"], strict=True):
                found = records(list(tokens), name.replace("|", "_"), chrom)
                found = sorted((to_genome(r, where) for r in found), key=lambda r: (r["chrom"], r["pos"], r["id"])) if where else found
                rows += [r | {"ord": k} for k, r in enumerate(found)]
            yield pd.DataFrame(rows, columns=["chrom", "pos", "id", "ref", "alt", "info", "ord"])

    return consensus.select("name", "tokens").mapInPandas(run, SCHEMA)


def text_lines(found: DataFrame) -> DataFrame:
    """id, k, value: the lines of each allele's VCF, header first, by chromosome, position and order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["value"] = [line(r) for r in pdf.to_dict("records")]
            yield pdf[["id", "k", "value"]]

    ranked = found.withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy("chrom", "pos", "ord")) + 1)
    body = ranked.mapInPandas(run, "id string, k int, value string")
    head = found.select("id").distinct().select("id", F.posexplode(F.array(*map(F.lit, HEADER))).alias("k", "value"))
    return head.union(body)


def write(found: DataFrame, path: str) -> None:
    """A folder for each allele (id=...) with its VCF text."""
    text_lines(found).repartition("id").sortWithinPartitions("id", "k").select("id", "value").write.partitionBy("id").text(path)
