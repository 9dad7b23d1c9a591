"""Tokens lifted from an allele to the control: against sequences, with insertions, deletions, substitutions and inversions."""

import random

from pyspark.sql import functions as F

from ampliqua.align.mapper import Index
from ampliqua.functions import tokens as K
from ampliqua.operators import lift
from ampliqua.pipeline import allele_table
from ampliqua.report import vcf
from ampliqua.schemas import GenomeCoordinates
from ampliqua.sources import synthetic

COMPLEMENT = str.maketrans("ACGT", "TGCA")


def turn(s):
    return s[::-1].translate(COMPLEMENT)


def random_tokens(rng, allele):
    """Tokens on the allele, and the sequence that they tell."""
    out, seq = [], ""
    for x in allele:
        ins = "".join(rng.choice("ACGT") for _ in range(rng.randint(1, 3))) if rng.random() < 0.08 else ""
        kind = rng.random()
        y = "" if kind < 0.06 else rng.choice([b for b in "ACGT" if b != x]) if kind < 0.12 else x
        out.append("".join(f"+{b}|" for b in ins) + ("-" + x if not y else "=" + x if y == x else "*" + x + y))
        seq += ins + y
    return out, seq


def test_a_map_has_all_bases_of_its_allele(spark):
    c = synthetic.control_sequence(900, 2)
    index = Index([("control", c)])
    cases = {"same": c, "flox": c[:300] + synthetic.control_sequence(40, 9) + c[300:], "short": c[:200] + c[800:], "ends": "T" + c[5:-6] + "GGA", "inverted": c[:400] + turn(c[400:560]) + c[560:], "other": synthetic.control_sequence(50, 77), "none": ""}
    rows = [(n, lift.whole_tokens(index, s)) for n, s in cases.items()]
    df = spark.createDataFrame(rows, "allele string, tokens array<string>")
    got = {r[0]: r[1] for r in df.select("allele", K.sequence_of(F.col("tokens"))).collect()}
    assert all(len(t) == 900 for _, t in rows)
    for name, seq in cases.items():
        assert got[name].upper() == seq or (name in ("ends", "other") and seq.startswith(got[name].upper()))
    assert sum(t.islower() for t in dict(rows)["inverted"]) > 150
    places = lift.coordinate_map(df).filter("kind <> 'D'").groupBy("allele").agg(F.count("a"), F.count_distinct("a"), F.max("a")).collect()
    for name, n, different, last in (tuple(r) for r in places):
        assert n == different == last + 1 <= len(cases[name])


def test_lifted_tokens_tell_the_same_sequence(spark):
    rng = random.Random(8)
    c = synthetic.control_sequence(500, 4)
    alleles = {"control": c, "flox": c[:200] + synthetic.control_sequence(34, 5) + c[200:], "gone": c[:150] + c[260:], "both": c[:100] + "ACGTTT" + c[110:300] + "A" + c[302:], "inv": c[:200] + turn(c[200:330]) + c[330:]}
    table = allele_table(spark, alleles)
    rows, want = [], {}
    for k in range(40):
        name = rng.choice(list(alleles))
        tokens, seq = random_tokens(rng, alleles[name])
        if tokens[-1].startswith("+"):
            continue
        rows.append((k, name, tokens))
        want[k] = seq
    tokens = spark.createDataFrame([*rows, (99, "unknown", ["=A"])], "id int, allele string, tokens array<string>")
    found = lift.lift(tokens, lift.control_tokens(table), ["id"])
    got = {r["id"]: r for r in found.select("id", "tokens", K.sequence_of(F.col("tokens")).alias("s")).collect()}
    assert set(got) == set(want)
    for k, seq in want.items():
        assert len(got[k]["tokens"]) == 500
        assert got[k]["s"].upper() == seq
        for x, t in zip(c, got[k]["tokens"], strict=True):
            anchor = t.rpartition("|")[2]
            assert anchor[1].upper() in (x, "N")


def test_unknown_and_missing_positions(spark):
    maps = spark.createDataFrame([("a", ["=A", "-C", "+T|=G", "*TA"])], "allele string, tokens array<string>")
    rows = spark.createDataFrame([(1, "a", ["=A", "=N"]), (2, "a", ["*AC", "-T", "=G", "*AT"]), (3, "a", ["=A", "+C|=T", "+A|-G", "+G|=A"])], "id int, allele string, tokens array<string>")
    got = {r["id"]: list(r["tokens"]) for r in lift.lift(rows, maps, ["id"]).collect()}
    assert got == {1: ["=A", "-C", "+N|=N", "=N"], 2: ["*AC", "-C", "=G", "=T"], 3: ["=A", "-C", "+C|+T|+A|-G", "+G|*TA"]}


def test_records_of_a_flox_allele_lie_on_the_control(spark):
    c = synthetic.control_sequence(240, 5)
    extra = "ACGTTGCATGCCTAGGATTACAGCATGCAA"
    flox = synthetic.inserted(c, 120, extra)
    tokens = ["=" + b for b in flox]
    tokens[200] = "*" + flox[200] + {"A": "C"}.get(flox[200], "A")
    table = allele_table(spark, {"control": c, "flox": flox})
    rows = spark.createDataFrame([("allele01|flox|indels|50%", "flox", tokens), ("allele02|control|intact|50%", "control", ["=" + b for b in c]), ("allele03|unassigned|deletion|1%", "deletion01_predicted", ["-" + c[0], *("=" + b for b in c[1:])])], "name string, allele string, tokens array<string>")
    lifted = lift.on_control(rows, table)
    assert {r["name"]: len(r["tokens"]) for r in lifted.collect()} == {r["name"]: 240 for r in rows.collect()}
    found = {(r["pos"], r["ref"], r["alt"], r["info"]["TYPE"]) for r in vcf.variants(lifted).filter("id like 'allele01%'").collect()}
    (ins,) = [r for r in found if r[3] == "INS"]
    assert {r for r in found if r[3] != "INS"} == {(171, flox[200], tokens[200][2], "SUB")}
    # an insertion may slide along equal bases: the sequence is what counts
    assert c[: ins[0]] + ins[2][1:] + c[ins[0] :] == flox and len(ins[2]) == 31
    genome = vcf.variants(lifted, GenomeCoordinates("mm", "chr1", 1000, 1240, "+", 5000)).filter("id like 'allele01%'").collect()
    assert {r["chrom"] for r in genome} == {"chr1"} and 1000 + 171 - 1 in {r["pos"] for r in genome}
