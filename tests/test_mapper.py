"""The aligner: costs against a brute-force programme, split reads, inversions, and a run that calls one."""

import random
import re
from functools import cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from ampliqua.align import affine, mapper
from ampliqua.functions import strings
from ampliqua.functions.sequential import cs_to_tokens
from ampliqua.operators import alignments
from ampliqua.pipeline import allele_table, genotype, tokens_of
from ampliqua.schemas import RunConfig
from ampliqua.sources import synthetic


def turn(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def array(s):
    return np.frombuffer(s.encode(), np.uint8)


def least_cost(x, y):
    @cache
    def best(i, j, state):
        if i == 0 and j == 0:
            return 0
        out = []
        if i and j:
            out.append(best(i - 1, j - 1, "M") + (0 if x[i - 1] == y[j - 1] else 4))
        if i:
            out.append(best(i - 1, j, "D") + 1 + (6 if state != "D" else 0))
        if j:
            out.append(best(i, j - 1, "I") + 1 + (6 if state != "I" else 0))
        return min(out)

    return best(len(x), len(y), "")


def mutated(rng, s, rate):
    return "".join(c if rng.random() > rate else rng.choice(["", rng.choice("ACGT"), c + rng.choice("ACGT") * rng.randint(1, 3)]) for c in s)


def test_affine_costs_against_brute_force():
    rng = random.Random(4)
    pairs = []
    for _ in range(150):
        x = "".join(rng.choice("ACGTN" if rng.random() < 0.05 else "AC") for _ in range(rng.randint(0, 25)))
        y = mutated(rng, x, 0.25) if rng.random() < 0.7 else "".join(rng.choice("AC") for _ in range(rng.randint(0, 25)))
        pairs.append((x, y))
    found = affine.between([(array(x), array(y)) for x, y in pairs])
    for (x, y), runs in zip(pairs, found, strict=True):
        assert sum(n for op, n in runs if op != "I") == len(x) and sum(n for op, n in runs if op != "D") == len(y)
        assert -affine.Costs().score(runs, array(x), array(y)) == least_cost(x, y)


def test_extension_stops_where_nothing_fits_and_crosses_windows():
    rng = random.Random(6)
    x, y, z = ("".join(rng.choice("ACGT") for _ in range(300)) for _ in range(3))
    runs = affine.onwards([(array(x + y), array(x + z)), (array(x), array(x[:150] + x[153:])), (array(""), array("ACG"))])
    assert abs(sum(n for op, n in runs[0] if op != "I") - 300) < 12
    assert sum(n for op, n in runs[1] if op == "D") == 3 and sum(n for op, n in runs[1] if op == "M") == 297
    assert runs[2] == []


def test_wide_gaps_become_one_deletion_and_one_insertion(monkeypatch):
    monkeypatch.setattr(affine, "MOST", 100)
    assert affine.between([(array("ACGT" + "A" * 20 + "GG"), array("ACGT" + "C" * 30 + "GG"))]) == [[("M", 4), ("D", 20), ("I", 30), ("M", 2)]]


def rebuilt(record, read, ref):
    """The read's and the allele's bases that a cs tag tells."""
    own, other = "", ""
    for op, body in re.findall(r"([=*+-])([A-Za-z]+)", record.cs(ref, read)):
        body = body.upper()
        own += body if op in "=+" else body[1] if op == "*" else ""
        other += body if op in "=-" else body[0] if op == "*" else ""
    return own, other


def test_records_tell_read_and_allele():
    rng = random.Random(9)
    ref = synthetic.control_sequence(1500, 3)
    index = mapper.Index([("control", ref)])
    reads = [mutated(rng, ref[rng.randint(0, 200) : rng.randint(900, 1500)], 0.08) for _ in range(30)]
    reads = [turn(r) if k % 2 else r for k, r in enumerate(reads)]
    for raw, records in zip(reads, mapper.map_reads(index, [r.encode() for r in reads]), strict=True):
        assert len(records) == 1
        record, read = records[0]
        own, other = rebuilt(record, read, array(ref))
        assert own == read.tobytes().decode()[record.read_at : record.read_end()] and other == ref[record.ref_at : record.ref_at + len(other)]
        assert len(own) > 0.95 * len(raw) and sum(n for n, _ in [(int(x[:-1]), x[-1]) for x in re.findall(r"\d+[MIDS]", record.cigar(len(raw))) if x[-1] != "D"]) == len(raw)


def test_split_reads():
    ref = synthetic.control_sequence(7000, 8)
    index = mapper.Index([("control", ref)])
    inside = ref[:2000] + turn(ref[2000:2300]) + ref[2300:3000]
    at_end = ref[:1000] + turn(ref[1000:1500])
    deleted = ref[:1000] + ref[6000:]
    inserted = ref[:1000] + synthetic.control_sequence(1200, 99) + ref[1000:2000]
    found = mapper.map_reads(index, [x.encode() for x in (inside, at_end, turn(at_end), deleted, inserted, "ACGT" * 20, "")])
    spans = [[(r.turned, r.ref_at, r.ref_at + sum(n for op, n in r.runs if op != "I")) for r, _ in records] for records in found]
    near = lambda got, want: len(got) == len(want) and all(a[0] == b[0] and abs(a[1] - b[1]) < 8 and abs(a[2] - b[2]) < 8 for a, b in zip(sorted(got), sorted(want), strict=True))
    assert near(spans[0], [(False, 0, 2000), (False, 2300, 3000), (True, 2000, 2300)])
    assert near(spans[1], [(False, 0, 1000), (True, 1000, 1500)]) and not spans[1][0][0]
    assert near(spans[2], [(True, 0, 1000), (False, 1000, 1500)]) and spans[2][0][0]
    assert near(spans[3], [(False, 0, 1000), (False, 6000, 7000)])
    assert len(spans[4]) == 1 and max(n for op, n in found[4][0][0].runs if op == "I") == 1200
    assert not spans[5] and not spans[6]


def test_a_read_that_fits_twice_is_left_out():
    unit = synthetic.control_sequence(400, 12)
    index = mapper.Index([("twice", unit + synthetic.control_sequence(300, 13) + unit)])
    assert mapper.map_reads(index, [unit.encode()]) == [[]]


def test_chains_of_many_groups_against_one_by_one():
    rng = np.random.default_rng(5)
    groups = []
    for n in (0, 1, 2, 90, 200, 33):
        ref = rng.integers(0, 900, n)
        groups.append((ref, np.where(rng.random(n) < 0.7, ref + 5 * rng.integers(0, 3, n), rng.integers(0, 900, n)), bool(n % 2)))
    for (ref, read, turned), found in zip(groups, mapper.chains(groups), strict=True):
        order = np.lexsort((read, ref))
        ref, read = ref[order], read[order]
        score, back = [float(mapper.K)] * len(ref), [-1] * len(ref)
        for i in range(len(ref)):
            for j in range(max(0, i - mapper.BACK), i):
                x, y = int(ref[i] - ref[j]), int(read[i] - read[j])
                gain = score[j] + min(x, y, mapper.K) - (0.5 * np.log2(abs(x - y) + 1.0) + 0.01 * mapper.K * min(abs(x - y), mapper.LONGEST_DELETION) if x != y else 0)
                if x > 0 and y > 0 and x - y <= mapper.LONGEST_DELETION and gain > score[i] + 1e-9:
                    score[i], back[i] = gain, j
        assert all(c.turned == turned and (np.diff(c.ref) > 0).all() and (np.diff(c.read) > 0).all() for c in found)
        if len(ref) > 1 and max(score) >= mapper.LEAST_SCORE:
            assert found and abs(found[0].score - max(score)) < 1e-6


def test_reads_of_one_split_are_dealt_to_many_tasks_and_repeats_are_rows_each(spark):
    ref = synthetic.control_sequence(500, 17)
    rows = [(f"r{k}", [ref[:300], turn(ref[100:400]), ref[200:]][k % 3], "I" * 299 + "#") for k in range(30)]
    reads = spark.createDataFrame(rows, "qname string, sequence string, quality string").coalesce(1)
    found = mapper.align(reads, allele_table(spark, {"control": ref}))
    assert reads.rdd.getNumPartitions() == 1 and found.rdd.getNumPartitions() > spark.sparkContext.defaultParallelism
    want = {(f"r{k}", (0, 16, 0)[k % 3], (1, 101, 201)[k % 3], ("I" * 299 + "#")[:: -1 if k % 3 == 1 else 1]) for k in range(30)}
    got = [(r["qname"], r["flag"], r["pos"], r["qual"]) for r in found.collect()]
    assert len(got) == 30 and set(got) == want


def test_tokens_of_an_inversion(spark):
    ref = synthetic.control_sequence(1200, 21)
    rows = [("inv", ref[:500] + turn(ref[500:700]) + ref[700:]), ("turned", turn(ref[:500] + turn(ref[500:700]) + ref[700:])), ("plain", ref), (None, None), ("empty", "")]
    reads = spark.createDataFrame([(n, s, None) for n, s in rows], "qname string, sequence string, quality string")
    table = allele_table(spark, {"control": ref})
    found = mapper.align(reads, table)
    assert {r["flag"] for r in found.filter("qname = 'inv'").collect()} == {0, 2048, 2064}
    assert all(len(r["seq"]) == 1200 and sum(int(n) for n, op in re.findall(r"(\d+)([MIS])", r["cigar"])) == 1200 for r in found.collect())
    tokens = {r["qname"]: list(r["tokens"]) for r in tokens_of(reads, table, "t").collect()}
    for name in ("inv", "turned"):
        lower = [k for k, t in enumerate(tokens[name]) if t.islower()]
        assert abs(lower[0] - 500) < 8 and abs(lower[-1] - 699) < 8 and len(lower) > 190
    assert tokens["plain"] == ["=" + c for c in ref] and len(tokens) == 3
    one = found.filter("qname = 'plain'").first()
    assert cs_to_tokens(one["cs"], one["pos"], 1200) == tokens["plain"]
    assert found.select(F.sum(strings.aligned_length(F.col("cigar")))).first()[0] > 0 and alignments.best_preset(found).count() == 3


@pytest.mark.parametrize("kind", ["inversion"])
def test_a_run_calls_the_inversion(spark, kind):
    c = synthetic.control_sequence(700, 31)
    inverted = c[:300] + turn(c[300:420]) + c[420:]
    sample = synthetic.reads(spark, [(c, 0.5), (inverted, 0.5)], 60, 2, 0.002)
    control = synthetic.reads(spark, [(c, 1.0)], 50, 3, 0.002)
    result = genotype(sample, control, RunConfig("s", "s", "control", {"control": c}))
    rows = result.consensus.collect()
    assert {r["allele"] for r in rows} == {"control", "inversion01_predicted"}
    assert [v["alt"] for v in result.variants.collect()] == ["<INV>"]
