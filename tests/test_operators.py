"""Table operators: profiles, loci, classification, k-mers, consensus, variants, statistics."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ampliqua.operators import alignments, classify, cluster, consensus, errors, kmers, profile, stats, sv, windows
from ampliqua.report import html, summary, vcf
from ampliqua.schemas import GenomeCoordinates


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_profile_counts_and_percents(spark):
    reads = spark.createDataFrame([("a", ["=A", "+T|=C", "=N"]), ("a", ["-A", "=C", "=g"]), ("a", ["*AG", "=C", "=G"])], "allele string, tokens array<string>")
    c = profile.count_indels(profile.explode_tokens(reads, ["allele"]), ["allele"])
    assert rows(c, "pos", "match", "ins", "del", "sub") == [(0, 1, 0, 1, 1), (1, 2, 1, 0, 0), (2, 1, 0, 0, 0)]
    p = profile.normalize(c, ["allele"])
    assert (0, "-", 1, 50.0) in rows(p, "pos", "mut", "n", "pct") and (2, "+", 0, 0.0) in rows(p, "pos", "mut", "n", "pct")
    both = profile.against_control(p, p.withColumn("pct", F.lit(99.0)), ["allele"])
    assert all(r["control"] == r["sample"] for r in both.collect())


def test_gap_filling(spark):
    rng = random.Random(2)
    for _ in range(3):
        loci = sorted(rng.sample(range(200), 60))
        got = {r[0] for r in windows.fill_gaps(spark.createDataFrame([("-", p) for p in loci], "mut string, pos int"), ["mut"]).select("pos").collect()}
        one = set(loci)
        for a, b in zip(loci, loci[1:]):
            if b - a < 10:
                one |= set(range(a, b))
        s, two = sorted(one), set(one)
        for a, b in zip(s, s[1:]):
            if b - a <= 20 and sum(a - 11 <= x < a for x in s) >= 8 and sum(b < x <= b + 11 for x in s) >= 8:
                two |= set(range(a, b))
        assert got == two


def test_sessions_and_converter(spark):
    starts = [1, 2, 2, 3, 30, 31, 31, 31, 31, 31, 31, 80]
    df = spark.createDataFrame([(0, s) for s in starts], "k int, pos int")
    conv = dict(rows(windows.start_converter(df, ["k"], "pos", 5, 5), "pos", "start"))
    assert conv == {30: 31, 31: 31}


def test_homopolymers(spark):
    seq = "ACGTAAAACCCCGGGGGTTTTNNNNAC"
    bases = spark.createDataFrame([("a", k, b) for k, b in enumerate(seq)], "allele string, pos int, base string")
    assert rows(profile.repeat_spans(bases, ["allele"]), "start", "stop") == [(4, 8), (8, 12), (12, 17), (17, 21), (21, 25)]
    pairs = spark.createDataFrame([("a", p, "-", 3.0, 2.9) for p in range(27)], "allele string, pos int, mut string, sample double, control double")
    loci = spark.createDataFrame([("a", 3, "-"), ("a", 9, "-")], "allele string, pos int, mut string")
    found = {p for p, in rows(profile.homopolymer_errors(pairs, profile.repeat_spans(bases, ["allele"]), loci, ["allele"]), "pos")}
    assert not set(range(4, 8)) & found and {9, 20, 25} <= found


def test_dissimilar_and_anomalies(spark):
    data = [("a", p, "*", 80.0 if p == 5 else 1.0, 1.0) for p in range(30)]
    pairs = spark.createDataFrame(data, "allele string, pos int, mut string, sample double, control double")
    assert rows(profile.anomalies(pairs, ["allele"]), "pos") == [(5,)]
    x = F.array(F.lit(1.0), F.lit(0.0))
    y = spark.range(1).select(profile.cosine_distance(x, F.array(F.lit(0.0), F.lit(2.0))).alias("d"), profile.cosine_distance(x, F.array(F.lit(0.0), F.lit(0.0))).alias("z")).first()
    assert abs(y["d"] - 1) < 1e-12 and y["z"] == 1


def test_classification_and_minor_alleles(spark):
    data = []
    for k in range(12):
        data += [(f"r{k}", "control", 0, 0.0 if k < 9 else -3.0), (f"r{k}", "flox", 1, -1.0), (f"r{k}", "del", 2, 0.0 if k >= 9 else -9.0)]
    s = spark.createDataFrame(data, "qname string, allele string, allele_ord int, score double")
    n = classify.allele_counts(s)
    assert dict(rows(n, "allele", "n")) == {"control": 9, "del": 3}
    assert rows(classify.minor(n), "allele") == [("del",)] and rows(classify.most_major(n), "allele") == [("control",)]
    merged = classify.allele_counts(classify.merge_minor(s, 2))
    assert dict(rows(merged, "allele", "n")) == {"control": 9, "del": 3}
    assert dict(rows(classify.allele_counts(classify.merge_minor(s, 5)), "allele", "n")) == {"control": 9, "flox": 3}
    t = spark.createDataFrame([("r", "a", 0, ["=A"]), ("r", "b", 1, ["=A"])], "qname string, allele string, allele_ord int, tokens array<string>")
    assert classify.classify(t, no_filter=True).first()["allele"] == "a"


def test_kmers(spark):
    reads = [("x", ["=A", "*AG", "+T|+T|=C", "-A", "=T"])]
    pos = spark.createDataFrame(reads, "qname string, tokens array<string>").select("qname", F.posexplode("tokens").alias("pos", "tok"))
    loci = spark.createDataFrame([(1, ["*"]), (2, ["+"]), (3, ["-"])], "pos int, muts array<string>")
    got = [k for _, k in rows(kmers.kmers(pos, ["qname"], loci, 5), "pos", "kmer")]
    assert got == ["@,@,@", "@,*AG,+T|+T|=C", "*AG,+I=C,-A", "+I=C,-A,@", "@,@,@"]


def test_scores(spark):
    n = spark.createDataFrame([(0, "a,*AG,b", 3), (0, "a,=A,b", 1)], "pos int, kmer string, n long")
    pct = kmers.percents(n, 4)
    assert dict(rows(pct, "kmer", "pct")) == {"a,*AG,b": 75.0, "a,=A,b": 25.0}
    control = spark.createDataFrame([(0, "a,*AG,b", 74.8)], "pos int, kmer string, pct double")
    diff = kmers.subtract(pct, control)
    assert dict(rows(kmers.matches_dropped(kmers.common_errors_dropped(diff)), "kmer", "pct")) == {}
    ins = spark.createDataFrame([(3, "@,+I=A,@", 2.0), (4, "@,+I=C,@", 5.0), (7, "@,+I=G,@", 1.0), (4, "@,*AG,@", 9.0)], "pos int, kmer string, pct double")
    loci = spark.createDataFrame([(p,) for p in (1, 3, 4, 5, 7)], "pos int")
    assert rows(kmers.level_insertions(ins, loci), "pos", "pct") == [(3, 5.0), (4, 5.0), (4, 9.0), (7, 1.0)]


def test_shares_labels_and_merging(spark):
    r = spark.createDataFrame([(k, x) for k, x in enumerate([1, 1, 2, 3, 3, 3])], "read_ord int, label int")
    s = consensus.add_shares(r)
    assert set(rows(s, "label", "readnum", "percent")) == {(1, 2, 33.333), (2, 1, 16.667), (3, 3, 50.0)}
    assert set(rows(windows.dense_label(s.select("label", "percent").withColumnRenamed("label", "old"), [-F.col("percent"), F.col("old")]), "old", "label")) == {(3, 1), (1, 2), (2, 3)}
    assert rows(consensus.drop_minor_labels(s, least=2), "label") == [(1,), (1,), (3,), (3,), (3,)]
    assert set(rows(consensus.rescale(consensus.drop_minor_labels(s, least=2)), "label", "percent")) == {(1, 40.0), (3, 60.0)}
    assert consensus.per_label(s.withColumn("qname", F.col("read_ord")), 1).count() == 3
    c = spark.createDataFrame([("a", 1, 20.0, "AC"), ("a", 2, 50.0, "AG"), ("a", 3, 30.0, "AC")], "allele string, label int, percent double, sequence string")
    merged, mapping = consensus.merge_equal(c)
    assert set(rows(merged, "sequence", "percent", "label")) == {("AC", 50.0, 1), ("AG", 50.0, 2)}
    assert rows(mapping, "label", "new_label") == [(1, 1), (2, 2), (3, 1)]
    named = consensus.names(merged, spark.createDataFrame([("a", "AC")], "allele string, sequence string"))
    assert rows(named, "name") == [("allele01|a|intact|50.0%",), ("allele02|a|indels|50.0%",)]


def test_weight_matrix(spark):
    pos = spark.createDataFrame([(1, 0, "=A"), (1, 0, "-A"), (1, 1, "=N"), (1, 1, "*CG"), (1, 2, "=N"), (1, 2, "=N")], "label int, pos int, tok string")
    ref = spark.createDataFrame([(0, "A"), (1, "C"), (2, "G")], "pos int, base string")
    loci = spark.createDataFrame([(1, ["*"])], "pos int, muts array<string>")
    m = consensus.weight_matrix(pos, ["label"], loci, ref)
    assert rows(m, "pos", "tok", "pct") == [(0, "=A", 100.0), (1, "*CG", 100.0), (2, "=N", 100.0)]
    assert consensus.call(m, ["label"]).first()["sequence"] == "AGN"


def test_sv_runs(spark):
    t = ["=A"] * 5 + ["-A"] * 10 + ["=A"] * 3 + ["-A"] * 9 + ["=a"] * 12 + ["|".join(["+C"] * 11 + ["=A"])]
    pos = spark.createDataFrame([("r", k, x) for k, x in enumerate(t)], "qname string, pos int, tok string")
    loci = spark.createDataFrame([(k, ["-", "+"]) for k in range(len(t))], "pos int, muts array<string>")
    assert rows(sv.runs(pos, "deletion", loci, ["qname"]), "start", "size") == [(5, 10)]
    assert rows(sv.runs(pos, "inversion", loci, ["qname"]), "start", "size") == [(27, 12)]
    assert rows(sv.runs(pos, "insertion", loci, ["qname"]), "start", "size") == [(39, 11)]
    assert sv.unique([(1, "A" * 40), (2, "A" * 41), (3, "C" * 40)], {"control": "G" * 40}) == [1, 3]
    assert sv.predicted_names([4, 5], ["deletion01_predicted"], "deletion") == {4: "deletion001_predicted", 5: "deletion002_predicted"}


def test_variant_records():
    r = vcf.records(["=A", "*CG", "-T", "-T", "=G", "+A|+C|=T", "=a", "=c", "=N", "=N"], "al|1")
    assert [(x["pos"], x["ref"], x["alt"]) for x in r] == [(2, "C", "G"), (3, "T", "<DEL>"), (5, "G", "GAC"), (7, "A", "<INV>"), (9, "N", "<DEL>")]
    assert r[1]["info"]["END"] == "4" and r[3]["info"]["SVLEN"] == "2"
    plus = vcf.to_genome(r[1], GenomeCoordinates("mm", "chr1", 100, 110, "+", 1000))
    assert (plus["chrom"], plus["pos"], plus["info"]["END"]) == ("chr1", 102, "103")
    minus = vcf.to_genome(r[0], GenomeCoordinates("mm", "chr1", 100, 110, "-", 1000))
    assert (minus["pos"], minus["ref"], minus["alt"]) == (109, "G", "C")
    ins = vcf.to_genome(r[2], GenomeCoordinates("mm", "chr1", 100, 110, "-", 1000))
    assert (ins["pos"], ins["ref"], ins["alt"]) == (105, "A", "AGT")
    assert vcf.line(r[4]).endswith("SVTYPE=DEL;TYPE=DEL;SVLEN=-2;SEQ=NN;QNAME=al|1;END=10")
    assert vcf.records(["+A|=C"], "x")[0]["pos"] == 1
    assert [x["alt"] for x in vcf.records(["=G", "+A|*CT"], "x")] == ["GA", "T"]
    assert vcf.records(["=G", "|".join(["+A"] * 51 + ["=C"])], "x")[0]["alt"] == "<INS>"


def test_pages():
    page = html.paragraph(html.split_tags(["=A", "+C|+G|=T", "*AG", "*CT", "-A", "-C", "=g"]))
    assert page == "<p class='p_seq'>A<span class='Ins'>CG</span>T<span class='Sub'>GT</span><span class='Del'>AC</span>G</p>"
    assert html.mark_ranges(["=A", "=C", "=G"], [(1, 2)], "Inv") == ["=A", "<span class='Inv'>=C", "=G</span>"]
    assert "<h1>x</h1>" in html.page(["=A"], None, "x")
    assert "<svg" in html.bar_chart([{"Sample": "s", "Allele type": "control", "Percent of reads": "60%"}])
    assert summary.ordered_types(["unassigned deletion", "flox", "control", "control with indels"])[0] == "control"


def test_statistics():
    assert stats.fisher_exact(100, 100, 100, 100) > 0.9 and stats.fisher_exact(100, 1, 100, 100) < 0.01
    assert abs(stats.fisher_exact(8, 2, 1, 5) - 0.03496503) < 1e-6
    centres, labels = stats.two_means(np.array([1.0, 1.2, 9.0, 9.4]))
    assert np.allclose(centres, [1.1, 9.2]) and labels.tolist() == [0, 0, 1, 1]
    assert stats.threshold(np.array([0.0, 0.1, 50.0])) > 10
    x = np.array([[0.0, 0], [0, 1], [10, 10], [10, 11]])
    assert stats.silhouette(x, np.array([0, 0, 1, 1])) > 0.9
    assert len(set(stats.bisecting_means(x, 2))) == 2
    pairs = {("ca", "abc"): 2, ("abcd", "acbd"): 1, ("", "ab"): 2, ("kitten", "sitting"): 3}
    assert all(stats.damerau_levenshtein(*k) == v for k, v in pairs.items())
    rng = np.random.default_rng(1)
    inlier = stats.local_outlier(rng.normal(0, 1, 200), np.array([0.0, 30.0]))
    assert inlier.tolist() == [True, False]
    y = np.zeros(400)
    y[200] = 100
    assert 200 in stats.gaussian_process_outliers(y + rng.normal(0, 0.1, 400))
    model = stats.detector(np.ones(100), 0.1)
    got = stats.detect(model, np.array([60.0, 95.0]), np.array([1.0, 1.0]))
    assert got.all()


def vectors(spark, x, w=None, n_sample=None, plus=None):
    n = len(x) if n_sample is None else n_sample
    rows = [(v.tolist(), float(1 if w is None else w[k]), int(plus[k]) if plus is not None else 0, k >= n) for k, v in enumerate(x)]
    return spark.createDataFrame(rows, "scores array<double>, w double, plus long, control boolean")


def labels_of(made, x):
    found = {tuple(r["scores"]): r["label"] for r in made.collect()}
    return np.array([found[tuple(v)] for v in x])


def test_clusters_and_strand_repair(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 0.1, (60, 3)), rng.normal(5, 0.1, (40, 3)), rng.normal(0, 0.1, (50, 3))])
    made = cluster.optimise(vectors(spark, x, n_sample=100))
    labels = labels_of(made, x)
    assert len(set(labels[:60])) == 1 and len(set(labels[60:100])) == 1 and labels[0] != labels[70]
    plus = np.array([k % 2 == 0 for k in range(60)] + [True] * 40 + [False] * 50)
    own = vectors(spark, x, n_sample=100, plus=plus).filter("not control").join(made.select("scores", "label"), "scores")
    assert len(set(labels_of(cluster.repair(own, 50, 50), x[:100]))) == 1
    # a control of two kinds keeps the sample together
    assert set(labels_of(cluster.optimise(vectors(spark, np.concatenate([x, x[60:100]]), n_sample=100)), x)) == {0}


def test_repair_by_a_tree_of_the_unbiased_clusters(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal((0, 0), 0.1, (40, 2)), rng.normal((5, 0), 0.1, (40, 2)), rng.normal((5, 1), 0.1, (30, 2))])
    plus = np.array([k % 2 == 0 for k in range(80)] + [True] * 30)
    rows = vectors(spark, x, plus=plus).withColumn("label", F.when(F.col("scores")[0] < 2.5, 0).otherwise(F.when(F.col("scores")[1] < 0.5, 1).otherwise(2)))
    labels = labels_of(cluster.repair(rows, 50, 50), x)
    assert set(labels[:40]) == {0} and set(labels[40:]) == {1}
    biased_all = rows.withColumn("plus", F.lit(1).cast("long"))
    assert set(labels_of(cluster.repair(biased_all, 50, 50), x)) == {0, 1, 2}


def test_silhouette_from_moments_is_that_of_all_pairs(spark):
    rng = np.random.default_rng(3)
    x, w = rng.normal(0, 1, (30, 4)), rng.integers(1, 9, 30)
    label = rng.integers(0, 3, 30)
    label[0] = 3  # weight alone in its cluster
    for first in (1, 5):
        w[0] = first
        rows = vectors(spark, x, w).join(spark.createDataFrame([(v.tolist(), int(k)) for v, k in zip(x, label, strict=True)], "scores array<double>, label int"), "scores")
        at = np.repeat(np.arange(30), w)
        d, kinds = ((x[at][:, None] - x[at][None]) ** 2).sum(2), label[at]
        each = []
        for k in range(len(at)):
            same = kinds == kinds[k]
            a = d[k, same].sum() / max(same.sum() - 1, 1)
            b = min(d[k, kinds == j].mean() for j in set(kinds) - {kinds[k]})
            each.append(0 if same.sum() == 1 else (b - a) / max(a, b))
        assert abs(cluster.silhouette(rows, cluster.moments(rows)) - np.mean(each)) < 1e-9


def test_labels_of_reads_by_counted_vectors(spark):
    kinds = {"control": [([0.0, 0.0], 50), ([40.0, 0.0], 30), ([0.0, 40.0], 20)], "other": [([0.0], 12)]}
    rows, k = [], 0
    for allele, parts in kinds.items():
        for scores, n in parts:
            for _ in range(n):
                rows.append((allele, f"r{k}", "+-"[k % 2], scores))
                k += 1
    sample = spark.createDataFrame(rows, "allele string, qname string, strand string, scores array<double>")
    control = spark.createDataFrame([("control", [0.0, 0.0])] * 2500, "allele string, scores array<double>")
    for parts in (1, 5):  # the same however the tables are split
        got = {r["qname"]: (r["allele"], r["label"]) for r in cluster.label_reads(sample.repartition(parts), control.repartition(parts), (56, 56), read="qname").collect()}
        assert len(got) == 112 and {got[f"r{k}"] for k in range(100, 112)} == {("other", 0)}
        groups = [{got[f"r{k}"][1] for k in r} for r in (range(50), range(50, 80), range(80, 100))]
        assert all(len(g) == 1 for g in groups) and len(set.union(*groups)) == 3
        assert parts == 1 or got == before
        before = got
    assert cluster.label_reads(sample.limit(0), control, (0, 0), read="qname").count() == 0
    assert cluster.label_reads(sample, control.limit(0), (56, 56), read="qname").count() == 112


def test_variant_clusters_by_sizes(spark):
    sample = spark.createDataFrame([(f"d{k}", 100, 500 + k % 3) for k in range(30)] + [(f"i{k}", 300, 60) for k in range(20)] + [(f"n{k}", 200, 11) for k in range(2)] + [("d0", 100, 20)], "qname string, start int, size int")
    control = spark.createDataFrame([("c0", 200, 10)], "qname string, start int, size int")
    got = {r["qname"]: r["label"] for r in sv.cluster(sample, control, 100, 100, "qname").collect()}
    assert len(got) == 52
    one, two = {got[f"d{k}"] for k in range(30)}, {got[f"i{k}"] for k in range(20)}
    assert len(one) == len(two) == 1 and one != two and min(one | two) >= 0
    assert sv.cluster(sample.limit(0), control.limit(0), 5, 5, "qname").count() == 0


def test_decision_tree():
    rng = np.random.default_rng(2)
    x = rng.random((300, 4))
    y = np.where(x[:, 1] > 0.5, np.where(x[:, 3] > 0.3, 2, 1), 0)
    tree = stats.Tree(x[:200], y[:200])
    assert (tree.predict(x[:200]) == y[:200]).all() and (tree.predict(x[200:]) == y[200:]).mean() > 0.95
    assert (stats.Tree(np.zeros((5, 2)), np.array([1, 1, 1, 0, 0])).predict(np.ones((3, 2))) == 1).all()


def test_fisher_at_real_depth():
    from math import comb

    for a, b, c, d in [(0, 0, 0, 0), (3, 1, 1, 3), (0, 9, 12, 4), (40, 60, 300, 280)]:
        n, row, col = a + b + c + d, a + b, a + c
        ways = [comb(row, k) * comb(n - row, col - k) for k in range(max(0, row + col - n), min(row, col) + 1)]
        own = comb(row, a) * comb(n - row, col - a)
        assert abs(stats.fisher_exact(a, b, c, d) - sum(w for w in ways if w <= own) / comb(n, col)) < 1e-9
    assert 0.9 < stats.fisher_exact(50_000, 50_000, 500_000, 500_100) <= 1


def test_thresholds_count_repeated_values(spark):
    values = [1.0] * 50 + [2.0] * 3 + [40.0] * 4 + [44.0]
    centres = stats.two_means(np.array(values))[0]
    assert np.allclose(stats.two_centres(*map(np.array, np.unique(values, return_counts=True))), centres)
    pairs = spark.createDataFrame([("a", "+", v, 0.0) for v in values], "allele string, mut string, sample double, control double")
    assert abs(stats.data_thresholds(pairs, ["allele"]).first()["threshold"] - centres.mean()) < 1e-9


def test_anomalies_by_process_and_network(spark):
    rng = np.random.default_rng(3)
    flat = [("a", k, "+", float(1 + rng.random() * 0.2 + 30 * (k == 200))) for k in range(400)]
    found = profile.insample_errors(spark.createDataFrame(flat, "allele string, pos int, mut string, pct double"), ["allele"])
    assert (200,) in rows(found, "pos") and found.count() < 30
    pairs = spark.createDataFrame([("a", k, m, 60.0 if k == 7 and m == "-" else 1.0, 1.0) for k in range(20) for m in "+-*"], "allele string, pos int, mut string, sample double, control double")
    assert rows(profile.network_anomalies(pairs, ["allele"]), "pos", "mut") == rows(profile.anomalies(pairs, ["allele"]), "pos", "mut") == [(7, "-")]


def test_sampled_reads_and_sorted_alignments(spark, tmp_path):
    from ampliqua.sources import files

    reads = spark.createDataFrame([(k, f"q{k}", f"read{k}", "ACGT", "IIII") for k in range(300)], "read_ord long, identifier string, qname string, sequence string, quality string").repartition(5)
    few = files.downsample(reads, 40)
    assert few.count() == 40 and few.columns == reads.columns and files.downsample(reads, 300).count() == 300
    assert rows(files.downsample(reads, 40), "qname") == rows(few, "qname")
    made = spark.createDataFrame([(f"r{k}", 0, "bca"[k % 3], 1 + k * 7 % 50, 60, "4M", "*", 0, 0, "ACGT", "IIII") for k in range(200)], "qname string, flag int, rname string, pos int, mapq int, cigar string, rnext string, pnext int, tlen int, seq string, qual string").repartition(4)
    files.write_sam(spark.createDataFrame([("@SQ\tSN:a\tLN:9",), ("@PG\tID:x",)], "value string"), made, f"{tmp_path}/sam")
    lines = [x for part in sorted((tmp_path / "sam").glob("part-*")) for x in part.read_text().splitlines()]
    body = [x.split("\t") for x in lines[2:]]
    assert all(x.startswith("@") for x in lines[:2]) and len(body) == 200
    assert [(f[2], int(f[3])) for f in body] == sorted((f[2], int(f[3])) for f in body)


def test_error_reads(spark):
    good, bad = ["=A"] * 50, ["=N"] * 40 + ["=A"] * 10
    c = spark.createDataFrame([(f"g{k}", good) for k in range(30)] + [(f"b{k}", bad) for k in range(10)], "qname string, tokens array<string>")
    judged = errors.control_errors(c)
    assert {r[0][0] for r in judged.filter("error").select("qname").collect()} == {"b"}
    s = spark.createDataFrame([("x", good), ("y", bad)], "qname string, tokens array<string>")
    assert rows(errors.sample_errors(s, judged), "qname", "error") == [("x", False), ("y", True)]
    assert errors.n_filtered(c).count() == 30


def test_alignments(spark):
    a = spark.createDataFrame(
        [("r1", 0, "control", 1, 60, "4M", "ACGT", "IIII", "=ACGT", "map-ont"), ("r1", 0, "control", 1, 60, "3M", "ACG", "III", "=ACG", "sr"), ("r2", 16, "control", 2, 60, "3M", "CGT", "III", "=CGT", "sr")],
        "qname string, flag int, rname string, pos int, mapq int, cigar string, seq string, qual string, cs string, preset string",
    )
    assert rows(alignments.best_preset(a), "qname", "preset") == [("r1", "map-ont"), ("r2", "sr")]
    alleles = spark.createDataFrame([("control", "ACGT")], "allele string, sequence string")
    t = alignments.to_tokens(alignments.of_best_preset(a), alleles)
    assert rows(t.withColumn("m", F.array_join("tokens", ",")), "qname", "strand", "m") == [("r1", "+", "=A,=C,=G,=T"), ("r2", "-", "=N,=C,=G,=T")]
    assert alignments.finish_tokens(t, alleles).count() == 2
    turned = alignments.revcomp_alignments(a.limit(1), 4).first()
    assert (turned["pos"], turned["flag"], turned["seq"]) == (1, 16, "ACGT")
    assert alignments.microhomology("AACGT", "CGTTT") == 3 and alignments.clipped("2S3M", "AACGT") == "CGT"
    one, two = {"cigar": "5M", "pos": 1, "seq": "AACGT", "qual": "IIIII"}, {"cigar": "5M", "pos": 20, "seq": "CGTTT", "qual": "JJJJJ"}
    alignments.trim_pair(one, two)
    assert two == {"cigar": "2M", "pos": 23, "seq": "TT", "qual": "JJ"} and one["cigar"] == "5M"
    assert alignments.sample_reads(a, 1).select("qname").distinct().count() == 1
    kept = windows.overlapping_dropped(spark.createDataFrame([("a", 1, 5), ("a", 4, 5), ("b", 1, 2), ("b", 9, 2)], "qname string, pos int, length int"))
    assert rows(kept, "qname") == [("b",), ("b",)]


def test_fisher_against_all_tables():
    rng = random.Random(3)
    for _ in range(600):
        a, b, c, d = (rng.randint(0, rng.choice((2, 9, 80))) for _ in range(4))
        n, row, col = a + b + c + d, a + b, a + c
        each = {x: math.comb(row, x) * math.comb(n - row, col - x) for x in range(max(0, row + col - n), min(row, col) + 1)}
        want = sum(v for v in each.values() if v <= each[a]) / math.comb(n, col)
        assert stats.fisher_exact(a, b, c, d) == pytest.approx(want, rel=1e-9)
    assert stats.fisher_exact(50_000_000, 50_010_000, 49_990_000, 50_000_000) == 1.0
    assert 0 < stats.fisher_exact(50_000_000, 50_060_000, 49_990_000, 50_000_000) < 1


def test_runs_in_whole_texts(spark):
    texts = ["AAAACC", "CAAAAA", "ANNNNNTTTTT", "ACGT", "", None, "AAAA\0AAAA", "GGGG" * 5000, "aaaa\nAAAAA"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {tuple(r) for r in profile.repeat_spans_of(rows, ["id"], "text").collect()}
    want = {(k, m.start(), m.end()) for k, t in enumerate(texts) for m in re.finditer(r"([ACGTN])\1{3,}", t or "")}
    assert got == want


def test_trimming_reads_its_input_once_and_works_across_batches(spark):
    rng = random.Random(8)
    letters = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    rows = []
    for k in range(40):
        shared = letters((0, 3, 11, 12, 13, 30)[k % 6])
        one, two = letters(40 - len(shared)) + shared, shared + letters(40 - len(shared))
        name = None if k >= 36 else f"r{k}"
        rows += [(name, 2048, 100, "40M", two, "I" * 40), (name, 0, 10, "40M", one, "*")][:: 1 if k % 2 else -1]
        rows += [("alone", 0, 5, "4M", "ACGT", "IIII"), (f"r{k}", 4, 0, "*", "*", "*")][: 1 if k else 2]
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    kinds = "qname string, flag int, pos int, cigar string, seq string, qual string"
    source = spark.createDataFrame(rows, kinds).repartition(3).mapInPandas(counted, kinds)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = [tuple(r) for r in alignments.trim_microhomology(source).filter("qname is null or qname != 'alone'").collect()]
        assert alignments.trim_microhomology(source).filter("qname = 'alone'").count() == 40
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert seen.value == 2 * len(rows)
    want = []
    for name in {r[0] for r in rows if r[0] not in (None, "alone")}:
        one, two = sorted((dict(zip(kinds.replace(" string", "").replace(" int", "").split(", "), r, strict=True)) for r in rows if r[0] == name and r[4] != "*"), key=lambda r: r["pos"])
        n = next((n for n in range(39, 0, -1) if one["seq"].endswith(two["seq"][:n])), 0)
        assert n == alignments.microhomology(one["seq"], two["seq"])
        want += [tuple(one.values()), (name, 2048, 100 + n, f"{40 - n}M", two["seq"][n:], "I" * (40 - n))]
    want += [r for r in rows if r[0] is None]
    assert sorted(got, key=str) == sorted(want, key=str)
