"""Scalar functions over tokens, names and alignments: input and expected output side by side."""

import pytest
from pyspark.sql import functions as F

from ampliqua.functions import sequential as Q
from ampliqua.functions import strings as S
from ampliqua.functions import tokens as K


def one(spark, expr, **columns):
    """Values of an expression over rows given by columns."""
    names = list(columns)
    rows = list(zip(*columns.values(), strict=True))
    kinds = ", ".join(f"{n} {'array<string>' if isinstance(rows[0][k], list) else 'int' if isinstance(rows[0][k], int) else 'string'}" for k, n in enumerate(names))
    return [r["x"] for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {kinds}").orderBy("i").select(expr.alias("x")).collect()]


def test_match_score(spark):
    cases = {"=A,=C,=G": 0, "=A,+T|+T|=G": -2, "-A,-C,=G": -2, "=A,*CG": -1, "=A,=c,=g": -2, "*ag": -3}
    assert one(spark, K.match_score(F.col("m")), m=list(cases)) == list(cases.values())


def test_unknown_and_inverted_tokens(spark):
    tokens = ["=N", "=n", "+A|=N", "=A", "-N", "=a", "*ag", "+t|=c", "+T|=c"]
    assert one(spark, K.is_n_tag(F.col("t")), t=tokens) == [True, True, True] + [False] * 6
    assert one(spark, K.is_lower(F.col("t")), t=tokens) == [False, True, False, False, False, True, True, True, False]
    assert one(spark, K.has_lower(F.col("t")), t=tokens)[-1] is True
    assert one(spark, K.reference_base(F.col("t")), t=["=A", "*CG", "-t", "+A|+C|=G", "+A", ""]) == ["A", "C", "T", "G", "N", "N"]


def test_internal_unknown_runs(spark):
    x = K.internal_n_to_deletion(F.col("t"), F.col("r"))
    got = one(spark, x, t=[["=N", "=C", "=N", "=N", "=A", "=N"], ["=N", "=N"], ["=A"]], r=["GCTTAG", "AC", "A"])
    assert got == [["=N", "=C", "-T", "-T", "=A", "=N"], ["=N", "=N"], ["=A"]]
    b = one(spark, K.n_boundaries(F.col("t")), t=[["=N", "=N", "=A", "=C", "=N"]])
    assert (b[0]["left"], b[0]["right"]) == (1, 4)
    assert one(spark, K.n_percent(F.col("t")), t=[["=N", "=A"]]) == [50.0]
    assert one(spark, K.longest_n_run(F.col("t")), t=["MNNMNNNM", "", "NN"]) == [3, 0, 2]


def test_indel_repair():
    assert Q.repair_indels(["-C", "+C|=T"]) == ["=C", "=T"]
    assert Q.repair_indels(["=A", "-C", "-G", "+C|+G|=T", "=A"]) == ["=A", "=C", "=G", "=T", "=A"]
    assert Q.repair_indels(["-C", "+G|=T"]) == ["-C", "+G|=T"]
    assert Q.repair_indels(["+C|=T"]) == ["+C|=T"]


def test_sequences_and_cs(spark):
    t = [["=A", "*AG", "-C", "+T|+T|=G"], ["=A", "=a", "=c", "=G"], ["+A|-C", "=G"], []]
    assert one(spark, K.sequence_of(F.col("t")), t=t) == ["AGTTG", "AgtG", "AG", ""]
    assert one(spark, K.cs_tag(F.col("t")), t=[["=A", "=C", "*AG", "*TC", "-G", "-G", "+T|+A|=C"]]) == ["=AC*ag*tc-gg+ta=C"]
    assert one(spark, K.compress_insertion(F.col("t")), t=["+A|+C|=G", "=A"]) == ["+I=G", "=A"]
    assert one(spark, K.compress_insertion(F.col("t"), True), t=["+A|+C|=G"]) == ["+2=G"]
    assert one(spark, K.inserted(F.col("t")), t=["+a|+C|=G", "=A"]) == ["AC", ""]


def test_reverse_complement_of_tokens():
    assert Q.reverse_complement_tokens(["=A", "*CG", "-T"]) == ["-A", "*GC", "=T"]
    assert Q.reverse_complement_tokens(["=A", "+T|+G|=C", "=G"]) == ["=C", "=G", "+C|+A|=T"]


def test_cs_to_tokens():
    assert Q.cs_to_tokens("=AC*ag-t+gg=C", 2, 8) == ["=N", "=A", "=C", "*AG", "-T", "+G|+G|=C", "=N", "=N"]
    assert Q.join_split_alignments([(0, ["=A", "=N", "=N"]), (16, ["=N", "=C", "=N"])], 3) == ["=A", "=c", "=N"]


def test_ranges_and_overlays():
    assert Q.inversion_ranges(["=A", "=c", "=g", "=T", "=a"]) == [(1, 2), (4, 4)]
    assert Q.insertion_ranges(["=A", "+C|+G|=T", "=A"]) == [(1, 2)]
    assert Q.between_deletions(["=A", "-C", "=G", "=T", "-A", "=C"]) == [(2, 3)]
    assert Q.deletion_ends(["=A", "-C", "=G", "-T"]) == [2]
    assert Q.overlay(["=A", "=G"], ["=A", "-C", "=G"]) == ["=A", "-C", "=G"]
    assert Q.overlay(["=A", "=C"], ["=A", "=c"]) == ["=A", "=c"]
    assert Q.overlay(["=A", "=T", "=T", "=G"], ["=A", "+T|+T|=G"]) == ["=A", "+T|+T|=G"]
    assert Q.insertion_like([["=A"] * 9, ["=A"], ["*AG"]]) == [True, False, True]
    assert Q.insertions_within_deletion(["=A", "-C", "=T", "-G", "=C"], ["=A", "-C", "=G", "-G", "=C"]) == ["=A", "-C", "-G", "-G", "+T|=C"]


def test_strings(spark):
    assert one(spark, S.revcomp(F.col("s")), s=["ACGTN", ""]) == ["NACGT", ""]
    assert S.revcomp_text("AACG") == "CGTT"
    with pytest.raises(ValueError):
        S.revcomp_text("AX")
    assert one(spark, S.sanitize(F.col("s")), s=["invalid|name?.txt", " a b "]) == ["invalid-name--txt", "a-b"]
    assert S.safe_name("a/b.c") == "a-b-c"
    assert one(spark, S.aligned_length(F.col("c")), c=["5S10M2D3I4M", "", "3=2X1N"]) == [16, 0, 6]
    assert one(spark, S.cigar_ops(F.col("c")), c=["5S10M"]) == [["5S", "10M"]]
    assert one(spark, S.trim_soft_clips(F.col("c"), F.col("s")), c=["2S3M1S", "3M", "2S3M"], s=["AACGTT", "ACG", "*"]) == ["CGT", "ACG", "*"]
    assert one(spark, S.qname(F.col("s")), s=["@read1 run=3", "read2"]) == ["read1", "read2"]
    assert one(spark, S.wrap(F.lit("h"), F.col("s"), 3), s=["ACGTACG", "ACGTAC"]) == [">h\nACG\nTAC\nG", ">h\nACG\nTAC"]
    assert one(spark, S.percent_label(F.col("s")), s=["5", "7%"]) == ["5%", "7%"]
    assert one(spark, S.allele_type_label(F.lit("control"), F.col("s")), s=["intact", "Indels ", "deletion"]) == ["control", "control with indels", "control deletion"]
    assert one(spark, S.stem(F.col("s")), s=["/a/b.fa.gz"]) == ["b"] and one(spark, S.extension(F.col("s")), s=["/a/b.fa.gz"]) == [".fa.gz"]
    assert one(spark, S.reverse_flag(F.col("f")), f=[0, 16, 2064]) == [16, 0, 2048]
    assert one(spark, K.strand(F.col("f")), f=[0, 16, 2064]) == ["+", "-", "-"]


def test_file_names():
    assert S.report_filename("allele01|control|intact|75%", ".vcf", "s") == "s_allele01_control_intact_75%.vcf"
    long = S.report_filename(f"allele01|{'x' * 300}|indels|5%", ".fa", "s")
    assert long == "s_allele01_5%.fa"
    hashed = S.report_filename("é" * 300, ".fa")
    assert len(hashed.encode()) <= 255 and hashed.endswith(".fa")
    assert S.truncate_utf8("éé", 3) == "é"
