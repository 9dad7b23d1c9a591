"""The driver's queries over alignment: affine costs, mapped reads, tokens lifted through a coordinate map, BAM files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ampliqua.align import affine, mapper
from ampliqua.functions import strings
from ampliqua.operators import lift
from ampliqua.plans import queries as base
from ampliqua.plans.queries import query
from ampliqua.session import scratch
from ampliqua.sources import bam, inputs

_t, _reads = base._t, base._reads


@query("SELECT p_partkey, CAST(levenshtein(p_name, p_type) AS BIGINT) AS cost FROM part")
def q_affine_distance(spark: SparkSession, d: str) -> DataFrame:
    """With gaps that cost as much as a mismatch for each base, the least cost is the edit distance."""
    unit = affine.Costs(0, -1, 0, 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pairs = [tuple(np.frombuffer(x.encode(), np.uint8) for x in p) for p in zip(pdf["p_name"], pdf["p_type"], strict=True)]
            yield pd.DataFrame({"p_partkey": pdf["p_partkey"], "cost": [-unit.score(r, *p) for r, p in zip(affine.between(pairs, unit), pairs, strict=True)]})

    return _t(spark, d, "part").select(F.col("p_partkey").cast("long").alias("p_partkey"), "p_name", "p_type").mapInPandas(run, "p_partkey long, cost long")


@query("""SELECT CAST(p_partkey AS VARCHAR) AS qname, CASE WHEN p_size % 2 = 1 THEN 16 ELSE 0 END AS flag, CAST(1 + p_partkey % 300 AS INT) AS pos, CAST(300 + p_size AS INT) AS span, CAST(p_size AS INT) AS deleted, 0 AS other FROM part""")
def q_mapped_reads(spark: SparkSession, d: str) -> DataFrame:
    """Every part is a read of 300 bases with a deletion of p_size bases, every second one of the other strand."""
    bases = F.translate(F.md5(F.col("n_name").cast("binary")), "0123456789abcdef", "ACGTACGTACGTACGT")
    control = _t(spark, d, "nation").select(F.struct("n_nationkey", bases.alias("b")).alias("x")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["b"]), "").alias("sequence")).withColumn("allele", F.lit("control"))
    start = 1 + F.col("p_partkey") % 300
    parts = _t(spark, d, "part").select("p_partkey", "p_size").repartition(mapper.TASKS * spark.sparkContext.defaultParallelism, "p_partkey")  # the file is a few splits
    rows = parts.crossJoin(F.broadcast(control))  # one row
    seq = F.concat(F.substring("sequence", start, F.lit(150)), F.substring("sequence", start + 150 + F.col("p_size"), F.lit(150)))
    reads = rows.select(F.col("p_partkey").cast("string").alias("qname"), F.when(F.col("p_size") % 2 == 1, strings.revcomp(seq)).otherwise(seq).alias("sequence"), F.lit(None).cast("string").alias("quality"))
    found = mapper.align(reads, control)
    total = lambda letter: F.aggregate(F.regexp_extract_all("cigar", F.lit(rf"(\d+){letter}"), F.lit(1)), F.lit(0), lambda a, x: a + x.cast("int"))
    other = F.size(F.regexp_extract_all("cs", F.lit("[*+]"), F.lit(0))) + total("S")
    return found.select("qname", "flag", "pos", strings.aligned_length(F.col("cigar")).cast("int").alias("span"), total("D").alias("deleted"), other.alias("other"))


_SQL_MAP = """nat AS (SELECT n_regionkey AS allele, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS c, substr('AGT', CAST(n_nationkey % 3 + 1 AS INT), 1) AS x, CASE n_nationkey % 4 WHEN 1 THEN 2 ELSE 0 END AS n, CASE n_nationkey % 4 WHEN 2 THEN 0 ELSE 1 END AS has FROM nation),
cum AS (SELECT *, sum(n + has) OVER (PARTITION BY allele ORDER BY c) - n - has AS f0, sum(n + has) OVER (PARTITION BY allele) AS total, allele = 4 AS inv FROM nat),
loc AS (SELECT allele, c, x, has, inv, CASE WHEN has = 0 THEN NULL WHEN inv THEN total - f0 - n - has ELSE f0 + n END AS aa, CASE WHEN n = 0 THEN NULL WHEN inv THEN total - f0 - 1 ELSE f0 END AS k0, CASE WHEN n = 0 THEN NULL WHEN inv THEN total - f0 - 2 ELSE f0 + 1 END AS k1 FROM cum),
pl AS (SELECT *, CASE WHEN inv THEN lag(aa) OVER (PARTITION BY allele ORDER BY c) END AS pa FROM loc)"""


@query(f"""WITH t AS (SELECT l_orderkey, {base._SQL_TOKEN} AS tok, row_number() OVER (PARTITION BY l_orderkey ORDER BY {base._SQL_LINE_ORDER}, {base._SQL_TOKEN}) - 1 AS a FROM lineitem),
b AS (SELECT l_orderkey, l_orderkey % 5 = 4 AS inv, a, tok, CASE WHEN tok LIKE '-%' THEN '' ELSE right(tok, 1) END AS y, CASE WHEN tok LIKE '+%' THEN 'AC' ELSE '' END AS ins FROM t),
k AS (SELECT l_orderkey, a, tok, CASE WHEN inv THEN translate(y, 'ACGT', 'TGCA') ELSE y END AS y, CASE WHEN inv THEN reverse(translate(ins, 'ACGT', 'TGCA')) ELSE ins END AS ins FROM b), {_SQL_MAP},
f AS (SELECT o.l_orderkey, c, CASE WHEN has = 0 THEN '-' || x WHEN m.tok IS NULL THEN '=N' ELSE CASE WHEN inv THEN lower(w) ELSE w END END AS tok,
  CASE WHEN inv THEN lower(coalesce(p.ins, '') || coalesce(u.y || u.ins, '') || coalesce(v.y || v.ins, '')) ELSE coalesce(u.ins || u.y, '') || coalesce(v.ins || v.y, '') || coalesce(m.ins, '') END AS ins
  FROM (SELECT DISTINCT l_orderkey FROM t) o JOIN pl ON pl.allele = o.l_orderkey % 5 LEFT JOIN k m ON m.l_orderkey = o.l_orderkey AND m.a = aa LEFT JOIN k u ON u.l_orderkey = o.l_orderkey AND u.a = k0
  LEFT JOIN k v ON v.l_orderkey = o.l_orderkey AND v.a = k1 LEFT JOIN k p ON p.l_orderkey = o.l_orderkey AND p.a = pa,
  LATERAL (SELECT CASE WHEN m.tok = '=N' THEN '=N' WHEN m.y = '' THEN '-' || x WHEN m.y = x THEN '=' || x ELSE '*' || x || m.y END AS w))
SELECT l_orderkey, string_agg(regexp_replace(ins, '(.)', '+\\1|', 'g') || tok, ',' ORDER BY c) AS midsv FROM f GROUP BY l_orderkey""")
def q_lift_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Orders' lines are tokens on one of five alleles, whose maps to a control of five bases come from the nations of a region."""
    x = F.substring(F.lit("AGT"), F.col("n_nationkey") % 3 + 1, F.lit(1))
    tok = F.element_at(F.array(F.concat(F.lit("="), x), F.concat(F.lit("+C|+G|="), x), F.concat(F.lit("-"), x), F.concat(F.lit("*"), x, F.lit("C"))), (F.col("n_nationkey") % 4 + 1).cast("int"))
    tok = F.when(F.col("n_regionkey") == 4, F.lower(tok)).otherwise(tok)
    maps = _t(spark, d, "nation").groupBy(F.col("n_regionkey").cast("string").alias("allele")).agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", tok.alias("t")))), lambda v: v["t"]).alias("tokens"))
    reads = _reads(spark, d).withColumn("allele", (F.col("l_orderkey") % 5).cast("string"))
    return lift.lift(reads, maps, ["l_orderkey"]).select("l_orderkey", F.array_join("tokens", ",").alias("midsv"))


# -- files of alignments -----------------------------------------------------------------------------------------------


def _order_alignments(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Orders as alignments to two references, and their header."""
    key = F.col("o_orderkey")
    first = key % 3 == 0
    bases = F.translate(F.md5(key.cast("string").cast("binary")), "0123456789abcdef", "ACGTACGTACGTNCGT")
    rows = _t(spark, d, "orders").select(
        key.cast("string").alias("qname"), F.when(key % 2 == 0, 16).otherwise(0).alias("flag"), F.when(first, "control").otherwise("chr2").alias("rname"), F.when(first, 1 + F.col("o_custkey") % 400).otherwise(1 + key * 37 % 90_000).cast("int").alias("pos"),
        F.lit(60).alias("mapq"), F.lit("4S20M2D8M").alias("cigar"), F.lit("*").alias("rnext"), F.lit(0).alias("pnext"), F.lit(0).alias("tlen"), bases.alias("seq"), F.lit("*").alias("qual"), F.concat(F.lit("="), F.substring(bases, 5, 20)).alias("cs"),
    )
    return spark.createDataFrame([("@SQ\tSN:control\tLN:500",), ("@SQ\tSN:chr2\tLN:100000",)], "value string"), rows


_SQL_ALIGNED = """a AS (SELECT CAST(o_orderkey AS VARCHAR) AS qname, CAST(CASE WHEN o_orderkey % 2 = 0 THEN 16 ELSE 0 END AS INT) AS flag, CASE WHEN o_orderkey % 3 = 0 THEN 'control' ELSE 'chr2' END AS rname,
CAST(CASE WHEN o_orderkey % 3 = 0 THEN 1 + o_custkey % 400 ELSE 1 + o_orderkey * 37 % 90000 END AS INT) AS pos, translate(md5(CAST(o_orderkey AS VARCHAR)), '0123456789abcdef', 'ACGTACGTACGTNCGT') AS seq FROM orders)"""


@query(f"WITH {_SQL_ALIGNED} SELECT qname, flag, rname, pos, 60 AS mapq, '4S20M2D8M' AS cigar, seq, '=' || substr(seq, 5, 20) AS cs FROM a")
def q_bam_files(spark: SparkSession, d: str) -> DataFrame:
    """Written as one file and read again in splits."""
    path = f"{scratch(spark, 'orders')}/orders.bam"
    bam.write_bam(*_order_alignments(spark, d), path)
    return bam.read_bam(spark, path)[1].select("qname", "flag", "rname", "pos", "mapq", "cigar", "seq", "cs")


@query(f"WITH {_SQL_ALIGNED} SELECT qname, flag, pos FROM a WHERE rname = 'chr2' AND pos <= 45000 AND pos + 30 > 30001")
def q_bam_interval(spark: SparkSession, d: str) -> DataFrame:
    """An interval by the index: records of 30 bases that overlap it."""
    path = f"{scratch(spark, 'orders')}/orders.bam"
    bam.write_bam(*_order_alignments(spark, d), path)
    bam.write_index(spark, path)
    return bam.read_interval(spark, path, "chr2", 30_001, 45_000)[0].select("qname", "flag", "pos")


@query(f"WITH {_SQL_ALIGNED}, r AS (SELECT qname, CASE WHEN flag = 16 THEN reverse(translate(seq, 'ACGT', 'TGCA')) ELSE seq END AS sequence FROM a) SELECT qname, sequence, repeat('I', 32) AS quality FROM r")
def q_bam_reads(spark: SparkSession, d: str) -> DataFrame:
    """Reads of a folder with such a file, found by its content."""
    path = scratch(spark, "reads")
    bam.write_bam(*_order_alignments(spark, d), f"{path}/orders.data")
    return inputs.read(spark, inputs.inputs(spark, [path])).select("qname", "sequence", "quality")
