"""The driver's queries: each runs operators of this package on an analogous shape of the driver's tables.

A read is a group key, a position an ordered key, a token a value. ORACLE has the same result in SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ampliqua.functions import sequential, strings
from ampliqua.functions import tokens as K
from ampliqua.operators import classify, consensus, errors, kmers, profile, stats, sv, windows
from ampliqua.report import summary, vcf
from ampliqua.session import importable, materialize, scratch
from ampliqua.sources import files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _long(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


# -- lineitem as tokens: an order's lines, in order, are a read -----------------------------------------------------

_LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]
_SQL_LINE_ORDER = ", ".join(_LINE_ORDER)


def _token(df: DataFrame) -> DataFrame:
    tok = F.when(F.col("l_returnflag") == "A", "+A|+C|=G").when(F.col("l_returnflag") == "R", "-T").when(F.col("l_quantity") > 40, "*AG").when(F.col("l_quantity") < 5, "=N").otherwise(F.concat(F.lit("="), F.translate("l_linestatus", "OF", "AC")))
    return df.withColumn("tok", tok)


_SQL_TOKEN = "CASE WHEN l_returnflag = 'A' THEN '+A|+C|=G' WHEN l_returnflag = 'R' THEN '-T' WHEN l_quantity > 40 THEN '*AG' WHEN l_quantity < 5 THEN '=N' ELSE '=' || translate(l_linestatus, 'OF', 'AC') END"


def _reads(spark: SparkSession, d: str) -> DataFrame:
    """l_orderkey, tokens."""
    rows = _token(_t(spark, d, "lineitem")).select("l_orderkey", F.struct(*_LINE_ORDER, "tok").alias("x"))
    return rows.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["tok"]).alias("tokens"))


_SQL_READS = f"r AS (SELECT l_orderkey, list({_SQL_TOKEN} ORDER BY {_SQL_LINE_ORDER}, {_SQL_TOKEN}) AS tokens FROM lineitem GROUP BY l_orderkey)"


@query("""SELECT doc_id, -CAST((length(text) - length(replace(text, '+', ''))) + (length(text) - length(replace(text, '-', ''))) + (length(text) - length(replace(text, '*', '')))
  + (length(text) - length(regexp_replace(text, '[a-z]', '', 'g'))) AS BIGINT) AS score FROM documents""")
def q_match_score(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", _long(K.match_score(F.col("text"))).alias("score"))


@query(f"""WITH {_SQL_READS}, n AS (SELECT l_orderkey, len(tokens) AS n, len(list_filter(tokens, lambda t: t = '=N')) AS k FROM r)
SELECT l_orderkey, CAST(n AS BIGINT) AS n_tokens, round(k * 100 / n, 6) AS n_percent FROM n WHERE k * 100 / n < 95""")
def q_ntag_filter(spark: SparkSession, d: str) -> DataFrame:
    pct = K.n_percent(F.col("tokens"))
    return _reads(spark, d).filter(pct < 95).select("l_orderkey", _long(F.size("tokens")).alias("n_tokens"), F.round(pct, 6).alias("n_percent"))


@query(f"""WITH t AS (SELECT l_orderkey, {_SQL_TOKEN} AS tok, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_SQL_LINE_ORDER}, {_SQL_TOKEN}) AS i FROM lineitem),
e AS (SELECT *, min(CASE WHEN tok <> '=N' THEN i END) OVER (PARTITION BY l_orderkey) AS a, max(CASE WHEN tok <> '=N' THEN i END) OVER (PARTITION BY l_orderkey) AS b FROM t)
SELECT l_orderkey, string_agg(CASE WHEN tok = '=N' AND i > a AND i < b THEN '-' || substr('ACGTACGTACGTACGTACGT', CAST(i AS INT), 1) ELSE tok END, ',' ORDER BY i) AS midsv FROM e GROUP BY l_orderkey""")
def q_internal_fill(spark: SparkSession, d: str) -> DataFrame:
    return _reads(spark, d).select("l_orderkey", F.array_join(K.internal_n_to_deletion(F.col("tokens"), F.lit("ACGT" * 5)), ",").alias("midsv"))


@query("""SELECT doc_id, CAST(length(s) AS BIGINT) AS n, md5(reverse(translate(s, 'ACGT', 'TGCA'))) AS turned FROM (SELECT doc_id, regexp_replace(upper(text), '[^ACGTN]', '', 'g') AS s FROM documents)""")
def q_revcomp(spark: SparkSession, d: str) -> DataFrame:
    s = K.dna_only(F.col("text"))
    return _t(spark, d, "documents").select("doc_id", _long(F.length(s)).alias("n"), F.md5(strings.revcomp(s)).alias("turned"))


@query(f"""WITH c AS (SELECT l_orderkey, string_agg(CAST(CAST(l_quantity AS INT) AS VARCHAR) || translate(l_returnflag, 'ARN', 'MDI'), '' ORDER BY {_SQL_LINE_ORDER}, l_returnflag) AS cigar FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, cigar, CAST(len(regexp_extract_all(cigar, '[0-9]+[MIDNSH=X]')) AS BIGINT) AS n_ops, CAST(coalesce(list_sum(list_transform(regexp_extract_all(cigar, '([0-9]+)[MDN=X]', 1), lambda x: CAST(x AS INT))), 0) AS BIGINT) AS aligned FROM c""")
def q_cigar_len(spark: SparkSession, d: str) -> DataFrame:
    op = F.concat(F.col("l_quantity").cast("int").cast("string"), F.translate("l_returnflag", "ARN", "MDI"))
    rows = _t(spark, d, "lineitem").select("l_orderkey", F.struct(*_LINE_ORDER, "l_returnflag", op.alias("op")).alias("x"))
    c = rows.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["op"]), "").alias("cigar"))
    return c.select("l_orderkey", "cigar", _long(F.size(strings.cigar_ops(F.col("cigar")))).alias("n_ops"), _long(strings.aligned_length(F.col("cigar"))).alias("aligned"))


_SQL_PROFILE = f"""tok AS (SELECT l_linestatus, l_linenumber AS pos, {_SQL_TOKEN} AS tok FROM lineitem),
cnt AS (SELECT l_linestatus, pos, count(*) FILTER (tok LIKE '=%') AS m, count(*) FILTER (tok LIKE '+%') AS i, count(*) FILTER (tok LIKE '-%') AS d, count(*) FILTER (tok LIKE '*%') AS s FROM tok WHERE tok <> '=N' GROUP BY ALL),
prof AS (SELECT l_linestatus, pos, u.mut, u.n, CASE WHEN u.n + m > 0 THEN 100.0::DOUBLE * u.n / (u.n + m) ELSE 0 END AS pct FROM cnt, LATERAL (VALUES ('+', i), ('-', d), ('*', s)) AS u(mut, n))"""


#: The same of large and of small quantities, which differ.
_SQL_SIDES = _SQL_PROFILE.replace("SELECT l_linestatus, l_linenumber AS pos", "SELECT CASE WHEN l_quantity > 25 THEN 'O' ELSE 'F' END AS l_linestatus, l_linenumber AS pos", 1)


def _profile(spark: SparkSession, d: str, sides: bool = False) -> DataFrame:
    rows = _token(_t(spark, d, "lineitem"))
    rows = rows.withColumn("l_linestatus", F.when(F.col("l_quantity") > 25, "O").otherwise("F")) if sides else rows
    rows = rows.select("l_linestatus", F.col("l_linenumber").alias("pos"), "tok")
    return profile.normalize(profile.count_indels(rows, ["l_linestatus"]), ["l_linestatus"])


@query(f"WITH {_SQL_PROFILE} SELECT l_linestatus, pos, mut, n, round(pct, 6) AS pct FROM prof")
def q_indel_profile(spark: SparkSession, d: str) -> DataFrame:
    return _profile(spark, d).withColumn("pct", F.round("pct", 6))


def _pairs(spark: SparkSession, d: str, sides: bool = False) -> DataFrame:
    p = _profile(spark, d, sides)
    return profile.against_control(p.filter("l_linestatus = 'O'").drop("l_linestatus"), p.filter("l_linestatus = 'F'").drop("l_linestatus"), [])


@query(f"""WITH {_SQL_PROFILE} SELECT s.pos, s.mut, round(s.pct, 6) AS sample, round(least(s.pct, coalesce(c.pct, 0)), 6) AS control
FROM prof s LEFT JOIN prof c ON c.l_linestatus = 'F' AND c.pos = s.pos AND c.mut = s.mut WHERE s.l_linestatus = 'O'""")
def q_minimize(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("pos", "mut", F.round("sample", 6).alias("sample"), F.round("control", 6).alias("control"))


@query(f"""WITH {_SQL_PROFILE} SELECT pos, string_agg(mut, '' ORDER BY mut) AS muts FROM prof WHERE l_linestatus = 'O' AND pct > 50 GROUP BY pos""")
def q_transpose_loci(spark: SparkSession, d: str) -> DataFrame:
    loci = _profile(spark, d).filter("l_linestatus = 'O' AND pct > 50")
    return profile.transpose(loci, []).select("pos", F.array_join("muts", "").alias("muts"))


@query("""SELECT o_custkey, o_orderkey, o_totalprice AS score FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k = 1""")
def q_argmax_allele(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "orders").select("o_custkey", "o_orderkey", F.col("o_totalprice").alias("score"), F.col("o_orderkey").alias("allele_ord"))
    return classify.best(rows, "o_custkey").drop("allele_ord")


_SQL_BEST = "b AS (SELECT o_custkey, o_orderpriority AS allele, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderpriority, o_orderkey) AS k FROM orders), n AS (SELECT allele, count(*) AS n FROM b WHERE k = 1 GROUP BY allele)"


def _scores(spark: SparkSession, d: str) -> DataFrame:
    """Customers as reads, order priorities as alleles."""
    return _t(spark, d, "orders").groupBy("o_custkey", F.col("o_orderpriority").alias("allele")).agg(F.max("o_totalprice").alias("score")).withColumn("allele_ord", F.col("allele"))


@query(f"WITH {_SQL_BEST}, m AS (SELECT avg(n) AS m FROM n) SELECT allele, n, CASE WHEN n < floor(m) THEN 'minor' ELSE 'major' END AS kind FROM n, m")
def q_minor_alleles(spark: SparkSession, d: str) -> DataFrame:
    n = classify.allele_counts(_scores(spark, d), "o_custkey")
    limit = int(n.agg(F.avg("n")).first()[0] or 0)
    few = classify.minor(n, limit).withColumn("kind", F.lit("minor"))
    return few.union(classify.major(n, limit).withColumn("kind", F.lit("major"))).select("allele", "n", "kind")


@query(f"""WITH {_SQL_BEST}, m AS (SELECT allele FROM n WHERE allele LIKE '1%' OR allele LIKE '5%'),
f AS (SELECT o_custkey FROM b WHERE k = 1 AND allele IN (SELECT allele FROM m)), s AS (SELECT DISTINCT o_custkey, o_orderpriority FROM orders)
SELECT CASE WHEN o_custkey IN (SELECT o_custkey FROM f) THEN 'minor' ELSE 'major' END AS part, count(*) AS n_rows, count(DISTINCT o_custkey) AS n_reads FROM s GROUP BY 1""")
def q_split_semi_anti(spark: SparkSession, d: str) -> DataFrame:
    s = _scores(spark, d)
    n = classify.allele_counts(s, "o_custkey").filter("allele LIKE '1%' OR allele LIKE '5%'")
    big, few = classify.split_by_minor(s, n, "o_custkey")
    both = big.withColumn("part", F.lit("major")).union(few.withColumn("part", F.lit("minor")))
    return both.groupBy("part").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("o_custkey").alias("n_reads"))


@query("""SELECT o_orderkey, o_orderpriority AS label, count(*) OVER (PARTITION BY o_orderpriority) AS readnum, round(100 * count(*) OVER (PARTITION BY o_orderpriority) / count(*) OVER (), 3) AS percent FROM orders""")
def q_readnum_percent(spark: SparkSession, d: str) -> DataFrame:
    return consensus.add_shares(_t(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("label"))).select("o_orderkey", "label", "readnum", "percent")


@query("""WITH n AS (SELECT p_brand, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY p_brand)
SELECT p_brand, n, CAST(dense_rank() OVER (ORDER BY -n, p_brand) AS INT) AS label, CAST(row_number() OVER (ORDER BY first) AS INT) AS appearance FROM n""")
def q_relabel(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "part").select("p_partkey", "p_brand", F.col("p_brand").alias("appearance"))
    seen = windows.relabel_by_appearance(rows, "appearance", "p_partkey")
    n = seen.groupBy("p_brand", "appearance").agg(F.count(F.lit(1)).alias("n"))
    return windows.dense_label(n, [-F.col("n"), F.col("p_brand")]).select("p_brand", "n", "label", "appearance")


_SQL_EVENT = "CASE event_type WHEN 'view' THEN '=A' WHEN 'click' THEN '*AG' WHEN 'signup' THEN '-T' WHEN 'error' THEN '+C|+T|=G' ELSE '=C' END"
_SQL_POSITIONS = f"p AS (SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS pos, {_SQL_EVENT} AS tok FROM events)"


def _positions(spark: SparkSession, d: str) -> DataFrame:
    """user_id, pos, tok: a user's events in order."""
    tok = F.when(F.col("event_type") == "view", "=A").when(F.col("event_type") == "click", "*AG").when(F.col("event_type") == "signup", "-T").when(F.col("event_type") == "error", "+C|+T|=G").otherwise("=C")
    pos = (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("int")
    return _t(spark, d, "events").select("user_id", "event_id", pos.alias("pos"), tok.alias("tok"))


def _length(rows: DataFrame) -> int:
    return (rows.agg(F.max("pos")).first()[0] or 0) + 1


def _loci(spark: SparkSession, length: int) -> DataFrame:
    """Loci by rule: insertions and substitutions at positions not divisible by 3, deletions at even ones."""
    kinds = F.flatten(F.array(F.when(F.col("id") % 3 != 0, F.array(F.lit("*"), F.lit("+"))).otherwise(F.array().cast("array<string>")), F.when(F.col("id") % 2 == 0, F.array(F.lit("-"))).otherwise(F.array().cast("array<string>"))))
    return spark.range(length).select(F.col("id").cast("int").alias("pos"), F.array_sort(kinds).alias("muts")).filter(F.size("muts") > 0)


_SQL_HAS = "({op} IN ('*', '+') AND {pos} % 3 <> 0 OR {op} = '-' AND {pos} % 2 = 0)"
_SQL_KMERS = f"""{_SQL_POSITIONS}, z AS (SELECT max(pos) + 1 AS size FROM p), w AS (SELECT p.*, pos > 0 AND pos < size - 1 AND (pos % 3 <> 0 OR pos % 2 = 0) AS live FROM p, z),
o AS (SELECT *, CASE WHEN live AND tok LIKE '+%' THEN '+I=G' ELSE tok END AS own FROM w),
a AS (SELECT *, lag(own) OVER u AS pt, lead(tok) OVER u AS nt FROM o WINDOW u AS (PARTITION BY user_id ORDER BY pos)),
k AS (SELECT user_id, pos, CASE WHEN live AND {_SQL_HAS.format(op="tok[1]", pos="pos")} THEN
  CASE WHEN {_SQL_HAS.format(op="pt[1]", pos="(pos - 1)")} THEN pt ELSE '@' END || ',' || own || ',' || CASE WHEN {_SQL_HAS.format(op="nt[1]", pos="(pos + 1)")} THEN CASE WHEN tok LIKE '+%' AND nt LIKE '+%' THEN '+I=G' ELSE nt END ELSE '@' END
  ELSE '@,@,@' END AS kmer FROM a)"""


def _kmers(spark: SparkSession, d: str) -> DataFrame:
    rows = _positions(spark, d)
    length = _length(rows)
    return kmers.kmers(rows, ["user_id"], _loci(spark, length), length)


@query(f"WITH {_SQL_KMERS} SELECT user_id, pos, kmer FROM k")
def q_kmers(spark: SparkSession, d: str) -> DataFrame:
    return _kmers(spark, d).select("user_id", "pos", "kmer")


_SQL_DIFF = f"""{_SQL_KMERS}, c AS (SELECT user_id % 2 AS side, count(DISTINCT user_id) AS cov FROM k GROUP BY 1),
x AS (SELECT user_id % 2 AS side, pos, kmer, round(count(*) * 100 / min(cov), 3) AS pct FROM k JOIN c ON c.side = user_id % 2 GROUP BY 1, 2, 3),
diff AS (SELECT s.pos, s.kmer, CASE WHEN s.pos = 7 THEN s.pct ELSE s.pct - coalesce(t.pct, 0) END AS pct FROM x s LEFT JOIN x t ON t.side = 0 AND t.pos = s.pos AND t.kmer = s.kmer WHERE s.side = 1),
y AS (SELECT * FROM diff WHERE (pos = 7 OR pct > 0) AND pct > 0.5 AND split_part(kmer, ',', 2) NOT LIKE '=%')"""


def _difference(spark: SparkSession, d: str) -> DataFrame:
    rows = _kmers(spark, d).withColumn("side", F.col("user_id") % 2)
    cov = rows.groupBy("side").agg(F.countDistinct("user_id").alias("coverage"))
    pct = kmers.percents(kmers.counts(rows, ["side"]), cov, ["side"])
    knock = spark.range(7, 8).select(F.col("id").cast("int").alias("pos"))
    diff = kmers.subtract(pct.filter("side = 1").drop("side"), pct.filter("side = 0").drop("side"), knockin=knock)
    return kmers.matches_dropped(kmers.common_errors_dropped(diff))


@query(f"WITH {_SQL_DIFF} SELECT pos, kmer, round(pct, 3) AS pct FROM y")
def q_kmer_subtract(spark: SparkSession, d: str) -> DataFrame:
    return _difference(spark, d).select("pos", "kmer", F.round("pct", 3).alias("pct"))


_SQL_LEVEL = f"""{_SQL_DIFF}, ins AS (SELECT i AS pos FROM (SELECT unnest(range(size)) AS i FROM z) WHERE i % 3 <> 0), isl AS (SELECT pos, pos - row_number() OVER (ORDER BY pos) AS g FROM ins),
lev AS (SELECT y.pos, kmer, CASE WHEN split_part(kmer, ',', 2) LIKE '+%' AND g IS NOT NULL THEN max(CASE WHEN split_part(kmer, ',', 2) LIKE '+%' THEN pct END) OVER (PARTITION BY g) ELSE pct END AS pct FROM y LEFT JOIN isl ON isl.pos = y.pos)"""


def _level(spark: SparkSession, d: str) -> DataFrame:
    ins = _loci(spark, _length(_positions(spark, d))).filter(F.array_contains("muts", "+")).select("pos")
    return kmers.level_insertions(_difference(spark, d), ins)


@query(f"WITH {_SQL_LEVEL} SELECT pos, kmer, round(pct, 3) AS pct FROM lev")
def q_insertion_level(spark: SparkSession, d: str) -> DataFrame:
    return _level(spark, d).select("pos", "kmer", F.round("pct", 3).alias("pct"))


@query(f"""WITH {_SQL_LEVEL} SELECT k.user_id, round(sum(coalesce(l.pct, 0)), 3) AS total, count(*) FILTER (l.pct > 0) AS n_scored FROM k LEFT JOIN lev l ON l.pos = k.pos AND l.kmer = k.kmer GROUP BY k.user_id""")
def q_score_annotate(spark: SparkSession, d: str) -> DataFrame:
    rows = kmers.annotate(_kmers(spark, d), _level(spark, d).select("pos", "kmer", F.col("pct").alias("score")))
    return rows.groupBy("user_id").agg(F.round(F.sum("score"), 3).alias("total"), F.count_if(F.col("score") > 0).alias("n_scored"))


@query("""WITH e AS (SELECT user_id, event_type, ts, event_id, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY epoch_us(ts)) <= 14400000000 THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM e),
m AS (SELECT user_id, session, event_type, count(*) AS n FROM s GROUP BY user_id, session, event_type), n AS (SELECT *, sum(n) OVER (PARTITION BY user_id, session) AS size FROM m)
SELECT user_id, CAST(session AS BIGINT) AS session, CAST(size AS BIGINT) AS size, event_type AS mode FROM (SELECT *, row_number() OVER (PARTITION BY user_id, session ORDER BY n DESC, event_type) AS k FROM n WHERE size > 2) WHERE k = 1""")
def q_gap_sessions(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "events").select("user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    s = windows.sessions(rows, ["user_id"], "at", 14_400_000_000, 2)
    size = s.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("size"))
    return size.join(windows.modal(s, ["user_id", "session"], "event_type"), ["user_id", "session"]).select("user_id", "session", "size", "mode")


@query(f"""WITH {_SQL_POSITIONS}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY pos) - row_number() OVER (PARTITION BY user_id, tok ORDER BY pos) AS g FROM p)
SELECT user_id, tok, min(pos) AS start, max(pos) AS stop, count(*) AS size FROM r GROUP BY user_id, tok, g HAVING count(*) >= 3""")
def q_runs(spark: SparkSession, d: str) -> DataFrame:
    return windows.value_runs(_positions(spark, d).select("user_id", "pos", "tok"), ["user_id"], ["pos"], "tok", 3)


@query("""WITH l AS (SELECT DISTINCT o_orderpriority || c_nationkey AS mut, CAST(epoch(o_orderdate) / 86400 AS INT) AS pos FROM orders JOIN customer ON c_custkey = o_custkey),
a AS (SELECT *, lead(pos) OVER (PARTITION BY mut ORDER BY pos) AS nx FROM l),
b AS (SELECT mut, pos FROM l UNION SELECT mut, CAST(unnest(generate_series(pos + 1, nx - 1)) AS INT) FROM a WHERE pos + 10 > nx AND nx - pos > 1),
c AS (SELECT *, lead(pos) OVER w AS nx, count(*) OVER (PARTITION BY mut ORDER BY pos RANGE BETWEEN 11 PRECEDING AND 1 PRECEDING) AS lf, count(*) OVER (PARTITION BY mut ORDER BY pos RANGE BETWEEN 1 FOLLOWING AND 11 FOLLOWING) AS rt FROM b WINDOW w AS (PARTITION BY mut ORDER BY pos)),
e AS (SELECT *, lead(rt) OVER (PARTITION BY mut ORDER BY pos) AS nr FROM c),
f AS (SELECT mut, pos FROM b UNION SELECT mut, CAST(unnest(generate_series(pos + 1, nx - 1)) AS INT) FROM e WHERE pos + 20 >= nx AND nx - pos > 1 AND lf >= 8 AND nr >= 8)
SELECT mut, count(*) AS n, CAST(sum(pos) AS BIGINT) AS total FROM f GROUP BY mut""")
def q_gap_fill(spark: SparkSession, d: str) -> DataFrame:
    both = _t(spark, d, "orders").join(_t(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    rows = both.select(F.concat("o_orderpriority", F.col("c_nationkey").cast("string")).alias("mut"), F.datediff("o_orderdate", F.lit("1970-01-01")).alias("pos"))
    return windows.fill_gaps(rows, ["mut"]).groupBy("mut").agg(F.count(F.lit(1)).alias("n"), F.sum("pos").alias("total"))


@query("""WITH n AS (SELECT doc_id, regexp_replace(regexp_replace(text, '[a-z]', 'N', 'g'), '[^N]', 'M', 'g') AS nm FROM documents)
SELECT doc_id, CAST(coalesce(list_max(list_transform(string_split(nm, 'M'), lambda x: length(x))), 0) AS BIGINT) AS longest, round(CASE WHEN length(nm) > 0 THEN (length(nm) - length(replace(nm, 'N', ''))) / length(nm) ELSE 0 END, 6) AS ratio FROM n""")
def q_longest_run(spark: SparkSession, d: str) -> DataFrame:
    nm = F.regexp_replace(F.regexp_replace("text", "[a-z]", "N"), "[^N]", "M")
    rows = _t(spark, d, "documents").select("doc_id", nm.alias("nm"))
    return rows.select("doc_id", _long(K.longest_n_run(F.col("nm"))).alias("longest"), F.round(K.n_ratio(F.col("nm")), 6).alias("ratio"))


@query("""WITH c AS (SELECT doc_id, string_split(text, '') AS l FROM documents WHERE text IS NOT NULL), b AS (SELECT doc_id, unnest(l) AS base, CAST(unnest(range(len(l))) AS INT) AS pos FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - row_number() OVER (PARTITION BY doc_id, base ORDER BY pos) AS g FROM b)
SELECT doc_id, min(pos) AS start, max(pos) + 1 AS stop FROM r WHERE base >= 'a' AND base <= 'z' AND length(base) = 1 GROUP BY doc_id, base, g HAVING count(*) >= 3""")
def q_homopolymer(spark: SparkSession, d: str) -> DataFrame:
    return profile.repeat_spans_of(_t(spark, d, "documents"), ["doc_id"], "text", least=3, letters="a-z")


@query("""WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), x AS (SELECT label, i, avg(e[i]) AS m FROM v, range(1, 65) AS g(i) GROUP BY label, i),
c AS (SELECT label, list(m ORDER BY i) AS m FROM x GROUP BY label)
SELECT vec_id, round(1 - list_cosine_similarity(e, m), 6) AS distance FROM v JOIN c USING (label)""")
def q_cosine(spark: SparkSession, d: str) -> DataFrame:
    v = _t(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))
    each = v.select("label", F.posexplode("e").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"))
    centre = each.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("m"))
    return v.join(centre, "label").select("vec_id", F.round(profile.cosine_distance(F.col("e"), F.col("m")), 6).alias("distance"))


_SQL_STRAND = "s AS (SELECT l_linenumber, l_returnflag, count(*) FILTER (l_linestatus = 'O') AS plus, count(*) FILTER (l_linestatus = 'F') AS minus FROM lineitem GROUP BY ALL)"


def _strands(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "lineitem")
    return rows.groupBy("l_linenumber", "l_returnflag").agg(F.count_if(F.col("l_linestatus") == "O").alias("plus"), F.count_if(F.col("l_linestatus") == "F").alias("minus"))


@query(f"WITH {_SQL_STRAND} SELECT l_linenumber, l_returnflag, plus, minus, NOT (plus / (plus + minus) > 0.2 AND plus / (plus + minus) < 0.7) AS biased FROM s")
def q_strand_bias(spark: SparkSession, d: str) -> DataFrame:
    return _strands(spark, d).withColumn("biased", profile.ratio_biased(F.col("plus"), F.col("minus"), 0.2, 0.7))


def fisher_sql(source: str, keys: str) -> str:
    """CTEs that end in pv (keys, p_value), from t (keys, a, b, c, d)."""
    log = lambda x: f"lgamma({x} + 1.0)"
    return f"""t AS ({source}), x AS (SELECT *, unnest(generate_series(CAST(greatest(0, a - d) AS BIGINT), CAST(least(a + b, a + c) AS BIGINT))) AS k FROM t),
p AS (SELECT *, {log("(a + b)")} + {log("(c + d)")} + {log("(a + c)")} + {log("(b + d)")} - {log("(a + b + c + d)")} - {log("k")} - {log("(a + b - k)")} - {log("(a + c - k)")} - {log("(d - a + k)")} AS l FROM x),
o AS (SELECT {keys}, max(l) FILTER (k = a) AS own FROM p GROUP BY ALL),
pv AS (SELECT {keys}, least(1, sum(exp(l)) FILTER (l <= own + 1e-7)) AS p_value FROM p JOIN o USING ({keys}) GROUP BY ALL)"""


@query(f"""WITH {_SQL_STRAND}, {fisher_sql("SELECT l_linenumber, l_returnflag, plus AS a, minus AS b, sum(plus) OVER () AS c, sum(minus) OVER () AS d FROM s", "l_linenumber, l_returnflag")}
SELECT l_linenumber, l_returnflag, round(p_value, 6) AS p_value FROM pv""")
def q_fisher(spark: SparkSession, d: str) -> DataFrame:
    s = _strands(spark, d)
    t = s.crossJoin(s.agg(F.sum("plus").alias("c"), F.sum("minus").alias("d")))  # one row
    return t.select("l_linenumber", "l_returnflag", F.round(stats.fisher_udf("plus", "minus", "c", "d"), 6).alias("p_value"))


_SQL_PWM = f"""tok AS (SELECT l_linestatus AS label, l_linenumber AS pos, {_SQL_TOKEN} AS tok FROM lineitem),
cal AS (SELECT label, pos, CASE WHEN tok[1] IN ('+', '-', '*') AND NOT (tok[1] = '+' AND pos % 2 = 0 OR tok[1] = '-' AND pos = 3) THEN '=' || substr('ACGTACG', pos, 1) ELSE tok END AS tok FROM tok),
n AS (SELECT label, pos, tok, count(*) AS n FROM cal GROUP BY ALL), kn AS (SELECT *, sum(CASE WHEN tok NOT IN ('=N', '=n') THEN 1 ELSE 0 END) OVER (PARTITION BY label, pos) AS k FROM n),
pwm AS (SELECT label, pos, tok, n * 100 / sum(n) OVER (PARTITION BY label, pos) AS pct FROM kn WHERE k = 0 OR tok NOT IN ('=N', '=n'))"""


def _pwm(spark: SparkSession, d: str) -> DataFrame:
    rows = _token(_t(spark, d, "lineitem")).select(F.col("l_linestatus").alias("label"), F.col("l_linenumber").alias("pos"), "tok")
    every = spark.range(1, 8).select(F.col("id").cast("int").alias("pos"))
    reference = every.select("pos", F.substring(F.lit("ACGTACG"), F.col("pos"), F.lit(1)).alias("base"))
    loci = every.select("pos", F.when(F.col("pos") % 2 == 0, F.array(F.lit("+"))).when(F.col("pos") == 3, F.array(F.lit("-"))).otherwise(F.array().cast("array<string>")).alias("muts"))
    return consensus.weight_matrix(rows, ["label"], loci, reference)


@query(f"WITH {_SQL_PWM} SELECT label, pos, tok, round(pct, 6) AS pct FROM pwm")
def q_pwm(spark: SparkSession, d: str) -> DataFrame:
    return _pwm(spark, d).select("label", "pos", "tok", F.round("pct", 6).alias("pct"))


@query(f"""WITH {_SQL_PWM}, top AS (SELECT label, pos, tok FROM (SELECT *, row_number() OVER (PARTITION BY label, pos ORDER BY pct DESC, tok) AS k FROM pwm) WHERE k = 1)
SELECT label, string_agg(tok, ',' ORDER BY pos) AS midsv, string_agg(CASE WHEN tok LIKE '-%' THEN '' WHEN tok LIKE '+%' THEN 'ACG' ELSE right(tok, 1) END, '' ORDER BY pos) AS sequence FROM top GROUP BY label""")
def q_consensus(spark: SparkSession, d: str) -> DataFrame:
    return consensus.call(_pwm(spark, d), ["label"]).select("label", F.array_join("tokens", ",").alias("midsv"), "sequence")


@query("""WITH c AS (SELECT p_type AS allele, CAST(p_partkey AS INT) AS label, p_name AS sequence, CAST(p_size AS DOUBLE) AS percent FROM part),
g AS (SELECT allele, sequence, min(label) AS first, sum(percent) AS percent, count(*) AS n FROM c GROUP BY ALL)
SELECT allele, sequence, percent, CAST(row_number() OVER (ORDER BY percent DESC, first) AS INT) AS label FROM g""")
def q_merge_duplicates(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "part").select(F.col("p_type").alias("allele"), F.col("p_partkey").cast("int").alias("label"), F.col("p_name").alias("sequence"), F.col("p_size").cast("double").alias("percent"))
    return consensus.merge_equal(rows)[0].select("allele", "sequence", "percent", "label")


@query("""WITH k AS (SELECT c_nationkey AS pos, CASE WHEN c_acctbal < 0 THEN '-' WHEN c_acctbal > 9000 THEN '+' ELSE '*' END AS mut FROM customer), l AS (SELECT DISTINCT * FROM k), e AS (SELECT DISTINCT s_nationkey AS pos, '*' AS mut FROM supplier),
n AS (SELECT n_nationkey AS pos FROM nation WHERE n_regionkey = 1), u AS (SELECT pos, mut FROM (SELECT * FROM l EXCEPT SELECT * FROM e) UNION SELECT pos, m FROM n, (VALUES ('+'), ('-'), ('*')) AS m(m))
SELECT pos, string_agg(mut, '' ORDER BY mut) AS muts FROM u GROUP BY pos""")
def q_set_ops(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("c_acctbal") < 0, "-").when(F.col("c_acctbal") > 9000, "+").otherwise("*")
    loci = _t(spark, d, "customer").select(F.col("c_nationkey").alias("pos"), kind.alias("mut")).distinct()
    errors = _t(spark, d, "supplier").select(F.col("s_nationkey").alias("pos"), F.lit("*").alias("mut"))
    knock = _t(spark, d, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("pos"))
    out = profile.add_everywhere(profile.without(loci, errors, []), knock, [])
    return profile.transpose(out, []).select("pos", F.array_join("muts", "").alias("muts"))


@query("""SELECT p_partkey, CAST(damerau_levenshtein(p_name, p_type) AS INT) AS distance FROM part""")
def q_edit_distance(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "part").select("p_partkey", stats.edit_distance_udf("p_name", "p_type").alias("distance"))


@query("""SELECT o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5(CAST(o_orderkey AS VARCHAR))) AS k FROM orders) WHERE k <= 50""")
def q_stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "orders").withColumnRenamed("o_orderpriority", "label")
    found = consensus.per_label(rows, 50, order=[F.md5(F.col("o_orderkey").cast("string"))])
    return found.select(F.col("label").alias("o_orderpriority"), "o_orderkey")


@query("SELECT user_id, " + ", ".join(f'CAST(count(*) FILTER (hour(ts) = {h}) AS INT) AS "{h}"' for h in range(24)) + " FROM events GROUP BY user_id")
def q_pivot_features(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "events").groupBy("user_id", F.hour(F.col("ts").cast("timestamp")).alias("start")).agg(F.count(F.lit(1)).cast("int").alias("size"))
    return sv.features(rows, "user_id", list(range(24)))


@query("""WITH a AS (SELECT o_custkey, o_orderkey, CAST(epoch(o_orderdate) / 86400 AS INT) AS pos, CAST(o_totalprice / 20000 AS INT) AS length FROM orders),
l AS (SELECT *, coalesce(pos + length >= lead(pos) OVER (PARTITION BY o_custkey ORDER BY pos), false) AS clash FROM a)
SELECT o_custkey, count(*) AS n FROM l GROUP BY o_custkey HAVING NOT bool_or(clash)""")
def q_overlap(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "orders").select("o_custkey", "o_orderkey", F.datediff("o_orderdate", F.lit("1970-01-01")).alias("pos"), F.rint(F.col("o_totalprice") / 20000).cast("int").alias("length"))
    return windows.overlapping_dropped(rows, "o_custkey").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH t AS (SELECT l_orderkey, {_SQL_TOKEN} AS tok, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_SQL_LINE_ORDER}, {_SQL_TOKEN}) AS pos FROM lineitem),
g AS (SELECT *, pos - row_number() OVER (PARTITION BY l_orderkey, tok = '-T', tok = '=N' ORDER BY pos) AS g FROM t), p AS (SELECT *, lag(tok) OVER (PARTITION BY l_orderkey ORDER BY pos) AS pt FROM t),
base AS (SELECT *, CASE WHEN pt IS NULL THEN NULL WHEN pt LIKE '+%' THEN 'G' WHEN pt LIKE '*%' THEN 'A' ELSE right(pt, 1) END AS anchor FROM p)
SELECT l_orderkey, CAST(min(pos) AS INT) AS pos, 'T' AS ref, '<DEL>' AS alt, 'DEL' AS kind, -CAST(count(*) AS INT) AS svlen FROM g WHERE tok = '-T' GROUP BY l_orderkey, g
UNION ALL SELECT l_orderkey, CAST(min(pos) AS INT), 'N', '<DEL>', 'DEL', -CAST(count(*) AS INT) FROM g WHERE tok = '=N' GROUP BY l_orderkey, g
UNION ALL SELECT l_orderkey, CAST(pos AS INT), 'A', 'G', 'SUB', 0 FROM t WHERE tok LIKE '*%'
UNION ALL SELECT l_orderkey, CAST(CASE WHEN anchor IS NULL THEN pos ELSE pos - 1 END AS INT), coalesce(anchor, 'G'), coalesce(anchor, 'G') || 'AC', 'INS', 2 FROM base WHERE tok LIKE '+%'""")
def q_vcf_records(spark: SparkSession, d: str) -> DataFrame:
    reads = _reads(spark, d).select(F.col("l_orderkey").cast("string").alias("name"), "tokens")
    v = vcf.variants(reads)
    return v.select(F.col("id").cast("long").alias("l_orderkey"), "pos", "ref", "alt", F.col("info")["TYPE"].alias("kind"), F.coalesce(F.col("info")["SVLEN"].cast("int"), F.lit(0)).alias("svlen"))


@query("""SELECT p_partkey, regexp_replace(trim(p_name), '[<>:"/\\\\|?*\\x00-\\x1F .]', '-', 'g') AS safe, md5(p_name) AS allele_key, sha256(p_type) AS hash FROM part""")
def q_sanitize_md5(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "part").select("p_partkey", strings.sanitize(F.col("p_name")).alias("safe"), strings.allele_key(F.col("p_name")).alias("allele_key"), strings.file_hash(F.col("p_type")).alias("hash"))


@query("""SELECT DISTINCT c_mktsegment AS "Sample", o_orderpriority AS "Label", c_mktsegment || CASE o_orderstatus WHEN 'F' THEN '' WHEN 'O' THEN ' with indels' ELSE ' ' || o_orderstatus END AS "Allele type" FROM orders JOIN customer ON c_custkey = o_custkey""")
def q_summary_distinct(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "orders").join(_t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    kind = F.when(F.col("o_orderstatus") == "F", "intact").when(F.col("o_orderstatus") == "O", "indels").otherwise(F.col("o_orderstatus"))
    named = rows.select(F.col("o_orderkey").alias("Read ID"), F.col("c_mktsegment").alias("Sample"), F.col("o_orderpriority").alias("Label"), strings.allele_type_label(F.col("c_mktsegment"), kind).alias("Allele type"))
    return summary.distinct(named)


@query("""WITH k AS (SELECT lower(p_brand) AS a, lower(p_type) AS b, min(p_name) AS path FROM part WHERE p_size > 30 GROUP BY 1, 2), f AS (SELECT lower(p_type) AS b, min(p_name) AS path FROM part WHERE p_size > 30 GROUP BY 1)
SELECT p_partkey, coalesce(k.path, f.path, '') AS path FROM part LEFT JOIN k ON lower(p_brand) = k.a AND lower(p_type) = k.b LEFT JOIN f ON lower(p_type) = f.b""")
def q_html_lookup(spark: SparkSession, d: str) -> DataFrame:
    part = _t(spark, d, "part")
    files = part.filter("p_size > 30").select(F.col("p_brand").alias("allele"), F.col("p_type").alias("type"), F.col("p_name").alias("path"))
    rows = part.select("p_partkey", F.col("p_brand").alias("allele"), F.col("p_type").alias("type"))
    return summary.attach_paths(rows, files, ["allele", "type"], ["type"]).select("p_partkey", "path")


@query("""SELECT DISTINCT c_name AS sample, 'control' AS control, c_mktsegment AS allele, c_mktsegment AS name, CASE WHEN c_nationkey < 12 THEN 'mm39' END AS genome FROM customer WHERE c_acctbal >= 0""")
def q_manifest_check(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "customer").select(
        F.concat(F.lit("  "), "c_name", F.lit(" ")).alias("sample"),
        F.when(F.col("c_acctbal") >= 0, " control").otherwise(" ").alias("control"),
        F.col("c_mktsegment").alias("allele"),
        F.col("c_mktsegment").alias("name"),
        F.when(F.col("c_nationkey") < 12, "mm39").otherwise("").alias("genome"),
        F.lit("other").alias("remark"),
    )
    path = scratch(spark, "manifest")
    rows.write.option("header", True).csv(path)
    return files.read_manifest(spark, path)


@query(f"""WITH {_SQL_READS} SELECT l_orderkey, array_to_string(list_transform(tokens, lambda t: CASE WHEN t LIKE '+%' THEN 'ACG' WHEN t LIKE '-%' THEN '' ELSE right(t, 1) END), '') AS sequence FROM r""")
def q_token_sequence(spark: SparkSession, d: str) -> DataFrame:
    return _reads(spark, d).select("l_orderkey", K.sequence_of(F.col("tokens")).alias("sequence"))


@query(f"""WITH {_SQL_READS} SELECT l_orderkey, array_to_string(list_transform(tokens, lambda t: CASE WHEN t LIKE '+%' THEN '+I=G' ELSE t END), ',') AS short, array_to_string(list_transform(tokens, lambda t: CASE WHEN t LIKE '+%' THEN 'G' WHEN t = '=N' THEN 'N' ELSE t[2] END), '') AS bases FROM r""")
def q_compress_insertion(spark: SparkSession, d: str) -> DataFrame:
    return _reads(spark, d).select("l_orderkey", F.array_join(F.transform("tokens", lambda t: K.compress_insertion(t)), ",").alias("short"), F.array_join(F.transform("tokens", lambda t: K.reference_base(t)), "").alias("bases"))


@query(f"""WITH {_SQL_READS}, s AS (SELECT l_orderkey, flatten(list_transform(tokens, lambda t: string_split(t, '|'))) AS t FROM r),
u AS (SELECT l_orderkey, unnest(t) AS t, unnest(range(len(t))) AS i FROM s), v AS (SELECT *, i - row_number() OVER (PARTITION BY l_orderkey, t[1] ORDER BY i) AS g FROM u),
w AS (SELECT l_orderkey, t[1] AS op, min(i) AS i, CASE WHEN t[1] = '*' THEN string_agg(lower(t), '' ORDER BY i) WHEN t[1] = '=' THEN '=' || string_agg(upper(t[2]), '' ORDER BY i) ELSE t[1] || string_agg(lower(t[2]), '' ORDER BY i) END AS x FROM v GROUP BY l_orderkey, t[1], g)
SELECT l_orderkey, string_agg(x, '' ORDER BY i) AS cs FROM w GROUP BY l_orderkey""")
def q_cs_tag(spark: SparkSession, d: str) -> DataFrame:
    return _reads(spark, d).select("l_orderkey", K.cs_tag(F.col("tokens")).alias("cs"))


@query(f"""WITH t AS (SELECT l_orderkey, {_SQL_TOKEN} AS tok, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_SQL_LINE_ORDER}, {_SQL_TOKEN}) AS i FROM lineitem),
n AS (SELECT *, lead(tok) OVER (PARTITION BY l_orderkey ORDER BY i) AS nx FROM t)
SELECT l_orderkey, string_agg(CASE WHEN i = 1 AND tok LIKE '+%' THEN '+G|+T|' ELSE '' END || CASE WHEN nx LIKE '+%' THEN '+G|+T|' ELSE '' END || CASE WHEN tok LIKE '+%' THEN '=C' ELSE translate(tok, 'ACGT', 'TGCA') END, ',' ORDER BY i DESC) AS turned FROM n GROUP BY l_orderkey""")
def q_revcomp_tokens(spark: SparkSession, d: str) -> DataFrame:
    return _reads(spark, d).select("l_orderkey", F.array_join(sequential.reverse_complement_udf("tokens"), ",").alias("turned"))


@query("""SELECT l_linenumber AS pos, count(*) AS n, CAST(count(*) FILTER (l_partkey & 16 <> 0) AS BIGINT) AS minus, CAST(sum(xor(l_suppkey, 16)) AS BIGINT) AS toggled FROM lineitem GROUP BY 1""")
def q_strand_flags(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "lineitem").withColumn("strand", K.strand(F.col("l_partkey")))
    return rows.groupBy(F.col("l_linenumber").alias("pos")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("strand") == "-").alias("minus"), F.sum(strings.reverse_flag(F.col("l_suppkey"))).alias("toggled"))


def _sql_cosine(x: str, y: str) -> str:
    return f"CASE WHEN len({x}) = 0 THEN 0 WHEN list_sum(list_transform({x}, lambda v: v * v)) = 0 OR list_sum(list_transform({y}, lambda v: v * v)) = 0 THEN 1 ELSE 1 - greatest(-1, least(1, list_inner_product({x}, {y}) / (sqrt(list_inner_product({x}, {x})) * sqrt(list_inner_product({y}, {y})) + 2.220446049250313e-16))) END"


SQL_DISSIMILAR = f"""{_SQL_SIDES}, m AS (SELECT s.pos, s.mut, s.pct AS x, least(s.pct, coalesce(c.pct, 0)) AS y FROM prof s LEFT JOIN prof c ON c.l_linestatus = 'F' AND c.pos = s.pos AND c.mut = s.mut WHERE s.l_linestatus = 'O'),
a AS (SELECT *, list(x) OVER w AS xs, list(y) OVER w AS ys FROM m WINDOW w AS (PARTITION BY mut ORDER BY pos ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)),
d AS (SELECT *, {_sql_cosine("xs", "ys")} AS d, {_sql_cosine("xs[2:]", "ys[2:]")} AS t FROM a),
dis AS (SELECT pos, mut, x, y, CASE WHEN x - y > 20 THEN {{jump}} WHEN d <= 0.05 THEN false ELSE d / (d + t) > 0.9 END AS dissimilar FROM d)"""


@query(f"WITH {SQL_DISSIMILAR.format(jump='true')} SELECT pos, mut, dissimilar FROM dis")
def q_look_ahead(spark: SparkSession, d: str) -> DataFrame:
    return profile.dissimilar(_pairs(spark, d, True), []).select("pos", "mut", "dissimilar")


@query(f"""WITH {SQL_DISSIMILAR.format(jump='true')} SELECT pos, mut FROM dis WHERE dissimilar AND x - y > CASE mut WHEN '+' THEN 0.5 WHEN '-' THEN 0.1 ELSE 0.2 END""")
def q_anomalies(spark: SparkSession, d: str) -> DataFrame:
    return profile.anomalies(_pairs(spark, d, True), [], {"+": 0.5, "-": 0.1, "*": 0.2})


@query("""WITH v AS (SELECT l_returnflag AS mut, l_quantity - l_discount * 100 AS x, count(*) AS n FROM lineitem GROUP BY ALL),
w AS (SELECT mut, x, sum(n) OVER a AS c, sum(n * x) OVER a AS s, sum(n * x * x) OVER a AS q, sum(n) OVER b AS ca, sum(n * x) OVER b AS sa, sum(n * x * x) OVER b AS qa FROM v WINDOW a AS (PARTITION BY mut ORDER BY x), b AS (PARTITION BY mut)),
k AS (SELECT *, row_number() OVER (PARTITION BY mut ORDER BY q - s * s / c + (qa - q) - (sa - s) * (sa - s) / (ca - c), x) AS k FROM w WHERE c < ca)
SELECT 'all' AS allele, mut, round(greatest((s / c + (sa - s) / (ca - c)) / 2, 10), 4) AS threshold FROM k WHERE k = 1""")
def q_two_means(spark: SparkSession, d: str) -> DataFrame:
    """A data-driven threshold for each return flag, from all lines."""
    rows = _t(spark, d, "lineitem").select(F.lit("all").alias("allele"), F.col("l_returnflag").alias("mut"), F.col("l_quantity").alias("sample"), (F.col("l_discount") * 100).alias("control"))
    return stats.data_thresholds(rows, ["allele"]).withColumn("threshold", F.round("threshold", 4))


@query()
def q_error_reads(spark: SparkSession, d: str) -> DataFrame:
    """Orders of 1-month halves as control and sample: reads with errors by two clusters, then by the classifier they train."""
    reads = _reads(spark, d).join(_t(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), "l_orderkey")
    reads = reads.withColumn("late", F.dayofmonth("o_orderdate") > 15)
    judged = materialize(errors.control_errors(reads.filter("not late")), "judged")
    found = errors.sample_errors(reads.filter("late"), judged)
    good, bad = errors.kept(reads.filter("late"), found, "l_orderkey")
    return good.select("l_orderkey", F.lit(False).alias("error")).union(bad.select("l_orderkey", F.lit(True)))


@query()
def q_merge_minor(spark: SparkSession, d: str) -> DataFrame:
    """Customers by priority after the least supported priorities are merged away."""
    s = _scores(spark, d).withColumn("score", F.col("score").cast("double"))
    limit = int(classify.allele_counts(s, "o_custkey").agg(F.avg("n")).first()[0] or 0)
    return classify.allele_counts(classify.merge_minor(s, limit, "o_custkey"), "o_custkey").select("allele", "n")
