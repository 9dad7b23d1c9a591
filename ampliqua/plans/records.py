"""More of the driver's queries: text fields, files written and read again, alignments, records, labels and loci."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ampliqua.functions import sequential, strings
from ampliqua.functions import tokens as K
from ampliqua.operators import alignments, classify, consensus, errors, profile, stats, sv, windows
from ampliqua.plans import queries as base
from ampliqua.plans.queries import fisher_sql, query
from ampliqua.report import summary, vcf
from ampliqua.schemas import GenomeCoordinates
from ampliqua.session import scratch
from ampliqua.sources import files

_t, _reads, _pairs, _positions = base._t, base._reads, base._pairs, base._positions
_SQL_READS, _SQL_TOKEN, _SQL_POSITIONS, _SQL_PROFILE = base._SQL_READS, base._SQL_TOKEN, base._SQL_POSITIONS, base._SQL_PROFILE
_LINE_ORDER, _SQL_LINE_ORDER = base._LINE_ORDER, base._SQL_LINE_ORDER


def _int(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("int")


# -- text fields ------------------------------------------------------------------------------------------------------


@query(r"""SELECT p_partkey, '@' || p_name || chr(10) || p_type || chr(10) || '+' || chr(10) || p_brand AS record, regexp_extract('@' || p_name, '^@?(\S+)', 1) AS qname, p_brand AS stem, '.fa.gz' AS extension,
  '>' || p_brand || chr(10) || regexp_replace(regexp_replace(p_name, '(.{10})', '\1' || chr(10), 'g'), chr(10) || '$', '') AS wrapped, p_size || '%' AS percent FROM part""")
def q_text_fields(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat(F.lit("a/b.c/"), "p_brand", F.lit(".fa.gz"))
    return _t(spark, d, "part").select(
        "p_partkey",
        strings.fastq_record(F.concat(F.lit("@"), "p_name"), F.col("p_type"), F.col("p_brand")).alias("record"),
        strings.qname(F.concat(F.lit("@"), "p_name")).alias("qname"),
        strings.stem(path).alias("stem"),
        strings.extension(path).alias("extension"),
        strings.wrap(F.col("p_brand"), F.col("p_name"), 10).alias("wrapped"),
        strings.percent_label(F.col("p_size")).alias("percent"),
    )


_SEQ = "ACGTTGCAAC" * 8


@query(f"""SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INT) AS quantity, CASE WHEN l_returnflag = 'A' THEN '*' ELSE substr('{_SEQ}', l_linenumber + 1, 80 - l_linenumber - CASE WHEN l_returnflag = 'R' THEN 3 ELSE 0 END) END AS clipped FROM lineitem""")
def q_soft_clips(spark: SparkSession, d: str) -> DataFrame:
    n, q = F.col("l_linenumber").cast("string"), _int("l_quantity").cast("string")
    cigar = F.concat(n, F.lit("S"), q, F.lit("M"), F.when(F.col("l_returnflag") == "R", "3S").otherwise(""))
    sequence = F.when(F.col("l_returnflag") == "A", "*").otherwise(_SEQ)
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", _int("l_quantity").alias("quantity"), strings.trim_soft_clips(cigar, sequence).alias("clipped"))


# -- tokens with inversions: lines of a high tax are inverted ----------------------------------------------------------

_SQL_INVERTED = f"CASE WHEN l_tax >= 0.06 THEN lower({_SQL_TOKEN}) ELSE {_SQL_TOKEN} END"
_SQL_TURNED = f"r AS (SELECT l_orderkey, list({_SQL_INVERTED} ORDER BY {_SQL_LINE_ORDER}, {_SQL_INVERTED}) AS tokens FROM lineitem GROUP BY l_orderkey)"


def _turned(spark: SparkSession, d: str) -> DataFrame:
    rows = base._token(_t(spark, d, "lineitem")).withColumn("tok", F.when(F.col("l_tax") >= 0.06, F.lower("tok")).otherwise(F.col("tok")))
    each = rows.select("l_orderkey", F.struct(*_LINE_ORDER, "tok").alias("x")).groupBy("l_orderkey").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return each.select("l_orderkey", F.transform("x", lambda x: x["tok"]).alias("tokens"))


_N_TAG = "^(=[Nn]|[+].*[|]=[Nn])$"


@query(f"""WITH {_SQL_TURNED}, k AS (SELECT *, list_filter(range(len(tokens)), lambda i: NOT regexp_matches(tokens[i + 1], '{_N_TAG}')) AS known FROM r)
SELECT l_orderkey, CAST(len(list_filter(tokens, lambda t: lower(t) = t AND regexp_matches(t, '[a-z]'))) AS INT) AS n_lower, CAST(len(list_filter(tokens, lambda t: regexp_matches(t, '[a-z]'))) AS INT) AS n_has, CAST(len(list_filter(tokens, lambda t: upper(t) = '=N')) AS INT) AS n_unknown,
  array_to_string(list_transform(tokens, lambda t: translate(t, 'ACGTacgt', 'TGCAtgca')), ',') AS complement, array_to_string(list_transform(tokens, lambda t: CASE WHEN t LIKE '+%' THEN 'AC' ELSE '' END), ',') AS inserted, CAST(2 * len(list_filter(tokens, lambda t: t LIKE '+%')) AS INT) AS added,
  CAST(coalesce(list_min(known), len(tokens)) - 1 AS INT) AS left_end, CAST(coalesce(list_max(known), -1) + 1 AS INT) AS right_end FROM k""")
def q_token_kinds(spark: SparkSession, d: str) -> DataFrame:
    t, n = F.col("tokens"), lambda f: _int(F.size(F.filter("tokens", f)))
    ends = K.n_boundaries(t)
    return _turned(spark, d).select(
        "l_orderkey",
        n(K.is_lower).alias("n_lower"),
        n(K.has_lower).alias("n_has"),
        n(K.is_unknown).alias("n_unknown"),
        F.array_join(K.complement(t), ",").alias("complement"),
        F.array_join(F.transform(t, K.inserted), ",").alias("inserted"),
        _int(F.aggregate(F.transform(t, lambda x: _int(K.insertion_size(x))), F.lit(0), lambda a, x: a + x)).alias("added"),
        _int(ends["left"]).alias("left_end"),
        _int(ends["right"]).alias("right_end"),
    )


@query(f"""WITH {_SQL_TURNED}, s AS (SELECT l_orderkey, array_to_string(list_transform(tokens, lambda t: CASE WHEN t LIKE '+A%' THEN 'ACG' WHEN t LIKE '+%' THEN 'acg' WHEN t LIKE '-%' THEN '' ELSE right(t, 1) END), '') AS s FROM r)
SELECT l_orderkey, array_to_string(list_transform(regexp_extract_all(s, '[a-z]+|[^a-z]+'), lambda x: CASE WHEN regexp_matches(x, '^[a-z]') THEN reverse(translate(x, 'acgt', 'tgca')) ELSE x END), '') AS sequence FROM s""")
def q_inverted_sequence(spark: SparkSession, d: str) -> DataFrame:
    return _turned(spark, d).select("l_orderkey", K.sequence_of(F.col("tokens")).alias("sequence"))


@query("""WITH t AS (SELECT l_orderkey, CASE l_returnflag WHEN 'A' THEN '-C' WHEN 'R' THEN '+C|=T' ELSE '=A' END AS tok, row_number() OVER (PARTITION BY l_orderkey ORDER BY """ + _SQL_LINE_ORDER + """, l_returnflag) AS i FROM lineitem),
n AS (SELECT *, lag(tok) OVER w AS before, lead(tok) OVER w AS after FROM t WINDOW w AS (PARTITION BY l_orderkey ORDER BY i))
SELECT l_orderkey, string_agg(CASE WHEN tok = '-C' AND after LIKE '+%' THEN '=C' WHEN tok LIKE '+%' AND before = '-C' THEN '=T' ELSE tok END, ',' ORDER BY i) AS midsv FROM n GROUP BY l_orderkey""")
def q_repair_indels(spark: SparkSession, d: str) -> DataFrame:
    tok = F.when(F.col("l_returnflag") == "A", "-C").when(F.col("l_returnflag") == "R", "+C|=T").otherwise("=A")
    rows = _t(spark, d, "lineitem").select("l_orderkey", F.struct(*_LINE_ORDER, "l_returnflag", tok.alias("tok")).alias("x"))
    reads = rows.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["tok"]).alias("tokens"))
    return reads.select("l_orderkey", F.array_join(sequential.repair_indels_udf("tokens"), ",").alias("midsv"))


# -- reads with errors, strands, runs of one base ----------------------------------------------------------------------


@query(f"""WITH {_SQL_READS}, m AS (SELECT l_orderkey, array_to_string(list_transform(tokens, lambda t: CASE WHEN t = '=N' THEN 'N' ELSE 'M' END), '') AS nm FROM r),
f AS (SELECT l_orderkey, length(replace(nm, 'M', '')) / length(nm) AS ratio, list_max(list_transform(string_split(nm, 'M'), lambda x: length(x))) AS run, length(replace(nm, 'N', '')) AS n_match FROM m)
SELECT l_orderkey, round(ratio, 6) AS n_ratio, CAST(run AS DOUBLE) AS n_run, CAST(n_match AS INT) AS n_match, ratio > 0.3 AS error FROM f""")
def q_error_features(spark: SparkSession, d: str) -> DataFrame:
    f = errors.features(_reads(spark, d)).drop("tokens")
    good, bad = errors.kept(f, f.select("l_orderkey", (F.col("n_ratio") > 0.3).alias("error")), "l_orderkey")
    both = good.withColumn("error", F.lit(False)).unionByName(bad.withColumn("error", F.lit(True)))
    return both.select("l_orderkey", F.round("n_ratio", 6).alias("n_ratio"), "n_run", _int("n_match").alias("n_match"), "error")


@query(f"""WITH {_SQL_READS}, s AS (SELECT tokens, o_totalprice > 150000 AS plus FROM r JOIN orders ON o_orderkey = l_orderkey), u AS (SELECT plus, unnest(tokens) AS tok, unnest(range(len(tokens))) AS pos FROM s)
SELECT CAST(pos AS INT) AS pos, tok[1] AS mut, count(*) FILTER (plus) AS plus, count(*) FILTER (NOT plus) AS minus FROM u WHERE tok[1] = '*' OR tok[1] = '+' AND pos % 2 = 0 OR tok[1] = '-' AND pos % 2 = 1 GROUP BY 1, 2""")
def q_strand_counts(spark: SparkSession, d: str) -> DataFrame:
    price = _t(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.when(F.col("o_totalprice") > 150000, "+").otherwise("-").alias("strand"))
    reads = _reads(spark, d).join(price, "l_orderkey")
    kinds = F.array(F.lit("*"), F.when(F.col("id") % 2 == 0, "+").otherwise("-"))
    length = reads.agg(F.max(F.size("tokens"))).first()[0] or 0
    return profile.strand_counts(reads, spark.range(length).select(_int("id").alias("pos"), F.explode(kinds).alias("mut")), [])


@query(f"""WITH n AS (SELECT l_linenumber AS label, count(*) FILTER (l_linestatus = 'O' AND l_quantity < 30) AS plus, count(*) FILTER (NOT (l_linestatus = 'O' AND l_quantity < 30)) AS minus FROM lineitem GROUP BY 1),
{fisher_sql("SELECT label, plus AS a, minus AS b, c, d FROM n, (SELECT count(*) FILTER (l_linestatus = 'O') AS c, count(*) FILTER (l_linestatus <> 'O') AS d FROM lineitem)", "label")}
SELECT label, plus / (plus + minus) NOT BETWEEN 0.2000001 AND 0.7999999 AND p_value < 0.01 AS biased, round(p_value, 6) AS p_value FROM n JOIN pv USING (label)""")
def q_strand_labels(spark: SparkSession, d: str) -> DataFrame:
    line = _t(spark, d, "lineitem")
    whole = line.agg(F.count_if(F.col("l_linestatus") == "O").alias("all_plus"), F.count_if(F.col("l_linestatus") != "O").alias("all_minus"))
    rows = line.select(F.col("l_linenumber").alias("label"), F.when((F.col("l_linestatus") == "O") & (F.col("l_quantity") < 30), "+").otherwise("-").alias("strand"))
    return stats.strand_biased_labels(rows, whole).withColumn("p_value", F.round("p_value", 6))


_BASES = "CAAAACC"


@query(f"""WITH {_SQL_PROFILE}, m AS (SELECT s.pos, s.mut, s.pct AS x, least(s.pct, coalesce(c.pct, 0)) AS y FROM prof s LEFT JOIN prof c ON c.l_linestatus = 'F' AND c.pos = s.pos AND c.mut = s.mut WHERE s.l_linestatus = 'O'),
e AS (SELECT mut, sum(x * CASE WHEN y >= 3 THEN x ELSE y END) / sqrt(sum(x * x) * sum(power(CASE WHEN y >= 3 THEN x ELSE y END, 2))) AS cos FROM m WHERE pos BETWEEN 2 AND 5 GROUP BY mut)
SELECT mut, CAST(unnest(range(2, 7)) AS INT) AS pos FROM e WHERE cos > 0.8 AND NOT (EXISTS (SELECT 1 FROM m WHERE x > 30 AND pos = 1) AND EXISTS (SELECT 1 FROM m WHERE x > 99 AND pos = 7))""")
def q_homopolymer_errors(spark: SparkSession, d: str) -> DataFrame:
    pairs = _pairs(spark, d)
    letters = spark.range(1, len(_BASES) + 1).select(_int("id").alias("pos"), F.substring(F.lit(_BASES), _int("id"), F.lit(1)).alias("base"))
    found = profile.homopolymer_errors(pairs, profile.repeat_spans(letters, []), pairs.filter("sample > CASE WHEN pos = 7 THEN 99 ELSE 30 END"), [])
    return found.select("mut", _int("pos").alias("pos"))


# -- ordered sequences -------------------------------------------------------------------------------------------------


@query("""WITH e AS (SELECT user_id, CAST(floor(epoch(ts) / 3600) AS INT) AS pos FROM events), l AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY user_id ORDER BY pos) <= 48 THEN 0 ELSE 1 END AS new FROM e),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY pos, new DESC ROWS UNBOUNDED PRECEDING) AS session FROM l), z AS (SELECT user_id, session, pos, count(*) AS n FROM s GROUP BY ALL),
m AS (SELECT *, sum(n) OVER (PARTITION BY user_id, session) AS size, first_value(pos) OVER (PARTITION BY user_id, session ORDER BY n DESC, pos) AS start FROM z)
SELECT user_id, pos, start FROM m WHERE size > 2""")
def q_start_converter(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "events").select("user_id", _int(F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600)).alias("pos"))
    return windows.start_converter(rows, ["user_id"], "pos", 48, 2).select("user_id", "pos", "start")


@query("""WITH p AS (SELECT CAST(floor(o_totalprice / 10) AS INT) AS start, count(*) AS n FROM orders GROUP BY 1), l AS (SELECT *, CASE WHEN start - lag(start) OVER (ORDER BY start) <= 5 THEN 0 ELSE 1 END AS new FROM p),
s AS (SELECT *, sum(new) OVER (ORDER BY start) AS session FROM l), m AS (SELECT *, sum(n) OVER (PARTITION BY session) AS size, first_value(start) OVER (PARTITION BY session ORDER BY n DESC, start) AS mode FROM s)
SELECT o_orderkey, mode AS start, 1 AS size FROM orders JOIN m ON m.start = floor(o_totalprice / 10) WHERE m.size > 5""")
def q_sv_starts(spark: SparkSession, d: str) -> DataFrame:
    found = _t(spark, d, "orders").select("o_orderkey", _int(F.floor(F.col("o_totalprice") / 10)).alias("start"), F.lit(1).alias("size"))
    return sv.converted(found, 20, ["o_orderkey"])


@query(f"""WITH {_SQL_POSITIONS}, q AS (SELECT user_id, pos, CASE WHEN tok = '=C' THEN '=c' ELSE tok END AS tok FROM p),
g AS (SELECT user_id, CASE WHEN tok = '=c' THEN 'inversion' ELSE 'deletion' END AS kind, pos, pos - row_number() OVER (PARTITION BY user_id, tok ORDER BY pos) AS g FROM q WHERE tok = '=c' OR tok = '-T' AND pos % 7 <> 6)
SELECT user_id, kind, min(pos) AS start, CAST(count(*) AS INT) AS size FROM g GROUP BY user_id, kind, g HAVING count(*) >= 2
UNION ALL SELECT user_id, 'insertion', pos, 2 FROM q WHERE tok LIKE '+%' AND pos % 7 <> 6""")
def q_sv_runs(spark: SparkSession, d: str) -> DataFrame:
    rows = _positions(spark, d).select("user_id", "pos", F.when(F.col("tok") == "=C", "=c").otherwise(F.col("tok")).alias("tok"))
    loci = spark.range(base._length(rows)).filter("id % 7 <> 6").select(_int("id").alias("pos"), F.array(F.lit("+"), F.lit("-")).alias("muts"))
    parts = [sv.runs(rows, kind, loci, ["user_id"], 2).select("user_id", F.lit(kind).alias("kind"), "start", "size") for kind in sv.KINDS]
    return parts[0].union(parts[1]).union(parts[2])


@query("""WITH e AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events),
w AS (SELECT user_id, event_id, pos, list(value) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS l, count(*) OVER (PARTITION BY user_id ORDER BY pos RANGE BETWEEN 3 PRECEDING AND 1 PRECEDING) AS before FROM e)
SELECT event_id, round(CASE WHEN len(l) = 3 THEN list_sum(l) ELSE 0 END, 6) AS around, before FROM w""")
def q_windows(spark: SparkSession, d: str) -> DataFrame:
    place = F.row_number().over(base.Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = _t(spark, d, "events").select("user_id", "event_id", "value", place.alias("pos"))
    rows = windows.count_in_range(windows.centred(rows, ["user_id"], "pos", "value", 3), ["user_id"], "pos", -3, -1, "before")
    return rows.select("event_id", F.round(F.aggregate("window", F.lit(0.0), lambda a, x: a + x), 6).alias("around"), "before")


# -- alignments --------------------------------------------------------------------------------------------------------

_SQL_PRESET = "CASE l_returnflag WHEN 'A' THEN 'map-ont' WHEN 'R' THEN 'sr' ELSE 'splice' END"


@query(f"""WITH a AS (SELECT l_orderkey, {_SQL_PRESET} AS preset, CAST(l_quantity AS INT) AS n FROM lineitem), s AS (SELECT l_orderkey, preset, sum(n) AS span, count(*) AS n FROM a GROUP BY ALL)
SELECT CAST(l_orderkey AS VARCHAR) AS qname, preset, n FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY span DESC, preset = 'map-ont' DESC, preset) AS k FROM s) WHERE k = 1""")
def q_best_preset(spark: SparkSession, d: str) -> DataFrame:
    preset = F.when(F.col("l_returnflag") == "A", "map-ont").when(F.col("l_returnflag") == "R", "sr").otherwise("splice")
    cigar = F.concat(F.lit("5S"), _int("l_quantity").cast("string"), F.lit("M2I"))
    rows = _t(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("qname"), preset.alias("preset"), cigar.alias("cigar"))
    return alignments.of_best_preset(rows).groupBy("qname", "preset").agg(F.count(F.lit(1)).alias("n"))


_SQL_BASE = "substr('ACGTACGTACGT', l_linenumber + {}, 1)"


@query(f"""WITH a AS (SELECT l_orderkey, l_linenumber AS pos, CASE l_returnflag WHEN 'R' THEN 16 ELSE 0 END AS flag, CAST(l_quantity AS INT) % 4 AS q, {_SQL_BASE.format(0)} AS x, {_SQL_BASE.format(1)} AS y, {_SQL_BASE.format(2)} AS z FROM lineitem),
c AS (SELECT *, '=' || x || CASE q WHEN 0 THEN y || z WHEN 1 THEN '*' || lower(y || translate(y, 'ACGT', 'CGTA')) || '=' || z WHEN 2 THEN '-' || lower(y) || '=' || z ELSE '+ga=' || y || z END AS cs,
  CASE q WHEN 0 THEN '=' || y WHEN 1 THEN '*' || y || translate(y, 'ACGT', 'CGTA') WHEN 2 THEN '-' || y ELSE '+G|+A|=' || y END AS mid FROM a),
m AS (SELECT l_orderkey, arg_min(flag, pos * 100 + flag) AS main FROM a GROUP BY 1),
k AS (SELECT l_orderkey, pos + o AS p, flag, CASE o WHEN 0 THEN '=' || x WHEN 1 THEN mid ELSE '=' || z END AS tok, row_number() OVER (PARTITION BY l_orderkey, pos + o ORDER BY pos, flag, cs) AS n FROM c, (SELECT unnest(range(3)) AS o)),
w AS (SELECT l_orderkey, main, unnest(range(1, 13)) AS p FROM m)
SELECT CAST(w.l_orderkey AS VARCHAR) AS qname, CASE main WHEN 16 THEN '-' ELSE '+' END AS strand, string_agg(CASE WHEN tok IS NULL THEN '=N' WHEN flag = main THEN tok ELSE lower(tok) END, ',' ORDER BY w.p) AS midsv FROM w LEFT JOIN k ON k.l_orderkey = w.l_orderkey AND k.p = w.p AND n = 1 GROUP BY w.l_orderkey, main""")
def q_alignment_tokens(spark: SparkSession, d: str) -> DataFrame:
    flag = F.when(F.col("l_returnflag") == "R", 16).otherwise(0)
    x, y, z = (F.substring(F.lit("ACGTACGTACGT"), F.col("l_linenumber") + k, F.lit(1)) for k in range(3))
    q = _int("l_quantity") % 4
    change = F.when(q == 0, F.concat(y, z)).when(q == 1, F.concat(F.lit("*"), F.lower(F.concat(y, F.translate(y, "ACGT", "CGTA"))), F.lit("="), z)).when(q == 2, F.concat(F.lit("-"), F.lower(y), F.lit("="), z)).otherwise(F.concat(F.lit("+ga="), y, z))
    rows = _t(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("qname"), flag.alias("flag"), F.lit("control").alias("rname"), F.col("l_linenumber").alias("pos"), F.concat(F.lit("="), x, change).alias("cs"))
    alleles = spark.createDataFrame([("control", "ACGTACGTACGT")], "allele string, sequence string")
    return alignments.to_tokens(rows, alleles).select("qname", "strand", F.array_join("tokens", ",").alias("midsv"))


@query("""SELECT l_orderkey, l_linenumber, l_suppkey, 1002 - (l_linenumber + 3 + CAST(l_quantity AS INT)) AS pos, xor(CASE l_returnflag WHEN 'R' THEN 16 ELSE 2048 END, 16) AS flag, CAST(CAST(l_quantity AS INT) AS VARCHAR) || 'D3M' AS cigar,
  reverse(translate(substr('ACGTNACGT', l_linenumber, 3), 'ACGT', 'TGCA')) AS seq, reverse(substr('ABCDEFGHI', l_linenumber, 3)) AS qual FROM lineitem""")
def q_turned_alignments(spark: SparkSession, d: str) -> DataFrame:
    line = _t(spark, d, "lineitem")
    part = lambda text: F.substring(F.lit(text), F.col("l_linenumber"), F.lit(3))
    rows = line.select("l_orderkey", "l_linenumber", "l_suppkey", F.col("l_linenumber").alias("pos"), F.when(F.col("l_returnflag") == "R", 16).otherwise(2048).alias("flag"), F.concat(F.lit("3M"), _int("l_quantity").cast("string"), F.lit("D")).alias("cigar"), part("ACGTNACGT").alias("seq"), part("ABCDEFGHI").alias("qual"))
    return alignments.revcomp_alignments(rows, 1000)


# -- variant records on the other strand -------------------------------------------------------------------------------


@query(f"""WITH t AS (SELECT l_orderkey, {_SQL_TOKEN} AS tok, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_SQL_LINE_ORDER}, {_SQL_TOKEN}) AS pos FROM lineitem),
g AS (SELECT *, pos - row_number() OVER (PARTITION BY l_orderkey, tok = '-T', tok = '=N' ORDER BY pos) AS g FROM t)
SELECT l_orderkey, CAST(1000 - max(pos) + 1 AS INT) AS pos, 'A' AS ref, '<DEL>' AS alt, 'DEL' AS kind, repeat('A', CAST(count(*) AS INT)) AS seq, CAST(1000 - min(pos) + 1 AS INT) AS stop FROM g WHERE tok = '-T' GROUP BY l_orderkey, g
UNION ALL SELECT l_orderkey, CAST(1000 - min(pos) + 1 AS INT), 'N', '<DEL>', 'DEL', repeat('N', CAST(count(*) AS INT)), CAST(1000 - min(pos) + 1 AS INT) FROM g WHERE tok = '=N' GROUP BY l_orderkey, g
UNION ALL SELECT l_orderkey, CAST(1000 - pos + 1 AS INT), 'T', 'C', 'SUB', '', 0 FROM t WHERE tok LIKE '*%'
UNION ALL SELECT l_orderkey, CAST(1000 - pos + 1 AS INT), 'C', 'CGT', 'INS', 'GT', 0 FROM t WHERE tok LIKE '+%'""")
def q_vcf_genome(spark: SparkSession, d: str) -> DataFrame:
    where = GenomeCoordinates("mm39", "chr5", 100, 1000, "-", 5000)
    v = vcf.variants(_reads(spark, d).select(F.col("l_orderkey").cast("string").alias("name"), "tokens"), where)
    info = F.col("info")
    return v.select(F.col("id").cast("long").alias("l_orderkey"), "pos", "ref", "alt", info["TYPE"].alias("kind"), F.coalesce(info["SEQ"], F.lit("")).alias("seq"), F.coalesce(_int(info["END"]), F.lit(0)).alias("stop"))


# -- labels, names, results --------------------------------------------------------------------------------------------


@query("""WITH n AS (SELECT o_orderpriority AS label, count(*) AS readnum FROM orders GROUP BY 1), p AS (SELECT *, round(100 * readnum / sum(readnum) OVER (), 3) AS percent, floor(sum(readnum) OVER () * 0.2) AS least FROM n), k AS (SELECT * FROM p WHERE readnum >= greatest(5, least))
SELECT label, readnum, round(percent * 100 / sum(percent) OVER (), 3) AS percent FROM k""")
def q_major_labels(spark: SparkSession, d: str) -> DataFrame:
    rows = consensus.add_shares(_t(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("label")))
    left = consensus.rescale(consensus.drop_minor_labels(rows, least=5, share=0.2))
    return consensus.label_counts(left).withColumnRenamed("n", "readnum").join(left.select("label", "percent").distinct(), "label")


@query("""WITH b AS (SELECT p_brand AS allele, min(p_name) AS ref FROM part GROUP BY 1), c AS (SELECT p_partkey, CASE WHEN p_type LIKE '%BRASS' THEN 'inversion07_predicted' ELSE p_brand END AS allele, CAST(p_partkey AS VARCHAR) AS label, CAST(p_size AS DOUBLE) AS percent, p_name, greatest(2, length(CAST(count(*) OVER () AS VARCHAR))) AS digits FROM part)
SELECT p_partkey, 'allele' || CASE WHEN length(label) >= digits THEN label ELSE lpad(label, CAST(digits AS INT), '0') END || '|' || CASE WHEN c.allele LIKE '%predicted' THEN 'unassigned|inversion' ELSE c.allele || CASE WHEN p_name = ref THEN '|intact' ELSE '|indels' END END || '|' || percent || '%' AS name
FROM c LEFT JOIN b ON b.allele = c.allele""")
def q_allele_names(spark: SparkSession, d: str) -> DataFrame:
    part = _t(spark, d, "part")
    allele = F.when(F.col("p_type").endswith("BRASS"), "inversion07_predicted").otherwise(F.col("p_brand"))
    rows = part.select("p_partkey", allele.alias("allele"), F.col("p_partkey").alias("label"), F.col("p_size").cast("double").alias("percent"), F.col("p_name").alias("sequence"))
    return consensus.names(rows, part.groupBy(F.col("p_brand").alias("allele")).agg(F.min("p_name").alias("sequence"))).select("p_partkey", "name")


@query("""WITH g AS (SELECT p_type AS allele, p_name AS sequence, min(p_partkey) AS first, sum(CAST(p_size AS DOUBLE)) AS percent, list(p_partkey) AS labels FROM part GROUP BY ALL), k AS (SELECT *, CAST(row_number() OVER (ORDER BY percent DESC, first) AS INT) AS label FROM g),
m AS (SELECT label, percent, unnest(labels) AS old FROM k)
SELECT label, 'n' || label AS name, percent, count(*) AS readnum FROM m JOIN lineitem ON l_partkey = old GROUP BY label, percent""")
def q_label_map(spark: SparkSession, d: str) -> DataFrame:
    part = _t(spark, d, "part").select(F.col("p_type").alias("allele"), _int("p_partkey").alias("label"), F.col("p_name").alias("sequence"), F.col("p_size").cast("double").alias("percent"))
    merged, mapping = consensus.merge_equal(part)
    reads = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("qname"), _int("l_partkey").alias("label"), F.lit(0).alias("readnum"), F.lit(0.0).alias("percent"))
    named = merged.withColumn("name", F.concat(F.lit("n"), F.col("label").cast("string")))
    return consensus.apply_labels(reads, mapping, named).select("label", "name", "percent", "readnum").distinct()


@query("""SELECT 's' AS "Sample", CAST(p_partkey AS VARCHAR) AS "Read ID", 'Allele' || p_partkey AS "Label", p_brand || '_' || p_size AS "Allele", CASE WHEN p_size > 25 THEN 'intact' ELSE 'indels' END AS "Type", p_size || '%' AS "Percent of reads", CASE WHEN p_size > 10 THEN '+' ELSE '-' END AS "Strand",
  p_brand || '_' || p_size || CASE WHEN p_size > 25 THEN '' ELSE ' with indels' END AS "Allele type" FROM part""")
def q_result_rows(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    name = F.concat(F.lit("allele"), F.col("p_partkey").cast("string"), F.lit("|"), "p_brand", F.lit("_"), size, F.lit("|"), F.when(F.col("p_size") > 25, "intact").otherwise("indels"), F.lit("|"), size, F.lit("%"))
    rows = _t(spark, d, "part").select(F.col("p_partkey").cast("string").alias("qname"), name.alias("name"), F.when(F.col("p_size") > 10, "+").otherwise("-").alias("strand"))
    return summary.with_allele_type(summary.result_rows(rows, "s"))


@query("""WITH c AS (SELECT l_orderkey, l_linestatus AS allele, CASE l_linestatus WHEN 'F' THEN 0 ELSE 1 END AS ord, sum(CASE l_returnflag WHEN 'A' THEN -2 WHEN 'R' THEN -1 ELSE CASE WHEN l_quantity > 40 THEN -1 ELSE 0 END END) AS score FROM lineitem GROUP BY ALL)
SELECT l_orderkey, allele FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, ord) AS k FROM c) WHERE k = 1""")
def q_classify(spark: SparkSession, d: str) -> DataFrame:
    rows = base._token(_t(spark, d, "lineitem")).groupBy("l_orderkey", F.col("l_linestatus").alias("allele")).agg(F.collect_list("tok").alias("tokens"))
    rows = rows.withColumn("allele_ord", F.when(F.col("allele") == "F", 0).otherwise(1))
    return classify.classify(rows, no_filter=True, read="l_orderkey").select("l_orderkey", "allele")


# -- loci --------------------------------------------------------------------------------------------------------------


@query(f"""WITH p AS (SELECT l_orderkey, l_linenumber AS pos, {_SQL_TOKEN} AS tok FROM lineitem), c AS (SELECT pos, count(*) FILTER (tok LIKE '=%') AS m, count(*) FILTER (tok LIKE '+%') AS i, count(*) FILTER (tok LIKE '-%') AS d, count(*) FILTER (tok LIKE '*%') AS s FROM p GROUP BY 1),
w AS (SELECT pos, u.mut, CASE WHEN m = 0 OR u.n / m > 0.5 THEN 0 ELSE u.n / m END AS weight FROM c, LATERAL (VALUES ('+', i), ('-', d), ('*', s)) AS u(mut, n))
SELECT l_orderkey, mut, round(sum(weight), 6) AS value FROM p JOIN w ON w.pos = p.pos AND w.mut = p.tok[1] GROUP BY 1, 2""")
def q_masked_sums(spark: SparkSession, d: str) -> DataFrame:
    rows = base._token(_t(spark, d, "lineitem")).select("l_orderkey", F.col("l_linenumber").alias("pos"), "tok")
    weights = profile.mask_weights(profile.onehot_percent(rows, []))
    return profile.masked_sums(rows, weights, "l_orderkey").withColumn("value", F.round("value", 6))


@query(f"""WITH {_SQL_READS}, u AS (SELECT l_orderkey % 4 AS allele, unnest(tokens) AS tok, unnest(range(len(tokens))) AS pos FROM r), k AS (SELECT DISTINCT allele, pos FROM u WHERE tok LIKE '-%'), o AS (SELECT DISTINCT allele, pos, '+' AS mut FROM u WHERE tok LIKE '+%'),
e AS (SELECT allele, pos, mut FROM k, (VALUES ('+'), ('-'), ('*')) AS m(mut) UNION SELECT * FROM o)
SELECT CAST(allele AS INT) AS allele, CAST(pos AS INT) AS pos, string_agg(mut, '' ORDER BY mut) AS muts FROM e GROUP BY ALL""")
def q_knockin_loci(spark: SparkSession, d: str) -> DataFrame:
    reads = _reads(spark, d).withColumn("allele", _int(F.col("l_orderkey") % 4))  # orders are dealt to four alleles
    more = profile.knockin_loci(reads, ["allele"])
    own = profile.explode_tokens(reads, ["allele"]).filter(F.col("tok").startswith("+")).select("allele", "pos", F.lit("+").alias("mut"))
    none = own.limit(0)
    return profile.transpose(profile.merged(profile.add_everywhere(none, more, ["allele"]), own, ["allele"]), ["allele"]).select("allele", "pos", F.array_join("muts", "").alias("muts"))


# -- files written and read again --------------------------------------------------------------------------------------


@query("""SELECT 'p' || p_partkey AS name, upper(replace(p_name, ' ', '')) AS sequence FROM part""")
def q_fasta_files(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "fasta")
    header = F.concat(F.lit("p"), F.col("p_partkey").cast("string"), F.lit(" brand>"), "p_brand")
    _t(spark, d, "part").select(strings.wrap(header, F.col("p_name"), 12)).write.text(path)
    return files.read_fasta(spark, path).select("name", "sequence")


@query("""SELECT '@r' || p_partkey || ' x=1' AS identifier, 'r' || p_partkey AS qname, p_name AS sequence, repeat('@', length(p_name)) AS quality FROM part""")
def q_fastq_files(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "fastq")
    rows = _t(spark, d, "part").select(F.concat(F.lit("@r"), F.col("p_partkey").cast("string"), F.lit(" x=1")).alias("identifier"), F.col("p_name").alias("sequence"), F.repeat(F.lit("@"), F.length("p_name")).alias("quality"))
    files.write_fastq(rows, path)
    return files.read_fastq(spark, path).select("identifier", "qname", "sequence", "quality")


@query("""SELECT CAST(l_orderkey AS VARCHAR) AS qname, 0 AS flag, l_returnflag AS rname, l_linenumber AS pos, 60 AS mapq, CAST(CAST(l_quantity AS INT) AS VARCHAR) || 'M' AS cigar, '*' AS rnext, 0 AS pnext, 0 AS tlen, 'ACGT' AS seq, 'IIII' AS qual, '' AS cs FROM lineitem WHERE l_linestatus = 'O' AND l_returnflag <> 'R'""")
def q_sam_files(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "sam")
    line = _t(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("qname"), F.when(F.col("l_linestatus") == "O", 0).otherwise(2064).alias("flag"), F.col("l_returnflag").alias("rname"), F.col("l_linenumber").alias("pos"), F.lit(60).alias("mapq"), F.concat(_int("l_quantity").cast("string"), F.lit("M")).alias("cigar"), F.lit("*").alias("rnext"), F.lit(0).alias("pnext"), F.lit(0).alias("tlen"), F.when(F.col("l_returnflag") == "R", "*").otherwise("ACGT").alias("seq"), F.lit("IIII").alias("qual"))
    files.write_sam(spark.createDataFrame([("@SQ\tSN:N\tLN:9",), ("@PG\tID:x",)], "value string"), line, path)
    return files.primary(files.mapped(files.read_sam(spark, path)[1]))


@query("""SELECT n_name AS chrom, n_nationkey * 10 AS start, n_nationkey * 10 + 5 AS "end", 'mm39' AS name, 1000 AS chrom_size, CASE WHEN n_regionkey > 2 THEN '-' ELSE '+' END AS strand FROM nation""")
def q_bed_files(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "bed")
    begin = F.col("n_nationkey") * 10
    _t(spark, d, "nation").select(F.concat_ws("\t", "n_name", begin.cast("string"), (begin + 5).cast("string"), F.lit("mm39"), F.lit("1000"), F.when(F.col("n_regionkey") > 2, "-").otherwise("+"))).write.text(path)
    return files.read_bed(spark, path)


@query(f"""WITH {_SQL_READS} SELECT 'a' AS allele, CAST(l_orderkey AS VARCHAR) AS qname, '+' AS strand, 'map-ont' AS preset, array_to_string(tokens, ',') AS midsv FROM r""")
def q_token_files(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "jsonl")
    _reads(spark, d).select(F.col("l_orderkey").cast("string").alias("QNAME"), F.lit("a").alias("RNAME"), F.array_join("tokens", ",").alias("MIDSV"), F.lit("+").alias("STRAND"), F.lit("map-ont").alias("PRESET")).write.json(path)
    return files.read_tokens(spark, path).select("allele", "qname", "strand", "preset", F.array_join("tokens", ",").alias("midsv"))
