"""URL filter rules, carried to aliases over redirect and canonical-link edges; DataFrame operations only.

Hosts and paths are judged by rules; pages without a rule take the decision of their component in the graph of
redirects (given, or `<meta http-equiv=refresh>`) and canonical links: an explicit allow anywhere in it wins, else an
explicit block, else the page is allowed.

Defined results: a url that is null or has no '://' has empty host and path and no rule; null html has no edges; pages
that share a url share its component; repeated rows each get a row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ampliqua.llm.components import connected_components

#: Fixed values: (action, host, path) of the rules in force.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: Up to so many rules are looked up in a literal; more are joined.
MAX_LITERAL_RULES = 500

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), "^([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def url_key(url: Column) -> Column:
    """What two spellings of an address share: host, path and query; not the scheme or the fragment. Null without a host."""
    key = F.concat(host_of(url), F.regexp_extract(_rest(url), "^[^/?#]*([^#]*)", 1))
    return F.when(host_of(url) != "", F.regexp_replace(key, "^([^/?]*)/?$", "$1/"))


def _suffixes(host: Column) -> Column:
    labels = F.split(host, "[.]")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))


def match_rules(df: DataFrame, rules: Sequence[tuple[str, str, str]] | DataFrame, host: str = "host", path: str = "path") -> DataFrame:
    """df with rule (host and path of the longest rule that fits) and action; of equally long rules the longer host, then allow, wins."""
    found = F.filter(F.col("_found"), lambda r: F.col(path).startswith(r["path"]))
    best = F.array_max(F.transform(found, lambda r: F.struct((F.length(r["host"]) + F.length(r["path"])).alias("n"), F.length(r["host"]).alias("h"), (r["action"] == "allow").alias("allow"), F.concat(r["host"], r["path"]).alias("rule"))))
    pick = lambda x: x.withColumn("_best", best).withColumn("rule", F.col("_best.rule")).withColumn("action", F.when(F.col("_best.allow"), "allow").when(~F.col("_best.allow"), "block")).drop("_best", "_found")
    if not isinstance(rules, DataFrame) and len(rules) <= MAX_LITERAL_RULES:
        literal = F.array(*(F.struct(*(F.lit(x).alias(n) for x, n in zip(r, ("action", "host", "path"), strict=True))) for r in rules)) if rules else F.array().cast("array<struct<action:string,host:string,path:string>>")
        return pick(df.withColumn("_found", F.filter(literal, lambda r: (F.col(host) == r["host"]) | F.col(host).endswith(F.concat(F.lit("."), r["host"])))))
    spark = df.sparkSession
    table = rules if isinstance(rules, DataFrame) else spark.createDataFrame(list(rules), "action string, host string, path string")
    hosts = df.select(F.col(host).alias("_host")).distinct().withColumn("_suffix", F.explode(_suffixes(F.col("_host"))))
    by_host = hosts.join(table.select("action", F.col("host").alias("_suffix"), "path"), "_suffix").groupBy("_host").agg(F.collect_set(F.struct("action", F.col("_suffix").alias("host"), "path")).alias("_found"))
    joined = df.join(by_host, F.col(host) == F.col("_host"), "left").drop("_host")
    return pick(joined)


def page_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """src, dst: keys of pages and of what their canonical links and refresh headers name."""
    html, url = F.col("_html"), F.col("_url")
    attribute = lambda tag, name: F.regexp_extract(tag, rf"(?i)\b{name}\s*=\s*[\"']?([^\"'>\s]+)", 1)
    canonical = F.transform(F.filter(F.regexp_extract_all(html, F.lit(r"(?i)<link\b[^>]*>"), F.lit(0)), lambda t: F.lower(attribute(t, "rel")) == "canonical"), lambda t: attribute(t, "href"))
    refresh = F.transform(F.filter(F.regexp_extract_all(html, F.lit(r"(?i)<meta\b[^>]*>"), F.lit(0)), lambda t: F.lower(attribute(t, "http-equiv")) == "refresh"), lambda t: F.regexp_extract(t, r"(?i)url\s*=\s*[\"']?([^\"'>\s;]+)", 1))
    target = F.col("_target")
    base = F.concat(F.lit("x://"), host_of(url))
    whole = F.when(F.instr(target, "://") > 0, target).when(target.startswith("//"), F.concat(F.lit("x:"), target)).when(target.startswith("/"), F.concat(base, target)).otherwise(F.concat(base, F.coalesce(F.nullif(F.regexp_extract(path_of(url), "^(.*/)", 1), F.lit("")), F.lit("/")), target))
    rows = pages.select(F.col(url_col).cast("string").alias("_url"), F.col(html_col).cast("string").alias("_html"))
    rows = rows.filter(html.rlike("(?i)canonical|http-equiv")).select("_url", F.explode(F.concat(canonical, refresh)).alias("_target")).filter(target != "")
    return rows.select(url_key(url).alias("src"), url_key(whole).alias("dst")).filter("src <> dst").distinct()


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] | DataFrame = RULES, redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page row: the id, host, path, rule (null if none fits), verdict, component (least key of its aliases, or null).

    redirects: further edges, from_url and to_url.
    """
    edges = page_links(pages, url_col, html_col)
    if redirects is not None:
        edges = edges.union(redirects.select(url_key(F.col("from_url")).alias("src"), url_key(F.col("to_url")).alias("dst")).filter("src <> dst"))
    nodes = connected_components(edges, "src", "dst")
    named = nodes.withColumn("_url", F.concat(F.lit("x://"), F.col("node")))
    ruled = match_rules(named.select("node", "component", host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path")), rules)
    whole = ruled.groupBy("component").agg(F.max((F.col("action") == "allow").cast("int")).alias("allowed"), F.max((F.col("action") == "block").cast("int")).alias("blocked"))
    decided = nodes.join(whole, "component").select("node", "component", F.when(F.coalesce("allowed", F.lit(0)) == 1, "allow").when(F.coalesce("blocked", F.lit(0)) == 1, "block").alias("carried"))
    url = F.col(url_col).cast("string")
    own = pages.select(F.col(id_col), host_of(url).alias("host"), path_of(url).alias("path"), url_key(url).alias("node"))
    judged = match_rules(own, rules).join(decided, "node", "left")
    return judged.select(id_col, "host", "path", "rule", F.coalesce("action", "carried", F.lit("allow")).alias("verdict"), "component")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("component")


_SQL_HOST = "coalesce(translate(regexp_extract({rest}, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '')"
_SQL_RULES = ", ".join(f"('{a}', '{h}', '{p}')" for a, h, p in RULES)
SQL = f"""
WITH RECURSIVE rules(action, host, path) AS (VALUES {_SQL_RULES}),
rest AS (SELECT page_id, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, html, {_SQL_HOST.format(rest="rest")} AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path, regexp_extract(rest, '^[^/?#]*([^#]*)', 1) AS tail FROM rest),
k AS (SELECT page_id, html, host, path, CASE WHEN host <> '' THEN regexp_replace(host || tail, '^([^/?]*)/?$', '\\1/') END AS node FROM p),
tags AS (SELECT node, host, unnest(regexp_extract_all(html, '(?i)<link\\b[^>]*>')) AS tag FROM k WHERE node IS NOT NULL),
links AS (SELECT node AS src, regexp_extract(tag, '(?i)\\bhref\\s*=\\s*["'']?([^"''>\\s]+)', 1) AS href FROM tags WHERE lower(regexp_extract(tag, '(?i)\\brel\\s*=\\s*["'']?([^"''>\\s]+)', 1)) = 'canonical'),
goal AS (SELECT src, substr(href, strpos(href, '://') + 3) AS rest FROM links WHERE strpos(href, '://') > 0),
edges AS (SELECT src AS u, regexp_replace({_SQL_HOST.format(rest="rest")} || regexp_extract(rest, '^[^/?#]*([^#]*)', 1), '^([^/?]*)/?$', '\\1/') AS v FROM goal),
sym AS (SELECT u, v FROM edges WHERE u <> v UNION SELECT v, u FROM edges WHERE u <> v),
reach(a, b) AS (SELECT u, u FROM sym UNION SELECT r.a, s.v FROM reach r JOIN sym s ON r.b = s.u),
act AS (SELECT n.node, r.action, row_number() OVER (PARTITION BY n.node ORDER BY length(r.host) + length(r.path) DESC, length(r.host) DESC, r.action) AS k
  FROM (SELECT DISTINCT b AS node, split_part(split_part(b, '/', 1), '?', 1) AS host, regexp_extract(b, '^[^/?#]*([^?#]*)', 1) AS path FROM reach) n
  JOIN rules r ON (n.host = r.host OR ends_with(n.host, '.' || r.host)) AND starts_with(n.path, r.path)),
carried AS (SELECT r.a AS node, max(CASE WHEN c.action = 'allow' THEN 2 WHEN c.action = 'block' THEN 1 END) AS c FROM reach r LEFT JOIN act c ON c.node = r.b AND c.k = 1 GROUP BY r.a),
best AS (SELECT k.page_id, k.host, k.path, k.node, r.host || r.path AS rule, r.action,
    row_number() OVER (PARTITION BY k.page_id ORDER BY length(r.host) + length(r.path) DESC NULLS LAST, length(r.host) DESC NULLS LAST, r.action) AS n
  FROM k LEFT JOIN rules r ON (k.host = r.host OR ends_with(k.host, '.' || r.host)) AND starts_with(k.path, r.path))
SELECT b.page_id, b.host, b.path, b.rule, coalesce(b.action, CASE c.c WHEN 2 THEN 'allow' WHEN 1 THEN 'block' END, 'allow') AS verdict
FROM best b LEFT JOIN carried c ON c.node = b.node WHERE b.n = 1
"""
