"""The queries of this subpackage, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ampliqua.llm import bpe, chat, decontam, errata, lbl, licenses, pii, puquality, ranked, setsketch, tokenstore, urlblock, vafile
from ampliqua.llm.common import table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenstore.store_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_pii_skip_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op4_va_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vafile.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op7_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return puquality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lbl.score(table(spark, sf_dir, "documents"))


def op11_errata_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return errata.variants(table(spark, sf_dir, "documents"))


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.query(table(spark, sf_dir, "conversations"), public_tokenizers.path("byte_bpe_50k.json"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_token_store": op2_token_store,
    "op3_pii_skip_chain": op3_pii_skip_chain,
    "op4_va_file": op4_va_file,
    "op5_bpe_trie": op5_bpe_trie,
    "op6_setsketch": op6_setsketch,
    "op7_pu_quality": op7_pu_quality,
    "op8_log_bilinear": op8_log_bilinear,
    "op9_license_scan": licenses.query,
    "op10_url_filter": urlblock.query,
    "op11_errata_trie": op11_errata_trie,
    "op12_chat_format": op12_chat_format,
    "op13_ranked_search": op13_ranked_search,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_SQL_DECONTAMINATE = rf"""
WITH i AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[k:k + least(10, len(w)) - 1], ' ') AS s FROM i, LATERAL (SELECT unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k) WHERE len(w) > 0),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
spots AS (SELECT r, n, k, array_to_string(w[k:k + n - 1], ' ') AS s FROM d, (SELECT DISTINCT n FROM windows), LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS k) WHERE len(w) >= n),
m AS (SELECT r, item, n, k FROM spots JOIN windows USING (n, s)),
hit AS (SELECT r, count(DISTINCT k + o) AS n_hit FROM m, LATERAL (SELECT unnest(range(0, n)) AS o) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT r, item FROM m) GROUP BY r),
places AS (SELECT r, unnest(w) AS term, unnest(range(len(w))) AS p FROM d),
rarity AS (SELECT term, count(*) AS c FROM places GROUP BY term),
different AS (SELECT row_number() OVER () AS id, n, string_split(s, ' ') AS t FROM (SELECT DISTINCT n, s FROM windows)),
rarest AS (SELECT id, term, o FROM (SELECT id, term, o, row_number() OVER (PARTITION BY id ORDER BY coalesce(c, 0), o) AS k FROM (SELECT id, unnest(t) AS term, unnest(range(n)) AS o FROM different) LEFT JOIN rarity USING (term)) WHERE k = 1),
starts AS (SELECT id, r, p - o AS b FROM rarest JOIN places USING (term)),
near AS (SELECT r, count(*) AS n_near FROM starts JOIN different USING (id) JOIN d USING (r)
  WHERE len(list_filter(range(n), lambda k: list_contains(w[greatest(1, b + k - 1):greatest(0, b + k + 3)], t[k + 1]))) = n GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r) LEFT JOIN near USING (r)
"""

_SQL_NEAR_DUPLICATES = rf"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array({_LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + least(5, len(w)) - 1], ' ') AS s FROM d, LATERAL (SELECT unnest(range(1, len(w) - least(5, len(w)) + 2)) AS k) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
sym AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(a, b) AS (SELECT a, b FROM sym UNION SELECT r.a, s.b FROM reach r JOIN sym s ON r.b = s.a)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(least(doc_id, m.least), doc_id) AS component_id, doc_id <= coalesce(m.least, doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS least FROM reach GROUP BY a) m USING (doc_id)
"""

SQL: dict[str, str] = {
    "op1_decontaminate": _SQL_DECONTAMINATE,
    "op6_setsketch": _SQL_NEAR_DUPLICATES,
    "op4_va_file": vafile.SQL,
    "op9_license_scan": licenses.SQL,
    "op10_url_filter": urlblock.SQL,
    "op12_chat_format": chat.SQL,
    "op13_ranked_search": ranked.SQL,
}
