"""Vector search, URL decisions, components, the pipeline and the registered SQL."""

import random
import re

import duckdb
import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from ampliqua.llm import components, pii, puquality, queries, urlblock, vafile
from tests.conftest import SF


def test_exact_search_against_brute_force(spark):
    rng = np.random.default_rng(2)
    v = [rng.normal(0, 0.2, 12).astype(np.float32).tolist() for _ in range(400)]
    v[7], v[8], v[9], v[10], v[11] = None, [None] * 12, [float("nan")] * 12, [float("inf")] * 12, v[3]
    rows = [(k, x, 0, "clash") for k, x in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, score string").repartition(3)
    got = [tuple(r) for r in vafile.top_k(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()]
    ok = {k: np.floor(256 * np.asarray(x, np.float32).astype(float)) for k, x in enumerate(v) if k not in (7, 8, 9, 10)}
    want = []
    for q in range(0, 400, 50):
        best = sorted((-int(ok[q] @ x), k) for k, x in ok.items() if k != q)[:5]
        want += [(q, r, k, -s) for r, (s, k) in enumerate(best, 1)]
    assert got == want
    assert vafile.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    few = spark.createDataFrame([(0, [1e30, 1.0]), (1, [1e30]), (50, [])], "vec_id long, embedding array<double>")
    assert vafile.top_k(few, F.col("vec_id") % 50 == 0).count() == 4


def test_exact_search_with_repeated_query_rows(spark):
    others = [(k, [float(x)]) for k, x in enumerate((9, 8, 7, 6, 5, 4, 3, 2, 1), 1)]
    for times in (1, 3, 8):
        df = spark.createDataFrame([(0, [10.0])] * times + others, "vec_id long, embedding array<double>").coalesce(1)
        got = sorted(tuple(r) for r in vafile.top_k(df, F.col("vec_id") == 0, scale=1.0).collect())
        assert got == sorted((0, k, k, 10 * (10 - k)) for k in range(1, 6) for _ in range(times))


def test_exact_search_with_common_vectors_and_small_waves(spark):
    rng = np.random.default_rng(12)
    v = [rng.integers(-3, 4, 4).astype(float).tolist() for _ in range(900)]
    v = [[2.0, 1.0, 0.0, 1.0] if k % 3 == 0 else x for k, x in enumerate(v)]  # a third of all rows are equal
    ids = [None if k % 97 == 5 else k if k % 11 else 300 for k in range(900)]  # no id, and an id of many rows
    df = spark.createDataFrame(list(zip(ids, v, strict=True)), "vec_id long, embedding array<double>").repartition(4)
    got = sorted(tuple(r) for r in vafile.top_k(df, F.col("vec_id") % 50 == 0, scale=1.0, wave=16).collect())
    rows = [(i, np.array(x).astype(int)) for i, x in zip(ids, v, strict=True) if i is not None]
    want = []
    for i, x in rows:
        if i % 50 == 0:
            best = sorted((-int(x @ y), j) for j, y in rows if j != i)[:5]
            want += [(i, n, j, -s) for n, (s, j) in enumerate(best, 1)]
    assert got == sorted(want)


def test_exact_vectors_are_read_in_the_order_of_their_bounds():
    rng = np.random.default_rng(13)
    exact = rng.integers(-500, 500, (3000, 8))
    block = {"block": 7, "n": 3, "dim": 8, "ids": [0, 1, 2], "exact": exact[:3].astype(np.int64).tobytes()}
    wave = vafile.Wave([block])
    rows = np.tile(np.arange(3000), 3)
    queries = np.repeat(np.arange(3), 3000)
    upper = (exact[:3] @ exact.T).ravel() + rng.random(9000) * 1000
    found, read = vafile.best_of_block(wave, queries, rows, upper, list(range(3000)), exact, 5)
    for q in range(3):
        best = sorted((-int(exact[q] @ exact[r]), r) for r in range(3000))[:5]
        assert [(-s, i) for n, s, i in found if n == q] == best
    assert read < 1000  # of 9000


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 460)] + [(500, k) for k in range(501, 560)] + [(7, 7)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: root(x) for x in linked}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_url_decisions(spark):
    link = lambda href: f"<html><link href='{href}' rel=canonical></html>"
    pages = [
        (1, "http://a.bad.net/x", None),
        (2, "https://alias.com/y", link("http://a.bad.net/x")),
        (3, "https://third.com/z?q=1#f", '<meta http-equiv="refresh" content="0; url=https://alias.com/y">'),
        (4, "http://www.example.net/en/page", link("http://a.bad.net/x")),
        (5, "no scheme", "x"),
        (6, None, None),
        (7, "http://EXAMPLE.com/de/a?b", ""),
        (8, "http://x.org/fr/", ""),
        (9, "http://lonely.com", ""),
        (10, "http://m.com/a/b", link("/c")),
        (11, "http://m.com/c", ""),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("rule", F.lit("clash"))
    got = {r["page_id"]: r for r in urlblock.judge_urls(df).collect()}
    assert [got[k]["verdict"] for k in range(1, 12)] == ["block", "allow", "allow", "allow", "allow", "allow", "block", "allow", "allow", "allow", "allow"]
    assert got[4]["rule"] == "example.net/en/" and got[7]["rule"] == "example.com/de/" and got[1]["rule"] == "net/"
    assert (got[5]["host"], got[5]["path"], got[6]["host"]) == ("", "", "") and got[7]["host"] == "example.com"
    assert got[10]["component"] == got[11]["component"] is not None
    no_allow = {r["page_id"]: r["verdict"] for r in urlblock.judge_urls(df.filter("page_id <> 4")).collect()}
    assert no_allow[2] == no_allow[3] == "block"  # carried over canonical link and redirect
    many = [("block", f"h{k}.com", "/") for k in range(600)] + urlblock.RULES
    assert {r["page_id"]: r["verdict"] for r in urlblock.judge_urls(df, many).collect()} == {k: r["verdict"] for k, r in got.items()}
    assert urlblock.judge_urls(df.limit(0)).count() == 0


def test_registered_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    for name, sql in queries.SQL.items():
        got, want = queries.QUERIES[name](spark, SF).toPandas(), con.execute(sql).df()
        cols = sorted(got.columns)
        assert cols == sorted(want.columns), name
        rows = lambda x: sorted(map(repr, x[cols].astype(object).where(x[cols].notna(), None).itertuples(index=False, name=None)))  # noqa: B023, E731
        assert rows(got) == rows(want), name


def kept_by_brute_force(texts, ids, percent=80):
    """Rows that stay: of each group of texts linked by five-word shingles the one with the least id, ids before none."""
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    holders = {}
    for k, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(k)
    component = list(range(len(sets)))

    def root(x):
        while component[x] != x:
            x = component[x]
        return x

    for k, s in enumerate(sets):
        for j in {j for x in s for j in holders[x] if j < k}:
            if 100 * len(s & sets[j]) >= percent * len(s | sets[j]):
                x, y = sorted((root(j), root(k)))
                component[y] = x
    best = {}
    for k in range(len(sets)):
        best[root(k)] = min(best.get(root(k), (True, 0, k)), (ids[k] is None, ids[k] or 0, k)) if root(k) in best else (ids[k] is None, ids[k] or 0, k)
    return {v[2] for v in best.values()}


def test_pipeline_against_brute_force(spark):
    import corpus_pipeline as c
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: (r["n_tokens"], list(r["ids"]), r["decoded"]) for r in c.run(spark, SF).collect()}
    judged = {r["doc_id"]: r["predicted"] for r in puquality.classify(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    rows = [(r["doc_id"], r["text"]) for r in docs.orderBy("doc_id").collect() if judged[r["doc_id"]]]
    stay = kept_by_brute_force([t for _, t in rows], [i for i, _ in rows])
    rows = [rows[k] for k in sorted(stay)]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({k: k + 32 for k in range(65, 91)}))
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r["text"])
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(x) for x in windows}
    rows = [(i, t) for i, t in rows if not any(tuple(w[k : k + n]) in windows for w in [words(t)] for n in sizes for k in range(len(w) - n + 1))]
    field = pii.fit(pii.configurations([t or "" for _, t in rows]))
    texts = [pii.masked(t or "", base + more) for (_, t), (base, more) in zip(rows, pii.label([t or "" for _, t in rows], field), strict=True)]
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for (i, _), t in zip(rows, texts, strict=True):
        ids = lib.encode(t, add_special_tokens=False).ids
        want[i] = (len(ids), ids, lib.decode(ids, skip_special_tokens=False))
    assert got == want and 0 < len(got) < docs.count()


def test_pipeline_of_odd_rows(spark, tmp_path):
    import corpus_pipeline as c

    long = " ".join(f"word{k}" for k in range(60))
    near = " ".join(["other", *(f"word{k}" for k in range(1, 60))])
    hit = spark.read.parquet(f"{SF}/benchmark.parquet").filter("size(split(text, ' ')) > 12").first()["text"]
    rows = [(None, long), (None, long), (9, long), (5, near), (5, "a text of its own"), (5, "a text of its own"), (None, "alone"), (None, hit), (3, hit), (7, None), (8, ""), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "extra", k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, score string, kept int")
    left = c.near_dedup(spark, docs, SF)
    assert left.columns == docs.columns
    assert sorted(r["kept"] for r in left.collect() if r["kept"] not in (4, 5)) == [3, 6, 8, 9, 10, 11] and left.filter("kept in (4, 5)").count() == 1
    left = c.decontaminate(spark, docs, SF)
    assert sorted(r["kept"] for r in left.collect()) == [k for k in range(12) if k not in (7, 8)] and left.columns == docs.columns
    left = c.quality(spark, docs, SF)
    judged = {r["row"]: r["predicted"] for r in puquality.classify(docs, spark.read.parquet(f"{SF}/labels.parquet"), row_col="kept").collect()}
    assert sorted(r["kept"] for r in left.collect()) == sorted(k for k, v in judged.items() if v)
    masked = {r["kept"]: r for r in c.mask_pii(spark, docs, SF).collect()}
    assert masked[7]["text"] == hit and masked[9]["text"] is None and masked[9]["n_chars"] is None and len(masked) == 12
    empty = f"{tmp_path}/empty"
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{empty}/{t}.parquet")
    assert c.run(spark, empty).count() == 0


def test_near_dedup_stage_against_brute_force(spark):
    import corpus_pipeline as c

    rng = random.Random(5)
    texts = []
    for n, edits in [(100, 2)] * 8 + [(49, 1)] * 8 + [(100, 3)] * 4 + [(100, 1)] * 4:  # similarities 0.81, 0.80, 0.73, 0.90
        base = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        texts.append(base)
        for _ in range(3):
            copy = list(base)
            for k in range(edits):
                copy[10 + 20 * k + rng.randrange(5)] = f"x{rng.randrange(10**6)}"
            texts.append(copy)
    chain = [f"y{k}" for k in range(100)]
    for k in range(5):  # a group that hangs together by links at 0.81 alone
        chain = list(chain)
        chain[10 + 16 * k] = chain[18 + 16 * k] = f"z{k}"
        texts.append(chain)
    rng.shuffle(texts)
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in texts]
    share = [(len(sets[a] & sets[b]), len(sets[a] | sets[b]), a, b) for a in range(len(sets)) for b in range(a)]
    assert sum(80 * e <= 100 * n < 85 * e for n, e, _, _ in share) > 40
    component = list(range(len(sets)))
    for n, e, a, b in share:
        if 100 * n >= 80 * e:
            x, y = sorted((component[a], component[b]))
            component = [x if k == y else k for k in component]
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = sorted(r["doc_id"] for r in c.near_dedup(spark, docs, SF).collect())
    assert got == sorted(set(component))
