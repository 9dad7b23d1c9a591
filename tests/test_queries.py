"""Every registered query against its SQL, on the smallest tables."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from ampliqua.plans import maps, records, runs  # noqa: F401  registers its queries
from ampliqua.plans.queries import ORACLE, QUERIES
from tests.conftest import SF


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return c


def plain(df):
    cols = sorted(df.columns)
    value = lambda v: None if v is None or v is pd.NA or v != v else v
    return cols, sorted(repr(tuple(map(value, r))) for r in df[cols].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in ORACLE:
        assert plain(got) == plain(con.execute(ORACLE[name]).df())
    else:
        assert len(got)


def test_merge_minor_against_brute_force(spark, con):
    rows = con.execute("SELECT o_custkey, o_orderpriority, max(o_totalprice) FROM orders GROUP BY 1, 2").fetchall()
    score = {}
    for read, allele, value in rows:
        score.setdefault(read, {})[allele] = value

    def counts(reads):
        out = {}
        for r in reads:
            left = [(-v, a) for a, v in score[r].items() if v is not None]
            if left:
                out[min(left)[1]] = out.get(min(left)[1], 0) + 1
        return out

    best = {r: min((-v, a) for a, v in s.items())[1] for r, s in score.items()}
    n = counts(score)
    limit = int(sum(n.values()) / len(n))
    few = sorted((a for a in n if n[a] < limit), key=lambda a: (n[a], a))
    top = min(n, key=lambda a: (-n[a], a))
    rest, raised = [r for r in score if best[r] in few], set()
    for allele in few:
        if allele in raised:
            continue
        for r in rest:
            left = [(-v, a) for a, v in score[r].items() if v is not None]
            if left and min(left)[1] == allele:
                score[r][allele] = None
        lost = sum(all(v is None for v in score[r].values()) for r in rest)
        now = counts(rest)
        # a read without any allele left still counts for its first one until the end
        for r in rest:
            if all(v is None for v in score[r].values()):
                now[min(score[r])] = now.get(min(score[r]), 0) + 1
        raised |= {a for a, k in now.items() if k >= limit}
        assert lost <= len(rest)
    want = counts(score)
    want[top] = want.get(top, 0) + sum(all(v is None for v in s.values()) for s in score.values())
    assert few and {r["allele"]: r["n"] for r in QUERIES["q_merge_minor"](spark, SF).collect()} == want


def test_line_clusters_against_brute_force(spark, con):
    x = np.array(con.execute("SELECT l_quantity, 10.0 * l_linenumber FROM lineitem").fetchall(), float)

    def split(rows):
        centres = [max((((v - rows.mean(0)) ** 2).sum(), *v) for v in rows)[1:]]
        centres = np.array([centres[0], max((((v - np.array(centres[0])) ** 2).sum(), *v) for v in rows)[1:]])
        for _ in range(20):
            side = ((rows - centres[1]) ** 2).sum(1) < ((rows - centres[0]) ** 2).sum(1)
            centres = np.array([rows[~side].mean(0), rows[side].mean(0)])
        return ((rows - centres[1]) ** 2).sum(1) < ((rows - centres[0]) ** 2).sum(1)

    def score(labels):
        total = 0.0
        for v, own in zip(x, labels, strict=True):
            d = ((x - v) ** 2).sum(1)
            a = d[labels == own].sum() / ((labels == own).sum() - 1)
            b = min(d[labels == k].mean() for k in set(labels) - {own})
            total += (b - a) / max(a, b)
        return total / len(x)

    labels, best = np.zeros(len(x), int), -np.inf
    for k in range(1, 50):
        j = max(range(k), key=lambda c: ((x[labels == c] - x[labels == c].mean(0)) ** 2).sum())
        rows, new = np.flatnonzero(labels == j), labels.copy()
        new[rows[split(x[rows])]] = k
        now = score(new)
        if now <= best:
            break
        labels, best = new, now
    want = {}
    for v, k in zip(x, labels, strict=True):
        want.setdefault((*v, k), []).append(1)
    got = {(r["quantity"], r["number"], r["label"]): r["n"] for r in QUERIES["q_line_clusters"](spark, SF).collect()}
    assert got == {v: len(n) for v, n in want.items()} and labels.max() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
