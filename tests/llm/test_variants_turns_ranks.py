"""Spelling variants, conversations as ids and ranked search against brute force, with nulls, repeats, long and empty texts."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from ampliqua.llm import chat, errata, lbl, licenses, ranked
from tests.conftest import SF

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(rows, least=7, least_count=2, ratio=10, damage=31):
    n = {}
    for doc_id, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'null' if doc_id is None else doc_id}:{w}".encode())
            if h % damage == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] = n.get(w, 0) + 1
    n = {w: c for w, c in n.items() if len(w) >= least and c >= least_count}
    near = {w: [] for w in n}
    for a, b in itertools.combinations(n, 2):
        if abs(len(a) - len(b)) < 2 and one_edit(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {w: min(x, key=lambda v: (-n[v], v)) if x else None for w, x in near.items()}
    form = {w: f if f and n[f] >= ratio * n[w] else None for w, f in form.items()}
    out = set()
    for w in n:
        end = w
        while form[end]:
            end = form[end]
        out.add((w, form[w], end, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def variant_docs(rng, n):
    letters = "abcéÿ×"
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(7, 9))) for _ in range(25)]
    words += ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "aaaaaaab", "baaaaaaa", "abababab", "bababab", "ababababa", "éaaaaaaa"]
    out = []
    for k in range(n):
        mine = []
        for _ in range(rng.randint(0, 60)):
            w = rng.choice(words[:6] if rng.random() < 0.6 else words)
            for _ in range(rng.choice((0, 0, 0, 1, 1, 2))):
                at = rng.randrange(len(w))
                w = rng.choice((w[:at] + w[at + 1 :], w[:at] + rng.choice(letters) + w[at:], w[:at] + rng.choice(letters) + w[at + 1 :]))
            mine.append(w.upper() if rng.random() < 0.2 else w)
        out.append((k, rng.choice((" ", "-", "1", "\n")).join(mine)))
    out.append((500, "cabbageé " * 300 + "cabbageéé " * 20 + "cabageéé " * 2))  # a chain of forms
    return [*out, (None, out[3][1]), (None, None), (7, out[7][1]), (8, ""), (9, "x" * 50_000 + " " + "ab" * 40)]


@pytest.mark.parametrize("part_words", [10_000, 40, 3])
def test_spelling_variants_against_brute_force(spark, part_words):
    rows = variant_docs(random.Random(part_words), 60)
    want = brute_variants(rows)
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, word string, n int").repartition(3)
    got = [tuple(r) for r in errata.variants(df, part_words=part_words).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(got) == len(want) and set(got) == want
    assert sum(f is not None for _, f, *_ in want) > 20 and any(f and f != r for _, f, r, *_ in want)


def test_each_pair_of_the_trie_comes_up_once():
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in range(300)})
    meet, found = {}, []
    for text, k, kind in errata.terminals(words, {}, 1):
        if kind == errata.LOOK and text in words:
            found.append(frozenset((text, words[k])))
        elif kind == errata.MEET:
            meet.setdefault(text, []).append(words[k])
    found += [frozenset(p) for x in meet.values() for p in itertools.combinations(x, 2)]
    want = {frozenset(p) for p in itertools.combinations(words, 2) if one_edit(*p)}
    assert len(found) == len(want) and set(found) == want
    edges = [k for k, *_ in errata.light_edges(words, {})]
    assert max(map(edges.count, set(edges))) <= 1 + math.log2(len(words))


def test_variants_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert errata.variants(df).count() == 0
    assert errata.variants(spark.createDataFrame([(1, "few words"), (2, None)], "doc_id long, text string")).count() == 0


def test_root_of_a_long_chain(spark):
    forms = spark.createDataFrame([(f"w{k}", f"w{k + 1}") for k in range(13)], "word string, form string")
    assert {tuple(r) for r in errata.roots(forms).collect()} == {(f"w{k}", "w13") for k in range(13)}


TURNS = [
    (1, 0, "system", "Be <s> brief </s>."),
    (1, 1, "user", "What is \\[INST] and <\\/s>, or [\\\\/INST]?"),
    (1, 2, "assistant", "A mark: [INST] [/INST] <|endoftext|> <\\|endoftext|> \0 日本 é x"),
    (1, 3, "user", None),
    (1, 3, "user", None),
    (1, 4, "assistant", ""),
    (2, None, "assistant", "first"),
    (2, 0, None, "[ROLE]tool[/ROLE]"),
    (2, 1, "[/ROLE]", "odd role"),
    (2, 1, "USER", "other role"),
    (3, 0, "user", "long " * 40_000),
    (None, 0, "user", "no id"),
    (None, 1, "assistant", "</s>[INST] ok [/INST]"),
    *((4, k, ("user", "assistant")[k % 2], f"turn {k} <s>") for k in range(200)),
]


def brute_digest(rows):
    out = {}
    for c in {r[0] for r in rows}:
        mine = sorted(((t is not None, t or 0), r or "", x or "") for i, t, r, x in rows if i == c)
        loss = "".join(x for _, r, x in mine if r == "assistant")
        marks = sum(20 if r == "user" else 7 if r == "assistant" else 20 + len(r) for _, r, _ in mine)
        mark = re.compile(r"<\\*/?s>|<\\*\|endoftext\|>|\[\\*/?(?:INST|ROLE)\]")
        escapes = sum(len(mark.findall(x)) + (len(mark.findall(r)) if r not in ("user", "assistant") else 0) for _, r, x in mine)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[c] = (len(mine), sha("".join(f"{r}\n{x}\n" for _, r, x in mine)), len(loss), sha(loss), marks + escapes + sum(len(x) for *_, x in mine))
    return out


def test_conversations_round_trip(spark):
    df = spark.createDataFrame([(*t, "clash", 5) for t in TURNS], "conv_id long, turn long, role string, text string, ids string, first int").repartition(4)
    got = {r[0]: tuple(r)[1:] for r in chat.query(df, TOKENIZER).collect()}
    assert got == brute_digest([*TURNS, *chat.TRICKY])


def test_a_conversation_over_many_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(chat, "PART_ROWS", 20)
    df = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")
    path = str(tmp_path / "chat")
    chat.write(df, TOKENIZER, path)
    rows = [r for r in chat.read_rows(spark, path).orderBy("part", "k").collect() if r["conv_id"] == 4]
    assert len({r["part"] for r in rows}) > 3
    at = 0
    for r in rows:
        assert r["start"] == at
        at += len(r["ids"]) // 4
    turns = chat.read_turns(spark, path, TOKENIZER)
    assert {r[0]: tuple(r)[1:] for r in chat.digest(turns, df.schema["conv_id"].dataType).collect()} == brute_digest(TURNS)


def test_marks_in_texts_never_become_marks():
    t, first = chat.template_of(open(TOKENIZER, encoding="utf-8").read())
    assert first == 50257 and "<|endoftext|>" in t.foreign
    rng = random.Random(3)
    pieces = [*t.marks, *t.foreign, "\\", "<", "[", "s>", "/s>", "INST]", "a"]
    for _ in range(2000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 8)))
        safe = t.escape(text)
        assert t.unescape(safe) == text and not any(m in safe for m in (*t.marks, *t.foreign))
        assert [x for x in re.split("(" + "|".join(map(re.escape, t.marks)) + ")", "<s>" + safe + "</s>") if x] == [x for x in ("<s>", safe, "</s>") if x]
    with pytest.raises(ValueError):
        chat.Template(marks=("<s>", "<<s>"))


def test_masks_are_prefix_sums():
    pool, at = np.arange(100, 120, dtype="<u4"), np.array([0, 1, 2, 5, 5, 20])
    ids, mask, stops = chat.assembled([[0, 2, 1], [0, 3, 1], [4]], pool, at, [1, 4, -1])
    assert ids.tolist() == [100, 102, 103, 104, 101, 100, 101, *range(105, 120)] and stops.tolist() == [5, 7, 22]
    assert np.flatnonzero(mask).tolist() == [1, 2, 3]


def test_no_conversations(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert [r["conv_id"] for r in chat.query(df, TOKENIZER).collect()] == [-7]


def brute_ranks(docs, items, k=10, repeats=False):
    terms = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    rows = [(i, terms(t)) for i, t in docs]
    rows = [(i, t) for i, t in rows if t]
    n_docs, total = len(rows), sum(len(t) for _, t in rows)
    df = {}
    for _, t in rows:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    out = []
    for item, text in items:
        own, scores = terms(text), []
        for i, t in rows:
            m = 10 + 90 * len(t) * n_docs // total
            s = sum((own.count(w) if repeats else 1) * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * t.count(w) // (1000 * t.count(w) + 8 * m)) for w in set(own) if w in df)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, r, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def rank_rows():
    rng = random.Random(11)
    words = ["the", "of", "Été", "日本", "x1", "rare", *(f"w{k}" for k in range(40))]
    text = lambda n: rng.choice((" ", ", ", "\n")).join(rng.choice(words[: rng.randint(3, len(words))]) for _ in range(n))
    docs = [(k, text(rng.randint(0, 30))) for k in range(300)]
    docs += [(1000 + k, "the of copies") for k in range(80)] + [(5, "the of copies"), (None, "the of copies"), (None, "rare rare"), (2000, None), (2001, " .. "), (2002, "the of w1 " * 30_000)]
    items = [(k, text(rng.randint(1, 12))) for k in range(12)] + [(3, "copies of the copies"), (3, "copies of the copies"), (None, "rare THE"), (40, None), (41, "--"), (42, "unknown")]
    return docs, items


@pytest.mark.parametrize("repeats", [False, True])
def test_ranked_search_against_brute_force(spark, monkeypatch, repeats):
    docs, items = rank_rows()
    monkeypatch.setattr(ranked, "SEGMENT_TERMS", 200)
    left = spark.createDataFrame([(*d, 1, "clash") for d in docs], "doc_id long, text string, score int, item_id string").repartition(5)
    right = spark.createDataFrame(items, "item_id long, text string")
    for block in (1 << 20, 60):
        got = [tuple(r) for r in ranked.search(left, right, repeats=repeats, block_bytes=block).collect()]
        assert sorted(got, key=repr) == brute_ranks(docs, items, repeats=repeats)


def test_ranked_search_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert ranked.search(empty, items).count() == 0
    assert ranked.search(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), items.limit(0)).count() == 0
    names = spark.createDataFrame([("k", "a b"), ("j", "a b c")], "doc_id string, text string")
    assert [tuple(r)[:3] for r in ranked.search(names, items.unionAll(spark.createDataFrame([(2, "c")], items.schema)), k=1).orderBy("item_id").collect()] == [(1, 1, "k"), (2, 1, "j")]


def test_counts_of_a_text_in_parts(monkeypatch):
    data = ("Alpha beta, ALPHA\ngamma " * 500).encode()
    whole = ranked.counted(data)
    monkeypatch.setattr(ranked, "PART_BYTES", 100)
    parts = ranked.counted(data)
    assert whole[2] == parts[2] == 2000 and all((a == b).all() for a, b in zip(whole[:2], parts[:2], strict=True))


def test_search_is_deterministic_in_the_layout(spark):
    docs, items = rank_rows()
    left, right = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = [sorted((tuple(r) for r in ranked.search(left.repartition(n), right).collect()), key=repr) for n in (1, 7)]
    assert got[0] == got[1] and left.filter(F.col("doc_id").isNull()).count() == 2


def test_language_model_scores_do_not_depend_on_the_layout(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    table = table.unionAll(table.filter("doc_id < 20")).unionAll(spark.createDataFrame([(None, "no id"), (9, None), (9, "")], table.schema))
    key = lambda r: repr((r["doc_id"], r["n_tokens"], r["base_score"]))
    got = [sorted(((key(r), r["score"]) for r in lbl.score(table.repartition(n)).select("doc_id", "n_tokens", F.round("base_score", 6).alias("base_score"), "score").collect())) for n in (1, 4, 16)]
    for other in got[1:]:
        assert [k for k, _ in other] == [k for k, _ in got[0]]
        assert max(abs(a - b) for (_, a), (_, b) in zip(got[0], other, strict=True)) < 1e-6


def test_language_model_of_many_shards(spark):
    rows = [(k, f"a{k % 7} b c{k % 3} d") for k in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, _text string").withColumn("held_out", F.col("doc_id") % 5 == 1)
    words = lbl.count_words(d)
    hot = lbl.hot_words(words)
    tokens = lbl._tokens(d, hot, lbl.choose_classes(words, hot, 960, 12, 240))
    made = [lbl.train_model(tokens.repartition(n), lbl.Model(np.arange(1.0, 15.0)), 1200, shard_tokens=100, block_tokens=64).pack() for n in (1, 5)]
    assert made[0] == made[1] != lbl.Model(np.arange(1.0, 15.0)).pack()


BSD_LIST = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice,
   this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
GPL_ONLY = """ * This program is free software; you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation; version 2 of the License.
"""
LGPL3 = """This library is free software: you can redistribute it and/or modify it under the terms
of the GNU Lesser General Public License as published by the Free Software Foundation,
either version 3 of the License, or (at your option) any later version.
"""
LICENCE_CASES = {
    BSD_LIST: "BSD-2-Clause",
    BSD_LIST + "3. Neither the name of the copyright holder nor the names of its contributors may be\n   used to endorse or promote products derived from this software without specific prior written permission.\n": "BSD-3-Clause,BSD-2-Clause",
    BSD_LIST.replace("1.", "a)").replace("2.", "b)"): "BSD-2-Clause",
    GPL_ONLY: "GPL-2.0",
    LGPL3: "LGPL-3.0",
    "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n\n   1. Definitions.\n": "Apache-2.0",
    "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\n Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed.\n": "GPL-3.0",
    "                  GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n": "LGPL-3.0",
    "Mozilla Public License Version 2.0\n==================================\n\n1. Definitions\n": "MPL-2.0",
    "CC0 1.0 Universal\n\nStatement of Purpose\n": "CC0-1.0",
    "This is free and unencumbered software released into the public domain.\n": "Unlicense",
    '// Licensed under the Apache License, Version 2.0 (the "License").': "Apache-2.0",
    "# SPDX-License-Identifier: MIT OR Apache-2.0\n": "MIT,Apache-2.0",
    "// SPDX-License-Identifier: (GPL-2.0-only WITH Linux-syscall-note) AND BSD-3-Clause OR ISC": "BSD-3-Clause,ISC,GPL-2.0",
    "SPDX-License-Identifier: GPL-2.0-or-later": "GPL-2.0",
    "SPDX-License-Identifier: LGPL-3.0+": "LGPL-3.0",
    "Licensed under GPLv3": "GPL-3.0",
    "Released under the BSD license.": "BSD",
    "under the BSD license": "BSD",
    "This project is not licensed under the MIT License.": "",
    "Version\n2. Something else follows the software here.": "",
}


def test_licences_as_they_are_written(spark, tmp_path):
    import duckdb

    rows = [*enumerate(LICENCE_CASES), (900, None), (900, ""), (901, "long " * 100_000 + "\nLicensed under GPLv3")]
    d = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, licences string")
    got = [tuple(r) for r in licenses.scan(d).select("doc_id", "n_known", "sentence_ids", "licences", "license_class").collect()]
    named = {r[0]: r[3] for r in got}
    assert {k: named[k] for k in range(len(LICENCE_CASES))} == dict(enumerate(LICENCE_CASES.values())) and named[901] == "GPL-3.0"
    d.drop("licences").coalesce(1).write.parquet(f"{tmp_path}/d")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/d/*.parquet'")
    assert sorted(con.execute(licenses.SQL).fetchall()) == sorted(got)
