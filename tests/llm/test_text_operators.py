"""Operators on documents against brute force, with nulls, empty and long texts, repeated rows and clashing columns."""

import hashlib
import itertools
import random
import re
import shutil
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ampliqua.llm import bpe, decontam, lbl, licenses, pii, puquality, setsketch, tokenstore, urlblock, wordtable
from tests.conftest import SF

TEXTS = [
    None,
    "",
    " \n ",
    "one",
    "The quick brown fox jumps over the lazy dog again and again, until the end of days comes near.",
    "The quick brown fox jumps over the lazy dog again and again, until the end of days comes near.",
    "Lines\n\nwith  odd\tspaces, <|endoftext|> tags, Été 日本 and 'quotes' it's 12!!",
    "word " * 5000,
    "a b c d",
    "Licensed under the MIT License.\nMail jane.roe@mail.example.com; jane.roe agreed, from 10.0.0.255 or +1 (555) 555-0199 with 4111 1111 1111 1111.",
]


def docs(spark, texts=TEXTS):
    rows = [(k, t, f"clash{k}", k, "x") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words string, score int, `key` string")


def empty(spark):
    return docs(spark, [])


def test_bpe_is_the_library(spark):
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r["doc_id"]: r for r in bpe.encode(docs(spark), public_tokenizers.path("word_bpe_49k.json")).collect()}
    assert len(got) == len(TEXTS)
    for k, t in enumerate(TEXTS):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert list(got[k]["ids"]) == ids and got[k]["decoded"] == lib.decode(ids, skip_special_tokens=False)
    d = {r["doc_id"]: r for r in bpe.digest(docs(spark), public_tokenizers.path("word_bpe_49k.json")).collect()}
    assert d[4]["ids_sha256"] == hashlib.sha256(np.array(got[4]["ids"], "<u4").tobytes()).hexdigest()
    assert bpe.digest(empty(spark), public_tokenizers.path("word_bpe_49k.json")).count() == 0
    back = {r["doc_id"]: r["text"] for r in bpe.decode(bpe.encode(docs(spark), public_tokenizers.path("word_bpe_49k.json")), public_tokenizers.path("word_bpe_49k.json")).collect()}
    assert all(back[k] == got[k]["decoded"] for k in back)


def test_bpe_on_random_texts():
    with open(public_tokenizers.path("word_bpe_49k.json")) as f:
        own = bpe.TrieBpe(f.read())
    rng = random.Random(4)
    parts = [*"abeinrst' é!9\nAE.,-_", "H\u0331", "A\u030a", "=\u0338", " \u0308", "\xa0", "\u2019s", "“", "日本", "İ", "Σς", "ﬁ", "\x1c", "\x0b", "\0", "<|endoftext|>", "<|", "😀", "don't", "WE'LL", "averyveryverylongword"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += [" ".join(f"w{k % 700} x" for k in range(200_000)), "", "x" * 600_000]
    lib = own.library
    for t, (ids, decoded) in zip(texts, own.encode_block([t.encode() for t in texts]), strict=True):
        want = lib.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, t[:200]
        assert decoded.decode() == lib.decode(want, skip_special_tokens=False)


def test_token_store_round_trip(spark, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib, at = Tokenizer.from_file(path), f"{tmp_path}/store"
    tokenstore.write_store(docs(spark), path, at)
    start = 0
    got = {r["doc_id"]: r for r in tokenstore.read_digests(spark, at).collect()}
    ids = {r["doc_id"]: list(r["ids"]) for r in tokenstore.read_ids(spark, at).collect()}
    for k, t in enumerate(TEXTS):
        want = [*lib.encode(t or "", add_special_tokens=False).ids, 0]
        assert ids[k] == want
        assert (got[k]["start"], got[k]["n_tokens"], got[k]["ids_crc32"]) == (start, len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
        start += len(want)
    assert tokenstore.verify(spark, at)
    objects = spark.read.parquet(f"{at}/objects").filter("kind = 'chunk'")
    assert objects.count() == objects.select("key").distinct().count()
    tokenstore.write_store(empty(spark), path, f"{tmp_path}/none")
    assert tokenstore.read_digests(spark, f"{tmp_path}/none").count() == 0


def test_token_store_encoder_on_random_texts():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        own = tokenstore.Encoder(f.read(), 7)
    rng = random.Random(8)
    parts = ["a", "b", "the", *"  \n\t.,-_é9", "  ", "\r\n", "'s", "É", "日本", "\xa0", "\u3000", "\x1c", "\0", "<|endoftext|>", "12", "!!", "😀", "\x85", "averyveryverylongword", "ñ" * 20]
    for _ in range(150):
        block = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(10)]
        ids, stops = own.encode([t.encode() for t in block])
        for t, got in zip(block, np.split(ids, stops[:-1]), strict=True):
            assert got.tolist() == [*own.library.encode(t, add_special_tokens=False).ids, 7], t
    long = " ".join(f"w{k % 5000}  x\n" for k in range(150_000))  # cut into parts
    ids, stops = own.encode([long.encode(), b""])
    assert ids.tolist() == [*own.library.encode(long, add_special_tokens=False).ids, 7, 7] and stops[1] == stops[0] + 1


def test_word_table_grows_and_finds():
    rng = random.Random(9)
    table, keys = wordtable.WordTable(room=8), []
    for _ in range(20):
        words = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 20))) for _ in range(200)]
        raw = b"".join(words)
        size = np.array(list(map(len, words)))
        got = table.lookup(raw, np.frombuffer(raw + bytes(wordtable.SHORT), np.uint8), np.cumsum(size) - size, size, keys.extend)
        assert [keys[k] for k in got] == words
    assert len(set(keys)) == len(keys) == table.n


def test_token_store_damage_is_found(spark, tmp_path):
    path, kept = public_tokenizers.path("byte_bpe_50k.json"), f"{tmp_path}/kept"
    tokenstore.write_store(docs(spark, [*TEXTS, *(f"text {k} " * 50 for k in range(40))]), path, kept)
    assert tokenstore.verify(spark, kept)

    def damaged(folder, change):
        at = f"{tmp_path}/{folder.replace('/', '-')}-{change.__name__}"
        shutil.copytree(kept, at)
        rows = change(spark.read.parquet(f"{kept}/{folder}"))
        shutil.rmtree(f"{at}/{folder}")
        rows.write.parquet(f"{at}/{folder}")
        return not tokenstore.verify(spark, at)

    def bit(df):
        return df.withColumn("ids", F.when(F.col("n_tokens") > 50, F.concat(F.substring("ids", 1, 10), F.lit(b"\x01\x02"), F.expr("substring(ids, 13)"))).otherwise(F.col("ids")))

    def chunk_gone(df):
        return df.filter("n_tokens < 50")

    def swapped(df):
        return df.withColumn("chunks", F.when(F.col("place") == 4, F.concat("chunks", "chunks")).otherwise(F.col("chunks")))

    def forged(df):  # a row put in the place of another, with its own right root
        return df.withColumn("place", F.when(F.col("place") < 2, 1 - F.col("place")).otherwise(F.col("place")))

    def dropped(df):
        return df.filter("n_docs is not null or place <> 1")

    def moved(df):
        return df.withColumn("start", F.col("start") + 1)

    for folder, change in [("objects/kind=chunk", bit), ("objects/kind=chunk", chunk_gone), ("recipes", swapped), ("recipes", forged), ("recipes", dropped), ("manifest", moved)]:
        assert damaged(folder, change), change.__name__


def test_crc_of_parts():
    a, b = b"some bytes", bytes(range(200))
    assert tokenstore.crc_join(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_decontamination_against_brute_force(spark):
    items = ["the lazy dog again and again until the end of days comes near", "quick", None, "a b c d", "word word word word word word word word word word word"]
    bench = spark.createDataFrame([(10 + k, t, 1) for k, t in enumerate(items)], "item_id long, text string, doc_id int")
    rx = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: rx.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    for block in (decontam.ITEM_BLOCK_BYTES, 40):
        got = {r["doc_id"]: r for r in decontam.judge(docs(spark), bench, block_bytes=block).collect()}
        assert len(got) == len(TEXTS)
        for k, t in enumerate(TEXTS):
            w, hit, found = words(t), set(), set()
            for i, item in enumerate(items):
                x = words(item)
                n = min(10, len(x))
                for a in range(len(x) - n + 1 if n else 0):
                    for b in range(len(w) - n + 1):
                        if w[b : b + n] == x[a : a + n]:
                            hit |= set(range(b, b + n))
                            found.add(str(10 + i))
            r = got[k]
            assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (len(w), len(hit), len(found), bool(hit)), k
            assert r["items_sha256"] == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    assert decontam.judge(empty(spark), bench).count() == 0
    assert not any(r["contaminated"] for r in decontam.judge(docs(spark), bench.limit(0)).collect())


def test_exact_and_proximity_matches(spark):
    d = spark.createDataFrame([(1, "alpha beta gamma delta epsilon"), (2, "alpha x beta gamma delta"), (3, "delta gamma beta alpha")], "doc_id long, text string")
    index = decontam.build_index(d)
    items = [("i", b"alpha beta gamma delta")]
    exact = {(r["doc_id"], r["position"]) for r in decontam.find_matches(index, items).collect()}
    near = {r["doc_id"] for r in decontam.find_matches(index, items, slop=2, exact=False).collect()}
    assert exact == {(1, 0)} and near == {1, 2}


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(400)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(3, 120))] for _ in range(40)]
    texts = [" ".join(b) for b in base]
    for b in base[:20]:
        for _ in range(6):
            c = list(b)
            for _ in range(rng.randint(0, 4)):
                c[rng.randrange(len(c))] = rng.choice(vocabulary)
            texts.append("  ".join(c).upper())
    texts += [None, "", texts[0], "a b", "A  B"]
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    got = {r["doc_id"]: r for r in setsketch.near_duplicates(docs(spark, texts)).collect()}
    assert len(got) == len(texts)
    for k in range(len(texts)):
        assert (got[k]["n_shingles"], got[k]["component_id"], got[k]["kept"]) == (len(sets[k]), root(k), root(k) == k)
    assert setsketch.near_duplicates(empty(spark)).count() == 0


def test_near_duplicates_after_a_row_without_id(spark):
    words = [f"w{k}" for k in range(100)]
    a, near = " ".join(words), " ".join(["x", *words[1:]])
    rows = [(None, a), (5, a), (9, a), (7, near), (None, "alone"), (3, "other")]
    got = setsketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got if r["doc_id"]} == {5: (96, 5, True), 9: (96, 5, False), 7: (96, 5, False), 3: (1, 3, True)}
    assert sorted((r["n_shingles"], r["component_id"], r["kept"]) for r in got if r["doc_id"] is None) == [(1, None, True), (96, None, True)]


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(1)
    pool = np.unique(rng.integers(0, 1 << 63, 3000, dtype=np.uint64))
    a, b = pool[:2000], pool[500:2500]
    u, v = setsketch.registers(a), setsketch.registers(b)
    assert (np.maximum(u, v) == setsketch.registers(np.union1d(a, b))).all()
    j, _ = setsketch.estimate(np.array([(u > v).sum()]), np.array([(u < v).sum()]), np.array([2000.0]), np.array([2000.0]))
    assert abs(j[0] - 0.6) < 0.15


def test_pii_base_spans_are_the_patterns():
    rng = random.Random(5)
    parts = [*"ab12890..@@-- ++()\n_%é", "4111111111111111", "@x.co", "1.2.3.4", "+1 555 ", "300.1.1.1"]
    email, ip = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card, phone = re.compile(r"[0-9]([ -]?[0-9])+"), re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        digits = lambda m: re.sub("[^0-9]", "", m.group())
        want = [("email", *m.span()) for m in email.finditer(t)]
        want += [("ip", *m.span()) for m in ip.finditer(t) if all(int(x) <= 255 for x in m.group().split("."))]
        want += [("card", *m.span()) for m in card.finditer(t) if 16 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
        want += [("phone", *m.span()) for m in phone.finditer(t) if 8 <= len(digits(m)) <= 15]
        assert sorted(pii.base_spans(t)) == sorted(want), t


def test_pii_field_finds_planted_second_mentions(spark):
    rng = random.Random(6)

    def number(n):
        return "".join(rng.choice("123456789") for _ in range(n))

    def one(k, again):
        name, start = f"u{k}.{number(2)}", f"4{number(14)}"
        card = next(c for c in (f"{start}{d}" for d in range(10)) if pii.luhn(c))
        p = number(10)
        first = f"We wrote to {name}@mail{k % 9}.example.com on day {k}, called +1 ({p[:3]}) {p[3:6]}-{p[6:]} and charged {card} in {rng.randint(1900, 2030)}."
        filler = " ".join(f"item {rng.randint(1, 999)} of lot {number(5)}" for _ in range(rng.randint(1, 40)))
        seconds = [f"user:{name}", f"{p[:3]}-{p[3:6]}-{p[6:]}", f"({card[:4]}.{card[4:8]}.{card[8:12]}.{card[12:]})"]
        text, marks = f"{first} {filler}", []
        for s in seconds if again else []:
            text += " then "
            at = len(text) + (5 if s.startswith("user") else s.startswith("("))
            text += s
            marks.append((("email", "phone", "card")[seconds.index(s)], at, at + len(s) - (5 if s.startswith("user") else 2 * s.startswith("("))))
        return text, marks

    field = pii.train(docs(spark, [one(k, False)[0] for k in range(150)]))
    wanted = found = hit = 0
    for k in range(150, 350):
        text, marks = one(k, k % 2)
        base, more = pii.label([text], field)[0]
        assert sorted(s[0] for s in base) == ["card", "email", "phone"]
        wanted, found, hit = wanted + len(marks), found + len(more), hit + len(set(marks) & set(more))
    assert wanted == 300 and hit / wanted >= 0.9 and hit / found >= 0.9, (wanted, found, hit)
    assert pii.masked("a b@c.d e", [("email", 2, 7)]) == "a [EMAIL] e"
    got = {r["doc_id"]: r for r in pii.digest(docs(spark), field).collect()}
    assert (got[9]["n_email"], got[9]["n_ip"], got[9]["n_card"], got[9]["n_phone"]) == (1, 1, 1, 1)
    assert got[0]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert pii.redact(docs(spark), field).filter("doc_id = 0").first()["text"] is None
    assert pii.digest(empty(spark)).count() == 0


def test_pii_marginals_are_exact_on_trees():
    rng = np.random.default_rng(4)
    n = len(pii.KINDS) + 1
    for _ in range(20):
        g, size = pii.Graph(), 6
        for k in range(size):  # each node but the first hangs on one before it
            g.features += bytes(rng.integers(0, 2, pii.N_FEATURES).tolist())
            g.evidence.append(int(rng.integers(1, n)) if k == 2 else 0)
            if k:
                (g.chain if rng.random() < 0.5 else g.skip).append((int(rng.integers(0, k)), k))
        field = pii.Field(rng.normal(0, 0.5, (pii.N_FEATURES, n)), rng.normal(0, 1, (n, n)), rng.normal(0, 1, n))
        unary, total = g.matrix() @ field.unary, np.zeros((size, n))
        for labels in itertools.product(range(n), repeat=size):
            if labels[2] == g.evidence[2]:
                w = sum(unary[k, v] for k, v in enumerate(labels)) + sum(field.chain[labels[a], labels[b]] for a, b in g.chain) + sum(field.skip[labels[a]] for a, b in g.skip if labels[a] == labels[b])
                total[range(size), labels] += np.exp(w)
        assert np.allclose(field.marginals(g, rounds=80), total / total.sum(axis=1, keepdims=True), atol=1e-6)


def _card(start, valid):
    return next(c for c in (f"{start}{d}" for d in range(10)) if pii.luhn(c) == valid)


def _field_of(n, name):
    rng = random.Random(12)
    number = lambda k: "".join(rng.choice("123456789") for _ in range(k))
    words = ["the", "mill", "by", "old", "river", "and", "lot", "report", "office", "day"]
    rows = []
    for k in range(n):
        card, bad = _card(f"4{number(14)}", True), _card(f"4{number(14)}", False)
        filler = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(5, 30)))
        rows.append(f"{filler()} {name(rng, k)}@mail{k % 9}.example.com {filler()} +1 ({number(3)}) {number(3)}-{number(4)} {filler()} {card} {filler()} 10.{k % 250}.7.{k % 199} {filler()} {bad} {filler()} {number(4)} {number(4)}")
    return rows, pii.fit(pii.configurations(rows))


def test_pii_field_finds_numbers_that_the_patterns_lose_in_texts_without_a_base_span():
    _, field = _field_of(200, lambda rng, k: f"u{k}.{rng.randint(1, 99)}")
    rng = random.Random(13)
    number = lambda k: "".join(rng.choice("123456789") for _ in range(k))
    wanted = found = hit = bare = 0
    for k in range(200):
        good, bad, phone = _card(f"4{number(14)}", True), _card(f"4{number(14)}", False), f"+1 ({number(3)}) {number(3)}-{number(4)}"
        # two numbers side by side are one match, which is too long; no kind of them is left
        text = [f"the mill {good} {bad} by the river", f"old mill {phone} {number(13)} by", f"lot {bad} {bad} and {number(4)} {number(4)}", f"{good} {good} the {number(3)}"][k % 4]
        marks = [[("card", 9, 25)], [("phone", 9, 9 + len(phone))], [], [("card", 0, 16), ("card", 17, 33)]][k % 4]
        base, more = pii.label([text], field)[0]
        assert not base
        wanted, found, hit, bare = wanted + len(marks), found + len(more), hit + len(set(marks) & set(more)), bare + bool(more)
    assert wanted == 200 and hit / wanted >= 0.9 and hit / found >= 0.9 and bare >= 135, (wanted, found, hit, bare)


def test_pii_names_of_any_length_are_left_to_the_field():
    names = ["bob", "anna", "jo", "li", "maria", "alexander", "tim", "kasimir"]
    rows, field = _field_of(200, lambda rng, k: names[k % len(names)])
    ordinary = "the office the office the office the office the office the office"
    for name in ("bob", "anna", "ute", "alexandra"):
        text = f"we met {name}@x.org and then {name} went home"
        assert pii.label([text], field)[0][1] == [("email", text.rindex(name), text.rindex(name) + len(name))]
        assert pii.label([f"{ordinary} office@x.org {name} {ordinary}"], field)[0][1] == []


def test_pii_messages_settle():
    rows, field = _field_of(60, lambda rng, k: f"u{k % 7}.{k % 5}")
    g = pii.Graph()
    for k in range(0, 60, 6):  # repeats within a text close loops
        g.add(k, " ".join(rows[k : k + 6] * 2), [])
    assert len(g.skip) > 50 and len(g.far) > 50 and len(g.chain) > 50
    assert np.allclose(field.marginals(g), field.marginals(g, rounds=10 * pii.ROUNDS), atol=1e-5)


def test_pii_in_linear_time():
    field = pii.Field.empty()
    field.unary += 0.1
    times = []
    for n in (4_000, 32_000):
        text = " ".join(f"w{k} 12{k} name.{k % 900}@mail.example.com name.{k % 900} 555-{k:07d} +1 555 {k:07d}" for k in range(n // 60))
        start = time.perf_counter()
        pii.label([text], field)
        times.append(time.perf_counter() - start)
    assert times[1] < 24 * times[0]


def test_quality_on_held_out_rows(spark):
    rng = random.Random(7)
    good = lambda: " ".join(rng.choice(["the", "river", "runs", "slowly", "past", "old", "mills"]) for _ in range(60)) + "."
    bad = lambda: " ".join(rng.choice(["BUY!!", "NOW$$$", "###", "CLICK%%%"]) for _ in range(60))
    quality = [int(rng.random() < 0.8) for _ in range(600)]
    d = docs(spark, [good() if q else bad() for q in quality] + TEXTS)
    labels = spark.createDataFrame([(k, q, 0) for k, q in enumerate(quality) if k % 2], "doc_id long, quality int, toxic int")
    rows = puquality.classify(d, labels).collect()
    assert len(rows) == 610 and all(0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] < 600]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in held)
    assert sum(r["predicted"] == quality[r["doc_id"]] for r in held) / len(held) > 0.97
    none = puquality.classify(d, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}


def test_quality_risk_and_prior_against_brute_force():
    rng = np.random.default_rng(5)
    truth = rng.random(4000) < 0.7
    x = rng.normal(0, 1, (4000, 3)) + np.where(truth[:, None], [1.5, 0.5, 0], [-1.5, 0, 0.3])
    z = puquality.extended(x, x.mean(axis=0), x.std(axis=0))
    good = z[truth & (rng.random(4000) < 0.3)]
    moments = [puquality.Moments(len(v), v.T @ v) for v in (good, z)]
    own, rest = (lambda v, w, label: ((1 - label * (v @ w)) ** 2).mean() / 4), puquality.risk

    def whole(w, prior):  # the risk that is minimised, from the rows themselves
        return prior * own(good, w, 1) + max(0, own(z, w, -1) - prior * own(good, w, -1)) + puquality.RIDGE * (w @ w) / 2

    for prior in (0.3, 0.7, 0.95):
        w = puquality.fit(*moments, prior)
        assert np.allclose(rest(w, *moments, prior), (prior * own(good, w, 1), own(z, w, -1) - prior * own(good, w, -1)))
        assert all(whole(w + rng.normal(0, size, len(w)), prior) > whole(w, prior) - 1e-9 for size in (1e-3, 1e-2, 0.1, 1) for _ in range(50))
    w = puquality.against(*moments)
    edges = np.linspace(-3, 3, 301)
    prior = puquality.estimate_prior(*(np.histogram(v @ w, edges)[0].astype(float) for v in (good, z)))
    ratios = [(z @ w >= t).mean() / (good @ w >= t).mean() for t in edges if 0.3 <= (good @ w >= t).mean() <= 0.98]
    assert min(ratios) <= prior < min(ratios) + 0.12 and abs(prior - 0.7) < 0.12


def test_quality_of_odd_tables(spark):
    labels = spark.createDataFrame([(0, 1, 0), (0, 0, 0), (2, None, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    rows = spark.createDataFrame([(None, "no id"), (None, None), (0, "good text"), (0, "good text"), (3, "")], "doc_id long, text string")
    got = puquality.classify(rows, labels).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 and not (r["doc_id"] is None and r["held_out"]) for r in got)
    assert puquality.classify(empty(spark), labels).count() == 0


def test_language_model_base_and_normalisation(spark):
    got = {r["doc_id"]: r for r in lbl.score(docs(spark)).collect()}
    from collections import Counter

    counts = Counter()
    for k, t in enumerate(TEXTS):
        if zlib.crc32(str(k).encode()) % 5 != 1:
            counts.update((t or "").encode().lower().split())
            counts[None] += 1
    n, v = sum(counts.values()), len(counts)
    for k, t in enumerate(TEXTS):
        w = [*(t or "").encode().lower().split(), None]
        want = sum(np.log10((counts.get(x, 0) + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        assert got[k]["base_score"] == pytest.approx(want) and got[k]["train_tokens"] == n
        assert (got[k]["n_tokens"], got[k]["n_known"]) == (len(w), sum(counts.get(x, 0) > 0 for x in w))
    model = lbl.Model(np.array([5.0, 9.0, 3.0, 2.0]))
    before, word = np.array([[0, 1], [1, 2], [2, 3]] * 50), np.array([1, 2, 3] * 50)
    model.train(before, word, np.ones(150), passes=30)
    z = model.normalisers()
    total = sum(np.exp(model.log_probabilities(before[:3], np.full(3, x), z)) for x in range(4))
    assert np.allclose(total, 1, atol=1e-4)
    assert model.log_probabilities(before[:3], word[:3], z).mean() > np.log(0.5)


def test_language_model_gradients():
    rng = np.random.default_rng(3)
    model = lbl.Model(rng.integers(1, 50, 12).astype(float))
    model.context, model.place, model.target, model.bias = (p.astype(float) for p in model.parts())
    before, word, weight, drawn = rng.integers(0, 12, (40, 2)), rng.integers(0, 12, 40), rng.random(40), rng.integers(0, 12, 9)
    for part, slope in zip(model.parts(), model.gradients(before, word, weight, drawn), strict=True):
        for k in rng.choice(part.size, min(part.size, 12), replace=False):
            old = part.flat[k]
            values = []
            for step in (1e-5, -1e-5):
                part.flat[k] = old + step
                values.append(model.contrast(before, word, weight, drawn))
            part.flat[k] = old
            assert slope.flat[k] == pytest.approx((values[0] - values[1]) / 2e-5, rel=1e-4, abs=1e-6)


def test_language_model_classes():
    texts = [b"The rising tide  \x0b ab x \xc3\xa9", b"", b"\nrising\x00 z"]
    hashes, endings, n = lbl.words_and_endings(texts)
    assert n.tolist() == [6, 0, 2] and len(hashes) == len(endings) == 8
    number = lambda w: int.from_bytes(w[-3:], "little")
    assert endings.tolist() == [number(w) for t in texts for w in t.lower().split()]
    words = {b"the": 50, b"rising": 7, b"falling": 5, b"ab": 3, b"cab": 2, b"zzz": 1}
    three, two = [(number(b"ing"), 12, 2)], [(number(b"ab"), 5, 2)]
    classes = lbl.Classes([(1, 50)], three, two, 9, (1, 1))
    at = classes.by_ending(np.array([number(w) for w in words]))
    assert at.tolist() == [lbl._OTHER, 3, 3, 4, 4, lbl._OTHER]  # 'the' is a class of its own, found by its hash
    assert classes.counts.tolist() == [9, 1, 50, 12, 5]
    for k, members in ((3, [7, 5]), (4, [3, 2]), (lbl._OTHER, [1])):  # with one share for unseen words
        assert sum(c + 0.5 for c in members) + 0.5 == pytest.approx(10 ** classes.within[k])


def test_language_model_gains_on_held_out_texts(spark):
    rows = lbl.score(spark.read.parquet(f"{SF}/documents.parquet")).filter("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert (rows[0] - rows[1]) / rows[2] > 0.1
    assert all(abs(r["base_score"]) < 1e-9 and r["train_tokens"] == 0 for r in lbl.score(spark.createDataFrame([(5, "a b")], "doc_id long, text string").filter("crc32(cast(cast(doc_id as string) as binary)) % 5 = 1")).collect())
    assert lbl.score(empty(spark)).count() == 0


MIT_TEXT = """MIT License

Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
APACHE_TEXT = """   Copyright 2020 Someone

   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.
   You may obtain a copy of the License at

     http://www.apache.org/licenses/LICENSE-2.0

   Unless required by applicable law or agreed to in writing, software
   distributed under the License is distributed on an "AS IS" BASIS,
   WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
   See the License for the specific language governing permissions and
   limitations under the License.
"""
GPL_TEXT = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU {}General Public License as published by
    the Free Software Foundation, either version {} of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU {}General Public License for more details.
"""
BSD_TEXT = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD_NAME = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
MPL_TEXT = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
ISC_TEXT = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE.
"""


def test_licence_rules(spark):
    cases = {
        MIT_TEXT: ("MIT", "permissive", 5),
        MIT_TEXT.split("\n\n", 2)[2]: ("MIT", "permissive", 4),
        APACHE_TEXT: ("Apache-2.0", "permissive", 4),
        GPL_TEXT.format("", 3, ""): ("GPL-3.0", "copyleft", 3),
        GPL_TEXT.format("", 2, ""): ("GPL-2.0", "copyleft", 3),
        GPL_TEXT.format("Affero ", 3, "Affero "): ("AGPL-3.0", "copyleft", 3),
        BSD_TEXT: ("BSD-2-Clause", "permissive", 3),
        BSD_TEXT + BSD_NAME: ("BSD-3-Clause,BSD-2-Clause", "permissive", 4),
        MPL_TEXT: ("MPL-2.0", "copyleft", 2),
        ISC_TEXT: ("ISC", "permissive", 2),
        "This work is licensed under the GNU General Public License, version 3.\nLicensed under CC BY-NC 4.0.": ("GPL-3.0,CC-BY-NC-4.0", "copyleft", 2),
        "# SPDX-License-Identifier: LGPL-2.1\nimport os": ("LGPL-2.1", "copyleft", 1),
        "/* SPDX-License-Identifier: CC0-1.0 */": ("CC0-1.0", "public-domain", 1),
        "MIT License (see LICENSE)": ("MIT", "permissive", 1),
        "This project is licensed under the EUPL.": ("", "none", 0),
        "Released under the Boost Software License, Version 1.0.\r\n": ("BSL-1.0", "permissive", 1),
        "I read about the mit license yesterday.": ("", "none", 0),
    }
    got = {r["doc_id"]: r for r in licenses.scan(docs(spark, [*TEXTS, *cases])).collect()}
    assert got[9]["licences"] == "MIT" and got[0]["n_known"] == 0 and got[0]["license_class"] == "none"
    for k, (text, (names, kind, n)) in enumerate(cases.items(), len(TEXTS)):
        assert (got[k]["licences"], got[k]["license_class"], got[k]["n_known"]) == (names, kind, n), text
    assert len(licenses.LICENCES) >= 30
    for licence, kind, names in licenses.LICENCES:
        assert all(licenses.normal(x) == x for x in names)
    every = [(f"SPDX-License-Identifier: {licence}", licence, kind) for licence, kind, _ in licenses.LICENCES] + [(f"Licensed under the {n}.", licence, kind) for licence, kind, ns in licenses.LICENCES for n in ns]
    found = {r["doc_id"]: r for r in licenses.scan(docs(spark, [t for t, _, _ in every])).collect()}
    assert [(found[k]["licences"], found[k]["license_class"]) for k in range(len(every))] == [(a, b) for _, a, b in every]
    assert all(any(a in s for a in licenses.ANCHORS) and licenses.normal(s) == s for s in licenses.KNOWN)
    assert licenses.scan(empty(spark)).count() == 0


def test_near_duplicate_recall_at_the_least_similarity(spark):
    rng = random.Random(21)
    texts = []
    for _ in range(1500):  # 61 of 71 shingles are shared: 0.859
        words = [f"v{rng.randrange(10**7)}" for _ in range(70)]
        texts.append(" ".join(words))
        words[rng.randrange(5, 65)] = "changed"
        texts.append(" ".join(words))
    got = {r["doc_id"]: r["component_id"] for r in setsketch.near_duplicates(docs(spark, texts).repartition(4)).collect()}
    assert sum(got[k] == got[k + 1] == k for k in range(0, 3000, 2)) / 1500 > 0.999


ODD = [(None, "no id here, mail a.b1@c.example.org"), (None, "no id here, mail a.b1@c.example.org"), (5, "Licensed under the MIT License."), (5, "Licensed under the MIT License."), (5, "another text of row five"), (None, None), (7, ""), (6, " \n\t"), (8, None), (9, "the quick brown fox " * 60_000)]


def test_null_and_repeated_ids(spark):
    table = spark.createDataFrame([(i, t, "clash", k) for k, (i, t) in enumerate(ODD)], "doc_id long, text string, score string, n_words int")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    rows = lambda df, *cols: sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    want = lambda f: sorted(((i, *f(t)) for i, t in ODD), key=repr)
    bench = spark.createDataFrame([(None, "row five"), (1, "row five"), (1, "row five"), (2, None)], "item_id long, text string")
    hit = lambda t: 2 if t and "row five" in t else 0
    assert rows(decontam.judge(table, bench), "doc_id", "n_words", "n_hit", "n_items") == want(lambda t: (len(words(t)), hit(t), hit(t)))
    assert rows(pii.digest(table), "doc_id", "n_email") == want(lambda t: ((t or "").count("@"),))
    assert rows(licenses.scan(table), "doc_id", "licences") == want(lambda t: ("MIT" if t and "MIT" in t else "",))
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert rows(bpe.digest(table, public_tokenizers.path("word_bpe_49k.json")), "doc_id", "n_tokens") == want(lambda t: (len(lib.encode(t or "", add_special_tokens=False).ids),))
    scored = lbl.score(table)
    assert rows(scored, "doc_id", "n_tokens") == want(lambda t: (len((t or "").split()) + 1,))
    assert scored.filter("doc_id is null and held_out").count() == 0 and scored.filter("score is null or isnan(score)").count() == 0
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sizes = {t: len(lib.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in ODD}
    stored = tokenstore.store_digests(table, public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert sorted(((r["doc_id"], r["n_tokens"]) for r in stored), key=repr) == want(lambda t: (sizes[t],))
    at = 0
    for r in sorted(stored, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    assert [r["doc_id"] for r in sorted(stored, key=lambda r: r["start"])] == [None] * 3 + [5, 5, 5, 6, 7, 8, 9]
    groups = setsketch.near_duplicates(table).collect()
    assert len(groups) == len(ODD) and {r["component_id"] for r in groups if r["doc_id"] == 5} == {5}
    pages = spark.createDataFrame([(None, "http://a.net/x"), (None, "http://a.net/x"), (4, "http://a.net/x"), (4, "http://b.org/fr/"), (4, None), (None, None)], "page_id long, url string").withColumn("html", F.lit(None).cast("string")).withColumn("host", F.lit("clash"))
    judged = urlblock.judge_urls(pages).collect()
    assert sorted((repr(r["page_id"]), r["host"], r["verdict"]) for r in judged) == sorted([("None", "a.net", "block")] * 2 + [("4", "a.net", "block"), ("4", "b.org", "allow"), ("4", "", "allow"), ("None", "", "allow")])
