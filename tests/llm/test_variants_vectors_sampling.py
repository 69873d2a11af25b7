"""Spelling variants, near-duplicate vectors and importance resampling against brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from recallgrid.llm import embedding_dedup, importance_sampling, kernel, spelling_variants

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# Spelling variants


def plain_counts(rows, damage=97):
    n = Counter()
    for i, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(ASCII_LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if damage and h % damage == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def near(s, t):
    if abs(len(s) - len(t)) > 1 or s == t:
        return False
    if len(s) == len(t):
        return sum(a != b for a, b in zip(s, t)) == 1
    s, t = sorted((s, t), key=len)
    return any(t[:k] + t[k + 1 :] == s for k in range(len(t)))


def plain_variants(n):
    form, number = {}, Counter()
    for w in n:
        others = [x for x in n if near(w, x)]
        number[w] = len(others)
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], number[w], n[form[w]] if form[w] else None))
    return out


def misspelt(rng, w):
    k = rng.randrange(len(w))
    return rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("aeßéÿ×x") + w[k:], w[:k] + rng.choice("aeoéx") + w[k + 1 :]])


def spelt_corpus(seed, n=70):
    rng = random.Random(seed)
    base = ["banana", "anana", "aaaaa", "aaaaaa", "theory", "theatre", "THEATER", "Élève", "straße", "résumé", "resume", "colour", "color", "colours", "naïve", "×ab×cde÷", "neighbour"]
    words = base + [misspelt(rng, rng.choice(base)) for _ in range(60)]
    words += [misspelt(rng, w) for w in words[-30:]]
    rows = [(i, rng.choice([" ", ", ", "1", "\n", "日本"]).join(rng.choice(words) for _ in range(rng.randrange(60)))) for i in range(n)]
    return [*rows, (None, "colour color banana"), (7, rows[7][1]), (8, None), (9, ""), (10, " ".join(words * 30))]


@pytest.mark.parametrize("seed", [1, 2])
def test_variants_equal_brute_force(spark, seed):
    rows = spelt_corpus(seed)
    docs = spark.createDataFrame([(i, "x", t) for i, t in rows], "doc_id long, word string, text string").repartition(3)
    n = plain_counts(rows, damage=5)
    got = spelling_variants.word_counts(docs, damage=5)
    assert {tuple(r) for r in got.collect()} == set(n.items())
    want = plain_variants(n)
    assert any(f for _, f, *_ in want) and any(f and r != f for _, f, r, *_ in want)
    for block_words in (4096, 3):  # with small blocks, what is left of words is halved until nothing is
        out = spelling_variants.variants(got, block_words=block_words)
        assert {tuple(r) for r in out.select("word", "form", "root", "n", "n_near", "form_n").collect()} == want


def test_one_hot_block_is_halved(spark):
    rng = random.Random(5)
    words = {"prefix" + "".join(rng.choice("abc") for _ in range(5)): rng.randrange(3, 90) for _ in range(200)}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    out = spelling_variants.variants(df, block_words=20)
    assert {tuple(r) for r in out.select("word", "form", "root", "n", "n_near", "form_n").collect()} == plain_variants(words)


def test_chains_of_forms_are_followed_to_their_end(spark):
    chain = ["abcdefghij"[:k] + "z" * (12 - k) for k in range(11)]
    df = spark.createDataFrame([(w, 3 * 2**k) for k, w in enumerate(chain)], "word string, n long")
    assert {r["root"] for r in spelling_variants.variants(df).collect()} == {chain[-1]}
    assert spelling_variants.variants(df.limit(0)).collect() == []


def test_heap_merge_counts_as_a_counter_does():
    rng = random.Random(3)
    for _ in range(300):
        postings = [sorted(rng.sample(range(30), rng.randrange(1, 20))) for _ in range(rng.randrange(8))]
        seen = Counter(itertools.chain(*postings))
        for least in (1, 2, 3, 5):
            assert list(spelling_variants.merged(postings, least)) == sorted(x for x, k in seen.items() if k >= least)


def test_crc32_equals_zlib():
    rng = random.Random(4)
    words = [bytes(rng.choice(b"abc\xc3\xa9") for _ in range(rng.choice([1, 2, 7, 63, 64, 65, 300]))) for _ in range(200)]
    data = np.frombuffer(b" ".join(words), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = ends - [len(w) for w in words]
    before = np.array([zlib.crc32(b"%d:" % k) for k in range(200)], np.uint32)
    assert kernel.runs_crc32(data, starts, ends).tolist() == [zlib.crc32(w) for w in words]
    assert kernel.runs_crc32(data, starts, ends, before).tolist() == [zlib.crc32(b"%d:" % k + w) for k, w in enumerate(words)]
    assert len(kernel.runs_crc32(data, starts[:0], ends[:0])) == 0


# Near-duplicate vectors


def vector_rows(seed=1, d=64, labels=3, hot=150):
    rng = np.random.default_rng(seed)

    def around(v, cosine):
        r = rng.normal(size=d)
        r -= r @ v * v
        return cosine * v + math.sqrt(1 - cosine**2) * r / np.linalg.norm(r)

    rows, key = [], itertools.count(1)
    for label in range(labels):
        for _ in range(60):
            v = rng.normal(size=d)
            v /= np.linalg.norm(v)
            rows.append((next(key), v, label))
            for c in rng.choice([0.9299, 0.9301, 0.935, 0.95, 0.99, 0.5], size=3):
                rows.append((next(key), around(v, c) * rng.uniform(0.1, 9), label))
    centre = rows[0][1]
    rows += [(next(key), around(centre, 0.985), 0) for _ in range(hot)]
    rows += [(next(key), centre, 0), (next(key), centre, 0), (next(key), centre, 1), (next(key), centre, None)]
    out = [(int(i), [float(np.float32(x)) for x in v], label) for i, v, label in rows]
    odd = [None, [], [0.0] * d, [float("nan")] * d, [None] + [1.0] * (d - 1), [float("inf")] * d, [1.0] * 3, [1.0] * 3]
    return out + [(next(key), v, 0) for v in odd]


def plain_links(rows, least):
    ok = [(k, np.array(v, dtype=np.float64), label) for k, (_, v, label) in enumerate(rows) if v and None not in v and label is not None and np.isfinite(np.array(v)).all() and any(v)]
    links = []
    for (a, x, la), (b, y, lb) in itertools.combinations(ok, 2):
        if la == lb and len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= least:
            links.append((a, b))
    return links


def components_of(n, links):
    root = list(range(n))

    def find(a):
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    for a, b in links:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(a) for a in range(n)]


@pytest.mark.parametrize("cell_rows", [2048, 40])
def test_vectors_equal_brute_force(spark, cell_rows):
    rows = vector_rows()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("code", F.lit(1)).repartition(3)
    links = plain_links(rows, 0.93)
    degree = Counter(itertools.chain(*links))
    comp = components_of(len(rows), links)
    want = {(i, degree[k], rows[comp[k]][0], comp[k] == k) for k, (i, _, _) in enumerate(rows)}
    got = {tuple(r) for r in embedding_dedup.near_duplicates(df, cell_rows=cell_rows).collect()}
    assert len(got) == len(rows)
    found = sum(r[1] for r in got) / 2
    assert found / len(links) >= 0.995 and found <= len(links)
    if found == len(links):
        assert got == want


def test_recall_at_the_threshold_and_no_wrong_link(spark):
    rng = np.random.default_rng(8)
    rows = []
    for k in range(1500):
        v = rng.normal(size=64)
        v /= np.linalg.norm(v)
        r = rng.normal(size=64)
        r -= r @ v * v
        c = 0.9305 if k % 2 else 0.9295
        rows += [(2 * k, v.tolist(), k % 5), (2 * k + 1, (c * v + math.sqrt(1 - c * c) * r / np.linalg.norm(r)).tolist(), k % 5)]
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    above = [k for k in range(1500) if k % 2]
    assert sum(got[2 * k]["n_links"] for k in above) / len(above) >= 0.99
    assert all(got[2 * k]["n_links"] == 0 and got[2 * k + 1]["kept"] for k in range(1500) if not k % 2)


def test_vectors_of_other_shapes(spark):
    f = embedding_dedup.near_duplicates
    schema = "vec_id long, embedding array<double>, label string"
    assert f(spark.createDataFrame([], schema)).collect() == []
    rows = [(1, [2.0], "a"), (2, [3.0], "a"), (3, [-1.0], "a"), (4, [1e308, 1e308], "a"), (5, [1e-308, 1e-308], "a"), (5, [1.0, 0.9], "a"), (None, [1.0, 1.0], "a"), (9, [1.0, 1.0], None)]
    got = sorted((tuple(r) for r in f(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == sorted([(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True), (4, 3, 4, True), (5, 3, 4, False), (5, 3, 4, False), (None, 3, 4, False), (9, 0, 9, True)], key=str)


# Importance resampling


def tokens(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII_LOWER))


def plain_resample(docs, target, buckets, longest, percent=10, least_words=20):
    def feats(text):
        w = tokens(text)
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    s, t = Counter(x for _, text in docs for x in feats(text)), Counter(x for text in target for x in feats(text))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets))))
    out = []
    for i, text in docs:
        f = feats(text)
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(tokens(text))))
    able = sorted((r for r in out if r[4] >= least_words), key=lambda r: (-r[3], r[0] is None, r[0]))
    rank = {id(r): k + 1 for k, r in enumerate(able[: percent * len(able) // 100])}
    return sorted(((*r[:4], rank.get(id(r))) for r in out), key=str)


@pytest.mark.parametrize("longest", [1, 3])
def test_resampling_equals_brute_force(spark, longest, monkeypatch):
    rng = random.Random(longest)
    words = "alpha Beta gamma é 日本 d3lta x".split() + [f"w{k}" for k in range(50)]
    docs = [(k, rng.choice([" ", "-", "\n"]).join(rng.choice(words) for _ in range(rng.randrange(80)))) for k in range(200)]
    docs += [(None, "alpha beta " * 30), (3, docs[3][1]), (5, None), (6, ""), (900, "-- !"), (901, "alpha " * 40_000)]
    target = ["alpha gamma w1 w2 w3", "alpha alpha é", None, ""]
    df = spark.createDataFrame([(i, "x", t) for i, t in docs], "doc_id long, bucket string, text string").repartition(3)
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    want = plain_resample(docs, target, 997, longest)
    for salt_bytes in (importance_sampling.SALT_BYTES, 5_000):
        monkeypatch.setattr(importance_sampling, "SALT_BYTES", salt_bytes)
        got = importance_sampling.resampled(df, aim, buckets=997, longest=longest)
        assert sorted((tuple(r) for r in got.collect()), key=str) == want


def test_resampling_without_documents_or_target(spark):
    docs, none = spark.createDataFrame([(1, "a b " * 20)], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, text string")
    f = importance_sampling.resampled
    assert f(none, docs.select("text")).collect() == []
    assert [tuple(r) for r in f(docs, none.select("text"), percent=100).collect()] == plain_resample([(1, "a b " * 20)], [], 10_000, 1, percent=100)
