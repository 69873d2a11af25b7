"""The corpus operators against brute force on small tables, with the cases that real tables have few of."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from recallgrid.llm import decontamination, language_id, license_scan, line_dedup, ngram_join, quality, sentencepiece_tokens, substring_dedup, topk_search, warc_fixity

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")


def corpus(seed=1, n=60):
    """Random texts, exact and near copies, shared passages, odd rows: (doc_id, text)."""
    rng = random.Random(seed)
    say = lambda k: " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(k))
    passage = say(70)
    rows = [(i, say(rng.randrange(5, 120))) for i in range(n)]
    for i in range(n, n + 25):
        words = rng.choice(rows)[1].split(" ")
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = "changed" + str(rng.randrange(5))
        rows.append((i, " ".join(words)))
    rows += [(n + 30 + i, say(20) + "\n" + passage + "\t" + say(i)) for i in range(6)]
    rows += [(900, None), (901, ""), (902, "   \n\t "), (903, "one two"), (904, "one two"), (905, "One Two"), (906, "é ß ü"), (907, "x" * 5000)]
    rows += [rows[3], rows[3], (950, ("lorem ipsum " * 400).strip()), (951, ("lorem ipsum " * 400).strip())]
    return rows


def frame(spark, rows, **extra):
    """With further columns whose names clash with those the operators use inside."""
    df = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string")
    for name in ("keys", "node", "n", "grams", "kind", "bucket", "gone", "score", "id", "component"):
        df = df.withColumn(name, F.lit(name))
    return df.repartition(3)


def got(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def gram_set(text, n):
    w = SPACED.findall(lower(text))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def jaccard_components(rows, n, percent):
    sets = [(i, gram_set(t, n)) for i, t in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    least = {}
    for k, (i, _) in enumerate(sets):
        least[find(k)] = min(least.get(find(k), i), i)
    return sorted((i, len(s), least[find(k)]) for k, (i, s) in enumerate(sets))


@pytest.mark.parametrize("seed,n,percent", [(1, 4, 85), (2, 5, 80), (3, 2, 50)])
def test_ngram_join(spark, seed, n, percent):
    rows = corpus(seed)
    out = ngram_join.ngram_jaccard_join(frame(spark, rows), n, percent)
    assert got(out, "doc_id", "n_shingles", "component_id") == jaccard_components(rows, n, percent)


def test_ngram_join_hub_isnt_smallest(spark):
    """Copies that link to a hub only, and a hub whose id is the largest."""
    base = [f"w{i}" for i in range(60)]
    rows = []
    for k in range(14):
        w = list(base)
        w[3 + 4 * k] = f"edit{k}"
        rows.append((k, " ".join(w)))
    rows.append((99, " ".join(base)))
    out = ngram_join.ngram_jaccard_join(frame(spark, rows), 4, 85)
    assert got(out, "doc_id", "n_shingles", "component_id") == jaccard_components(rows, 4, 85)


def test_one_of_each(spark):
    rows = corpus(4)
    kept = ngram_join.one_of_each(frame(spark, rows), 5, 80)
    want = {(i, c) for i, n, c in jaccard_components(rows, 5, 80) if n}
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i not in (900, 901, 902)) == sorted({c for _, c in want}) and {900, 901, 902} <= set(ids)
    assert kept.columns == frame(spark, rows).columns


def brute_substring(rows, window):
    first = {}
    for i, t in rows:
        w = SPACED.findall(t or "")
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            first[k] = min(first.get(k, i), i)
    out = []
    for i, t in rows:
        w = SPACED.findall(t or "")
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < i:
                gone |= set(range(s, s + window))
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("seed,window", [(1, 50), (2, 20), (3, 9)])
def test_substring_dedup(spark, seed, window):
    rows = corpus(seed)
    out = substring_dedup.substring_dedup(frame(spark, rows), window)
    assert got(out, "doc_id", "n_words", "n_removed", "kept_sha256") == brute_substring(rows, window)


def edits(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            prev, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, prev + (x != y))
    return d[-1]


def line_corpus(seed):
    rng = random.Random(seed)
    lines = [" ".join(rng.choice(WORDS) for _ in range(rng.choice([3, 8, 9, 10, 14]))) for _ in range(25)]
    rows = []
    for i in range(40):
        own = []
        for _ in range(rng.randrange(1, 6)):
            w = rng.choice(lines).split()
            k = rng.randrange(len(w))
            own.append(" ".join(rng.choice([w, w[:k] + w[k + 1 :], w[:k] + [rng.choice(WORDS)] + w[k:], w[:k] + ["new"] + w[k + 1 :]])))
        rows.append((i, "\n".join(own)))
    return rows + [(100, None), (101, ""), (102, "\n\n"), (103, "a\n\na\n b"), (104, "a a a a a a a a a\na a a a a a a a"), (105, " ".join(WORDS * 40))]


def test_line_dedup(spark):
    for seed in (1, 2):
        rows = line_corpus(seed)
        flat = [(i, k, x.split()) for i, t in rows if t is not None for k, x in enumerate(t.split("\n"))]
        flat.sort(key=lambda x: x[:2])
        gone = set()
        for a, (i, k, w) in enumerate(flat):
            if w and any(v == w or (min(len(v), len(w)) >= 8 and abs(len(v) - len(w)) < 2 and edits(v, w) <= 1) for _, _, v in flat[:a] if v):
                gone.add((i, k))
        want = sorted((i, None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone)) for i, t in rows)
        out = line_dedup.rewritten(frame(spark, rows))
        have = sorted((r["doc_id"], r["text"]) for r in out.collect())
        assert have == want
        assert out.columns[:-2] == frame(spark, rows).columns


def test_line_dedup_words_with_other_spaces(spark):
    rest = "one two three four five six seven eight nine"
    rows = [(1, f"{rest} 10\u00a0000"), (2, f"{rest} 20\u00a0500"), (3, f"{rest} a\u3000b\u2028c"), (4, f"x\u0085y {rest}"), (5, f"a\u001cb {rest}"), (6, f"other\u00a0line {rest} and\u00a0more")]
    flat = [(i, SPACED.findall(t)) for i, t in rows]
    gone = {i for a, (i, w) in enumerate(flat) if any(edits(v, w) <= 1 for _, v in flat[:a])}
    out = {r["doc_id"]: r["text"] for r in line_dedup.rewritten(frame(spark, rows)).collect()}
    assert gone == {2, 3, 5} and {i for i, t in out.items() if t == ""} == gone


BENCH = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_decontamination(spark):
    rng = random.Random(7)
    items = [(k, " ".join(rng.choice(WORDS) for _ in range(n))) for k, n in enumerate([3, 10, 14, 25, 1, 12])] + [(50, None), (51, "!!"), (1, "repeat of an id"), (52, " ".join(["again"] * 14))]
    rows = corpus(5, 20)
    for i in range(8):
        w = items[3][1].split()
        rows.append((300 + i, "Start " + " - ".join(x.upper() for x in w[i : i + 10 + i % 3]) + " end " + items[5][1] + " " + "again " * 12))
    want = []
    for i, t in rows:
        d, hit, names = BENCH.findall(lower(t)), set(), set()
        for item, x in items:
            w = BENCH.findall(lower(x))
            n = min(10, len(w))
            for s in range(len(w) - n + 1 if n else 0):
                for p in range(len(d) - n + 1):
                    if d[p : p + n] == w[s : s + n]:
                        hit |= set(range(p, p + n))
                        names.add(str(item))
        want.append((i, len(d), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for pass_words in (10**6, 20):  # one pass, and several
        docs = frame(spark, rows).select("doc_id", "text")
        out = decontamination.contaminated(docs, bench, pass_words=pass_words).drop("text").mapInArrow(decontamination.report, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")
        assert got(out, *out.columns) == sorted(want)
    kept = decontamination.clean(frame(spark, rows), bench)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(w[0] for w in want if not w[5]) and kept.columns == frame(spark, rows).columns


def test_topk(spark):
    rows = corpus(6)
    docs = {k: Counter(BENCH.findall(lower(t))) for k, (_, t) in enumerate(rows)}
    n, mean = len(rows), sum(sum(c.values()) for c in docs.values()) / len(rows)
    df = Counter(t for c in docs.values() for t in c)
    queries = {i: Counter(BENCH.findall(lower(t))) for i, t in rows if i % 10 == 0}
    want = []
    for q, terms in queries.items():
        found = []
        for k, c in docs.items():
            length = sum(c.values())
            s = sum(m * math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * length / mean)) for t, m in terms.items() if t in c)
            if s > 0:
                found.append((-round(s, 4), rows[k][0]))
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(found)[:10])]
    for shard in (1 << 20, 2000):
        topk_search.SHARD_BYTES, old = shard, topk_search.SHARD_BYTES
        shards = topk_search.stored(topk_search.index(frame(spark, rows)))
        topk_search.SHARD_BYTES = old
        terms = topk_search.query_terms(frame(spark, rows).where("doc_id % 10 = 0"))
        for pass_terms in (10**6, 300):
            out = [(r["query_id"], r["rank"], r["doc_id"], round(r["score"], 4)) for r in topk_search.search(shards, terms, pass_terms=pass_terms).collect()]
            assert sorted(out) == sorted(want)


def test_warc_audit_finds_planted_faults(spark):
    pages = spark.createDataFrame([(i % 250, f"http://h/{i}", "é" * (i % 90)) for i in range(300)] + [(5, None, None), (5, None, None)], "page_id long, url string, html string")
    records = warc_fixity.stored(warc_fixity.laid_out(pages, 40))
    assert records.count() == 301 and records.agg(F.sum("copies")).first()[0] == 302
    assert warc_fixity.audit(records, records).count() == 0
    bad = records.where("record_no % 9 <> 4").withColumn("record", F.when(F.col("record_no") % 9 == 5, F.concat("record", F.lit("x"))).otherwise(F.col("record")))
    extra = records.where("record_no = 1").withColumn("start", F.lit(9_999_999).cast("long"))
    found = {(r["file_id"], r["start"]): r["status"] for r in warc_fixity.audit(records, bad.unionByName(extra)).collect()}
    want = {(r["file_id"], r["start"]): "missing" if r["record_no"] % 9 == 4 else "corrupt" for r in records.where("record_no % 9 in (4, 5)").collect()}
    want |= {(r["file_id"], 9_999_999): "extra" for r in records.where("record_no = 1").collect()}
    assert found == want


def test_read_warc(spark, tmp_path):
    import gzip

    rec = lambda u, b: f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: {u}\r\nContent-Length: {len(b)}\r\n\r\n".encode() + b + b"\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(rec("u1", b"one\r\n\r\ntwo") + rec("u2", b""))
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(rec("u3", b"x")) + gzip.compress(rec("u4", b"yy")))
    got_ = sorted((r["url"], bytes(r["body"])) for r in warc_fixity.read_warc(spark, str(tmp_path)).collect())
    assert got_ == [("u1", b"one\r\n\r\ntwo"), ("u2", b""), ("u3", b"x"), ("u4", b"yy")]


def test_license_rules(spark):
    mit = " ".join([license_scan.SENTENCES["mit_grant"][0] + ".", license_scan.SENTENCES["mit_keep"][0] + ".", license_scan.SENTENCES["as_is"][0] + "."])
    bsd = ".\n".join(license_scan.SENTENCES[k][0].upper() for k in ("bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse"))
    rows = [(1, mit), (2, bsd), (3, "Hello. Licensed under CC BY-NC 4.0.\nReleased under the MIT License!"), (4, None), (5, ""), (6, "the mit license is nice"), (3, "No licence")]
    found = sorted((r["doc_id"], tuple(r["licences"])) for r in license_scan.license_scan(frame(spark, rows)).collect())
    assert found == [(1, ("MIT",)), (2, ("BSD-3-Clause",)), (3, ()), (3, ("CC-BY-NC-4.0", "MIT")), (4, ()), (5, ()), (6, ())]


def test_sentencepiece_parity_and_round_trip(spark, data):
    raw = sentencepiece_tokens.model_bytes(spark)
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_proto=raw)
    odd = ["  a  b ", "\ta\nb", "é ｆｕｌｌ ①", "", "   ", "a​b", "▁x", "<s> hi </s>", "\x00a", "😀  ", "aaaa" * 50, None, "x" * 20000]
    rows = list(enumerate(odd)) + [(100 + i, r["text"]) for i, r in enumerate(spark.read.parquet(f"{data}/documents.parquet").limit(60).collect())]
    out = {r["doc_id"]: r for r in sentencepiece_tokens.encode(frame(spark, rows), raw).collect()}
    for i, t in rows:
        assert list(out[i]["ids"]) == (library.encode(t) if t else []), repr(t)
        assert out[i]["parity"] and (out[i]["round_trip"] or "▁" in (t or ""))
    back = {r["doc_id"]: r["text"] for r in sentencepiece_tokens.decode(sentencepiece_tokens.encode(frame(spark, rows), raw), raw).collect()}
    assert all(back[i] == (t or "") for i, t in rows if "▁" not in (t or ""))


def test_unigram_model_is_rebuilt():
    """A small unigram model written by hand as protobuf: both libraries agree on its ids."""
    import struct

    import sentencepiece

    def field(number, kind, value):
        return bytes([number << 3 | kind]) + (bytes([len(value)]) + value if kind == 2 else value)

    def piece(text, score, kind=1):
        body = field(1, 2, text.encode()) + field(2, 5, struct.pack("<f", score)) + (field(3, 0, bytes([kind])) if kind != 1 else b"")
        return field(1, 2, body)

    raw = piece("<unk>", 0, 2) + piece("<s>", 0, 3) + piece("</s>", 0, 3)
    for text, score in [("▁", -3.0), ("▁ab", -2.0), ("a", -4.0), ("b", -4.1), ("ab", -3.2), ("c", -5.0), ("bc", -3.5), ("▁a", -3.7)]:
        raw += piece(text, score)
    raw += field(2, 2, field(3, 0, b"\x01")) + field(3, 2, field(1, 2, b"identity") + field(3, 0, b"\x01") + field(4, 0, b"\x00"))
    library, codec = sentencepiece.SentencePieceProcessor(model_proto=raw), sentencepiece_tokens.Codec(raw)
    for text in ("abc ab", "a b c", "abcabc", "cab bca"):
        assert codec.encode([text])[0][0].tolist() == library.encode(text), text


def test_language_id(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    held = language_id.held_out("doc_id", 4, 2)
    model = language_id.learn(docs.where(~held))
    out = language_id.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(held)
    n, right = out.count(), out.where("lang = lang_pred").count()
    assert n > 20 and right / n > 0.95
    odd = frame(spark, [(1, None), (2, ""), (3, "123 !!"), (4, "the"), (4, "the"), (None, "der die das")])
    found = sorted(((r["doc_id"] or 0), r["lang_pred"], r["score"]) for r in language_id.predict(odd, model).collect())
    assert [f[1] for f in found if f[0] in (1, 2, 3)] == ["und"] * 3 and all(0 <= f[2] <= 1 for f in found)
    nothing = language_id.learn(docs.where("false"))
    assert {r["lang_pred"] for r in language_id.predict(odd, nothing).collect()} == {"und"}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in docs.select("doc_id", held.alias("held_out")).collect())


def test_quality(spark):
    """sf0.01 has enough labels: the held-out fold is told apart; odd rows get scores."""
    import os

    big = os.environ.get("TESTDATA_DIR", "/root/testdata") + "/sf0.01"
    out = quality.op6_quality_classifier(spark, big).join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id").where("held_out")
    n, right = out.count(), out.where("predicted = quality").count()
    assert n > 40 and right / n > 0.9
    model = quality.learned(spark, big)
    odd = frame(spark, [(1, None), (2, ""), (3, "ok " * 9000), (None, "x")])
    found = quality.predict(odd, model).collect()
    assert len(found) == 4 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in found)
    none = quality.learn(odd.select("doc_id", "text"), spark.createDataFrame([], "doc_id long, label int"))
    assert {r["score"] for r in quality.predict(odd, none).collect()} == {0.5}


@pytest.mark.parametrize("name", ["join", "substring", "lines", "topk", "wu", "licence", "tokens", "warc"])
def test_empty_tables(spark, name):
    none = frame(spark, [(1, "x")]).where("false")
    bench = spark.createDataFrame([], "item_id long, text string")
    run = {
        "join": lambda: ngram_join.ngram_jaccard_join(none), "substring": lambda: substring_dedup.substring_dedup(none), "lines": lambda: line_dedup.rewritten(none),
        "topk": lambda: topk_search.search(topk_search.stored(topk_search.index(none)), topk_search.query_terms(none)), "wu": lambda: decontamination.contaminated(none, bench),
        "licence": lambda: license_scan.license_scan(none), "tokens": lambda: sentencepiece_tokens.encode(none, sentencepiece_tokens.model_bytes(spark)),
        "warc": lambda: warc_fixity.audit(*[warc_fixity.laid_out(spark.createDataFrame([], "page_id long, url string, html string"))] * 2),
    }
    assert run[name]().count() == 0


def test_null_ids(spark):
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (None, None), (None, "only here it is said")]
    out = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in ngram_join.ngram_jaccard_join(frame(spark, rows)).collect()}
    assert out == {(None, 3): 3, (3, 3): 3, (None, 0): None, (None, 2): None} or len(out) == 4
    assert substring_dedup.substring_dedup(frame(spark, rows)).count() == 4
    assert line_dedup.rewritten(frame(spark, rows)).count() == 4


def test_kernel_hashes_are_by_content():
    import pyarrow as pa

    from recallgrid.llm.kernel import SPACED as MEMBER
    from recallgrid.llm.kernel import grams, runs_hash, slices, words

    texts = ["aa bb", None, "", " bb\taa ", "x" * 70000 + " aa", "é é"]
    seen = {}
    for limit in (1, 50, 1 << 20):
        for i, j, data, off in slices(pa.array(texts), limit):
            s, e, row = words(data, off, MEMBER)
            for a, b, r, h in zip(s, e, row, runs_hash(data, s, e)):
                w = bytes(data[a:b])
                assert w in texts[i + r].encode() and seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen) == 4
    h = np.arange(20, dtype=np.uint64)
    for n in (1, 2, 3, 7, 20, 21):
        assert len(grams(h, n)) == max(0, 20 - n + 1)
    assert grams(np.array([5, 1, 2, 3, 1, 2, 3], np.uint64), 3)[1] == grams(np.array([5, 1, 2, 3, 1, 2, 3], np.uint64), 3)[4]
