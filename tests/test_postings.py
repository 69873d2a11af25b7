"""The stored inverted index against a scan of the texts, and against plain Python."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from recallgrid.operators import keyword, postings
from recallgrid.operators.postings import KeywordIndex, bucket_of, bucket_of_word

WORDS = "alpha beta gamma the theory then licence license élan über data_1 x 日本 a1".split()


def texts(n=120, seed=2):
    rng = random.Random(seed)
    rows = [(k, rng.choice([" ", ", ", "\n", "—"]).join(rng.choice(WORDS).title() if rng.random() < 0.2 else rng.choice(WORDS) for _ in range(rng.randrange(25)))) for k in range(n)]
    return [*rows, (n, None), (n + 1, ""), (n + 2, "the " * 3000), (n + 3, "-- !")]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(texts(), "id long, content string").repartition(3)


def plain(rows, terms, prefix=False, phrase=False, every=True):
    """(id -> bm25) of the rows that match."""
    words = {i: re.findall(r"[^\W]+", (t or "").lower()) for i, t in rows}
    same = (lambda w, t: w.startswith(t)) if prefix else (lambda w, t: w == t)
    tf = {i: [sum(same(w, t) for w in ws) for t in terms] for i, ws in words.items()}
    n, mean = len(words), sum(map(len, words.values())) / len(words)
    df = [sum(v[k] > 0 for v in tf.values()) for k in range(len(terms))]
    out = {}
    for i, ws in words.items():
        hit = (all if every else any)(tf[i])
        if phrase:
            hit = hit and any(ws[p : p + len(terms)] == terms for p in range(len(ws)))
        if hit:
            out[i] = -sum(math.log(1 + (n - df[k] + 0.5) / (df[k] + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(ws) / mean)) for k, f in enumerate(tf[i]) if f)
    return out


QUERIES = [("license", "hybrid", {"terms": ["license"], "prefix": True}), ("t", "hybrid", {"terms": ["t"], "prefix": True}), ("the theory", "hybrid", {"terms": ["the", "theory"]}), ("alpha beta license", "fts5", {"terms": ["alpha", "beta", "license"], "every": False}), ('"alpha beta"', "hybrid", {"terms": ["alpha", "beta"], "phrase": True}), ('"the the the"', "hybrid", {"terms": ["the", "the", "the"], "phrase": True}), ("élan 日本", "hybrid", {"terms": ["élan", "日本"]}), ("nothing here", "hybrid", {"terms": ["nothing", "here"]}), ("!!", "hybrid", None)]


def equal(got, want):
    found = {r["id"]: r["bm25"] for r in got.collect()}
    assert found.keys() == want.keys()
    assert all(math.isclose(found[i], want[i], rel_tol=1e-12) for i in want)


def test_index_equals_plain_python_and_the_scan(spark, items, tmp_path):
    index = KeywordIndex.build(items, f"{tmp_path}/i")
    for raw, mode, want in QUERIES:
        q = keyword.compile_query(raw, mode)
        equal(index.matches(q), plain(texts(), **want) if want else {})
        scan = keyword.keyword_search(items, raw, 1000, mode)
        by_index = keyword.keyword_search(items, raw, 1000, mode, index=index)
        assert by_index.columns == scan.columns
        assert [(r["id"], r["content"], round(r["bm25"], 9)) for r in by_index.collect()] == [(r["id"], r["content"], round(r["bm25"], 9)) for r in scan.collect()]


def test_only_the_buckets_of_the_terms_are_read(spark, items, tmp_path):
    index = KeywordIndex.build(items, f"{tmp_path}/i")
    folders = lambda df: {re.search(r"bucket=(\d+)", f)[1] for f in df.select(F.input_file_name().alias("f")).distinct().toPandas()["f"]}
    read = index._read("postings")
    used = folders(read)
    assert len(used) > 5
    plan = index.postings(["license"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1][:120] and "PushedFilters" in plan and "EqualTo(term,license)" in plan
    assert all(r["b"] == bucket_of_word(r["w"]) for r in spark.createDataFrame([(w,) for w in WORDS], "w string").select("w", bucket_of(F.col("w")).alias("b")).collect())
    mine = read.where(F.col("bucket") == bucket_of_word("license"))
    assert len(folders(mine)) == 1
    assert {r["term"] for r in mine.select("term").distinct().collect()} >= {"license", "licence"}


def test_rows_are_added_and_removed(spark, items, tmp_path):
    index = KeywordIndex.build(items.where("id < 60"), f"{tmp_path}/i")
    before = {f for f in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{tmp_path}/i/postings").select("path", "modificationTime").collect()}
    assert index.add(items) == 64 and index.add(items) == 0
    after = {f for f in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{tmp_path}/i/postings").select("path", "modificationTime").collect()}
    assert before < after  # what was there isn't written again
    for raw, mode, want in QUERIES[:6]:
        equal(index.matches(keyword.compile_query(raw, mode)), plain(texts(), **want))
    gone = spark.createDataFrame([(5,), (7,), (5,), (-1,)], "id long")
    assert index.remove(gone) == 2 and index.remove(gone) == 0
    left = [r for r in texts() if r[0] not in (5, 7)]
    equal(index.matches(keyword.compile_query("the theory")), plain(left, ["the", "theory"]))
    changed = spark.createDataFrame([(5, "the theory of licences"), (6, "not taken: it is there")], "id long, content string")
    assert index.add(changed) == 1
    now = [*left, (5, "the theory of licences")]
    for packed in (index, index.compact(f"{tmp_path}/j")):
        equal(packed.matches(keyword.compile_query("the theory")), plain(now, ["the", "theory"]))
        equal(packed.matches(keyword.compile_query("lic")), plain(now, ["lic"], prefix=True))


def test_a_generation_that_was_broken_off_does_not_count(spark, items, tmp_path, monkeypatch):
    index = KeywordIndex.build(items.where("id < 60"), f"{tmp_path}/i")

    def lost(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(KeywordIndex, "_sum", lost)
        with pytest.raises(OSError, match="lost"):
            index.add(items)
    equal(index.matches(keyword.compile_query("the theory")), plain(texts()[:60], ["the", "theory"]))
    assert index.add(items) == 64
    equal(index.matches(keyword.compile_query("the theory")), plain(texts(), ["the", "theory"]))


def test_a_word_of_most_rows_is_spread_over_files(spark, tmp_path, monkeypatch, request):
    from recallgrid.operators import postings

    monkeypatch.setattr(postings, "SALT_BYTES", 400)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled"))
    docs = spark.range(0, 400, 1, 8).select("id", F.lit("the same words").alias("content"))
    index = KeywordIndex.build(docs, f"{tmp_path}/i", buckets=2)
    files = index.postings(["the"]).select(F.input_file_name().alias("f")).distinct().count()
    assert files > 1
    assert Counter(r["bm25"] for r in index.matches(keyword.compile_query("the same")).collect()).most_common(1)[0][1] == 400


def test_an_empty_table(spark, items, tmp_path):
    index = KeywordIndex.build(items.where("false"), f"{tmp_path}/i")
    assert index.matches(keyword.compile_query("the")).collect() == []
    assert index.add(items) == len(texts())
    equal(index.matches(keyword.compile_query("the theory")), plain(texts(), ["the", "theory"]))


def test_lists_are_put_together_in_little_memory():
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(1)
    words = pa.array([f"w{k}" for k in range(500)]).take(pa.array(rng.integers(0, 500, 1_000_000)))
    batch = pa.record_batch({"id": pa.array(np.arange(5000)), "tokens": pa.ListArray.from_arrays(pa.array(np.arange(5001) * 200, pa.int32()), words)})
    tracemalloc.start()
    out = list(postings._lists(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(len(b["positions"].flatten()) for b in out) == 1_000_000
    assert peak < 55_000_000  # of numpy; 55 bytes a word
