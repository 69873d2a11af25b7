"""Odd tables for every corpus operator and pipeline stage: clashing names, other ids, very long texts, nulls, ties, nothing."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from recallgrid.llm import buckets, decontamination, kernel, language_id, license_scan, line_dedup, ngram_join, quality, sentencepiece_tokens, substring_dedup, topk_search, warc_fixity

CLASHING = ["_id", "_gone", "_near", "_lines", "_removed", "_node", "_wm_hits", "_wm_found", "_wm_n_words", "_Lines", "keys", "gone", "copies", "copy_of", "found", "rank", "number", "so_far"]
WORDS = " ".join(f"w{i}" for i in range(60))
LINE = "one two three four five six seven eight nine"
ROWS = [
    (1, f"{LINE}\nalpha"), (2, f"{LINE}\nbeta"), (3, WORDS), (4, WORDS + " end"), (5, None), (6, ""), (7, " \n\t"), (1, f"{LINE}\nalpha"), (None, WORDS), (8, "tail " + WORDS), (9, WORDS), (None, None),
]
ITEM = " ".join(f"w{i}" for i in range(12))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)


@pytest.fixture(scope="module")
def clashing(docs):
    taken = {c.lower() for c in docs.columns}
    for c in CLASHING:
        if c.lower() not in taken:
            taken.add(c.lower())
            docs = docs.withColumn(c, F.lit(c))
    return docs


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([("b1", ITEM), (None, ITEM), ("b2", None)], "item_id string, text string")


def bag(df, columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_columns_may_have_any_names(spark, docs, clashing, benchmark):
    added = ["lines_here", "removed_here"]
    assert bag(line_dedup.rewritten(clashing, columns=added), ["doc_id", "text", *added]) == bag(line_dedup.rewritten(docs, columns=added), ["doc_id", "text", *added])
    for f in (lambda t: ngram_join.one_of_each(t, 5, 80), lambda t: decontamination.clean(t, benchmark)):
        got = f(clashing)
        assert got.columns == clashing.columns and bag(got, docs.columns) == bag(f(docs), docs.columns)
        assert {r["_id"] for r in got.collect()} <= {"_id"}
    for f in (ngram_join.ngram_jaccard_join, substring_dedup.substring_dedup):
        have = f(clashing)
        assert bag(have, have.columns) == bag(f(docs), have.columns)
    with pytest.raises(ValueError, match="already has columns"):
        line_dedup.rewritten(clashing)
    with pytest.raises(ValueError, match="already has columns"):
        decontamination.contaminated(clashing, benchmark)


def test_ids_have_to_be_whole_numbers_where_they_are_packed(spark):
    named = spark.createDataFrame([("a", WORDS), ("b", WORDS)], "doc_id string, text string")
    for f in (substring_dedup.substring_dedup, line_dedup.rewritten, topk_search.index):
        with pytest.raises(TypeError, match="whole number"):
            f(named)
    small = spark.createDataFrame([(1, WORDS), (2, WORDS)], "doc_id int, text string")
    assert bag(substring_dedup.substring_dedup(small), ["doc_id", "n_removed"]) == [(1, 0), (2, 60)]
    assert bag(line_dedup.rewritten(small), ["doc_id", "_removed"]) == [(1, 0), (2, 1)]


def test_repeated_rows_and_ties(spark, docs):
    kept = bag(ngram_join.one_of_each(docs, 5, 80), ["doc_id", "text"])
    assert kept == sorted([(1, f"{LINE}\nalpha"), (2, f"{LINE}\nbeta"), (3, WORDS), (5, None), (6, ""), (7, " \n\t"), (None, None)], key=str)
    lines = {(r["doc_id"], r["text"]) for r in line_dedup.rewritten(docs).collect()}
    assert (2, "beta") in lines and (1, f"{LINE}\nalpha") in lines and (5, None) in lines and (9, "") in lines


def test_texts_longer_than_a_slice(spark, benchmark):
    block = " ".join(f"x{i}" for i in range(2000))
    long = "\n".join(f"line {i} {block[i % 50 : i % 50 + 400]} {i}" for i in range(4000)) + "\n" + WORDS
    assert len(long) > kernel.SLICE_BYTES
    rows = [(1, long), (2, long), (3, WORDS), (4, "short")]
    big = spark.createDataFrame(rows, "doc_id long, text string")
    n = len(long.split())
    assert bag(substring_dedup.substring_dedup(big), ["doc_id", "n_words", "n_removed"]) == [(1, n, 0), (2, n, n), (3, 60, 60), (4, 1, 0)]
    assert bag(ngram_join.ngram_jaccard_join(big).select("doc_id", "component_id"), ["doc_id", "component_id"]) == [(1, 1), (2, 1), (3, 3), (4, 4)]
    assert {r["doc_id"]: r["_removed"] for r in line_dedup.rewritten(big).collect()}[2] == 4001
    hits = {r["doc_id"]: len(r["_wm_hits"]) for r in decontamination.contaminated(big, benchmark).collect()}
    assert hits == {1: 6, 2: 6, 3: 6, 4: 0}
    encoded = {r["doc_id"]: r for r in sentencepiece_tokens.encode(big, sentencepiece_tokens.model_bytes(spark)).collect()}
    assert encoded[1]["parity"] and encoded[1]["ids"] == encoded[2]["ids"] and len(encoded[1]["ids"]) > n
    best = bag(topk_search.search(topk_search.stored(topk_search.index(big)), topk_search.query_terms(big.where("doc_id = 3"))), ["doc_id", "rank"])
    assert best[0] == (1, 2) or (3, 1) in best
    assert {r["doc_id"] for r in license_scan.license_scan(big).collect()} == {1, 2, 3, 4}
    model = {"langs": [], "orders": {0: {}}, "log10": None}
    assert {r["lang_pred"] for r in language_id.predict(big, model).collect()} == {"und"}
    assert quality.predict(big, {"share": 0.25}).where("predicted = 0").count() == 4


def test_empty_tables(spark, benchmark, data):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    for df in (
        ngram_join.ngram_jaccard_join(none), substring_dedup.substring_dedup(none), line_dedup.rewritten(none), decontamination.contaminated(none, benchmark), license_scan.license_scan(none),
        sentencepiece_tokens.encode(none, sentencepiece_tokens.model_bytes(spark)), topk_search.search(topk_search.stored(topk_search.index(none)), topk_search.query_terms(none)), warc_fixity.laid_out(pages), quality.predict(none, {"share": 0.5}),
    ):
        assert df.count() == 0
    records = warc_fixity.stored(warc_fixity.laid_out(pages))
    assert warc_fixity.audit(records, records).count() == 0
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, data)
        assert out.count() == 0 and (name == "tokens" or out.columns == none.columns)
    some = spark.createDataFrame(ROWS, "doc_id long, text string")
    assert decontamination.clean(some, benchmark.limit(0)).count() == len(ROWS)


def test_stages_take_nulls_ties_and_repeats(spark, data):
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in ROWS]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("_removed", F.lit("mine"))
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        out = stage(spark, docs, data)
        assert out.columns == docs.columns
        got = [tuple(r) for r in out.collect()]
        assert {t for i, t, *_ in got if i in (5, 6)} == {None, ""} and {r[-1] for r in got} == {"mine"}
    tokens = corpus_pipeline.tokens(spark, docs, data)
    assert tokens.count() == len(ROWS) and tokens.where("not parity").count() == 0


def test_pages_that_differ_only_in_where_parts_end(spark):
    rows = [(1, "a|b", "c"), (1, "a", "b|c"), (1, "a", "b|c"), (None, "a", "b|c"), (1, None, None), (1, "", "")]
    records = warc_fixity.laid_out(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert sorted(r["copies"] for r in records.collect()) == [1, 1, 2, 2]


def test_records_that_claim_one_place(spark):
    a = [(0, 0, "x"), (0, 0, "y"), (0, 5, "z")] + [(1, 7, f"r{i}") for i in range(500)]
    frame = lambda rows: spark.createDataFrame(rows, "file_id long, start long, record string")
    assert warc_fixity.audit(frame(a), frame(a[::-1])).count() == 0
    changed = [(0, 0, "x"), (0, 0, "x"), (0, 5, "z")] + a[3:-1]
    assert bag(warc_fixity.audit(frame(a), frame(changed)), ["file_id", "start", "status"]) == [(0, 0, "corrupt"), (1, 7, "corrupt")]


def test_packing_keeps_every_record():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(1)
    keys, owners = rng.integers(0, 1 << 63, 3000).astype(np.uint64), rng.integers(0, 50, 3000)
    packer = buckets.Packer(7, False)
    for i in range(0, 3000, 100):
        packer.add(keys[i : i + 100], owners[i : i + 100], i % 3, keys[i : i + 100], by_owner=i % 2 == 0)
    table = pa.Table.from_batches([*packer.full(), *packer.rest()])
    k, o, _ = buckets.unpack(table, narrow=False)
    assert sorted(zip(k.tolist(), o.tolist())) == sorted(zip(keys.tolist(), owners.tolist())) and not list(packer.rest())
    assert sorted(buckets.unpack_extras(table).tolist()) == sorted(keys.tolist())
