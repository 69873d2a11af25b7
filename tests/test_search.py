"""The composed retrieval pipelines, against plain Python and literal rows."""

import math

import pytest
from pyspark.sql import functions as F

from recallgrid.operators import documents, keyword, ranking
from recallgrid.plans import catalogue, search


@pytest.fixture(scope="module")
def pool(spark, data):
    rows = ranking.candidates(spark, data).select("id", "content", "score", "cos", "bm25", "valid_from", "embedding", "lang").collect()
    return [r.asDict() for r in rows]


def cosine(a, b):
    n = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b)) / n if n else 0.0


def best(rows, key, n):
    return sorted(rows, key=lambda r: (-r[key], r["id"]))[:n]


def plain_dedup(rows, keep):
    seen, out = set(), []
    for r in best(rows, "score", len(rows)):
        k = (r["content"] or "").strip(" ")
        if k == "" or k not in seen:
            out.append(r)
        seen.add(k)
    return out[:keep]


def test_formatted_scores_without_diversity(spark, data, pool):
    hits = spark.createDataFrame([{k: r[k] for k in ("id", "content", "score", "valid_from", "embedding")} for r in pool])
    got = [(r["id"], r["position"]) for r in search.scored(hits, 5, diversify=False).orderBy("position").collect()]
    trimmed = {r["id"] for r in ranking.elbow_trim(hits.orderBy(F.desc("score"), "id").limit(60)).collect()}
    want = plain_dedup([r for r in best(pool, "score", 60) if r["id"] in trimmed], 15)[:5]
    assert got == [(r["id"], k) for k, r in enumerate(want, 1)]
    lines = search.formatted(spark.createDataFrame([(7, 0.51239, 1, "note", None, "keyword=0.1"), (8, 0.5, 2, None, "T", "")], "id long, score double, position int, type string, title string, reason string")).orderBy("position")
    assert [r["line"] for r in lines.collect()] == ["1. [7] score=0.5124  type: note  title: \n   Why: keyword=0.1", "2. [8] score=0.5000  type: unknown  title: T"]


def test_diverse_scores_follow_marginal_relevance(spark, pool):
    hits = spark.createDataFrame([{k: r[k] for k in ("id", "content", "score", "valid_from", "embedding")} for r in pool])
    got = [r["id"] for r in search.scored(hits, 5).orderBy("position").collect()]
    trimmed = {r["id"] for r in ranking.elbow_trim(hits.orderBy(F.desc("score"), "id").limit(60)).collect()}
    left = plain_dedup([r for r in best(pool, "score", 60) if r["id"] in trimmed], 15)
    chosen = [left.pop(0)]
    while left and len(chosen) < 5:
        values = [0.7 * r["score"] - 0.3 * max(cosine(r["embedding"], c["embedding"]) for c in chosen) for r in left]
        top = max(values)
        chosen.append(left.pop(next(k for k, v in enumerate(values) if v >= top - 1e-12)))
    assert got == [r["id"] for r in chosen]


def test_smart_expansion(spark):
    shape = "id long, score double, valid_from string"
    a, b = spark.createDataFrame([(1, 0.5, "2024-01-02"), (2, 0.4, "2024-01-01")], shape), spark.createDataFrame([(2, 0.9, "2024-01-01"), (3, 0.1, "2024-01-03")], shape)
    assert {r["id"]: round(r["score"], 6) for r in search.smart_expand(a, b).collect()} == {2: 0.9, 1: 0.55, 3: 0.2}
    assert {r["id"]: r["score"] for r in search.smart_expand(a.limit(1), a.limit(0)).collect()} == {1: 0.6}


def test_expansion_stays_in_scope_and_behind_the_guard(spark):
    hits = spark.createDataFrame([(1, 0.9), (2, 0.8)], "id long, score double")
    edges = spark.createDataFrame([(1, 3), (4, 2), (2, 5), (3, 6)], "from_id long, to_id long")
    rows = spark.createDataFrame([(3, 0.95, "agent"), (4, 0.7, "org"), (5, 0.1, "agent"), (6, 0.9, "agent")], "id long, score double, scope string")
    got = search.expanded(hits, edges, rows, "agent", 4).orderBy("position").collect()
    assert {r["id"] for r in got} == {1, 2, 3, 5}
    assert got[0]["id"] == 1  # an expansion doesn't take the first place, however good


def test_routed_search_by_plain_python(spark, data, pool):
    got = [(r["id"], round(r["score"], 9)) for r in catalogue.queries()["search_routed"](spark, data).collect()]
    fused = {}
    for r in best([{"id": p["id"], "score": p["cos"]} for p in pool], "score", 30) + best(pool, "score", 30):
        fused[r["id"]] = max(fused.get(r["id"], -9.0), r["score"])
    hits = dict(sorted(fused.items(), key=lambda x: (-x[1], x[0]))[:15])
    agent = {p["id"]: p["score"] for p in pool if p["lang"] == "en"}
    ids = {p["id"] for p in pool}
    near = {n for i in hits for n in (i - 1, i + 1) if (n in ids or n - 1 in ids) and n not in hits and n in agent}
    every = {**{n: agent[n] for n in near}, **hits}
    assert {i for i, _ in got} <= set(every)
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{data}/labels.parquet").where("toxic = 1").collect()}
    for i, score in got:
        assert score == pytest.approx(every[i] * (0.5 if i in toxic else 1.0), abs=1e-8)
    assert got == sorted(got, key=lambda x: (-x[1], x[0])) and 5 <= len(got) <= 15


def test_files_search_fuses_words_and_vectors(spark, data):
    got = [(r["id"], round(r["score"], 9)) for r in catalogue.queries()["files_search"](spark, data).collect()]
    docs = spark.read.parquet(f"{data}/documents.parquet").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    words = [r["id"] for r in keyword.keyword_search(docs, "license", 50).collect()]
    v = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()}
    near = sorted(v, key=lambda i: (-cosine(v[i], v[0]), i))[:50]
    score = {}
    for ranked in (words, near):
        for k, i in enumerate(ranked, 1):
            score[i] = score.get(i, 0.0) + 1 / (60 + k)
    assert got == [(i, round(s, 9)) for i, s in sorted(score.items(), key=lambda x: (-round(x[1], 12), x[0]))[:10]]
    assert documents.SECTION_MOST == 16_000
