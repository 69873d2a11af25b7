"""Operators on literal rows: exact numbers and cases the tables don't have."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from recallgrid.functions import text as X
from recallgrid.operators import documents, entity, graph, keyword, lifecycle, predicates, ranking, routing, vector
from recallgrid.sources import transfer

ODD = ['a "b" OR c', "gpt-4o AND x", "é NOT à", "", "!!!", "it's NEAR 5", "😀 ok", "don't_stop"]


def col(spark, values, name="x", kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"{name} {kind}")


def test_sanitize_odd_strings(spark):
    got = [r[0] for r in col(spark, ODD).select(X.sanitize(F.col("x"))).collect()]
    assert got[1].split() == ["gpt", "4o", "x"] and "é" in got[2] and "NOT" not in got[2] and got[3] == "" and got[4] == "" and "don" in got[7]


@pytest.mark.parametrize("raw,kind,terms", [('"Big Cat"', "phrase", ["big", "cat"]), ("cat", "all", ["cat"]), ("a OR b", "all", ["a", "b"])])
def test_compile(raw, kind, terms):
    q = keyword.compile_query(raw)
    assert (q.ok, q.kind, q.terms) == (True, kind, terms)


def test_compile_empty():
    assert not keyword.compile_query("!!! OR").ok


def test_redaction_counts_and_order(spark):
    s = "key sk-ant-" + "a" * 24 + " mail me@x.org, ghp_" + "b" * 36 + " 555-123-4567"
    text, count = X.redact(F.col("x"))
    out, n = col(spark, [s]).select(text, count).first()
    assert n == 4 and out == "key [REDACTED:api_keys] mail [REDACTED:pii], [REDACTED:github_tokens] [REDACTED:pii]"


def test_strip_framing(spark):
    got = col(spark, ["a\n\n\n<system-reminder>x\ny</system-reminder>\n\n\nb", "plain"]).select(X.strip_framing(F.col("x"))).collect()
    assert [r[0] for r in got] == ["a\n\nb", "plain"]


def test_cosine_zero_and_mismatch(spark):
    df = spark.createDataFrame([([1.0, 0.0], [2.0, 0.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 1.0])], "a array<float>, b array<float>")
    assert [round(r[0], 6) for r in df.select(vector.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0]


def test_maxpool_without_anchors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert vector.maxpool(v, v.where("false")).first()["score"] == -1.0


def test_hybrid_score_short_content(spark):
    got = spark.range(1).select(ranking.hybrid_score(F.lit(0.5), F.lit(-1.0), F.lit(5), F.lit(1.0), F.lit(0.4))).first()[0]
    assert abs(got - ((0.5 * 0.7 + 0.5 * 0.3) * 0.3 + 0.15 + 0.06)) < 1e-9


def test_mmr_against_loop(spark):
    rng = np.random.default_rng(3)
    pool = [(0, i, float(rng.random()), [float(x) for x in rng.normal(size=4)] if i % 5 else None) for i in range(30)]
    got = ranking.mmr(spark.createDataFrame(pool, "query int, id long, score double, embedding array<double>"), 8).orderBy("position").collect()
    left = sorted(pool, key=lambda r: (-r[2], r[1]))
    cos = lambda a, b: 0.0 if a is None or b is None else float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))
    chosen = [left.pop(0)]
    while len(chosen) < 8:
        best = max(left, key=lambda r: 0.7 * r[2] - 0.3 * max(cos(r[3], c[3]) for c in chosen))
        left.remove(best)
        chosen.append(best)
    assert [r["id"] for r in got] == [c[1] for c in chosen]


def test_displacement_guard_swaps(spark):
    rows = [(0, 1, 0.9, True), (0, 2, 0.5, False), (0, 3, 0.4, False)]
    got = ranking.displacement_guard(spark.createDataFrame(rows, "query int, id long, score double, expansion boolean")).orderBy("position").collect()
    assert [r["id"] for r in got] == [2, 1, 3] or [r["id"] for r in got] == [2, 3, 1]


def test_components_and_khop_small(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (7, 8)], "from_id long, to_id long")
    assert {r["id"]: r["component"] for r in graph.components(e).collect()} == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7}
    assert graph.components(e.where("false")).count() == 0
    assert {(r["id"], r["hop"]) for r in graph.khop(e, spark.createDataFrame([(1,)], "id long"), 3).collect()} == {(2, 1), (3, 1)}


def test_components_random(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]
    parent = list(range(60))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    used = {x for a, b in edges for x in (a, b) if a != b}
    got = {r["id"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "from_id long, to_id long")).collect()}
    assert got == {x: find(x) for x in used}


def test_greedy_dedup_chain(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (1, 5), (4, 5)], "a long, b long")
    assert {r["id"]: r["parent"] for r in lifecycle.greedy_dedup(pairs).collect()} == {2: 1, 4: 3, 5: 1}


def test_confidence_caps(spark):
    rows = spark.createDataFrame([(0.95, 100.0, 0), (0.5, 0.0, 9), (0.4, 2.0, 1)], "p double, t double, n int")
    got = [round(r[0], 6) for r in rows.select(lifecycle.confidence(F.col("p"), F.col("t"), F.col("n"))).collect()]
    assert got == [1.0, 0.2, 0.4]


def test_prefix_lookup_is_ambiguous(spark):
    t = col(spark, ["abcdefgh1", "abcdefgh2", "zbcdefgh3"], "id")
    assert predicates.prefix_lookup(t, "abcdefgh", "id").count() == 0 and predicates.prefix_lookup(t, "zbcdefgh", "id").count() == 1


def test_as_of_is_half_open(spark):
    t = spark.sql("select * from values (timestamp'2024-01-01', timestamp'2024-01-02'), (timestamp'2024-01-02', null), (null, timestamp'2024-01-01') t(valid_from, valid_to)")
    assert t.where(predicates.as_of("2024-01-02 00:00:00")).count() == 1


def test_guards(spark):
    pairs = spark.createDataFrame([("run-k20", "run-k30"), ("entity row", "entity rows"), ("_hash", "hash")], "a string, b string")
    got = pairs.select(entity.numeric_collision(F.col("a"), F.col("b")), entity.underscore_collision(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in got] == [(True, False), (False, False), (False, True)]


def test_pack_paragraphs_limits():
    text = "\n\n".join(["x" * 900, "y" * 900, "z" * 100, " ".join(["word."] * 900)])
    got = documents.pack_paragraphs(text)
    assert all(len(c) <= 2400 + 302 for c in got) and "".join("".join(got).split()) == "".join(text.split())
    assert documents.pack_paragraphs("   ") == []


def test_resolve_temporal(spark):
    got = [r[0] for r in col(spark, ["yesterday", "2 weeks ago", "last monday", "never"]).select(routing.resolve_temporal(F.col("x"), F.lit("2024-01-15").cast("date"))).collect()]
    assert got == ["2024-01-14", "2024-01-01", "2024-01-08", None]


def test_merge_layers():
    assert routing.merge_layers({"k": 1, "w": 2}, {"w": 3}, {"k": None, "z": 4}) == {"k": 1, "w": 3, "z": 4}


def test_transcripts(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text(
        '{"type":"user","uuid":"1","sessionId":"s","timestamp":"t","message":{"role":"user","content":"hi"}}\n'
        '{"type":"assistant","uuid":"2","sessionId":"s","timestamp":"t","message":{"role":"assistant","model":"m","content":[{"type":"text","text":"a"},{"type":"tool","id":1},{"type":"text","text":"b"}],"usage":{"input_tokens":3,"output_tokens":4}}}\n'
        '{"type":"summary","uuid":"3"}\nnot json\n'
    )
    got = transfer.transcript_lines(spark, str(tmp_path / "a.jsonl")).orderBy("id").collect()
    assert [(r["id"], r["text"], r["tokens_out"]) for r in got] == [("1", "hi", None), ("2", "a\nb", 4)]
    (tmp_path / "b.json").write_text('{"sessionId":"q","messages":[{"id":"1","type":"user","content":"x"},{"id":"2","type":"gemini","content":[{"text":"y"}],"tokens":{"input":1,"output":2}}]}')
    got = transfer.transcript_sessions(spark, str(tmp_path / "b.json")).orderBy("id").collect()
    assert [(r["session"], r["role"], r["text"]) for r in got] == [("q", "user", "x"), ("q", "assistant", "y")]


def test_walk(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hello")
    (tmp_path / "b.bin").write_bytes(b"\x00\x01")
    (tmp_path / "skip.log").write_text("no")
    got = transfer.walk(spark, str(tmp_path), ["skip"]).collect()
    assert [r["text"] for r in got] == ["hello"]


def test_newer_wins_keeps_target_on_ties(spark):
    t = spark.sql("select * from values (1, 'a', timestamp'2024-01-01'), (2, 'b', null) t(k, v, at)")
    s = spark.sql("select * from values (1, 'x', timestamp'2024-01-01'), (2, 'y', timestamp'2024-01-01'), (3, 'z', null) t(k, v, at)")
    assert {r["k"]: r["v"] for r in transfer.newer_wins(t, s, ["k"], "at").collect()} == {1: "a", 2: "y", 3: "z"}


def test_rrf_is_order_free(spark):
    ch = [spark.createDataFrame(list(zip(p, (1, 2, 3))), "id long, rank int") for p in itertools.islice(itertools.permutations((1, 2, 3)), 2)]
    a, b = (sorted((r["id"], round(r["score"], 9)) for r in ranking.rrf(x).collect()) for x in (ch, ch[::-1]))
    assert a == b


def test_communities_of_two_cliques(spark):
    from recallgrid.operators import extras

    cliques = [(a, b, 1.0) for group in (range(5), range(10, 15)) for a in group for b in group if a < b]
    e = spark.createDataFrame([*cliques, (4, 10, 1.0), (20, 21, 2.0)], "from_id long, to_id long, weight double")
    got = {r["id"]: r["cluster"] for r in extras.communities(e).collect()}
    assert got == {**dict.fromkeys(range(5), 0), **dict.fromkeys(range(10, 15), 10), 20: 20, 21: 20}


def test_inference_defaults(spark):
    from recallgrid.operators import extras

    got = col(spark, ["claude-3", None, "llama-3", "zzz"]).select(extras.infer_provider(F.col("x"))).collect()
    assert [r[0] for r in got] == ["anthropic", "other", "local", "other"]
