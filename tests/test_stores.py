"""Batch work on stores, by literal rows."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from recallgrid.operators import stores
from recallgrid.plans import catalogue


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_adjacent_turns_are_linked_within_their_conversation(spark):
    t = spark.createDataFrame([(1, "a", 0), (2, "a", 2), (3, "a", 1), (4, "b", 0), (5, None, 1), (6, "b", None)], "id int, conv string, turn int")
    assert rows(stores.link_adjacent(t, "id", "conv", "turn"), "from_id", "to_id") == [(1, 3), (3, 2)]
    assert stores.link_adjacent(t.limit(0), "id", "conv", "turn").count() == 0


@pytest.mark.parametrize("cell_rows", [7, 1000])
def test_knn_by_brute_force(spark, cell_rows):
    rng = np.random.default_rng(2)
    v = [(i, [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(40)] + [(100, [0.0] * 4), (101, None), (102, [1.0, 1.0]), (103, [1.0, 1.0])]
    want = []
    for a, x in v:
        found = []
        for b, y in v:
            if a != b and x and y and len(x) == len(y) and any(x) and any(y):
                s = float(np.dot(x, y) / (np.linalg.norm(x) * np.linalg.norm(y)))
                if s >= 0.3:
                    found.append((-round(s, 9), b))
        want += [(a, b) for _, b in sorted(found)[:3]]
    got = stores.knn_graph(spark.createDataFrame(v, "id long, embedding array<float>"), 3, 0.3, cell_rows=cell_rows)
    scores = {(r["from_id"], r["to_id"]): r["score"] for r in got.collect()}
    assert len(scores) == len(want) and len(set(scores) ^ set(want)) <= 4  # ties within rounding may differ
    assert (102, 103) in scores and (103, 102) in scores


def test_variant_copies(spark):
    items = spark.createDataFrame([(1, "a", False), (2, "a", True), (3, None, False)], "id int, variant string, is_deleted boolean")
    vectors = spark.createDataFrame([(1, "m", 5), (1, "k", 9), (3, "m", 1)], "id int, model string, x int")
    copied, v = stores.copy_variant(items, vectors, "a", "b")
    assert rows(copied, "variant") == [("b",)] and rows(v, "model", "x") == [("k", 9)] and rows(copied, "id") == rows(v, "id")
    with pytest.raises(ValueError, match="has rows already"):
        stores.copy_variant(items, vectors, "b", "a")


def test_titles(spark):
    cases = {"": "", "  <task-notification> <b>\n\n first  line\t here \nsecond": "<b>", "<x>\n\n  one\n two": "one", "a" * 120: "a" * 100 + "…", "word " * 30: ("word " * 20).strip() + "…", "x" * 40 + " " + "y" * 90: "x" * 40 + " " + "y" * 59 + "…"}
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, c string")
    assert [r[0] for r in df.orderBy("i").select(stores.derive_title(F.col("c"))).collect()] == list(cases.values())


def queue(spark):
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    return spark.createDataFrame(
        [(1, "g1", 2, "s", at(5), None, None), (2, "g2", 0, "s", at(9), None, None), (3, "g3", 0, "s", at(7), "old", None), (4, "g4", 5, "s", at(1), None, None), (5, "g5", 0, "t", at(0), None, None)],
        "id int, group_key string, attempts int, stage string, enqueued_at timestamp, last_error string, last_attempt_at timestamp",
    )


def test_queues(spark):
    q = queue(spark)
    assert [r["id"] for r in stores.queue_pop(q, "s", 2).collect()] == [3, 2]
    assert stores.queue_depth(q, "s").first()["n"] == 3 and stores.queue_depth(q, "none").first()["n"] == 0
    failed = spark.createDataFrame([(2, "x" * 900), (2, "a"), (77, "b")], "id int, error string")
    left = stores.queue_settle(q, q.where("id = 1"), failed)
    assert rows(left, "id", "attempts") == [(2, 1), (3, 0), (4, 5), (5, 0)]
    assert {r["id"]: r["last_error"] for r in left.collect()}[2] == "x" * 500


def test_claims_are_released(spark):
    at = lambda h: dt.datetime(2024, 1, 25, h)
    g = spark.createDataFrame([("a", "in_progress", at(1), "t", "r1"), ("b", "in_progress", at(11), "t", "r2"), ("c", "success", at(1), "t", "r1"), ("d", "in_progress", None, "t", None)], "group_key string, status string, claimed_at timestamp, claim_token string, enrich_run_id string")
    now = "2024-01-25 12:00:00"
    state = lambda df: [r["status"][0] for r in df.orderBy("group_key").collect()]
    assert state(stores.release_claims(g, run_id="r1")) == ["p", "i", "s", "i"]
    assert state(stores.release_claims(g, older_than=120, now=now)) == ["p", "i", "s", "i"]
    assert state(stores.release_claims(g, everything=True)) == ["p", "p", "s", "p"]
    done = spark.createDataFrame([("a", "done_text"), ("a", "done_empty"), ("b", "failed")], "group_key string, result string")
    out = stores.release_claims(g, everything=True, results=done)
    assert state(out) == ["i", "p", "s", "p"] and out.columns == g.columns
    assert [r["claim_token"] for r in out.orderBy("group_key").collect()] == ["t", None, "t", None]
    with pytest.raises(ValueError, match="exactly|one of"):
        stores.release_claims(g, run_id="r", everything=True)


def test_routes(spark):
    q = spark.createDataFrame([(1, "s", "t", 5, None, "pending"), (2, "s", "t", 5, "x", "failed"), (3, "s", "t", 50, None, "pending"), (4, "s", "t", None, None, "pending"), (5, "s", "t", 5, None, "success"), (6, "o", "t", 5, None, "pending")], "id int, source_variant string, target_variant string, content_size_k int, send_to string, status string")
    sent = lambda **k: [r["send_to"] for r in stores.assign_route(q, "s", "t", k.pop("to", "g"), **k).orderBy("id").collect()]
    assert sent() == ["g", "g", "g", "g", None, None]
    assert sent(max_size=9, only_unassigned=True) == ["g", "x", None, None, None, None]
    assert sent(to=None, include_completed=True) == [None] * 6


def test_fact_backlog(spark):
    items = spark.createDataFrame([(1, "note", None, False, "a"), (2, "note", "v", False, "b"), (3, "fact_enriched", None, False, "c"), (4, "note", None, False, "d"), (5, "note", None, True, "e"), (6, "note", None, False, "f"), (7, "note", None, False, "g")], "id int, type string, variant string, is_deleted boolean, content string")
    edges = spark.createDataFrame([(3, 4, "references"), (3, 1, "related")], "from_id int, to_id int, relationship_type string")
    q = spark.createDataFrame([(6, 4), (7, 5)], "memory_id int, attempts int")
    assert rows(stores.fact_backlog(items, edges, q), "id") == [(1,), (6,)]
    assert rows(stores.fact_backlog(items, edges, q, variants=["v"]), "id") == [(1,), (2,), (6,)]


def test_distillation_gathers_results_and_steps(spark):
    t = dt.datetime(2024, 1, 1)
    tasks = spark.createDataFrame([(1, "completed", None, 10, t), (2, "completed", None, 20, dt.datetime(2024, 1, 24, 12)), (3, "pending", None, 30, t), (4, "completed", t, 30, t), (5, "completed", None, None, t)], "id int, state string, deleted_at timestamp, result_memory_id int, completed_at timestamp")
    items = spark.createDataFrame([(10, "c", "T", "done", 9, False), (11, "c", None, "second", 3, False), (12, "c", "S", "first", 1, False), (13, "c", "S", "gone", 2, True), (20, None, "U", "alone", 1, False)], "id int, conversation_id string, title string, content string, created_at int, is_deleted boolean")
    got = lambda **k: [(r["task_id"], r["source_ids"], r["texts"]) for r in stores.distill_candidates(tasks, items, "2024-01-25 00:00:00", **k).orderBy("task_id").collect()]
    assert got() == [(1, [10, 12, 11], ["- RESULT: T: done", "- STEP: S: first", "- STEP: : second"])]
    assert [g[0] for g in got(stale_days=0)] == [1, 2] and got(threshold=2) == [] and [g[1] for g in got(steps=1)] == [[10, 12]]


def test_stores_are_split_and_synced(spark):
    source = spark.createDataFrame([(1, "chat", "x"), (2, "note", "y"), (3, "chat", "z"), (4, None, "w")], "id int, type string, extra string")
    target = spark.createDataFrame([(3, "chat", 7)], "id int, type string, other int")
    left, right = stores.split_store(source, target, F.col("type") == "chat", "id")
    assert rows(left, "id") == [(2,), (4,)] and sorted(rows(right, "id", "other")) == [(1, None), (3, 7)]
    at = lambda day: dt.datetime(2024, 1, day)
    a = spark.createDataFrame([(1, at(5), "a"), (2, at(1), "a"), (3, at(9), "a")], "id int, ts timestamp, v string")
    b = spark.createDataFrame([(1, at(6), "b"), (2, at(1), "b"), (4, at(2), "b")], "id int, ts timestamp, v string")
    mine, theirs = stores.sync_sets(a, b, "id", "ts", pushed="2024-01-04 00:00:00", pulled="2024-01-03 00:00:00")
    assert rows(mine, "id", "v") == [(1, "b"), (2, "a"), (3, "a")] and rows(theirs, "id", "v") == [(1, "b"), (2, "b"), (3, "a"), (4, "b")]
    mine, theirs = stores.sync_inserts(a, b, "id", "ts", pushed="2024-01-06 00:00:00")
    assert rows(mine, "id", "v") == [(1, "a"), (2, "a"), (3, "a"), (4, "b")] and rows(theirs, "id", "v") == [(1, "b"), (2, "b"), (3, "a"), (4, "b")]


def test_browsing(spark):
    t = dt.datetime(2024, 1, 1)
    items = spark.createDataFrame([(1, "note", "A Title", "x", 0.5, t, t, False), (2, "Notes", "b", "has TITLE", 0.9, t, t, False), (3, "fact", None, "title", 0.1, t, t, False), (4, "note", "title", "x", 1.0, t, t, True), (5, "", "t", None, 0.2, t, t, False), (6, "message", "t", "t", 0.2, t, t, False)], "id int, type string, title string, content string, importance double, created_at timestamp, updated_at timestamp, is_deleted boolean")
    ids = lambda df: [r["id"] for r in df.collect()]
    assert ids(stores.kb_browse(items)) == [2, 1, 5, 6, 3]
    assert ids(stores.kb_browse(items, "NOTE")) == [2, 1] and ids(stores.kb_browse(items, '"note"')) == [1] and ids(stores.kb_browse(items, "*ot*s")) == [2]
    assert ids(stores.kb_browse(items, search="title")) == [2, 1, 3] and ids(stores.kb_browse(items, search="'title'", limit=9)) == [3]
    assert [r["type"] for r in stores.item_types(items).collect()] == ["Notes", "fact", "message", "note"]
    assert ids(stores.list_knowledge(items)) == [1, 2, 3, 5] and ids(stores.list_knowledge(items, type_="note%")) == [1, 2] and ids(stores.list_knowledge(items, type_="'note'")) == [1]


def test_scopes(spark):
    items = spark.createDataFrame([("/crew", ["a", "b"], 1), ("/crew/x/y", ["a"], 2), ("/crewz", [], 3), (None, ["a"], 4), ("/crew/x", None, 5), ("/", ["c"], 6)], "scope string, categories array<string>, created_at int")
    assert rows(stores.category_counts(items, "/crew/"), "category", "n") == [("a", 2), ("b", 1)]
    assert rows(stores.category_counts(items), "category", "n") == [("a", 3), ("b", 1), ("c", 1)]
    assert rows(stores.child_scopes(items, "/crew"), "scope") == [("/crew/x",)] and rows(stores.child_scopes(items), "scope") == [("/crew",), ("/crewz",)]
    assert stores.scope_count(items, "crew").first()[:] == (3, 1, 5) and stores.scope_count(items, " / ").first()["n"] == 6


def test_reviews(spark):
    at = lambda day: dt.datetime(2024, 1, day)
    members = spark.createDataFrame(
        [(1, "synthesis", True, [at(1), at(20)], False, 0.5), (2, "synthesis", True, None, True, None), (3, "synthesis", False, [at(1)], False, 0.9), (4, "note", True, None, False, 0.9), (5, "synthesis", True, [at(1)], False, 0.7)],
        "id int, type string, restricted boolean, erased_at array<timestamp>, pinned boolean, importance double",
    )
    edges = spark.createDataFrame([(1, 4, "consolidates"), (1, 99, "consolidates"), (1, 3, "related"), (5, 4, "distills_from"), (5, 3, "distills_from")], "from_id int, to_id int, relationship_type string")
    got = rows(stores.derivability_review(members, edges, "2024-02-10 00:00:00"), "position", "id", "surviving_sources", "erasures", "age_days", "overdue", "derivable_candidate")
    assert got == [(1, 2, 0, 0, None, False, False), (2, 5, 2, 1, 40.0, True, True), (3, 1, 1, 2, 21.0, False, True)]


def test_a_review_keeps_pages_and_turns_apart(spark, tmp_path):
    turns = [(c, t, "user", "x") for c in (2, 30000, 30001) for t in (0, 1)]  # 2's first turn was 30000 once
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = rows(catalogue.queries()["derivability_review"](spark, str(tmp_path)), "id", "surviving_sources")
    assert got == [(2, 1), (30000, 0)]


def test_activity(spark):
    log = spark.createDataFrame([(dt.datetime(2024, 1, 1, 5, 6, 7), "p", "ab <think>why"), (dt.datetime(2024, 1, 1), "q", "x" * 600)], "timestamp timestamp, query string, response string")
    assert rows(stores.activity_view(log), "time", "project", "preview", "full_size") == [("00:00:00", "q", "x" * 500 + "...", 600), ("05:06:07", "p", "why...", 13)]
