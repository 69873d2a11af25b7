"""Erasure, supersession, failed files and profiles: literal rows."""

from datetime import datetime

from recallgrid.operators import erasure
from recallgrid.plans import catalogue

AT = "2024-02-01 00:00:00"


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns or df.columns) for r in df.collect()), key=str)


def test_all_tables_of_a_store_are_cleared(spark):
    f = spark.createDataFrame
    store = {
        "items": f([(1, "u", False), (2, "v", False), (3, "v", False), (4, None, False), (5, "w", True)], "id long, user_id string, restricted boolean"),
        "vectors": f([(1,), (2,)], "memory_id long"), "history": f([(1,), (1,), (3,)], "memory_id long"),
        "edges": f([(2, 1, "consolidates"), (3, 1, "related"), (1, 4, "related"), (3, 2, "consolidates")], "from_id long, to_id long, relationship_type string"),
        "surface": f([(1, "u"), (2, "u"), (3, "v")], "memory_id long, user_id string"), "archive": f([(1, "x"), (90, "u"), (91, "v")], "id long, user_id string"),
        "members": f([(7, 1), (7, 2), (8, 3)], "run_id long, memory_id long"),
    }
    after = erasure.erase(store, f([("u",), ("u",), ("nobody",), (None,)], "user_id string"), AT)
    assert rows(after["items"]) == rows(f([(2, "v", True), (3, "v", False), (4, None, False), (5, "w", True)], store["items"].schema))
    assert rows(after["vectors"]) == [(2,)] and rows(after["history"]) == [(3,)]
    assert rows(after["edges"]) == [(3, 2, "consolidates")]
    assert rows(after["surface"]) == [(3, "v")] and rows(after["archive"]) == [(91, "v")]
    assert rows(after["members"]) == [(8, 3)] and rows(after["runs"], "run_id", "erased") == [(7, 1)]
    assert rows(after["requests"], "subject_id", "request_type", "status", "items_affected") == [("nobody", "forget", "completed", 0), ("u", "forget", "completed", 1)]
    assert set(erasure.erase({"items": store["items"]}, f([("u",)], "user_id string"), AT)) == {"items", "requests"}


def test_supersession_leaves_an_edge_and_history(spark):
    t = lambda k: datetime(2024, 1, k)
    items = spark.createDataFrame([(1, "one", False, None, None), (2, "two", False, t(2), None), (3, "three", True, t(3), None), (4, "new", False, None, None), (5, "newer", None, None, None)], "id long, content string, is_deleted boolean, valid_to timestamp, updated_at timestamp")
    pairs = spark.createDataFrame([(1, 5, t(9)), (1, 4, t(8)), (2, 4, t(8)), (3, 4, t(8)), (4, 4, t(8)), (77, 4, t(8))], "old_id long, new_id long, close_at timestamp")
    edges = spark.createDataFrame([(4, 2, "supersedes")], "from_id long, to_id long, relationship_type string")
    history = spark.createDataFrame([], "memory_id long, event string, prev_value string, new_value string, field string, actor_id string, created_at timestamp")
    after = erasure.mark_superseded(items, pairs, edges, history, AT, "me")
    assert rows(after["items"], "id", "is_deleted", "valid_to") == rows(spark.createDataFrame([(1, True, t(8)), (2, True, t(2)), (3, True, t(3)), (4, False, None), (5, None, None)], "id long, is_deleted boolean, valid_to timestamp"))
    assert rows(after["edges"]) == [(4, 1, "supersedes"), (4, 2, "supersedes")]
    assert rows(after["history"], "memory_id", "event", "prev_value", "new_value", "actor_id") == [(1, "supersede", "one", "4", "me"), (2, "supersede", "two", "4", "me")]
    every = erasure.mark_superseded(items, pairs, edges, history, AT, only_active=False)
    assert {r[0] for r in rows(every["history"], "memory_id")} == {1, 2, 3}


def test_failed_files_and_drifted_promotions(spark):
    f = spark.createDataFrame
    files = f([(1, "/a", None), (2, "/b", 3), (3, "/b", None)], "file_id long, path string, superseded_by long")
    leaves = f([(10, 1, "failed"), (11, 1, "done"), (12, 1, "failed"), (20, 2, "failed"), (30, 3, "done")], "leaf_id long, file_id long, status string")
    attempts = f([(10, "failed", "old", 1), (12, "failed", "new", 5), (11, "failed", "healed", 9), (10, "done", None, 7)], "leaf_id long, status string, error string, attempted_at int")
    assert rows(erasure.failed_files(leaves, attempts, files)) == [("/a", 2, 3, "new")]
    facts = f([(100, 2), (101, 1)], "fact_id long, file_id long")
    markers = f([(1, "m1", 100), (2, "m2", 20), (3, "m3", 2), (4, "m4", 101), (5, "m5", 3)], "marker_id long, promoted_to string, source long")
    assert rows(erasure.drifted_promotions(markers, files, leaves, facts)) == [(1, "m1", "/b"), (2, "m2", "/b"), (3, "m3", "/b")]


def test_profile_has_both_directions(spark):
    f = spark.createDataFrame
    entities = f([(1, "One"), (2, "Two")], "entity_id long, name string")
    relations = f([(1, 2, "knows"), (2, 1, "likes"), (1, 2, "knows"), (1, 3, "is")], "from_entity long, to_entity long, predicate string")
    mentions = f([(10, 1), (11, 1), (10, 1), (12, 2)], "memory_id long, entity_id long")
    items = f([(10, datetime(2024, 1, 1)), (11, datetime(2024, 1, 2)), (12, datetime(2024, 1, 3))], "memory_id long, created_at timestamp")
    got = erasure.entity_profile(entities, relations, mentions, items, 1).collect()[0]
    assert [tuple(x) for x in got["outgoing"]] == [("is", 3), ("knows", 2)] and [tuple(x) for x in got["incoming"]] == [("likes", 2)] and got["items"] == [11, 10]
    assert erasure.entity_profile(entities, relations, mentions, items, 2, 0).collect()[0]["items"] == []
    assert erasure.entity_profile(entities, relations, mentions, items, 9).collect() == []


def test_no_item_has_an_id_of_the_archive(spark, tmp_path):
    events = [(1, 7, "signup"), (2, 50, "signup"), (5_000_001, 50, "view")]  # the first one's archived id was 5000001 once
    spark.createDataFrame(events, "event_id long, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    left = {r["table"]: r["n"] for r in catalogue.queries()["gdpr_erase"](spark, str(tmp_path)).collect()}
    assert left["items"] == 1 and left["archive"] == 1
