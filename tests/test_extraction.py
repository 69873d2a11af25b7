"""Typed mentions, relations and the walk: literal rows, and the definition tried pair by pair."""

import random
import re

import pytest

from recallgrid.operators import extraction as E

STORY = "Ann Lee lives in Roanoke. She joined Acme Corp\nand uses rust and C++, not SQLite. The Valley Inn is far. ann knows Rust"


def test_mentions_of_a_story():
    got = {(n, k, at) for n, k, at, _ in E.mentions(STORY)}
    assert got == {
        ("rust", "topic", 56), ("Rust", "topic", STORY.rindex("Rust")), ("C++", "topic", STORY.index("C++")), ("SQLite", "topic", STORY.index("SQLite")),
        ("Ann Lee", "person", 0), ("Roanoke", "place", 17), ("She", "person", 26), ("Acme Corp", "organization", 37), ("The Valley Inn", "place", STORY.index("The Valley")),
    }
    assert {n for n, *_ in E.mentions("The Rustic and RUST", kinds=frozenset(["topic"]))} == {"RUST"}
    assert E.mentions(None) == E.mentions("") == [] and E.mentions("the", {}) == []
    assert E.mentions("An OR The", {}) == [("An OR The", "person", 0, 0.7)]


def test_relations_of_a_story():
    got = {(s, t, p) for s, t, p, _ in E.relations(STORY, E.mentions(STORY))}
    assert {("Ann Lee", "Roanoke", "located_in"), ("She", "Acme Corp", "works_at")} <= got
    assert ("Ann Lee", "Acme Corp", "works_at") in got and ("Ann Lee", "SQLite", "works_at") not in got
    far = "Bo lives in " + "x" * 99 + " Lake Tahoe"
    assert E.relations(far, E.mentions(far)) == []
    near = far.replace("xx", "x", 1)
    assert E.relations(near, E.mentions(near)) == [("Bo", "Lake Tahoe", "located_in", 0.75)]


def by_definition(text, found):
    """Each pair of names with each way in which a cue may stand between them."""
    out = set()
    for predicate, kind, verbs, left, right, both, sure in E.RELATIONS:
        for p in (m[0] for m in found if m[1] == "person"):
            for t in (m[0] for m in found if m[1] == kind):
                ways = [(re.escape(p), re.escape(t), left)] + ([(re.escape(t), re.escape(p), left)] if both else [(E.PRONOUN, re.escape(t), E.PRONOUN_FAR)])
                if any(re.search(f"{a}.{{0,{far}}}?(?:{verbs}).{{0,{right}}}?{b}", text, re.I) for a, b, far in ways):
                    out.add((p, t, predicate, sure))
    return sorted(out)


def test_relations_equal_the_definition():
    rng = random.Random(4)
    words = ["Ann", "Bo Dent", "Ann Lee", "Roanoke", "Lake Tahoe", "Acme Corp", "GitHub", "Rust", "python", "C++", "lives in", "moved\nto", "works at", "joined", "knows", "is learning", "he", "They", "then", "\n", "x" * 30, ".", "writes", "hired by"]
    several = 0
    for _ in range(300):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(30)))
        found = E.mentions(text)
        want = by_definition(text, found)
        several += len(want) > 1
        assert E.relations(text, found) == want, text
    assert several > 50


def test_table_functions_in_sql(spark):
    E.register(spark)
    docs = spark.createDataFrame([(1, STORY), (2, None), (3, ""), (1, STORY)], "id long, text string")
    rows = spark.sql("SELECT id, m.* FROM {docs}, LATERAL entity_mentions(text) m", docs=docs).collect()
    assert sorted((r["id"], r["name"], r["kind"], r["at"]) for r in rows) == sorted([(1, *m[:3]) for m in E.mentions(STORY)] * 2)
    related = spark.sql("SELECT id, r.* FROM {docs}, LATERAL entity_relations(text) r", docs=docs).collect()
    assert sorted(tuple(r)[1:] for r in related) == sorted(E.relations(STORY, E.mentions(STORY)) * 2)
    parts = spark.sql("SELECT s.path, s.chunk FROM {docs}, LATERAL markdown_sections(text) s WHERE id = 4", docs=spark.createDataFrame([(4, "# A\none\n## B\ntwo")], "id long, text string")).collect()
    assert [r["path"] for r in parts] == ["a", "a/b"]


@pytest.fixture(scope="module")
def graph(spark):
    names = [(1, "Rust", "topic"), (2, "Rust Lang", "topic"), (3, "trust fund", "org"), (4, "Ann", "person"), (5, "Bob", "person"), (6, "User", "person"), (7, "rusty 7", "topic"), (8, "rusty 8", "topic"), (9, "rusty 9", "topic"), (10, "Cy", "person"), (11, "Di", "person")]
    edges = [(4, 1, "likes"), (5, 4, "knows"), (10, 5, "knows"), (11, 10, "knows"), (4, 6, "knows"), (6, 11, "knows")]
    return spark.createDataFrame(names, "entity_id long, name string, entity_type string"), spark.createDataFrame(edges, "from_entity long, to_entity long, predicate string")


def walk(graph, *a, **b):
    return {(r["entity_id"], r["hop"]) for r in E.entity_walk(*graph, *a, **b).collect()}


def test_names_start_exactly_or_alike(graph):
    assert walk(graph, ["Rust"], depth=0) == {(1, 0)}
    assert walk(graph, ["rust"], depth=0) == {(1, 0), (2, 0), (3, 0), (7, 0), (8, 0)}  # five at most, smaller ids first
    assert walk(graph, ["rust"], depth=0, types=["topic"]) == {(1, 0), (2, 0), (7, 0), (8, 0), (9, 0)}
    assert walk(graph, ["rust", "Ann"], depth=0, stoplist=[" RUST "]) == {(2, 0), (3, 0), (4, 0), (7, 0), (8, 0), (9, 0)}
    assert walk(graph, ["nobody"]) == set()


def test_walks_follow_predicates_and_leave_the_stoplist_out(graph):
    assert walk(graph, ["Rust"], depth=2) == {(1, 0), (4, 1), (5, 2), (6, 2)}
    assert walk(graph, ["Rust"], depth=9) == {(1, 0), (4, 1), (5, 2), (6, 2), (10, 3), (11, 3)}  # three hops at most
    assert walk(graph, ["Rust"], depth=3, predicates=["likes"]) == {(1, 0), (4, 1)}
    assert walk(graph, ["Rust"], depth=3, stoplist=["user"]) == {(1, 0), (4, 1), (5, 2), (10, 3)}
    assert walk(graph, ["Rust"], depth=3, nodes=3) == {(1, 0), (4, 1), (5, 2)}
    assert walk(graph, ["rust"], depth=1, nodes=3) == {(1, 0), (2, 0), (3, 0), (7, 0), (8, 0)}  # the start counts whole


def test_items_of_a_walk(spark, graph):
    mentions = spark.createDataFrame([(100, 4), (101, 6), (100, 1), (102, 11)], "memory_id long, entity_id long")
    got = E.walked_items(E.entity_walk(*graph, ["Rust"], depth=1), mentions)
    assert [r["memory_id"] for r in got.orderBy("memory_id").collect()] == [100]
