"""Long chains, several types, repeated keys, files that aren't taken: literal rows and plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from recallgrid.operators import documents, entity, graph, lifecycle
from recallgrid.sources import transfer


def test_dependents_of_long_chains_and_cycles(spark):
    chain = [(k + 1, k) for k in range(30)] + [(0, 30)] + [(100, 101), (101, 100), (7, 7)]
    edges = spark.createDataFrame(chain, "from_id long, to_id long")
    seeds = spark.createDataFrame([(0,), (999,)], "id long")
    assert sorted(r["id"] for r in graph.dependents(edges, seeds).collect()) == list(range(1, 31))
    both = spark.createDataFrame([(100,), (2,)], "id long")
    assert sorted(r["id"] for r in graph.dependents(edges, both).collect()) == [0, 1, *range(3, 31), 101]


def plain_greedy(pairs):
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
    parent = {}
    for a in sorted(near):
        if a not in parent:
            for b in sorted(near[a]):
                parent.setdefault(b, a)
    return parent


def test_greedy_dedup_of_a_chain_of_300(spark):
    chain = [(k, k + 1) for k in range(300)]
    df = spark.createDataFrame(chain, "a long, b long")
    assert {r["id"]: r["parent"] for r in lifecycle.greedy_dedup(df).collect()} == plain_greedy(chain)


def test_greedy_dedup_by_tasks_and_in_rounds(spark):
    rng = random.Random(6)
    pairs = sorted({tuple(sorted(rng.sample(range(40 * g, 40 * g + 40), 2))) for g in range(4) for _ in range(12 * g + 12)})
    df = spark.createDataFrame(pairs, "a long, b long")
    want = plain_greedy(pairs)
    for most in (10**6, 20):
        assert {r["id"]: r["parent"] for r in lifecycle.greedy_dedup(df, component_pairs=most).collect()} == want
    assert lifecycle.greedy_dedup(df.limit(0)).collect() == []


def test_names_resolve_within_their_type(spark):
    names = spark.createDataFrame([("Foo", "a"), ("Foo", "b"), ("Foo", "c"), ("big red bus", "a"), ("big red bus", "b"), ("qq", "a")], "name string, type string")
    entities = spark.createDataFrame(
        [(1, "foo", "a", 1), (2, "foo", "b", 2), (3, "big red bus", "b", 3), (4, "big red bus co", "a", 4), (5, "bus red big", "a", 5), (6, "old", "a", -1)],
        "entity_id long, name string, entity_type string, created_at int",
    )
    got = {(r["name"], r["type"]): (r["entity_id"], r["how"]) for r in entity.resolve(names, entities, 0.7).collect()}
    assert got == {("Foo", "a"): (1, "exact"), ("Foo", "b"): (2, "exact"), ("big red bus", "b"): (3, "exact"), ("big red bus", "a"): (5, "fuzzy")}
    of_names = spark.createDataFrame([("qq", [1.0, 0.0]), ("Foo", [0.0, 1.0])], "name string, embedding array<double>")
    of_entities = spark.createDataFrame([(1, [0.96, 0.28]), (4, [0.96, -0.28]), (5, [0.0, 1.0]), (6, [1.0, 0.0])], "entity_id long, embedding array<double>")
    found = lambda **o: {(r["name"], r["type"]): (r["entity_id"], r["how"]) for r in entity.resolve(names, entities, 0.7, of_names, of_entities, **o).collect()}
    assert found() == got | {("qq", "a"): (6, "cosine")}
    assert found(newest=3) == got | {("qq", "a"): (4, "cosine")}  # 6 is too old; of 1 and 4, equally near, the newer
    assert found(newest=3, least=0.97) == got


def test_leaves_are_taken_in_order(spark):
    prior = spark.createDataFrame([("f", 0, "A"), ("f", 1, "B"), ("g", 0, "A"), ("g", 1, "A"), ("h", 0, "A")], "file string, part int, chunk string")
    new = spark.createDataFrame([("f", 0, "X"), ("f", 1, "A"), ("g", 0, "A"), ("g", 1, "A"), ("g", 2, "A"), ("i", 0, "A")], "file string, part int, chunk string")
    got = sorted((tuple(r) for r in documents.leaf_diff(prior, new, "file").collect()), key=str)
    assert got == sorted([("f", 0, "evolve", 0), ("f", 1, "evolve", 1), ("g", 0, "carry", 0), ("g", 1, "evolve", 1), ("g", 2, "new", None), ("i", 0, "new", None)], key=str)


def test_cut_sections_are_less_sure(spark):
    long = "\n\n".join(["x" * 7000] * 5)
    parts = documents.markdown_sections(f"# One\n{long}\n# Two\n{'y' * 17000}\n")
    assert [(p.path, p.sure) for p in parts] == [("one/part-1", 0.6), ("one/part-2", 0.6), ("one/part-3", 0.7), ("two", 1.0)]
    assert documents.markdown_sections("# A\nshort")[0].sure == 1.0


def test_repeated_incoming_keys_give_one_row(spark):
    stored = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    incoming = spark.createDataFrame([(1, "x"), (1, "x"), (3, "z"), (3, "z")], "id long, name string")
    assert sorted(tuple(r) for r in transfer.upsert(stored, incoming, ["id"]).collect()) == [(1, "x"), (2, "b"), (3, "z")]
    old = spark.createDataFrame([(1, 1.0, "2024-01-01", "agent")], "id long, v double, updated_at string, change_agent string")
    new = spark.createDataFrame([(1, 2.0, "2024-01-02", "agent"), (1, 3.0, "2024-01-03", "agent"), (2, 5.0, "2024-01-02", "agent"), (2, 4.0, "2024-01-01", "agent")], "id long, v double, updated_at string, change_agent string")
    assert sorted((r["id"], r["v"]) for r in transfer.sync_items(old, new, "id", ["v"]).collect()) == [(1, 3.0), (2, 5.0)]


def test_files_that_are_left_out_are_listed(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, content in {"a.txt": b"hello", "in/b.txt": b"x" * 200, "c.bin": b"a\0b", "d.txt": b"\xff\xfe", "e.log": b"no"}.items():
        (tmp_path / name).write_bytes(content)
    rows = {r["path"].rpartition("/")[2]: (r["length"], r["text"], r["left_out"]) for r in transfer.walk(spark, str(tmp_path), ["e.log"], most_bytes=100, listed=True).collect()}
    assert rows == {"a.txt": (5, "hello", None), "b.txt": (200, None, "large"), "c.bin": (3, None, "binary"), "d.txt": (2, None, "encoding")}


@pytest.mark.parametrize("share", [1, 2])
def test_contradictions(spark, share):
    rows = [(1, "t", [1.0, 0.0], "x", "one"), (2, "t", [0.98, 0.199], "x", "two"), (3, "t", [0.98, 0.199], "x", "one"), (4, "t", [0.8, 0.6], "y", "three"), (5, "u", [1.0, 0.0], "x", "four")]
    items = spark.createDataFrame(rows, "id long, type string, embedding array<double>, title string, content string").repartition(share)
    got = sorted(tuple(r) for r in lifecycle.contradictions(items).collect())
    assert got == [(1, 2, "supersede"), (1, 3, "corroborate"), (1, 4, "related"), (2, 3, "supersede"), (2, 4, "related"), (3, 4, "related")]
