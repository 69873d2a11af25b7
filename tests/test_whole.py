"""Queries do the whole job: no row, pair or text is left out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from recallgrid.operators import entity, extras, lifecycle, vector
from recallgrid.plans import catalogue
from test_oracles import rows

QUERIES, ORACLES = catalogue.queries(), catalogue.oracle_sql()


@pytest.mark.parametrize("cell_rows", [3, 1000])
def test_cross_pairs_by_brute_force(spark, cell_rows):
    rng = np.random.default_rng(4)
    v = [(i, [float(x) for x in rng.integers(-2, 3, 3 + (i % 9 == 0))], i % 3 if i % 11 else None) for i in range(40)] + [(100, [0.0] * 3, 7), (101, [1.0] * 3, 8), (102, None, 9), (103, [2.0] * 3, 7)]
    frame = spark.createDataFrame(v, "vec_id long, embedding array<float>, label int")
    want = {}
    for a, x, g in v:
        for b, y, h in v:
            if a < b and None not in (x, y, g, h) and g != h and len(x) == len(y) and any(x) and any(y):
                s = np.dot(x, y) / (np.linalg.norm(x) * np.linalg.norm(y))
                if s >= 0.55:
                    want[a, b] = round(float(s), 6)
    got = {(r["a"], r["b"]): round(r["score"], 6) for r in lifecycle.cross_pairs(frame, 0.55, "vec_id", "label", cell_rows).collect()}
    assert got == want and (101, 103) in got


def naive_communities(edges):
    """Greedy modularity over the whole graph, all pairs looked at for each merge."""
    weight, total = {}, sum(edges.values())
    degree, members = {}, {}
    for (a, b), w in edges.items():
        weight[a, b] = w / (2 * total)
        for n in (a, b):
            degree[n] = degree.get(n, 0.0) + w / (2 * total)
            members[n] = [n]
    while weight:
        best, a, b = max((2 * (z - degree[p] * degree[q]), -p, -q) for (p, q), z in weight.items())
        a, b = -a, -b
        if best <= 1e-12:
            break
        degree[a] += degree.pop(b)
        members[a] += members.pop(b)
        for (p, q), z in list(weight.items()):
            if b in (p, q):
                del weight[p, q]
                n = p if q == b else q
                if n != a:
                    weight[min(a, n), max(a, n)] = weight.get((min(a, n), max(a, n)), 0.0) + z
    return {i: min(group) for group in members.values() for i in group}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_communities_use_the_whole_graphs_weight(spark, seed):
    rng = np.random.default_rng(seed)
    edges = {}
    for part, (n, m) in enumerate([(40, 90), (25, 30), (6, 9), (2, 1), (30, 200)]):
        for a, b in rng.integers(0, n, (m, 2)):
            if a != b:
                edges[100 * part + int(min(a, b)), 100 * part + int(max(a, b))] = float(rng.integers(1, 5))
    frame = spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "from_id long, to_id long, weight double")
    assert {r["id"]: r["cluster"] for r in extras.communities(frame, 1000).collect()} == naive_communities(edges)


@pytest.mark.parametrize("shape", ["star", "ring"])
def test_communities_lose_no_node(spark, shape):
    n = 5000
    edges = [(0, i, 1.0) for i in range(1, n + 1)] if shape == "star" else [(i, (i + 1) % n, 1.0) for i in range(n)]
    frame = spark.createDataFrame(edges, "from_id long, to_id long, weight double")
    nodes = spark.createDataFrame([(i,) for i in (*range(n), 9001, 9002, 9002)], "id long")
    got = [(r["id"], r["cluster"]) for r in extras.communities(frame, nodes=nodes).collect()]
    assert sorted(i for i, _ in got) == [*range(n + (shape == "star")), 9001, 9002]
    sizes = {}
    for i, c in got:
        sizes.setdefault(c, []).append(i)
    assert max(map(len, sizes.values())) <= extras.CLUSTER_CAP and all(c == min(m) for c, m in sizes.items()) and sizes[9001] == [9001]


def test_communities_keep_large_components_whole(spark):
    ids = [int(i) for i in np.random.default_rng(5).permutation(2101)]
    frame = spark.createDataFrame([(a, b, 1.0) for a, b in zip(ids, ids[1:])], "from_id long, to_id long, weight double")
    got = {r["id"]: r["cluster"] for r in extras.communities(frame, 10_000).collect()}
    assert len(got) == 2101
    assert sum(got[a] == got[b] for a, b in zip(ids, ids[1:])) == 2101 - len(set(got.values()))  # each is one run of the chain
    edges = {(min(a, b), max(a, b)): 1.0 for a, b in zip(ids, ids[1:])}
    assert got == naive_communities(edges)


@pytest.mark.parametrize("name,table,change", [
    ("content_dedup", "documents", lambda t: "The same opening of all texts. " + t),
    ("event_sentences", "conversations", lambda t: "nothing is said for a long time, for a very long time here. Anna released it on Friday! " + t),
])
def test_what_comes_after_a_prefix_counts(spark, data, tmp_path, name, table, change):
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings", "conversations"):
        df = pd.read_parquet(f"{data}/{t}.parquet")
        if t == table:
            df["text"] = [change(x or "") for x in df["text"]]
        df.to_parquet(tmp_path / f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    have = rows(QUERIES[name](spark, str(tmp_path)).toPandas())
    assert have == rows(con.execute(ORACLES[name]).df()) != rows(QUERIES[name](spark, data).toPandas())


def test_coalescing_meets_all_pairs_of_a_block(spark):
    rng = np.random.default_rng(9)
    names = ["acme corporation", "acme corporations", "corporation acme", "acme", "acmes", "beta industries of the north", "beta industries of the south", "beta industry of the north"]
    for _ in range(60):
        base = list(names[int(rng.integers(0, 8))] + " " + "".join("abc"[i] for i in rng.integers(0, 3, 12)))
        for _ in range(int(rng.integers(0, 4))):
            base[int(rng.integers(5, len(base)))] = "xyz "[int(rng.integers(0, 4))]
        names.append("".join(base))
    frame = spark.createDataFrame(list(enumerate(names)), "id long, name string")
    vectors = vector.hash_embedding(frame.toDF("doc_id", "text")).toDF("id", "embedding")
    x = frame.withColumn("g", entity.block_key(F.col("name"))).join(vectors, "id")
    a, b = x.toDF("a", "na", "g", "ea"), x.toDF("b", "nb", "g", "eb")
    every = a.join(b, "g").where("a < b").select("a", "b", entity.token_sort_ratio(F.col("na"), F.col("nb")).alias("r"), vector.cosine(F.col("ea"), F.col("eb")).alias("c")).collect()
    assert (0, 1) in {(r["a"], r["b"]) for r in every if r["r"] >= 90}
    for fuzzy in (90, 75):
        assert {(r["a"], r["b"]) for r in entity.coalesce_candidates(frame, fuzzy).collect()} == {(r["a"], r["b"]) for r in every if r["r"] >= fuzzy}
    got = {(r["a"], r["b"]): r["band"] for r in entity.coalesce_candidates(frame, vectors=vectors).collect()}
    edge = {(r["a"], r["b"]) for r in every if r["r"] < 90 and abs(r["c"] - 0.8) < 1e-9}
    assert set(got) - edge == {(r["a"], r["b"]) for r in every if r["r"] >= 90 or r["c"] >= 0.8} - edge
    assert all(got[r["a"], r["b"]] == "review" for r in every if (r["a"], r["b"]) in got and r["r"] < 95)


def test_copies_of_a_name_are_one_class_and_no_pair_is_lost(spark):
    from recallgrid.operators.vector import hash_embedding

    names = ["large ring", "large rings", "Large ring", "large  bolt", "old plate", "9 lives", " ", None, "old_plate 1", "old_plate 2"]
    rows = [(k, n) for k, n in enumerate(names * 4)]
    frame = spark.createDataFrame(rows, "id long, name string")
    embed = lambda df: hash_embedding(df.toDF("doc_id", "text")).toDF("id", "embedding")
    every = {(r["a"], r["b"]): (r["ratio"], r["band"]) for r in entity.coalesce_candidates(frame, vectors=embed(frame)).collect()}
    got = {(r["a"], r["b"]): (r["ratio"], r["band"]) for r in entity.coalesce_classes(frame, embed=embed).collect()}
    head = {b: a for (a, b), (ratio, _) in got.items() if rows[a][1] == rows[b][1]}
    assert len(head) == 7 * 3 and len(got) < len(every) / 4
    of = lambda i: head.get(i, i)
    assert got == {k: v for k, v in every.items() if of(k[0]) == k[0] and (of(k[1]) in k)}
    spread = {(a, b): got[min(of(a), of(b)), max(of(a), of(b))] if of(a) != of(b) else (100.0, "merge") for a in range(len(rows)) for b in range(a + 1, len(rows)) if (of(a) == of(b) and a in (*head, *head.values())) or (min(of(a), of(b)), max(of(a), of(b))) in got and of(a) != of(b)}
    assert spread == every
