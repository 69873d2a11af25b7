"""Cells where all pairs are looked at: what they hold, equal scores, blocks in shares, kinds of pairs."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from recallgrid.operators import lifecycle, stores


def cell(n, sides, groups=3):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(n, 8)).astype(np.float32)
    ids = np.arange(n)
    return pa.table({"id": ids, "embedding": pa.array(list(m)), "g": ids % groups, "share": ids % sides, "x": np.zeros(n, np.int64), "y": np.full(n, sides - 1)})


def most(run):
    tracemalloc.start()
    n = sum(len(t) for t in run())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return n, peak / 1e6


@pytest.mark.parametrize("sides", [1, 2])
def test_a_cell_holds_a_tile_of_scores(sides):
    rows = cell(20_000, sides)
    n, mb = most(lambda: lifecycle._pairs(rows, 0.97, True))
    assert n > 200 and mb < 60
    n, mb = most(lambda: stores._nearest(rows, 3, 0.5))
    assert n == 60_000 and mb < 60


@pytest.mark.parametrize("cell_rows", [90, 5000])
def test_copies_are_neighbours_by_id(spark, cell_rows):
    """Equal vectors have equal scores wherever they stand in a cell."""
    rng = np.random.default_rng(6)
    base = rng.normal(size=(7, 64))
    df = spark.createDataFrame([(k, base[k % 7].tolist()) for k in range(2700)], "id long, embedding array<float>")
    got = {}
    for r in stores.knn_graph(df, 3, 0.9, cell_rows=cell_rows).collect():
        got.setdefault(r["from_id"], []).append(r["to_id"])
    assert {k: sorted(v) for k, v in got.items()} == {k: [x for x in range(k % 7, 40, 7) if x != k][:3] for k in range(2700)}


@pytest.mark.parametrize("cell_rows", [4, None])
def test_kinds_by_brute_force(spark, cell_rows):
    rng = np.random.default_rng(8)
    titles, texts = ["a", "b", None], ["x", "y", "z", None]
    rows = [(k, k % 2 if k % 13 else None, rng.normal(size=4).tolist(), titles[k % 3], texts[k % 4] if k % 3 < 2 else None) for k in range(60)]
    want = set()
    for a, g, x, t, c in rows:
        for b, h, y, u, d in rows:
            s = np.dot(x, y) / (np.linalg.norm(x) * np.linalg.norm(y))
            if a < b and g is not None and g == h and s > 0.2:
                want.add((a, b, "supersede" if s > 0.4 and t is not None and t == u and c != d else "corroborate" if s >= 0.7 else "related"))
    items = spark.createDataFrame(rows, "id long, type int, embedding array<double>, title string, content string")
    found = lifecycle.contradictions(items, 0.2, 0.4, 0.7, cell_rows=cell_rows)
    assert {tuple(r) for r in found.collect()} == want and len({k for _, _, k in want}) == 3


def test_pairs_that_were_found_are_not_shuffled(spark):
    items = spark.range(10).select("id", F.lit(1).alias("type"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("embedding"), F.lit("t").alias("title"), F.col("id").cast("string").alias("content"))
    plan = lifecycle.contradictions(items)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan[: plan.index("MapInArrow")]
