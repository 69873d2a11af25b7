"""Pruned vector joins: measured recall, no wrong pair, hot buckets, exclusions."""

import itertools
import math

import numpy as np
import pytest

from recallgrid.operators import nearby


def rows_with_pairs(cosine, n=700, d=64, seed=1):
    rng = np.random.default_rng(seed)
    out = []
    for k in range(n):
        v = rng.normal(size=d)
        v /= np.linalg.norm(v)
        r = rng.normal(size=d)
        r -= r @ v * v
        out += [(2 * k, v.tolist(), 0, None), (2 * k + 1, (cosine * v + math.sqrt(1 - cosine**2) * r / np.linalg.norm(r)).tolist(), 0, None)]
    return out


SCHEMA = "id long, embedding array<double>, g int, f int"


@pytest.mark.parametrize("threshold, recall", [(0.9, 0.99), (0.85, 0.95)])
def test_recall_at_the_threshold(spark, threshold, recall):
    df = spark.createDataFrame(rows_with_pairs(threshold + 0.0005), SCHEMA)
    got = [(r["a"], r["b"]) for r in nearby.near_pairs(df, threshold, recall).collect()]
    assert len(got) == len(set(got)) and all(a % 2 == 0 and b == a + 1 for a, b in got)
    assert len(got) / 700 >= recall - 0.02 >= 0.9
    below = spark.createDataFrame(rows_with_pairs(threshold - 0.0005), SCHEMA)
    assert nearby.near_pairs(below, threshold, recall).collect() == []


def test_one_hot_bucket_gives_every_pair_once(spark):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=32)
    rows = [(k, (centre + rng.normal(size=32) * 0.02).tolist(), 0, k % 3 if k % 2 else None) for k in range(120)] + [(500, None, 0, 0), (501, [0.0] * 32, 0, 0), (502, [1.0], 0, 0), (503, [float("nan")] * 32, 0, 0), (504, centre.tolist(), 1, 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = sorted((a[0], b[0]) for a, b in itertools.combinations(rows[:120], 2) if a[3] is None or a[3] != b[3])
    for cell_rows in (2048, 25):
        got = sorted((r["a"], r["b"]) for r in nearby.near_pairs(df, 0.95, 0.999, cell_rows=cell_rows).collect())
        assert len(got) == len(set(got)) and set(got) <= set(want) and len(got) >= 0.999 * len(want)


def test_neighbours_by_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 48))
    rows = [(k, (base[k % 60] + rng.normal(size=48) * 0.15).tolist()) for k in range(300)]
    m = np.array([v for _, v in rows])
    m /= np.linalg.norm(m, axis=1)[:, None]
    s = m @ m.T
    want = set()
    for i in range(300):
        near = sorted((-s[i, j], j) for j in range(300) if j != i and s[i, j] >= 0.9)[:3]
        want |= {(i, j) for _, j in near}
    got = {(r["from_id"], r["to_id"]) for r in nearby.near_neighbours(spark.createDataFrame(rows, "id long, embedding array<double>"), 3, 0.9, 0.999).collect()}
    assert len(want) > 300 and len(got & want) / len(want) >= 0.99


def test_tables_follow_from_recall_and_low_thresholds_are_refused():
    assert nearby.tables_for(0.92, 10, 0.99) < nearby.tables_for(0.92, 16, 0.99) < nearby.tables_for(0.92, 16, 0.999)
    with pytest.raises(ValueError, match="compare all pairs"):
        nearby.tables_for(0.3, 10, 0.99)


def test_documents_of_one_model_and_different_files(spark):
    v = [1.0, 0.0]
    rows = [(1, v, "m", "a", None), (2, v, "m", "b", None), (3, v, "m", "b", 1), (4, v, "n", "c", None), (5, v, "m", "c", None), (6, [0.0, 1.0], "m", "d", None)]
    leaves = spark.createDataFrame(rows, "id long, embedding array<double>, model string, file string, evolved_from long")
    pending = spark.createDataFrame([(5, 2)], "a long, b long")
    got = sorted((r["a"], r["b"]) for r in nearby.document_pairs(leaves, pending).collect())
    assert got == [(1, 2), (1, 5), (3, 5)]
    assert nearby.document_pairs(leaves.limit(0), pending).collect() == []


def test_tables_do_not_grow_with_the_rows():
    """A vector is shuffled once for each table."""
    assert {nearby.tables_for(0.9, nearby.bits_for(n), 0.99) for n in (40_000, 400_000, 2_400_000)} == {14}
    assert nearby.cell_rows_for(40_000) == 2048 and nearby.cell_rows_for(2_400_000) > 2 * 2_400_000 >> nearby.bits_for(2_400_000)
