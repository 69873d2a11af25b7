"""Range and as-of joins against plain loops; long and short intervals, hot keys, ties, nulls."""

import random

from recallgrid.operators import temporal


def test_range_join_equals_a_loop(spark):
    rng = random.Random(1)
    hot = lambda: 1 if rng.random() < 0.4 else rng.randrange(2, 9)
    points = [(hot(), k, rng.choice([None, rng.uniform(-500, 5000), float(rng.randrange(50))])) for k in range(400)]
    ranges = [(hot(), k, low, low + rng.choice([0, 1, 3.5, 60, 700, 100_000, -1])) for k in range(150) for low in [float(rng.randrange(-600, 5000))]] + [(1, 999, None, 5.0), (None, 998, 0.0, 9.0)]
    p = spark.createDataFrame(points, "k int, p int, at double")
    r = spark.createDataFrame(ranges, "k int, r int, low double, high double")
    want = sorted((a, b) for k, a, at in points for g, b, low, high in ranges if k == g and None not in (at, low, high) and low <= at <= high)
    for width in (0.5, 60.0, 1e6):
        assert sorted((x["p"], x["r"]) for x in temporal.range_join(p, r, ["k"], "at", "low", "high", width).collect()) == want
    assert len(want) > 500 and temporal.range_join(p, r.limit(0), ["k"], "at", "low", "high").collect() == []


def test_a_range_is_in_few_bins(spark):
    r = spark.createDataFrame([(1, 1, 0.0, 1e9), (1, 2, 5.0, 5.0)], "k int, r int, low double, high double")
    p = spark.createDataFrame([(1, 7, 5.0)], "k int, p int, at double")
    out = temporal.range_join(p, r, ["k"], "at", "low", "high", 1.0)
    assert sorted(x["r"] for x in out.collect()) == [1, 2]  # a billion bins of the narrowest width would not end


def test_asof_join_equals_a_loop(spark):
    rng = random.Random(2)
    key = lambda: rng.choice([1, 1, 1, 2, 3, None])
    left = [(key(), k, rng.choice([None, float(rng.randrange(300))])) for k in range(300)]
    right = [(key(), float(rng.randrange(300)), k) for k in range(120)] + [(1, None, 500)]
    l_df = spark.createDataFrame(left, "k int, id int, at double")
    r_df = spark.createDataFrame(right, "k int, seen double, v int")
    for width in (7.0, 1000.0):
        for within in (None, 20.0):
            want = set()
            for k, i, at in left:
                ok = [(s, v) for g, s, v in right if g is not None and g == k and at is not None and s is not None and s <= at and (within is None or s >= at - within)]
                want.add((i, *(max(ok) if ok else (None, None))))
            got = temporal.asof_join(l_df, r_df, ["k"], "at", "seen", ["v"], width, within)
            rows = got.collect()
            assert len(rows) == len(left) and {(x["id"], x["seen"], x["v"]) for x in rows} == want
