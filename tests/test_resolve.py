"""Entities of names: sets of tokens, the newest by cosine, how names are dealt out."""

import numpy as np
import pytest

from recallgrid.operators import entity


def bags(rows):
    return {(r["name"], r["type"]): (r["entity_id"], r["how"]) for r in rows}


@pytest.mark.parametrize("share", [3, 20_000])
def test_resolve_by_brute_force(spark, monkeypatch, share):
    monkeypatch.setattr(entity, "SHARE_NAMES", share)
    rng = np.random.default_rng(3)
    words, types = ["a", "b", "c", "d"], ["p", "q"]
    e = [(k, " ".join(rng.choice(words, 3)), types[k % 2], -(k // 2)) for k in range(60)]
    names = [(" ".join(rng.choice(words, 4)).upper(), types[k % 2]) for k in range(30)] + [(x[1].upper(), x[2]) for x in e[:5]] + [(f"zz{k}", types[k % 2]) for k in range(20)]
    vectors = {k: [float(x) for x in rng.integers(-2, 3, 3 if k % 7 else 2)] for k in range(60)}
    of_names = {f"zz{k}": [float(x) for x in rng.integers(-2, 3, 3)] for k in range(18)}
    want = {}
    for name, t in set(names):
        mine = [x for x in e if x[2] == t]
        exact = [x[0] for x in mine if x[1] == name.lower()]
        w = set(name.lower().split())
        j = [(len(w & set(x[1].split())) / len(w | set(x[1].split())), -x[0]) for x in mine]
        near = []
        if name in of_names:
            q = np.array(of_names[name])
            for nth, x in enumerate(sorted(mine, key=lambda x: (-x[3], x[0]))[:10]):
                v = np.array(vectors[x[0]])
                if len(v) == len(q) and v.any() and q.any():
                    near.append((round(float(q @ v / np.linalg.norm(q) / np.linalg.norm(v)), 9), -nth, x[0]))
        if exact:
            want[name, t] = (min(exact), "exact")
        elif max(j)[0] >= 0.6:
            want[name, t] = (-max(j)[1], "fuzzy")
        elif near and max(near)[0] >= 0.3:
            want[name, t] = (max(near)[2], "cosine")
    frame = spark.createDataFrame(e, "entity_id long, name string, entity_type string, created_at long")
    nv = spark.createDataFrame(list(of_names.items()), "name string, embedding array<double>")
    ev = spark.createDataFrame(list(vectors.items()), "entity_id long, embedding array<double>")
    found = entity.resolve(spark.createDataFrame(names, "name string, type string"), frame, 0.6, nv, ev, 0.3, 10)
    got = bags(found.collect())
    differ = [k for k in set(got) | set(want) if got.get(k) != want.get(k)]
    assert {h for _, h in want.values()} == {"exact", "fuzzy", "cosine"}
    assert all(got.get(k, "")[1:] == want.get(k, "")[1:] == ("cosine",) for k in differ) and len(differ) <= 2  # ties within rounding


def test_a_types_names_are_dealt_to_several_tasks(spark):
    e = spark.createDataFrame([(1, "a", "p", 0)], "entity_id long, name string, entity_type string, created_at long")
    nv = spark.createDataFrame([("z", [1.0])], "name string, embedding array<double>")
    found = entity.resolve(spark.createDataFrame([("z", "p")], "name string, type string"), e, 0.6, nv, nv.selectExpr("1L as entity_id", "embedding"), 0.3)
    assert "FlatMapCoGroupsInArrow" in (plan := found._jdf.queryExecution().optimizedPlan().toString()) and "_share" in plan
    assert bags(found.collect()) == {("z", "p"): (1, "cosine")}
