"""Queries are scored many at a time: equal to a plain sum over all documents, with and without thresholds."""

import numpy as np

from recallgrid.llm import topk_search as T


def shard_of(spark, texts):
    rows = T.index(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)).toArrow()
    assert rows.num_rows == 1
    return {c: rows[c][0].as_buffer() for c in ("ids", "lengths", "terms", "df", "docs", "tf")}


def test_queries_are_scored_together(spark, monkeypatch):
    rng = np.random.default_rng(5)
    share = 1 / np.arange(1, 401)
    texts = [" ".join(f"w{w}" for w in rng.choice(400, rng.integers(1, 80), p=share / share.sum())) + (f" own{i % 90}" if i % 3 else "") for i in range(700)]
    counts = [{w: t.split().count(w) for w in set(t.split())} for t in texts]
    words = sorted(set().union(*counts))
    tf = np.array([[c.get(w, 0) for w in words] for c in counts], float)
    n, length = len(texts), tf.sum(axis=1)
    mean = length.mean()
    df = (tf > 0).sum(axis=0)
    impact = tf * (T.K1 + 1) / (tf + T.K1 * (1 - T.B + T.B * length[:, None] / mean))
    full = impact @ (np.log(1 + (n - df + 0.5) / (df + 0.5))[:, None] * tf[:300].T)  # document by query
    want = []
    for q in range(300):
        s = np.round(full[:, q], T.PLACES)
        order = np.lexsort((np.arange(n), -s))
        want += [(q, int(d), float(s[d])) for d in order[:10] if full[d, q] > 0]

    _, _, row, term, count, _ = next(T.term_counts(spark.createDataFrame(list(enumerate(texts)), "i long, text string").coalesce(1).toArrow()["text"], 1 << 30))
    asked = row < 300
    terms, inverse = np.unique(term[asked], return_inverse=True)
    own, own_df = np.unique(term, return_counts=True)
    d = own_df[np.searchsorted(own, terms)]
    weight = np.log(1 + (n - d + 0.5) / (d + 0.5))[inverse] * count[asked]
    shard = T.Shard(shard_of(spark, texts), terms, mean)
    assert len(shard.edges) > 2 and 0 < shard.n_common < len(terms)

    calls = []
    plain = np.bincount
    monkeypatch.setattr(np, "bincount", lambda *a, **b: calls.append(1) or plain(*a, **b))
    tenth = np.zeros(300)
    for q, _, s in want:
        tenth[q] = s
    for threshold in (np.zeros(300), tenth, tenth + 1e9):
        calls.clear()
        got = shard.search(row[asked], inverse, weight, threshold, 10)
        assert len(calls) < 100  # not once or more for each query
        if threshold[0] < 1e9:
            assert [(int(q), int(i)) for q, i in zip(*got[:2])] == [w[:2] for w in want]
            assert np.allclose(got[2], [w[2] for w in want], atol=2e-4)
        else:
            assert not len(got[0])
