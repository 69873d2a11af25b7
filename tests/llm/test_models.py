"""The learned operators against plain Python: the same model and scores from the definitions alone; ablation."""

import math
import random
import unicodedata
from collections import Counter

import numpy as np
import pytest

from recallgrid.llm import language_id, quality

SYLLABLES = {"aa": "ka ti mo ru pe na".split(), "bb": "sch ung ein tor ber wal".split(), "cc": "eau ois que lle ment ai".split()}


def texts(n=90, seed=3):
    rng = random.Random(seed)
    word = lambda lang: "".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4)))
    rows = [(i, " ".join(word(lang) for _ in range(rng.randrange(3, 25))).capitalize() + rng.choice([".", " 12 ½", " É²x"]), lang) for i in range(n) for lang in [sorted(SYLLABLES)[i % 3]]]
    return [*rows, (900, None, "aa"), (901, "", "bb"), (902, "² ½ ① 12 _", None), (903, "unseen zzz", None), (904, rows[0][1], None), (905, "ka " * 30000, None)]


def plain_words(text):
    """Runs of characters of Unicode's letter categories."""
    return "".join(c if unicodedata.category(c)[0] == "L" else " " for c in (text or "").lower()).split()


def plain_model(rows, top, max_n):
    counts = {}
    for _, text, lang in rows:
        if text is not None and lang is not None:
            for w in plain_words(text):
                counts.setdefault((lang, 0), Counter())[w] += 1
                for n in range(1, max_n + 1):
                    p = f" {w} "
                    for i in range(len(p) - n + 1):
                        counts.setdefault((lang, n), Counter())[p[i : i + n]] += 1
    model = {}
    for key, c in counts.items():
        total = sum(c.values())
        model[key] = {g: math.log10(n / total) for g, n in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:top]}
    return model


def plain_score(text, model, max_n):
    langs = sorted({lang for lang, _ in model})
    words = plain_words(text)
    if not words:
        return "und", 0.0
    mean = np.zeros(len(langs))
    known = lambda g, n: any(g in model.get((x, n), ()) for x in langs)
    for w in words:
        if known(w, 0):
            parts, n = [w], 0
        else:
            p = f" {w} "
            n = next((n for n in range(min(len(p), max_n), 0, -1) if any(known(p[i : i + n], n) for i in range(len(p) - n + 1))), None)
            parts = [p[i : i + n] for i in range(len(p) - n + 1)] if n else []
        for k, x in enumerate(langs):
            mean[k] += np.mean([model.get((x, n), {}).get(g, language_id.PENALTY) for g in parts]) if parts else language_id.PENALTY
    mean /= len(words)
    best = int(np.argmax(np.round(mean, 9)))
    return langs[best], float(1 / np.exp((mean - mean[best]) * math.log(10) * min(len(words), language_id.CONFIDENT_WORDS)).sum())


@pytest.mark.parametrize("top", [20_000, 15])
def test_language_scores_equal_plain_python(spark, top):
    rows = texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = language_id.learn(docs, top=top)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict(docs, model).collect()}
    plain = plain_model(rows, top, language_id.MAX_N)
    assert len(got) == len(rows)
    for i, text, _ in rows:
        lang, score = plain_score(text, plain, language_id.MAX_N)
        assert got[i][0] == lang and got[i][1] == pytest.approx(score, abs=1e-4), (i, text)
    assert got[902] == ("und", 0.0) and got[900] == ("und", 0.0)


def test_a_language_of_one_repeated_text_is_learned(spark):
    rows = [(i, "ka ti mo ru", "aa") for i in range(3000)] + [(10_000 + i, f"ein tor wal{i}", "bb") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.learn(docs, learn_docs=50)
    assert model["langs"] == ["aa", "bb"]


def test_learners_and_scorers_take_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = language_id.learn(docs)
    assert model["langs"] == [] and language_id.predict(docs, model).count() == 0
    some = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    assert {tuple(r)[1:] for r in language_id.predict(some, model).collect()} == {("und", 0.0)}
    labels = spark.createDataFrame([], "doc_id long, label int")
    assert quality.learn(some, labels) == {"share": 0.5}
    assert {r["score"] for r in quality.predict(some, {"share": 0.5}).collect()} == {0.5}


def labelled(n=240, seed=5):
    rng = random.Random(seed)
    say = lambda: " ".join("".join(rng.choice("ka ti mo ru pe na ber wal".split()) for _ in range(2)) for _ in range(rng.randrange(5, 200)))
    spoil = [lambda t: t.replace(" ", " ### "), lambda t: t.upper().replace(" ", "!! "), lambda t: t.replace(" ", " | ")]
    rows = [(i, say() if i % 3 else rng.choice(spoil)(say()), int(i % 3 > 0)) for i in range(n)]
    return [*rows, (900, None, None), (901, "", None), (902, rows[1][1], None), (903, "x" * 300_000, None)]


def test_quality_scores_equal_plain_python(spark):
    rows = labelled()
    docs = spark.createDataFrame([r[:2] for r in rows] + [rows[5][:2]] * 3, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, q) for i, _, q in rows if q is not None] + [(0, 0)] * 50 + [(5, 7)], "doc_id long, label int")
    model = quality.learn(docs, labels, dictionary_docs=40, curve_docs=40)
    import zstandard

    good, bad = (zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(d)) for d in model["dictionaries"])
    plain = zstandard.ZstdCompressor(level=quality.LEVEL)
    got = {r["doc_id"]: (r["score"], r["predicted"]) for r in quality.predict(docs, model).collect()}
    for i, text, _ in rows:
        raw = (text or "").encode()
        parts = [raw[k : k + 256] for k in range(0, max(1, len(raw)), 256)]
        g, b = (sum(len(c.compress(p)) for p in parts) for c in (good, bad))
        x = [(b - g) / max(g, b), math.log(len(plain.compress(raw)) / (len(raw) + 16)), math.log(1 + len(raw))]
        z = model["curve"]["weights"][0] + sum(w * (v - m) / s for w, v, m, s in zip(model["curve"]["weights"][1:], x, model["curve"]["mean"], model["curve"]["spread"]))
        score = 1 / (1 + math.exp(-max(-35, min(35, z))))
        assert got[i] == (pytest.approx(score, abs=1e-9), int(score >= 0.3))
    assert {r["doc_id"] for r in quality.accepted(docs, model).collect()} == {i for i, (s, _) in got.items() if s >= 0.3}


def auc(scores, labels):
    rank = np.argsort(np.argsort(scores, kind="stable"), kind="stable")
    good = np.array(labels) == 1
    return (rank[good].mean() - (good.sum() - 1) / 2) / (~good).sum()


def test_the_difference_of_dictionaries_carries_the_score(spark, data):
    """Ablation on held-out labels: the normalised difference alone ranks nearly as well as the whole curve, and better than the rest."""
    import zlib

    sf = data.replace("sf0.001", "sf0.1")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.learned(spark, sf)
    held = docs.join(labels, "doc_id").select("doc_id", "text", "quality").collect()
    held = [r for r in held if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    c = quality.Compressors(*model["dictionaries"])
    x, y = np.array([c.features(r["text"]) for r in held]), [r["quality"] for r in held]
    whole = auc(((x - model["curve"]["mean"]) / model["curve"]["spread"]) @ model["curve"]["weights"][1:], y)
    alone = auc(x[:, 0], y)
    rest = auc(((x - model["curve"]["mean"]) / model["curve"]["spread"])[:, 1:] @ model["curve"]["weights"][2:], y)
    assert whole > 0.98 and alone > 0.97 and alone > rest


def test_sample_is_bounded_in_bytes(spark):
    docs = spark.createDataFrame([(i, f"text {i} " * 500) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, label int")
    assert set(quality.learn(docs, labels, learn_bytes=60_000)) <= {"dictionaries", "curve", "share"}
