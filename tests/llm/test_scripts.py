"""Words of scripts with marks, and models of many languages."""

import random
import sys
import unicodedata
from collections import Counter

import numpy as np

from recallgrid.llm import language_id

HINDI, THAI, COMBINED = "हिन्दी भाषा में", "ภาษาไทยสวยมาก", "résumé näive"


def test_marks_belong_to_words():
    assert language_id.word_counts(HINDI) == Counter(HINDI.split())
    assert language_id.word_counts(THAI) == {THAI: 1}
    assert language_id.word_counts(COMBINED) == Counter(COMBINED.split())
    assert language_id.word_counts("́ ́́ 12́ _̈") == {}  # a word has a letter
    assert language_id.word_counts("a²́b c½d") == Counter(["a", "́b", "c", "d"])
    assert language_id.word_counts(None) == language_id.word_counts("") == {}


def plain(text):
    out, word = Counter(), ""
    for c in text.lower() + " ":
        if unicodedata.category(c)[0] in "LM":
            word += c
        else:
            if any(unicodedata.category(x)[0] == "L" for x in word):
                out[word] += 1
            word = ""
    return out


def test_words_equal_the_definition():
    rng = random.Random(1)
    signs = "aZé9_ ²½́िัहกאְ.İ\U0001d165𝐀-"
    for _ in range(500):
        text = "".join(rng.choice(signs) for _ in range(rng.randrange(20)))
        assert language_id.word_counts(text) == plain(text), repr(text)


def test_scripts_are_told_apart(spark):
    rows = [(k, text, lang) for k in range(12) for text, lang in ((HINDI, "hi"), ("मराठी भाषेत आहे", "mr"), (THAI, "th"), ("plain english words", "en"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.learn(docs)
    asked = spark.createDataFrame([(1, "हिन्दी", ), (2, "भाषेत",), (3, "ภาษาไทย",), (4, "english",), (5, "́",)], "doc_id long, text string")
    assert {r["doc_id"]: r["lang_pred"] for r in language_id.predict(asked, model).collect()} == {1: "hi", 2: "mr", 3: "th", 4: "en", 5: "und"}


def size(model):
    return sum(sys.getsizeof(d) + sum(sys.getsizeof(g) + 32 for g in d) for d in model["orders"].values()) + sum(model[k].nbytes for k in ("first", "lang", "log10"))


def test_500_languages_stay_below_200_mb(spark, monkeypatch):
    rng = random.Random(2)
    words = {x: ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9))) for _ in range(150)] for x in range(500)}
    rows = [(x, " ".join(words[x]), f"l{x:03}") for x in words]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.learn(docs)
    assert len(model["langs"]) == 500 and len(model["log10"]) <= language_id.MAX_ENTRIES and size(model) < 200e6
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.predict(docs, model).collect()}
    assert np.mean([got[x] == f"l{x:03}" for x in words]) > 0.99
    monkeypatch.setattr(language_id, "MAX_ENTRIES", 60_000)  # twenty for each language and order
    few = language_id.learn(docs)
    assert max(Counter(few["lang"].tolist()).values()) <= 6 * 20
