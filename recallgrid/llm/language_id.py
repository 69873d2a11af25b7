"""Language ID by words first, backing off to shorter character n-grams for unseen words.

Every word known to the model scores by its log relative frequency in each language. A word that no
language knows is scored by its character n-grams instead, from the longest order downwards, stopping at
the first order of which any n-gram is known (Jauhiainen, Lindén and Jauhiainen, HeLI, 2016). A text's
score per language is the mean over its words.

Defined results: a null text or one without a letter is `und` with score 0, and so is every text when no
language could be learned. Words are runs of letters and marks (vowel signs, accents) with a letter among them,
lower-cased. Ties go to the language first in
alphabetical order. Rows whose id is null are not learned from and not held out. Repeated rows each get
their own, equal, result; a text of any length is scored whole; other columns of the input are ignored.
"""

from __future__ import annotations

import re
import sys
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table, thrifty

def _marks() -> str:
    """Marks, as ranges of a character class."""
    found = [c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c))[0] == "M"]
    starts = [c for c in found if unicodedata.category(chr(c - 1))[0] != "M"]
    ends = [c for c in found if c == sys.maxunicode or unicodedata.category(chr(c + 1))[0] != "M"]
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(starts, ends))


#: Runs of what may be letters; numerals that aren't decimal digits are taken out afterwards.
WORD = re.compile(r"[^\W\d_]+")
MARK = re.compile(f"[{_marks()}]")
#: What a text with marks has, and is looked for faster.
BEYOND_LATIN = re.compile("[\u0300-\U0010ffff]")
#: The same with marks.
MARKED_WORD = re.compile(rf"(?:[^\W\d_]|{MARK.pattern})+")
#: Documents per language that are learned from, as a bound on the expected sample.
LEARN_DOCS = 2000
#: Entries kept per language and order: words, and n-grams of each length.
TOP = 20_000
MAX_N = 5
#: Languages that can be told apart, and entries of the whole model: bounds of what is broadcast. Where a model of many
#: languages would have more, fewer are kept for each language and order.
MAX_LANGS = 1000
MAX_ENTRIES = 1_000_000
#: Bytes of scores of words that a worker remembers.
REMEMBER_BYTES = 64 << 20
#: log10 frequency given to what a language's model lacks.
PENALTY = -7.0
#: Texts weigh as at most so many words when the score is made a probability.
CONFIDENT_WORDS = 10


def word_counts(text: str | None) -> Counter:
    """How often each word is in a text: runs of letters and marks, lower-cased. Learning and scoring both use it."""
    if not text:
        return Counter()
    low = text.lower()
    marks = BEYOND_LATIN.search(low) and MARK.search(low)
    counts = Counter((MARKED_WORD if marks else WORD).findall(low))
    for w in [w for w in counts if not w.isalpha()]:
        n = counts.pop(w)
        for part in "".join(c if c.isalpha() or (marks and MARK.match(c)) else " " for c in w).split():
            if any(map(str.isalpha, part)):
                counts[part] += n
    return counts


@thrifty
def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n) of each batch's words."""
    for b in batches:
        by_lang: dict[str, Counter] = {}
        for lang, text in zip(b["lang"].to_pylist(), b["text"]):
            by_lang.setdefault(lang, Counter()).update(word_counts(text.as_py()))
        langs = [x for x, c in by_lang.items() for _ in c]
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array([w for c in by_lang.values() for w in c], pa.string()), pa.array([n for c in by_lang.values() for n in c.values()], pa.int64())], names=["lang", "word", "n"])


def learn(rows: DataFrame, learn_docs: int = LEARN_DOCS, top: int = TOP, max_n: int = MAX_N, id_col: str = "doc_id") -> dict:
    """The model from rows (id, text, lang): the languages, and by order (0: words, n: n-grams) the entry that each has.

    An entry holds the languages that have it and their log10 frequencies (`lang` and `log10` between two of `first`).
    A language with more than learn_docs rows is thinned by a hash of id and text to learn_docs in expectation;
    counts run on Spark. The model is bounded: at most top entries for each language and order, and MAX_ENTRIES in all.
    """
    rows = rows.where("text is not null and lang is not null").select(id_col, "text", "lang")
    rate = stored(rows.groupBy("lang").agg((F.lit(float(learn_docs)) / F.count("*")).alias("_rate")))
    if (n_langs := rate.count()) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    top = min(top, MAX_ENTRIES // ((max_n + 1) * max(1, n_langs)))
    picked = rows.join(F.broadcast(rate), "lang").where(F.pmod(F.xxhash64(id_col, "text"), F.lit(1_000_003)) < F.col("_rate") * 1_000_003)
    words = picked.select("lang", "text").mapInArrow(_counted, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    padded = F.concat(F.lit(" "), "word", F.lit(" "))
    # Each distinct word once, as itself (order 0) and as its n-grams of all orders.
    starts = lambda n: F.when(F.length(padded) >= n, F.sequence(F.lit(1), F.length(padded) - n + 1)).otherwise(F.array().cast("array<int>"))
    of_order = lambda n: F.transform(starts(n), lambda i: F.struct(F.lit(n).alias("ord"), padded.substr(i, F.lit(n)).alias("gram")))
    itself = F.array(F.struct(F.lit(0).alias("ord"), F.col("word").alias("gram")))
    grams = words.select("lang", "n", F.explode(F.concat(itself, *[of_order(n) for n in range(1, max_n + 1)])).alias("g")).select("lang", "g.ord", "g.gram", "n")
    counts = stored(grams.groupBy("lang", "ord", "gram").agg(F.sum("n").alias("n")))
    total = counts.groupBy("lang", "ord").agg(F.sum("n").alias("total"))
    rank = F.row_number().over(Window.partitionBy("lang", "ord").orderBy(F.desc("n"), "gram"))
    kept = counts.withColumn("rank", rank).where(F.col("rank") <= top).join(F.broadcast(total), ["lang", "ord"])
    kept = kept.select("lang", "ord", "gram", F.log10(F.col("n") / F.col("total")).cast("float").alias("f")).toArrow()
    langs = sorted(set(kept["lang"].unique().to_pylist()))
    orders: dict[int, dict[str, int]] = {n: {} for n in range(max_n + 1)}
    used = 0
    entry = np.zeros(len(kept), np.int64)
    for k, (n, gram) in enumerate(zip(kept["ord"].to_pylist(), kept["gram"].to_pylist())):
        entry[k] = orders[n].setdefault(gram, used)
        used += entry[k] == used
    of = np.searchsorted(langs, kept["lang"].to_numpy()) if langs else np.zeros(0, np.int64)
    order = np.lexsort((of, entry))
    first = np.searchsorted(entry[order], np.arange(used + 1))
    return {"langs": langs, "orders": orders, "first": first, "lang": of[order].astype(np.int32), "log10": kept["f"].to_numpy()[order].astype(np.float32)}


class Scorer:
    """Scores texts; remembers the words it has scored, up to a bound in bytes."""

    def __init__(self, model: dict, remember: int | None = None) -> None:
        self.langs, self.orders = model["langs"], model["orders"]
        self.first, self.lang, self.log10 = (model.get(k) for k in ("first", "lang", "log10"))
        self.remember = remember or max(1000, REMEMBER_BYTES // (8 * max(1, len(self.langs)) + 120))
        self.at: dict[str, int] = {}
        self.table = np.zeros((1024, max(1, len(self.langs))))

    def entries(self, w: str) -> tuple[list[int], int]:
        """The model's entries that score a word, and of how many parts they are."""
        if (known := self.orders[0].get(w)) is not None:
            return [known], 1
        p = f" {w} "
        for n in range(min(len(p), max(self.orders)), 0, -1):
            get = self.orders[n].get
            found = [x for i in range(len(p) - n + 1) if (x := get(p[i : i + n])) is not None]
            if found:
                return found, len(p) - n + 1
        return [], 1

    def add(self, new: list[str]) -> None:
        """Scores words that aren't remembered yet."""
        at, flat, have, parts = len(self.at), [], [], []
        for w in new:
            found, n = self.entries(w)
            flat += found
            have.append(len(found))
            parts.append(n)
            self.at[w] = len(self.at)
        while len(self.at) > len(self.table):
            self.table = np.concatenate((self.table, np.zeros_like(self.table)))
        # What an entry's languages have is summed; each other language, and each unknown part, counts PENALTY.
        width, flat = self.table.shape[1], np.array(flat, np.int64)
        size = self.first[flat + 1] - self.first[flat]
        where = np.repeat(self.first[flat] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        cell = np.repeat(np.repeat(np.arange(len(new)), have), size) * width + self.lang[where]
        sums = np.bincount(cell, self.log10[where], len(new) * width).reshape(len(new), width)
        known = np.bincount(cell, minlength=len(new) * width).reshape(len(new), width)
        of = np.array(parts)[:, None]
        self.table[at : len(self.at)] = (sums + (of - known) * PENALTY) / of

    def text(self, text: str | None) -> tuple[str, float]:
        counts = word_counts(text) if self.langs else None
        if not counts:
            return "und", 0.0
        at = self.at
        if new := [w for w in counts if w not in at]:
            self.add(new)
        n = np.fromiter(counts.values(), float, len(counts))
        mean = n @ self.table[[at[w] for w in counts]] / n.sum()
        best = int(mean.argmax())
        if len(at) > self.remember:  # frequent words are soon there again
            at.clear()
        p = np.exp((mean - mean[best]) * np.log(10) * min(n.sum(), CONFIDENT_WORDS))
        return self.langs[best], float(1 / p.sum())


_SCORERS: dict[str, Scorer] = {}


def scorer_of(name: str, shared) -> Scorer:
    """The worker's scorer of a model, which keeps what it remembers from task to task; there is one at a time."""
    if name not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[name] = Scorer(shared.value)
    return _SCORERS[name]


def predict(docs: DataFrame, model: dict, id_col: str = "doc_id") -> DataFrame:
    """(id, lang_pred, score) for each row; the model goes to the executors as a broadcast of bounded size."""
    shared, name = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    @thrifty
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = scorer_of(name, shared)
        for pdf in batches:
            got = [scorer.text(t) for t in pdf["text"]]
            yield pd.DataFrame({id_col: pdf[id_col], "lang_pred": [x[0] for x in got], "score": [x[1] for x in got]})

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, "text").mapInPandas(score, f"{id_col} {kind}, lang_pred string, score double")


def held_out(column: str, folds: int, fold: int):
    """Whether crc32 of the id as text falls in the fold; false for null ids."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = learn(docs.where(F.col("doc_id").isNotNull() & ~held_out("doc_id", 4, 2)))
    return predict(docs, model).select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")


QUERIES = {"op3_language_id": op3_language_id}
ORACLES: dict[str, str] = {}
