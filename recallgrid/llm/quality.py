"""Quality classifier by compression: how much better good text's dictionary compresses a text than bad text's.

Two zstandard dictionaries are trained, one on texts labelled good and one on texts labelled bad. A text is
compressed in chunks of CHUNK bytes, each with the dictionary alone and not with what came before in the text, so
the dictionaries count alike in short and in long texts. d = (size with the bad dictionary - size with the good
one) / the larger size is the normalised difference; a logistic curve, fitted on labelled texts that the
dictionaries haven't seen, makes d a probability of label 1. The curve is calibrated by the plain compression
ratio and the length (both in logs), which say how far d can be trusted; d carries the score (the tests hold its
ranking alone, and that of the other two, against the labels).

Defined results: a null text scores as an empty one; without labelled rows of both labels every score is
the share of label 1 (0.5 without any). Rows whose id is null are not learned from. Labels other than 0
and 1 are ignored; label rows and documents that repeat an id are learned from once. A text of any length is
scored whole. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import only, stored, table, thrifty

#: Labelled texts of each label, in expectation, for the dictionaries and for the curve: the learner's sample.
DICTIONARY_DOCS = 600
CURVE_DOCS = 1500
DICTIONARY_BYTES = 64 << 10
#: Bytes of text that the learner takes to the driver at most: of the chosen texts, those first in order of a hash.
LEARN_BYTES = 128 << 20
#: Bytes that are compressed at a time.
CHUNK = 256
LEVEL = 3
#: predicted is 1 from this score on.
ACCEPT = 0.3


class Compressors:
    def __init__(self, good: bytes, bad: bytes) -> None:
        self.good, self.bad = (zstandard.ZstdCompressor(level=LEVEL, dict_data=self.loaded(d)) for d in (good, bad))
        self.plain = zstandard.ZstdCompressor(level=LEVEL)

    @staticmethod
    def loaded(raw: bytes) -> zstandard.ZstdCompressionDict:
        d = zstandard.ZstdCompressionDict(raw)
        d.precompute_compress(level=LEVEL)
        return d

    def features(self, text: str | None) -> tuple[float, float, float]:
        """(normalised difference, log of the plain ratio, log of the length)."""
        raw = (text or "").encode()
        parts = chunks(raw)
        good, bad = (sum(len(c.compress(p)) for p in parts) for c in (self.good, self.bad))
        return (bad - good) / max(good, bad), float(np.log(len(self.plain.compress(raw)) / (len(raw) + 16))), float(np.log1p(len(raw)))


def chunks(raw: bytes) -> list[bytes]:
    return [raw[i : i + CHUNK] for i in range(0, len(raw), CHUNK)] or [b""]


def dictionary(texts: list[bytes]) -> bytes:
    """A dictionary trained on the chunks of texts, or the texts themselves where there are too few to train one."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [c for t in texts for c in chunks(t)]).as_bytes()
    except zstandard.ZstdError:
        return (b"\n".join(texts) or b"\n")[-DICTIONARY_BYTES:]


def fit_curve(x: np.ndarray, y: np.ndarray) -> dict:
    """Logistic regression by Newton's method, with a small ridge."""
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.c_[np.ones(len(x)), (x - mean) / spread]
    w, ridge = np.zeros(z.shape[1]), np.diag([0.0] + [0.1] * x.shape[1]) + 1e-6 * np.eye(z.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -35, 35)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (p - y) + ridge @ w)
        w -= step / max(1.0, float(np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return {"mean": mean, "spread": spread, "weights": w}


def learn(docs: DataFrame, labels: DataFrame, dictionary_docs: int = DICTIONARY_DOCS, curve_docs: int = CURVE_DOCS, id_col: str = "doc_id", learn_bytes: int = LEARN_BYTES) -> dict:
    """The model from docs and labels (id, label). At most dictionary_docs + curve_docs ids of a label are used, in
    expectation, and learn_bytes of their texts; a hash of the id chooses them. Only those ids are sent around, and
    their texts brought to the driver, which fits on them; no other text moves."""
    labels = labels.where("label in (0, 1)").where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max("label").alias("label"))
    n = {r["label"]: r["count"] for r in labels.groupBy("label").count().collect()}
    if len(n) < 2:
        return {"share": float(next(iter(n))) if n else 0.5}
    want = dictionary_docs + curve_docs
    place = F.pmod(F.xxhash64(id_col), F.lit(1_000_003))
    rate = F.when(F.col("label") == 1, want / n[1]).otherwise(want / n[0])
    chosen = stored(labels.where(place < rate * 1_000_003))
    picked = only(docs.select(id_col, F.coalesce("text", F.lit("")).alias("text")), chosen.select(id_col), id_col)
    picked = stored(picked.groupBy(id_col).agg(F.min("text").alias("text")).join(chosen, id_col))
    # The bytes up to and with each text, in order of the hash, over the few rows chosen.
    so_far = F.sum(F.octet_length("text")).over(Window.orderBy(place, id_col))
    bounded = picked.withColumn("so_far", so_far).where((F.col("so_far") <= learn_bytes) | (F.col("so_far") == F.octet_length("text")))
    texts: dict[int, list[bytes]] = {0: [], 1: []}
    for label, text in sorted(map(tuple, bounded.select("label", "text").collect()), key=lambda x: hashlib.md5(x[1].encode()).digest()):
        texts[label].append(text.encode())
    if not (texts[0] and texts[1]):
        return {"share": n[1] / (n[0] + n[1])}
    cut = {k: min(dictionary_docs, len(v) // 2) for k, v in texts.items()}
    dicts = {k: dictionary(v[: cut[k]]) for k, v in texts.items()}
    c = Compressors(dicts[1], dicts[0])
    rest = [(c.features(t.decode()), k) for k, v in texts.items() for t in v[cut[k] :]]
    # Each label is thinned at its own rate; the curve's intercept takes that back.
    shift = np.log(n[1] / max(1, len(texts[1]))) - np.log(n[0] / max(1, len(texts[0])))
    curve = fit_curve(np.array([x for x, _ in rest]), np.array([k for _, k in rest], float))
    curve["weights"][0] += shift
    return {"dictionaries": (dicts[1], dicts[0]), "curve": curve}


def predict(docs: DataFrame, model: dict, id_col: str = "doc_id") -> DataFrame:
    """(id, score, predicted) for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @thrifty
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        c = Compressors(*m["dictionaries"]) if "curve" in m else None
        for pdf in batches:
            if c is None:
                s = np.full(len(pdf), m["share"])
            else:
                x = np.array([c.features(t) for t in pdf["text"]]).reshape(-1, 3)
                z = np.c_[np.ones(len(x)), (x - m["curve"]["mean"]) / m["curve"]["spread"]] @ m["curve"]["weights"]
                s = 1 / (1 + np.exp(-np.clip(z, -35, 35)))
            yield pd.DataFrame({id_col: pdf[id_col], "score": s, "predicted": (s >= ACCEPT).astype("int32")})

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, "text").mapInPandas(score, f"{id_col} {kind}, score double, predicted int")


def held_out(column: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def learned(spark: SparkSession, sf_dir: str) -> dict:
    """The model from the labels that aren't held out."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return learn(table(spark, sf_dir, "documents").select("doc_id", "text"), labels.where(~held_out()))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return predict(docs, learned(spark, sf_dir)).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def accepted(docs: DataFrame, model: dict) -> DataFrame:
    """The rows of docs that the classifier doesn't reject, with their own columns only."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @thrifty
    def keep(batches):
        m = shared.value
        c = Compressors(*m["dictionaries"]) if "curve" in m else None
        for batch in batches:
            if c is None:
                yield batch if m["share"] >= ACCEPT else batch.slice(0, 0)
                continue
            x = np.array([c.features(t) for t in batch["text"].to_pylist()]).reshape(-1, 3)
            z = np.c_[np.ones(len(x)), (x - m["curve"]["mean"]) / m["curve"]["spread"]] @ m["curve"]["weights"]
            s = 1 / (1 + np.exp(-np.clip(z, -35, 35)))
            yield batch.take(np.flatnonzero(s >= ACCEPT))

    return docs.mapInArrow(keep, docs.schema)


QUERIES = {"op6_quality_classifier": op6_quality_classifier}
ORACLES: dict[str, str] = {}
