"""Substring dedup with fixed-block anchors: reference blocks are indexed, every rolling window probes them.

A repeat of at least `window` words holds a whole block of `block` = window / 2 words that starts at a
multiple of `block` in the reference text, wherever the repeat lies. So the index has only each document's
non-overlapping blocks, and the probes are the hashes of every rolling window of `block` words:

1. Anchors. Blocks and probes meet by hash; a probe hits if a block of another text has its words. What is
   sent is packed binary, and hashes that texts of one map task share aren't asked about.
2. Extension. Around its hits, each document's windows of `window` words are extended in both directions;
   runs of them are the maximal repeats. Every such window is held against the smallest id of a document
   in which its words start.
3. Removal. Words inside windows that start in a document with a smaller id go; words are judged on the
   input. Spans are merged per document.

Texts with equal word sequences form a class; only its smallest id takes part, the others' words all go
(if there are at least `window`). Windows are compared by 64-bit hashes of their words.

Defined results: a null text has no words; ids that are equal aren't smaller than each other, so equal rows
get equal results; rows whose id is null keep all words and take no part. Ids have to be whole numbers. A text of any length is read
whole: a slice of text is a few documents or one long one. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import buckets as B
from .common import joined_spread, n_buckets, need_whole_ids, only, stored, table, thrifty, thrifty_group
from .kernel import SPACED, gram_rows, runs_hash, slices, words

WINDOW = 50
NOTHING = hashlib.sha256(b"").hexdigest()

_SPACES = bytes(b if SPACED[b] else 32 for b in range(256))


def profile(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, whole_sha256) of each row; the hash is of all words joined by one space."""

    @thrifty
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, digest = [], []
            for t in b["text"]:
                all_words = t.as_py().encode().translate(_SPACES).split() if t.is_valid else []
                n.append(len(all_words))
                digest.append(hashlib.sha256(b" ".join(all_words)).hexdigest())
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(n, pa.int64()), pa.array(digest)], names=["doc_id", "n_words", "whole_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_words long, whole_sha256 string")


BLOCK, PROBE, KNOWN = 0, 1, 2


def word_hashes(texts) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, row of each word, hash of each word, where each row starts) of slices of texts."""
    for i, j, data, offsets in slices(texts):
        start, end, row = words(data, offsets, SPACED)
        yield i, j, row, runs_hash(data, start, end), np.searchsorted(row, np.arange(j - i + 1))


def anchors(docs: DataFrame, block: int) -> DataFrame:
    """(doc_id, keys): 32-bit keys of the probes of each text that hit a block of another text."""
    parts = n_buckets(docs.sparkSession, docs)

    @thrifty
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = B.Packer(parts, narrow=True)
        for b in batches:
            ids = b["doc_id"].to_numpy(zero_copy_only=False)
            for i, j, row, h, first in word_hashes(b["text"]):
                place, key = gram_rows(h, row, block)
                owner = ids[i:j][row[place]]
                aligned = (place - first[row[place]]) % block == 0
                order = np.lexsort((~aligned, owner, key))
                key, owner, aligned = key[order], owner[order], aligned[order]
                new = np.ones(len(key), bool)  # once per text; as a block where it is one anywhere
                new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
                key, owner, aligned = key[new], owner[new], aligned[new]
                begin = B.first_of(key)
                size = np.diff(np.append(begin, len(key)))
                shared = np.repeat(size > 1, size)
                kind = np.where(aligned, BLOCK, PROBE).astype(np.int8)
                packer.add(key[~shared], owner[~shared], kind[~shared])
                # Hashes that texts here share are hits without asking. They go to buckets by text, and only
                # one record of each, without a text, tells the hash's own bucket of it.
                packer.add(key[shared], owner[shared], KNOWN, by_owner=True)
                some = begin[size > 1]
                if len(some):
                    any_block = np.logical_or.reduceat(aligned, begin)[size > 1]
                    packer.add(key[some], np.full(len(some), -1), np.where(any_block, BLOCK, PROBE).astype(np.int8))
                yield from packer.full()
        yield from packer.rest()

    @thrifty_group
    def meet(rows: pa.Table) -> pa.Table:
        keys, owners, kinds = B.unpack(rows, narrow=True)
        passed = kinds == KNOWN
        done_keys, done_owners = keys[passed], owners[passed]
        keys, owners, kinds = keys[~passed], owners[~passed], kinds[~passed]
        order = np.argsort(keys, kind="stable")
        keys, owners, kinds = keys[order], owners[order], kinds[order]
        begin = B.first_of(keys)
        if len(begin):
            size = np.diff(np.append(begin, len(keys)))
            low, high = np.minimum.reduceat(owners, begin), np.maximum.reduceat(owners, begin)
            # -1 stands for at least two texts of some task.
            hit = ((low != high) | (low == -1)) & (np.minimum.reduceat(kinds, begin) == BLOCK)
            take = np.repeat(hit, size) & (owners != -1)
            done_keys, done_owners = np.concatenate((done_keys, keys[take])), np.concatenate((done_owners, owners[take]))
        return B.answers(done_owners, done_keys, np.zeros(len(done_keys), np.int8), parts)

    return told(docs.mapInArrow(send, B.SCHEMA), meet, parts, narrow=True)


def told(sent: DataFrame, meet, parts: int, narrow: bool) -> DataFrame:
    """(doc_id, keys) of each document that gets answers: records meet by key, answers go back by document."""

    @thrifty_group
    def gather(rows: pa.Table) -> pa.Table:
        keys, owners, _ = B.unpack(rows, narrow)
        ids, (mine,) = B.by_owner(owners, keys)
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "keys": pa.array(mine, pa.binary())})

    back = sent.repartition(parts, "bucket").groupBy("bucket").applyInArrow(meet, B.SCHEMA)
    return back.repartition(parts, "bucket").groupBy("bucket").applyInArrow(gather, "doc_id long, keys binary")


def repeats(near: DataFrame, block: int, window: int, parts: int) -> DataFrame:
    """(doc_id, keys): 64-bit hashes of the windows near hits whose words also start in a smaller doc_id.

    near has (doc_id, text, keys).
    """

    @thrifty
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = B.Packer(parts, narrow=False)
        for b in batches:
            ids = b["doc_id"].to_numpy(zero_copy_only=False)
            for i, j, row, h, _ in word_hashes(b["text"]):
                place, key = gram_rows(h, row, block)
                # A hit's key is looked for in its own text's keys only: both are made distinct by the row.
                mine = [np.frombuffer(x, np.uint32) for x in b["keys"].slice(i, j - i).to_pylist()]
                tagged = np.repeat(np.arange(j - i, dtype=np.uint64) << np.uint64(32), [len(x) for x in mine]) | np.concatenate(mine).astype(np.uint64)
                hit = np.zeros(len(h) + 1, np.int64)
                hit[place[np.isin(row[place].astype(np.uint64) << np.uint64(32) | key >> np.uint64(32), tagged)]] = 1
                so_far = np.concatenate(([0], np.cumsum(hit)))
                at, full = gram_rows(h, row, window)
                touched = so_far[at + window - block + 1] > so_far[at]
                at, full = at[touched], full[touched]
                owner = ids[i:j][row[at]]
                order = np.lexsort((owner, full))
                full, owner = full[order], owner[order]
                new = np.ones(len(full), bool)
                new[1:] = (full[1:] != full[:-1]) | (owner[1:] != owner[:-1])
                full, owner = full[new], owner[new]
                lead = np.zeros(len(full), bool)  # of the texts here, the smallest asks; the others are answered
                lead[B.first_of(full)] = True
                packer.add(full[lead], owner[lead], PROBE)
                packer.add(full[~lead], owner[~lead], KNOWN, by_owner=True)
                yield from packer.full()
        yield from packer.rest()

    @thrifty_group
    def meet(rows: pa.Table) -> pa.Table:
        keys, owners, kinds = B.unpack(rows, narrow=False)
        passed = kinds == KNOWN
        done_keys, done_owners = keys[passed], owners[passed]
        keys, owners = keys[~passed], owners[~passed]
        order = np.lexsort((owners, keys))
        keys, owners = keys[order], owners[order]
        begin = B.first_of(keys)
        smallest = np.repeat(owners[begin], np.diff(np.append(begin, len(keys)))) if len(begin) else owners
        later = owners > smallest
        done_keys, done_owners = np.concatenate((done_keys, keys[later])), np.concatenate((done_owners, owners[later]))
        return B.answers(done_owners, done_keys, np.zeros(len(done_keys), np.int8), parts)

    return told(near.mapInArrow(send, B.SCHEMA), meet, parts, narrow=False)


def covered_words(texts, keys: pa.Array, window: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, whether each word is inside a window of the row's keys) of each text."""
    for i, j, row, h, first in word_hashes(texts):
        at, full = gram_rows(h, row, window)
        bound = np.searchsorted(row[at], np.arange(j - i + 1))
        for r in range(j - i):
            mine = np.frombuffer(keys[i + r].as_py() or b"", np.uint64)
            a = at[bound[r] : bound[r + 1]]
            starts = a[np.isin(full[bound[r] : bound[r + 1]], mine)] - first[r]
            step = np.zeros(first[r + 1] - first[r] + 1, np.int64)
            np.add.at(step, starts, 1)
            np.add.at(step, starts + window, -1)
            yield i + r, np.cumsum(step[:-1]) > 0


def substring_repeats(docs: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(profile with `copy_of`, the smallest id with the same words; repeats as (doc_id, keys))."""
    need_whole_ids(docs)
    block = window // 2
    rows = stored(profile(docs))
    first = rows.where("doc_id is not null").groupBy("whole_sha256", "n_words").agg(F.min("doc_id").alias("copy_of"), F.count("*").alias("copies"))
    first = stored(first)
    rows = stored(joined_spread(rows, first, ["whole_sha256", "n_words"], "copies"))
    alone = stored(rows.where(f"n_words >= {window} and copy_of = doc_id").select("doc_id").distinct())
    texts = only(docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text"), alone, "doc_id")
    hits = stored(anchors(texts, block))
    near = only(texts, stored(hits.select("doc_id")), "doc_id").join(hits, "doc_id")
    found = stored(repeats(near, block, window, n_buckets(docs.sparkSession, docs)))
    return rows, found


def substring_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept) of each row.

    kept is the kept words joined by one space where some were removed and some stay, else null: then
    all words stay (n_removed 0) or none do.
    """
    rows, found = substring_repeats(docs, window)
    # A copy loses all its words; a repeat loses those in windows, and only those texts are read again.
    whole = rows.join(found.select("doc_id", F.lit(True).alias("found")), "doc_id", "left")
    copy = F.coalesce((F.col("copy_of") < F.col("doc_id")) & (F.col("n_words") >= window), F.lit(False))
    whole = whole.withColumn("copy", copy)
    # Ids whose texts are read again; rows that share an id with such a text go with it.
    keep = stored(whole.where("found and not copy").select("doc_id").distinct())
    simple = whole.join(keep.withColumn("cut", F.lit(True)), "doc_id", "left").where("cut is null").select(
        "doc_id", "n_words", F.when(F.col("copy"), F.col("n_words")).otherwise(0).alias("n_removed"),
        F.when(F.col("copy"), F.lit(NOTHING)).otherwise(F.col("whole_sha256")).alias("kept_sha256"), F.lit(None).cast("string").alias("kept"),
    )

    @thrifty
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, removed, digest, kept = [], [], [], []
            for r, gone in covered_words(b["text"], b["keys"], window):
                all_words = b["text"][r].as_py().encode().translate(_SPACES).split() if b["text"][r].is_valid else []
                text = b" ".join([w for w, g in zip(all_words, gone) if not g])
                n.append(len(gone))
                removed.append(int(gone.sum()))
                digest.append(hashlib.sha256(text).hexdigest())
                kept.append(text.decode())
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    texts = only(docs.select("doc_id", "text"), keep, "doc_id").join(found, "doc_id").select("doc_id", "text", "keys")
    cut_rows = texts.mapInArrow(cut, f"doc_id {dict(docs.dtypes)['doc_id']}, n_words long, n_removed long, kept_sha256 string, kept string")
    return simple.unionByName(cut_rows)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("kept")


_ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, s, md5(array_to_string(w[s : s + 49], ' ')) AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM d WHERE len(w) >= 50)),
m AS (SELECT win, min(doc_id) AS first FROM s GROUP BY win),
c AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS p FROM s JOIN m USING (win) WHERE first < doc_id),
r AS (SELECT doc_id, list(p) AS gone, count(*) AS n FROM c GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
"""

QUERIES = {"op2_substring_dedup": op2_substring_dedup}
ORACLES = {"op2_substring_dedup": _ORACLE}
