"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the benchmark's windows of consecutive words (an item with fewer words is one window). All
windows of one length share a shift table over blocks of two words: a block that no pattern has lets the
search skip as far as the window's length allows; a block that ends patterns leads to the bucket of its
suffix hash, whose patterns are compared with the text directly (Wu and Manber, 1994).

Defined results: null and wordless texts have no words, no hits and no items; items without words have no
window; repeated items count once; an item whose id is null marks words but can't be listed. Rows with
equal ids keep their own results, and other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table, thrifty, unused
from .kernel import ALNUM, LOWER

WINDOW = 10
#: Words of benchmark text searched for in one pass; a larger benchmark takes several passes.
PASS_WORDS = 250_000

#: Word bytes are kept, in lower case; all others become spaces.
_CLEAN = bytes(int(LOWER[b]) if ALNUM[b] else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_CLEAN).split() if text else []


class WuManber:
    """The windows of one length: shift and suffix tables over blocks of min(2, length) words.

    A window is a place in the list of all items' words; the windows of a suffix block are told apart by their
    first word before they are compared.
    """

    def __init__(self, length: int) -> None:
        self.length, self.block = length, min(2, length)
        self.flat: list[bytes] = []
        self.shift: dict = {}
        self.ending: dict = {}
        self.default = length - self.block + 1

    def key(self, words: list[bytes], end: int):
        return words[end - 1] if self.block == 1 else (words[end - 2], words[end - 1])

    def add(self, words: list[bytes], item: int) -> None:
        """All windows of an item's words."""
        base, length = len(self.flat), self.length
        self.flat += words
        for end in range(self.block, len(words) + 1):  # a block is nearest to a window's end in the first window that holds it
            k = self.key(words, end)
            self.shift[k] = min(self.shift.get(k, self.default), max(0, length - end))
        for start in range(len(words) - length + 1):
            self.ending.setdefault(self.key(words, start + length), {}).setdefault(words[start], []).append((base + start, item))

    def search(self, words: list[bytes]) -> Iterator[tuple[int, list[int]]]:
        """(start, items) of each occurrence."""
        end, n, shift, default, length, flat = self.length, len(words), self.shift.get, self.default, self.length, self.flat
        if self.block == 1:
            for i, w in enumerate(words):
                if w in self.ending:
                    yield i, [item for _, item in self.ending[w][w]]
            return
        while end <= n:
            step = shift((words[end - 2], words[end - 1]), default)
            if step:
                end += step
                continue
            window = words[end - length : end]
            items = [item for at, item in self.ending[words[end - 2], words[end - 1]].get(window[0], ()) if flat[at : at + length] == window]
            if items:
                yield end - length, items
            end += 1


def patterns(items: list[tuple[str | None, str | None]], window: int) -> tuple[list[str | None], list[WuManber]]:
    """(ids, searchers) for (id, text) pairs."""
    ids: dict[str | None, int] = {}
    by_length: dict[int, WuManber] = {}
    for item, text in items:
        words = words_of(text)
        if n := min(window, len(words)):
            by_length.setdefault(n, WuManber(n)).add(words, ids.setdefault(item, len(ids)))
    return list(ids), list(by_length.values())


_COMPILED: dict[str, tuple[list[str | None], list[WuManber]]] = {}


def compiled(name: str, items, window: int) -> tuple[list[str | None], list[WuManber]]:
    """The worker's search tables of one pass, made once; there are those of one pass at a time."""
    if name not in _COMPILED:
        _COMPILED.clear()
        _COMPILED[name] = patterns(items.value, window)
    return _COMPILED[name]


def find(docs: DataFrame, items: list[tuple[str | None, str | None]], window: int, columns: list[str]) -> DataFrame:
    """docs with its columns of hits (start, end of words, in turn) and found (item ids) extended by what items occur."""
    shared, name = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex
    hits_col, found_col, n_col = columns

    @thrifty
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, searchers = compiled(name, shared, window)
        for batch in batches:
            hits, found, sizes = [], [], []
            for text, old_hits, old_found in zip(batch["text"], batch[hits_col].to_pylist(), batch[found_col].to_pylist()):
                words = words_of(text.as_py())
                items_here: set[int] = set()
                for s in searchers:
                    for start, got in s.search(words):
                        old_hits += (start, start + s.length)
                        items_here.update(got)
                hits.append(old_hits)
                found.append(old_found + [x for i in items_here if (x := ids[i]) is not None])
                sizes.append(len(words))
            keep = [batch.column(n) for n in batch.schema.names[:-3]]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(hits, pa.list_(pa.int32())), pa.array(found, pa.list_(pa.string())), pa.array(sizes, pa.int64())], schema=batch.schema)

    return docs.mapInArrow(scan, docs.schema)


ADDED = ["_wm_hits", "_wm_found", "_wm_n_words"]


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, pass_words: int = PASS_WORDS, columns: list[str] = ADDED) -> DataFrame:
    """docs and, of each row, three columns: word spans that are hit (start and end in turn), ids of items, number of words.

    The benchmark is a stated, small set of queries. It is read in parts of about pass_words words, one
    pass over docs for each part, so what is broadcast is bounded however large the benchmark is. columns
    names the added columns; docs must not have them.
    """
    if clash := {c.lower() for c in docs.columns} & {c.lower() for c in columns}:
        raise ValueError(f"docs already has columns {sorted(clash)}; give other names in columns")
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").where("text is not null").distinct()
    total = items.agg(F.sum(F.length("text") / 5 + 1)).first()[0] or 0
    parts = int(total // pass_words) + 1
    hits_col, found_col, n_col = columns
    out = docs.withColumns({hits_col: F.array().cast("array<int>"), found_col: F.array().cast("array<string>"), n_col: F.lit(0).cast("long")})
    for part in range(parts):
        mine = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == part) if parts > 1 else items
        out = find(stored(out) if part else out, [tuple(r) for r in mine.collect()], window, columns)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs, with their own columns only, in which no window of the benchmark occurs."""
    columns = unused(docs, *ADDED)
    return contaminated(docs, benchmark, window, columns=columns).where(F.size(columns[0]) == 0).select(*docs.columns)


@thrifty
def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each row of contaminated()."""
    for b in batches:
        n_hit, n_items, digest = [], [], []
        for spans, found in zip(b["_wm_hits"].to_pylist(), b["_wm_found"].to_pylist()):
            covered: set[int] = set()
            for i in range(0, len(spans), 2):
                covered.update(range(spans[i], spans[i + 1]))
            names = sorted(set(found))
            n_hit.append(len(covered))
            n_items.append(len(names))
            digest.append(hashlib.sha256(",".join(names).encode()).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [b["doc_id"], b["_wm_n_words"], pa.array(n_hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(digest, pa.string()), pa.array([n > 0 for n in n_hit], pa.bool_())],
            names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
        )


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contaminated(docs, table(spark, sf_dir, "benchmark"))
    kind = dict(docs.dtypes)["doc_id"]
    return found.drop("text").mapInArrow(report, f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


_ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[s : s + least(len(w), 10) - 1], ' ') AS win
       FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') AS win
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, s, dw.n, item FROM dw JOIN iw USING (n, win)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

QUERIES = {"op9_benchmark_decontamination": op9_benchmark_decontamination}
ORACLES = {"op9_benchmark_decontamination": _ORACLE}
