"""Exact top-k search by BM25: an inverted index per shard, block-max WAND, an exact merge by rounds.

A shard is a run of documents of one map task, indexed where it is read. Alike documents lie side by side in
blocks; a term's postings are in order of document. The lists of rarer terms are scored, those of many queries at
a time. Those of frequent terms are kept as rows, with the largest contribution in each block (block-max WAND,
Ding and Suel, 2011): a block goes when its best document and the maxima of the frequent terms stay below the
threshold (the pivot is between rare and frequent). In the others, the frequent terms of all queries that are left
are scored by a matrix product in single precision, and what may reach the threshold is scored in full, so
nothing is lost. Every shard scores with the collection's own counts, so shards' best lists merge exactly.

Shards are searched in rounds, a small part of them first and GROWTH times as many in each further round. After
each round, the k-th best score so far is a query's threshold in all shards of the next, so a round gives few
rows beyond what replaces earlier ones: about k * GROWTH for a query, however many shards there are. A task
merges its shards' lists and raises its own threshold as it goes.

Queries are a stated set of rows. They are searched for in blocks of bounded size, one pass over the index
for each, so that what is broadcast is bounded. Scores are rounded to 4 places; ties go to the smaller id.

Terms are runs of ASCII letters (lower-cased), digits and non-ASCII characters, by 64-bit hash.

Defined results: documents without terms are counted in the collection's size and mean length but are never
found; rows without an id are no part of the collection; queries without terms find nothing; fewer than k
results are given where fewer documents share a term. Repeated rows are documents of their own; rows with equal
ids are one query, whose term counts are the largest of any of them. Ids have to be whole numbers. A text of any
length is read whole; one longer than a shard is a shard by itself. Other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import need_whole_ids, stored, table, thrifty
from .kernel import ALNUM, LOWER, SLICE_BYTES, runs_hash, slices, words

K1, B, K = 1.2, 0.75, 10
SHARD_BYTES = 16 << 20
BLOCK = 256
#: Query terms searched for in one pass over the index.
PASS_TERMS = 2_000_000
#: Share of a shard's documents from which a term's list is kept as a row, and how many such rows there are at most.
COMMON = 0.04
MOST_COMMON = 1500
#: Bound of single precision's error, as a share of the score: a sum of MOST_COMMON products, none of them negative.
ROUGH = 1e-4
#: Queries scored together at most, scores that are held at a time, and postings of rarer terms that are added up at a time.
TOGETHER = 256
CELLS = 1 << 21
PIECE = 1 << 15
#: Shards of the first round, at most, and how many times as many there are after each round.
FIRST_SHARDS = 8
GROWTH = 8
#: Groups of documents with alike words in a shard, and the most frequent terms they are told apart by.
GROUPS = 8
GROUP_TERMS = 128
PLACES = 4
#: Scores nearer than this may be equal when rounded; thresholds leave it as slack.
SLACK = 2 * 10**-PLACES


def term_counts(texts, limit: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, row, term, count of it in the row; terms in each row) of slices; sorted by row, term."""
    for i, j, data, offsets in slices(texts, limit):
        data = LOWER[data]
        start, end, row = words(data, offsets, ALNUM)
        h = runs_hash(data, start, end)
        order = np.lexsort((h, row))
        row, h = row[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        at = np.flatnonzero(new)
        yield i, j, row[at], h[at], np.diff(np.append(at, len(h))), np.bincount(row, minlength=j - i)


INDEX = "ids binary, lengths binary, terms binary, df binary, docs binary, tf binary"


def similar(row: np.ndarray, term: np.ndarray, tf: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The rows of a shard in an order that puts alike ones side by side: by group (k-means over the shard's most
    frequent terms), then by length. Any order gives the same results; this one makes blocks' maxima tighter."""
    n = len(length)
    own, df = np.unique(term, return_counts=True)
    top = np.sort(own[np.argsort(-df, kind="stable")[:GROUP_TERMS]])
    x = np.zeros((n, max(1, len(top))), np.float32)
    some = np.flatnonzero(np.isin(term, top))
    x[row[some], np.searchsorted(top, term[some])] = 1 + np.log(tf[some])
    x /= np.linalg.norm(x, axis=1, keepdims=True) + 1e-9
    by_length = np.argsort(length, kind="stable")
    centre = x[by_length[np.linspace(0, n - 1, min(n, GROUPS)).astype(int)]]
    group = np.zeros(n, np.int64)
    for _ in range(5):
        group = (x @ centre.T).argmax(axis=1)
        for g in range(len(centre)):
            if (group == g).any():
                c = x[group == g].mean(axis=0)
                centre[g] = c / (np.linalg.norm(c) + 1e-9)
    return np.lexsort((length, group))


def index(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per shard: ids and lengths of its documents (alike ones side by side), terms, and postings by term."""
    need_whole_ids(docs, id_col)

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(x["text"].nbytes for x in held) >= SHARD_BYTES:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
        if held:
            yield pa.Table.from_batches(held).combine_chunks()

    @thrifty
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in gathered(batches):
            ids = b[id_col].to_numpy().astype(np.int64)
            rows, terms, tfs, lengths = [], [], [], []
            for i, _, row, term, tf, length in term_counts(b["text"], SLICE_BYTES):
                rows.append((row + i).astype(np.int32))
                terms.append(term)
                tfs.append(tf.astype(np.int32))
                lengths.append(length)
            row, term, tf, length = (np.concatenate(x) for x in (rows, terms, tfs, lengths))
            del rows, terms, tfs
            order = similar(row, term, tf, length)
            place = np.empty(len(order), np.int32)
            place[order] = np.arange(len(order))
            at = place[row]
            by_term = np.lexsort((at, term))
            term, at, tf = term[by_term], at[by_term], tf[by_term]
            first = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1]))) if len(term) else np.zeros(0, np.int64)
            columns = (ids[order], length[order].astype(np.uint32), term[first], np.diff(np.append(first, len(term))).astype(np.uint32), narrow(at), narrow(tf))
            yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in columns], names=["ids", "lengths", "terms", "df", "docs", "tf"])

    return docs.where(F.col(id_col).isNotNull()).select(id_col, "text").mapInArrow(build, INDEX)


def query_terms(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(query_id, term, qtf) of each query."""

    @thrifty
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b[id_col].to_numpy(zero_copy_only=False)
            for i, j, row, term, tf, _ in term_counts(b["text"], SLICE_BYTES):
                yield pa.RecordBatch.from_arrays([pa.array(ids[i:j][row], pa.int64()), pa.array(term.view(np.int64)), pa.array(tf, pa.int64())], names=["query_id", "term", "qtf"])

    return rows.select(id_col, "text").mapInArrow(run, "query_id long, term long, qtf long").groupBy("query_id", "term").agg(F.max("qtf").alias("qtf"))


def narrow(x: np.ndarray) -> np.ndarray:
    """x in as few bytes each as its largest value needs: 1, 2 or 4."""
    most = int(x.max(initial=0))
    return x.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32)


def wide(raw: pa.Buffer, count: int) -> np.ndarray:
    """count numbers as narrow() wrote them."""
    return np.frombuffer(raw, {1: np.uint8, 2: np.uint16, 4: np.uint32}[raw.size // count] if count else np.uint8)


def spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[i] .. start[i] + size[i], one after the other."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


class Shard:
    """A shard's postings for a block of queries' terms, those of frequent terms as rows with their block maxima."""

    def __init__(self, row: dict[str, pa.Buffer], terms: np.ndarray, mean_length: float) -> None:
        self.ids = np.frombuffer(row["ids"], np.int64)
        length = np.frombuffer(row["lengths"], np.uint32).astype(float)
        own, df = np.frombuffer(row["terms"], np.uint64), np.frombuffer(row["df"], np.uint32).astype(np.int64)
        self.n = len(self.ids)
        #: Where each of the queries' terms is among the shard's, or -1.
        self.at = np.full(len(terms), -1)
        if len(terms) and len(own):
            spot = np.minimum(np.searchsorted(terms, own), len(terms) - 1)
            hit = np.flatnonzero(terms[spot] == own)
            self.at[spot[hit]] = hit
        self.df, self.start = df, np.cumsum(df) - df
        n = int(df.sum())
        self.docs = wide(row["docs"], n).astype(np.int64)
        tf = wide(row["tf"], n).astype(float)
        self.impact = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[self.docs] / mean_length))
        # The most frequent of the queries' terms, as rows.
        asked = np.zeros(len(own), bool)
        asked[self.at[self.at >= 0]] = True
        common = np.flatnonzero(asked & (df >= max(2, self.n * COMMON)))
        common = np.sort(common[np.argsort(-df[common], kind="stable")[:MOST_COMMON]])
        self.n_common = len(common)
        self.row = np.full(len(own), -1)
        self.row[common] = np.arange(len(common))
        at = spans(self.start[common], df[common])
        doc, place, impact = self.docs[at], np.repeat(np.arange(len(common)), df[common]), self.impact[at]
        by_doc = np.argsort(doc, kind="stable")
        doc, self.doc_row, self.doc_impact = doc[by_doc], place[by_doc], impact[by_doc]
        self.doc_first = np.searchsorted(doc, np.arange(self.n + 1))
        self.edges = np.arange(0, self.n, BLOCK)
        self.blocks = []  # for each block, the rows that have an entry in it, and these in single precision
        self.most = np.zeros((len(common), len(self.edges)), np.float32)
        for k, a in enumerate(self.edges):
            mine = slice(self.doc_first[a], self.doc_first[min(a + BLOCK, self.n)])
            dense = np.zeros((len(common), min(BLOCK, self.n - a)), np.float32)
            dense[self.doc_row[mine], doc[mine] - a] = self.doc_impact[mine]
            self.most[:, k] = dense.max(axis=1)
            some = np.flatnonzero(self.most[:, k])
            self.blocks.append((some, dense[some]))

    def rare(self, query: np.ndarray, at: np.ndarray, weight: np.ndarray, n_queries: int) -> np.ndarray:
        """What the lists at (of query, a sorted array) give to each query's documents; a piece of queries at a time."""
        size = self.df[at]
        out = np.zeros((n_queries, self.n))
        first = np.searchsorted(query, np.arange(n_queries + 1))
        done = np.concatenate(([0], np.cumsum(size)))[first]  # postings before each query
        a = 0
        while a < n_queries:
            b = max(a + 1, int(np.searchsorted(done, done[a] + PIECE, "right")) - 1)
            if done[b] > done[a]:
                mine = slice(first[a], first[b])
                p = spans(self.start[at[mine]], size[mine])
                where = self.docs[p]
                where += np.repeat((query[mine] - a) * self.n, size[mine])
                what = self.impact[p]
                what *= np.repeat(weight[mine], size[mine])
                out[a:b] = np.bincount(where, what, (b - a) * self.n).reshape(b - a, self.n)
            a = b
        return out

    def search(self, query: np.ndarray, terms: np.ndarray, weights: np.ndarray, threshold: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, ids, scores) of the best k documents here of each query that reach its threshold, best first.

        query (sorted, below len(threshold)), terms (places in the queries' terms) and weights are the queries' terms.
        """
        at = self.at[terms]
        query, weights, at = query[at >= 0], weights[at >= 0], at[at >= 0]
        n_queries = len(threshold)
        row = self.row[at]
        is_rare = row < 0
        score = self.rare(query[is_rare], at[is_rare], weights[is_rare], n_queries)
        long = np.zeros((n_queries, self.n_common))
        long[query[~is_rare], row[~is_rare]] = weights[~is_rare]
        long_rough = long.astype(np.float32)
        # The pivot: blocks whose best document can't reach the threshold with the frequent terms' maxima are skipped.
        least = threshold - SLACK
        most = (np.maximum.reduceat(score, self.edges, axis=1) + long_rough @ self.most) * (1 + ROUGH)
        live = (most > 0) & (most >= least[:, None])
        total = np.full((n_queries, self.n), -1, np.float32)
        for b, (some, dense) in enumerate(self.blocks):
            rows = np.flatnonzero(live[:, b])
            if len(rows):
                mine = slice(self.edges[b], self.edges[b] + BLOCK)
                total[rows, mine] = score[rows, mine] + long_rough.take(rows, axis=0).take(some, axis=1) @ dense
        # Single precision decides only what can't be near the threshold, or near the k-th best.
        least = np.maximum(least * (1 - ROUGH), np.finfo(np.float32).tiny)
        many = np.flatnonzero(np.count_nonzero(total >= least.astype(np.float32)[:, None], axis=1) > 4 * k)
        if len(many):
            kth = np.partition(total[many], self.n - k, axis=1)[:, self.n - k].astype(float)
            least[many] = np.maximum(least[many], kth * (1 - 3 * ROUGH) - SLACK)
        q, d = np.divmod(np.flatnonzero(total >= np.nextafter(least.astype(np.float32), np.float32(0))[:, None]), self.n)
        size = self.doc_first[d + 1] - self.doc_first[d]
        p, pair = spans(self.doc_first[d], size), np.repeat(np.arange(len(d)), size)
        s = score[q, d] + np.bincount(pair, long[q[pair], self.doc_row[p]] * self.doc_impact[p], len(d))
        found = s >= np.maximum(threshold[q] - SLACK, 1e-9)
        q, ids, s = q[found], self.ids[d[found]], np.round(s[found], PLACES)
        return best_k(q, ids, s, k)


def best_k(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of each query, by query, falling score and id."""
    order = np.lexsort((ids, -score, query))
    query, ids, score = query[order], ids[order], score[order]
    some = np.arange(len(query)) - np.searchsorted(query, query) < k
    return query[some], ids[some], score[some]


FOUND = "query_id long, doc_id long, score double"


def best_of(found: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, score, rank): each query's best k rows of found."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rounds(n_shards: int) -> list[tuple[float, float]]:
    """(from, to) of the shares of shards searched in turn: about FIRST_SHARDS shards first, then GROWTH times as many."""
    ends = [1.0]
    while ends[-1] * n_shards > FIRST_SHARDS:
        ends.append(ends[-1] / GROWTH)
    ends = ends[::-1]
    return list(zip([0.0, *ends[:-1]], ends))


def search(shards: DataFrame, queries: DataFrame, k: int = K, pass_terms: int = PASS_TERMS) -> DataFrame:
    """(query_id, rank, doc_id, score): the best k documents of each query. shards is a stored index()."""
    spark = shards.sparkSession
    queries = stored(queries)
    n_shards = shards.count()
    # A shard's place in the order of rounds: a hash of its ids, so that any part of the order is a fair part of the collection.
    place = F.pmod(F.xxhash64("ids"), F.lit(1 << 30)) / F.lit(float(1 << 30))

    @thrifty
    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length = [np.frombuffer(x.as_buffer(), np.uint32) for x in b["lengths"]]
            yield pa.RecordBatch.from_arrays([pa.array([len(x) for x in length], pa.int64()), pa.array([int(x.sum()) for x in length], pa.int64())], names=["n", "total"])

    n, total = shards.select("lengths").mapInArrow(sizes, "n long, total long").agg(F.sum("n"), F.sum("total")).first()
    mean_length = max(1.0, (total or 0) / max(1, n or 0))
    passes = 1 + queries.count() // pass_terms
    found = []
    for part in range(passes):
        mine = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == part).orderBy("query_id", "term").toArrow()
        term, inverse = np.unique(mine["term"].to_numpy().view(np.uint64), return_inverse=True)
        query = mine["query_id"].to_numpy()
        cut = np.flatnonzero(np.concatenate(([True], query[1:] != query[:-1], [True]))) if len(query) else np.zeros(1, np.int64)
        ids = query[cut[:-1]] if len(query) else query
        shared_terms = spark.sparkContext.broadcast(term)

        @thrifty
        def count(batches: Iterator[pa.RecordBatch], shared=shared_terms) -> Iterator[pa.RecordBatch]:
            wanted = shared.value
            total = np.zeros(len(wanted), np.int64)
            for b in batches:
                for terms, df in zip(b["terms"], b["df"]):
                    own, df = np.frombuffer(terms.as_buffer(), np.uint64), np.frombuffer(df.as_buffer(), np.uint32)
                    if len(wanted):
                        spot = np.minimum(np.searchsorted(wanted, own), len(wanted) - 1)
                        hit = wanted[spot] == own
                        total[spot[hit]] += df[hit]  # a term is once in a shard
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["at", "df"])

        counted = shards.select("terms", "df").mapInArrow(count, "at long, df long").groupBy("at").agg(F.sum("df").alias("df")).toArrow()
        shared_terms.destroy()
        df = np.zeros(len(term))
        df[counted["at"].to_numpy()] = counted["df"].to_numpy()
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5)) if len(term) else df
        weight = idf[inverse] * mine["qtf"].to_numpy() if len(term) else df
        threshold = np.zeros(len(ids))
        so_far = None
        for low, high in rounds(n_shards):
            shared = spark.sparkContext.broadcast((term, inverse, weight, ids, cut, threshold))

            @thrifty
            def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                term, inverse, weight, ids, cut, threshold = shared.value
                threshold = threshold.copy()
                best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)  # the queries' best k of the task's shards
                for b in batches:
                    for r in range(b.num_rows):
                        shard = Shard({c: b[c][r].as_buffer() for c in ("ids", "lengths", "terms", "df", "docs", "tf")}, term, mean_length)
                        found = [best]
                        step = max(1, min(TOGETHER, CELLS // shard.n))
                        for q in range(0, len(ids), step):
                            to = min(q + step, len(ids))
                            mine = slice(cut[q], cut[to])
                            of, doc, s = shard.search(np.repeat(np.arange(to - q), np.diff(cut[q : to + 1])), inverse[mine], weight[mine], threshold[q:to], k)
                            found.append((of + q, doc, s))
                        best = best_k(*(np.concatenate(x) for x in zip(*found)), k)
                        full = np.flatnonzero(np.arange(len(best[0])) - np.searchsorted(best[0], best[0]) == k - 1)
                        threshold[best[0][full]] = np.maximum(threshold[best[0][full]], best[2][full])
                        del shard
                for a in range(0, len(best[0]), 100_000):
                    q, doc, s = (x[a : a + 100_000] for x in best)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[q], pa.int64()), pa.array(doc, pa.int64()), pa.array(s, pa.float64())], names=["query_id", "doc_id", "score"])

            here = shards.where((place >= low) & (place < high))
            got = here.select("ids", "lengths", "terms", "df", "docs", "tf").mapInArrow(run, FOUND)
            so_far = stored(best_of(got if so_far is None else got.union(so_far.select("query_id", "doc_id", "score")), k))
            shared.destroy()
            if high < 1:
                reached = so_far.where(F.col("rank") == k).select("query_id", "score").toArrow()
                at = np.searchsorted(ids, reached["query_id"].to_numpy())
                threshold[at] = reached["score"].to_numpy()
        if so_far is not None:
            found.append(so_far)
    every = functools.reduce(DataFrame.union, found) if found else spark.createDataFrame([], FOUND + ", rank int")
    return every.select("query_id", "rank", "doc_id", "score")


def op10_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return search(stored(index(docs)), query_terms(docs.where("doc_id % 50 = 0")))


_ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents WHERE doc_id IS NOT NULL),
c AS (SELECT count(*) AS n, greatest(1.0, sum(len(w)) / count(*)) AS mean FROM d),
p AS (SELECT doc_id, len, t, count(*) AS tf FROM (SELECT doc_id, len(w) AS len, unnest(w) AS t FROM d) GROUP BY ALL),
f AS (SELECT t, count(*) AS df FROM p GROUP BY t),
s AS (SELECT q.doc_id AS query_id, p.doc_id, sum(q.tf * ln(1 + (n - df + 0.5) / (df + 0.5)) * p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * p.len / mean))) AS s
      FROM p AS q JOIN p ON q.t = p.t JOIN f ON f.t = p.t, c WHERE q.doc_id % 50 = 0 GROUP BY ALL),
r AS (SELECT query_id, doc_id, round(s, 4) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 4) DESC, doc_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 10
"""

QUERIES = {"op10_topk_search": op10_topk_search}
ORACLES = {"op10_topk_search": _ORACLE}
