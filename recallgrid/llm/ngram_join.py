"""N-gram Jaccard join by vertical partitioning: fragments of the n-gram order, partial overlaps summed by pair.

A document's set is its distinct word n-grams (the whole word sequence where it has fewer words), each as a
64-bit hash. Documents with equal sets form a class, of which one stands in for all. Then:

1. The key space is cut into fragments, and each fragment counts in how many classes each n-gram is. A
   class of which too few n-grams are shared to reach the threshold with anyone is done. What is sent is
   packed binary; n-grams common within a map task are pre-aggregated there.
2. For the rest, n-grams are put in one global order, rarest first. By the prefix principle two classes can
   only be linked if they share one of their first n-grams in that order.
3. Candidates come in two rounds. In the first, the most typical class of each such n-gram is paired with
   the others (a star, not a clique). In the second, pairs are made only between classes that links haven't
   yet joined, so no link between components is lost and no group expands into all its pairs.
4. Each pair's overlap is counted: the order is cut at pivots, each class's n-grams into segments, each
   fragment counts the overlap of a pair's two segments, and the sum per pair is held against the threshold.

Linked classes are joined to components. Following Rong et al., Fast and scalable distributed set
similarity joins for big data analytics (2017), and the prefix, length, shared-count and segment-length bounds usual there.

Defined results: a text that is null or has no word has an empty set and is its own component. Rows with
equal ids keep a row each; a row's component is the smallest id of all rows reached. Rows whose id is null
are nobody's representative but belong to their class; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import buckets as B
from .common import n_buckets, only, stored, table, thrifty, thrifty_group, unused
from .components import components
from .kernel import LOWER, SPACED, gram_rows, grams, mix, runs_hash, slices, words

N = 4
#: Percent of the union that the intersection must reach.
PERCENT = 85
FRAGMENTS = 8


def gram_sets(texts, n: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, row of each entry, n-gram) with the distinct n-grams of each row of a slice, sorted by row."""
    for i, j, data, offsets in slices(texts):
        data = LOWER[data]
        start, end, row = words(data, offsets, SPACED)
        h = runs_hash(data, start, end)
        place, g = gram_rows(h, row, n)
        rows = [row[place]]
        values = [g]
        count = np.bincount(row, minlength=j - i)
        first = np.searchsorted(row, np.arange(j - i))
        for k in range(1, n):  # texts with fewer words: all of them as one
            short = np.flatnonzero(count == k)
            if len(short):
                rows.append(short)
                values.append(mix(grams(h, k)[first[short]] + np.uint64(k)))
        r, v = np.concatenate(rows), np.concatenate(values)
        order = np.lexsort((v, r))
        r, v = r[order], v[order]
        new = np.ones(len(r), bool)
        new[1:] = (r[1:] != r[:-1]) | (v[1:] != v[:-1])
        yield i, j, r[new], v[new]


def signatures(row: np.ndarray, gram: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(set size, 64-bit name of the set) of each row; the name of an empty set is 0."""
    size = np.bincount(row, minlength=n_rows)
    total = np.zeros(n_rows, np.uint64)
    cut = np.searchsorted(row, np.flatnonzero(size))
    if len(cut):
        total[size > 0] = mix(np.add.reduceat(mix(gram), cut) + size[size > 0].astype(np.uint64))
    return size, total.view(np.int64)


def profile(docs: DataFrame, n: int = N) -> DataFrame:
    """(doc_id, n_shingles, node) of each row; node names the set."""

    @thrifty
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, row, gram in gram_sets(b["text"], n):
                size, node = signatures(row, gram, j - i)
                yield pa.RecordBatch.from_arrays([b["doc_id"].slice(i, j - i), pa.array(size, pa.int64()), pa.array(node, pa.int64())], names=["doc_id", "n_shingles", "node"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_shingles long, node long")


ASK, KNOWN = 0, 1


def single_counts(docs: DataFrame, n: int = N) -> DataFrame:
    """(node, singles): how many n-grams of a class no other class has; classes without any are left out."""
    parts = n_buckets(docs.sparkSession, docs)

    @thrifty
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = B.Packer(parts, narrow=True)
        for b in batches:
            for i, j, row, gram in gram_sets(b["text"], n):
                _, node = signatures(row, gram, j - i)
                owner = node[row]
                order = np.lexsort((owner, gram))
                gram, owner = gram[order], owner[order]
                new = np.ones(len(gram), bool)
                new[1:] = (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1])
                gram, owner = gram[new], owner[new]
                first = B.first_of(gram)
                many = np.diff(np.append(first, len(gram))) > 1
                # An n-gram that two classes here share needs no answer, but others must know of it: one record.
                one, two = first[~many], first[many]
                keys = np.concatenate((gram[one], gram[two]))
                owners = np.concatenate((owner[one], np.zeros(len(two), np.int64)))
                kinds = np.concatenate((np.full(len(one), ASK, np.int8), np.full(len(two), KNOWN, np.int8)))
                packer.add(keys, owners, kinds)
                yield from packer.full()
        yield from packer.rest()

    @thrifty_group
    def count(rows: pa.Table) -> pa.Table:
        keys, owners, kinds = B.unpack(rows, narrow=True)
        order = np.argsort(keys, kind="stable")
        keys, owners, kinds = keys[order], owners[order], kinds[order]
        first = B.first_of(keys)
        same = (np.minimum.reduceat(owners, first) == np.maximum.reduceat(owners, first)) & (np.maximum.reduceat(kinds, first) == ASK)
        node, singles = np.unique(owners[first[same]], return_counts=True)
        return B.answers(node, singles.astype(np.uint64), np.zeros(len(node), np.int8), parts)

    @thrifty_group
    def add(rows: pa.Table) -> pa.Table:
        singles, owners, _ = B.unpack(rows, narrow=False)
        node, at = np.unique(owners, return_inverse=True)
        return pa.table({"node": pa.array(node, pa.int64()), "singles": pa.array(np.bincount(at, singles, len(node)).astype(np.int64))})

    sent = docs.select("text").mapInArrow(send, B.SCHEMA)
    back = sent.repartition(parts, "bucket").groupBy("bucket").applyInArrow(count, B.SCHEMA)
    return back.repartition(parts, "bucket").groupBy("bucket").applyInArrow(add, "node long, singles long")


def least_overlap(n: str, percent: int) -> str:
    """SQL for the least overlap that a set of size n has with any set it is linked to."""
    return f"cast(ceil({n} * {percent} / 100) as long)"


def may_link(a: str, b: str, percent: int) -> str:
    """SQL: sizes, and numbers of n-grams shared with anyone (s), allow a link between sets a and b."""
    return (
        f"100 * least({a}.n, {b}.n) >= {percent} * greatest({a}.n, {b}.n)"
        f" and {100 + percent} * least({a}.s, {b}.s) >= {percent} * ({a}.n + {b}.n)"
    )


#: Fragments by which segment lengths bound an overlap.
LENGTHS = 32


def segment_lengths(listed: DataFrame) -> DataFrame:
    """(node, lengths): how many of a class's shared n-grams fall into each of LENGTHS fragments."""

    @thrifty
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [np.bincount(np.asarray(g.values, np.int64) & (LENGTHS - 1), minlength=LENGTHS) for g in b["grams"]]
            flat = pa.array(np.concatenate(rows).astype(np.int32) if rows else np.zeros(0, np.int32))
            ends = pa.array(np.arange(0, LENGTHS * len(rows) + 1, LENGTHS, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([b["node"], pa.ListArray.from_arrays(ends, flat)], names=["node", "lengths"])

    return listed.select("node", F.expr("transform(grams, x -> x.gram)").alias("grams")).mapInArrow(run, "node long, lengths array<int>")


def lengths_allow(a: str, b: str, percent: int) -> str:
    """SQL: two segments share no more than the shorter one has; the sum of that over fragments allows a link."""
    most = f"aggregate(zip_with({a}.lengths, {b}.lengths, (x, y) -> least(x, y)), 0, (sum, x) -> sum + x)"
    return f"{100 + percent} * {most} >= {percent} * ({a}.n + {b}.n)"


def links(pairs: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (a, b, na, nb) whose fragments' overlaps sum up to the threshold."""
    mine = segments.select(F.col("node").alias("a"), "fragment", F.col("grams").alias("ga"))
    other = segments.select(F.col("node").alias("b"), "fragment", F.col("grams").alias("gb"))
    partial = pairs.join(mine, "a").join(other, ["b", "fragment"]).select("a", "b", "na", "nb", F.size(F.array_intersect("ga", "gb")).alias("overlap"))
    whole = partial.groupBy("a", "b", "na", "nb").agg(F.sum("overlap").alias("overlap"))
    return whole.where(f"{100 + percent} * overlap >= {percent} * (na + nb)").select("a", "b", "overlap")


def linked(docs: DataFrame, n: int = N, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(profile of each row, (node, component) of the classes that have links); component is a node."""
    rows = stored(profile(docs, n))
    classes = rows.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"))
    able = stored(
        classes.join(single_counts(docs, n), "node", "left")
        .where(f"n - coalesce(singles, 0) >= {least_overlap('n', percent)}")
        .where("doc_id is not null")
    )

    @thrifty
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, row, gram in gram_sets(b["text"], n):
                size, node = signatures(row, gram, j - i)
                ends = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(gram.view(np.int64)))], names=["node", "grams"])

    wanted = only(docs.select("doc_id", "text"), stored(able.select("doc_id").distinct()), "doc_id")
    found = wanted.select("text").mapInArrow(sets, "node long, grams array<long>").join(able.select("node", "n"), "node")
    grams_of = stored(found.dropDuplicates(["node"]))
    flat = grams_of.select("node", "n", F.explode("grams").alias("gram"))
    common = flat.groupBy("gram").agg(F.count("*").alias("df")).where("df > 1")
    # The global order: by frequency, then by the n-gram itself (as a fraction).
    order = F.col("df") + F.pmod("gram", F.lit(1 << 40)) / F.lit(float(1 << 40))
    shared = flat.join(common, "gram").select("node", "n", "gram", order.alias("ord"))
    listed = shared.groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("ord", "gram"))).alias("grams")).withColumn("s", F.size("grams"))
    listed = stored(listed.where(f"s >= {least_overlap('n', percent)}"))
    pivots = listed.select(F.explode("grams.ord").alias("ord")).agg(F.percentile_approx("ord", [i / FRAGMENTS for i in range(1, FRAGMENTS)], 1000)).first()[0] or []
    fragment = sum(((F.col("g.ord") > p).cast("int") for p in pivots), F.lit(0))
    segments = listed.select("node", F.explode("grams").alias("g")).groupBy("node", fragment.alias("fragment")).agg(F.collect_list("g.gram").alias("grams"))
    segments = stored(segments)

    # n - least + 1 n-grams are the prefix; the n - s that nobody shares come first in it.
    reach = f"s - {least_overlap('n', percent)} + 1"
    posts = stored(listed.select("node", "n", "s", F.explode(F.expr(f"slice(transform(grams, x -> x.gram), 1, cast({reach} as int))")).alias("gram")))
    typical = posts.groupBy("gram").agg(F.min_by(F.struct("node", "n", "s"), F.struct((F.col("n") - F.col("s")) / F.col("n"), "node")).alias("t"), F.count("*").alias("k")).where("k > 1")
    star = posts.alias("p").join(typical.alias("q"), "gram").where("p.node <> t.node")
    star = star.selectExpr("struct(p.node, p.n, p.s) as p", "t").where(may_link("p", "t", percent))
    ordered = ["least(p.node, t.node) as a", "greatest(p.node, t.node) as b", "if(p.node < t.node, p.n, t.n) as na", "if(p.node < t.node, t.n, p.n) as nb"]
    tried = stored(star.selectExpr(*ordered).distinct())
    first = stored(links(tried, segments, percent))
    joined = components(first.select(F.col("a").alias("u"), F.col("b").alias("v")))

    # Second round: between components only. In each posting list, what isn't in the largest component meets the rest.
    placed = stored(posts.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node")))
    sizes = placed.groupBy("gram", "component").agg(F.count("*").alias("k"))
    largest = sizes.groupBy("gram").agg(F.max_by("component", F.struct("k", "component")).alias("main"), F.count("*").alias("parts")).where("parts > 1").drop("parts")
    mixed = stored(placed.join(largest, "gram").join(segment_lengths(listed), "node"))
    rest = mixed.where("component <> main").select("gram", F.struct("node", "n", "s", "component", "lengths").alias("p"))
    every = mixed.select("gram", F.struct("node", "n", "s", "component", "lengths", (F.col("component") == F.col("main")).alias("main")).alias("t"))
    across = rest.join(every, "gram").where("p.component <> t.component and (t.main or p.node < t.node)").where(may_link("p", "t", percent)).where(lengths_allow("p", "t", percent))
    pairs = across.selectExpr(*ordered).distinct().join(tried.select("a", "b"), ["a", "b"], "left_anti")
    second = links(stored(pairs), segments, percent)
    every_link = first.union(second).select(F.col("a").alias("u"), F.col("b").alias("v"))
    return rows, components(every_link)


def named(docs: DataFrame, n: int = N, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(profile of each row, (node, class_id, component_id) of each class with an id)."""
    rows, joined = linked(docs, n, percent)
    classes = rows.where("n_shingles > 0 and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("class_id"))
    classes = classes.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = classes.groupBy("component").agg(F.min("class_id").alias("component_id"))
    return rows, classes.join(smallest, "component").select("node", "class_id", "component_id")


def ngram_jaccard_join(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, class_id) of each row; class_id is the smallest id with the same set."""
    rows, names = named(docs, n, percent)
    full = rows.where("n_shingles > 0").join(names, "node", "left").select("doc_id", "n_shingles", "component_id", "class_id")
    empty = rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.col("doc_id").alias("class_id"))
    return full.union(empty)


def one_of_each(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """The rows of docs, with their own columns only, of which one stays for each component: the smallest id's.

    Rows without words stay, and so do rows without an id unless a row with an id has the same set.
    """
    rows, names = named(docs.select("doc_id", "text"), n, percent)
    node_col, id_col = unused(docs, "_node", "_id")
    as_text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    mine = names.where("class_id = component_id").select(F.col("node").alias(node_col), as_text("class_id").alias(id_col))
    unnamed = rows.where("n_shingles > 0 and doc_id is null").select("node").distinct().join(names, "node", "left_anti")
    keep = stored(mine.union(unnamed.select(F.col("node").alias(node_col), F.lit("").alias(id_col))))
    own_columns = docs.columns

    @thrifty
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, row, gram in gram_sets(b["text"], n):
                _, node = signatures(row, gram, j - i)
                part = b.slice(i, j - i)
                ids = pa.array([str(x) if x is not None else "" for x in part["doc_id"].to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(node, pa.int64()), ids], names=[*own_columns, node_col, id_col])

    shape = docs.withColumns({node_col: F.lit(0).cast("long"), id_col: F.lit("").cast("string")}).schema
    marked = docs.mapInArrow(mark, shape)
    both = [node_col, id_col]
    empty = marked.where(F.col(node_col) == 0)
    kept = only(marked.where(F.col(node_col) != 0), keep, both)
    # Equal rows are copies too: ids that several rows with one set share are made single.
    again = stored(rows.where("n_shingles > 0").groupBy("node", "doc_id").count().where("count > 1").select(F.col("node").alias(node_col), as_text("doc_id").alias(id_col)))
    if again.count():
        kept = only(kept, again, both, "left_anti").unionByName(only(kept, again, both).dropDuplicates(both))
    return kept.unionByName(empty).drop(*both)


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


_ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[s : s + least(len(w), 4) - 1], ' ') AS gram
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(len(w), 4) + 2)) AS s FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
e AS MATERIALIZED (SELECT a AS u, b AS v FROM l UNION ALL SELECT b, a FROM l),
r(root, node) AS (SELECT u, u FROM e UNION SELECT r.root, e.v FROM r JOIN e ON r.node = e.u WHERE e.v > r.root OR e.v < r.root),
c AS (SELECT node AS doc_id, min(root) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""

QUERIES = {"op1_ngram_jaccard_join": op1_ngram_jaccard_join}
ORACLES = {"op1_ngram_jaccard_join": _ORACLE}
