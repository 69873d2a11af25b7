"""Entity operators: counts and mentions, lookup, resolution, rule extraction, surfaces, coalescing."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..registry import query, read
from .nearby import filled

FUZZY, COSINE = 0.85, 0.92
#: Names in one block of the coalescing pass; larger blocks are split by their second token.
MERGE_FUZZY, MERGE_COSINE, FLAG_COSINE = 90, 0.95, 0.80
#: Vectors in one side of a cell where all vectors of a block are compared.
CELL_ROWS = 2000


def count_entities(items: DataFrame, mentions: DataFrame, entities: DataFrame, conversation, type_: str | None = None, name: str | None = None) -> DataFrame:
    """The number of distinct entities that a conversation's items mention; the conversation must be given."""
    if conversation in (None, ""):
        raise ValueError("a conversation is needed")
    e = entities.where(F.col("entity_type") == type_) if type_ else entities
    e = e.where(F.col("name").like(name)) if name else e
    m = mentions.join(items.where(F.col("conversation_id") == conversation).select("memory_id"), "memory_id", "left_semi")
    return m.join(e.select("entity_id"), "entity_id", "left_semi").agg(F.countDistinct("entity_id").alias("n"))


def count_mentions(mentions: DataFrame, entities: DataFrame, limit: int = 1000) -> DataFrame:
    """Mentions per entity, most first, then by name, and the number of entities there are."""
    n = mentions.groupBy("entity_id").agg(F.count("*").alias("n"))
    total = n.agg(F.count("*").alias("total"))
    return n.join(entities, "entity_id").orderBy(F.desc("n"), "name", "entity_id").limit(min(limit, 10_000)).crossJoin(F.broadcast(total))


def token_jaccard(a: Column, b: Column) -> Column:
    x, y = F.array_distinct(X.tokens(a)), F.array_distinct(X.tokens(b))
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(x, y)) / union)


#: Entities of a type, newest first, that the cosine step of resolve looks at: the operator's own bound.
NEWEST = 100


def resolve(names: DataFrame, entities: DataFrame, fuzzy: float = FUZZY, name_vectors: DataFrame | None = None, entity_vectors: DataFrame | None = None, least: float = COSINE, newest: int = NEWEST) -> DataFrame:
    """(name, type, entity_id, how) of each name (name, type) that has an entity (entity_id, name, entity_type, created_at).

    Only entities of the name's type count, at every step: exact (whatever the case); else fuzzy, the best token
    Jaccard of at least fuzzy (candidates share a token); else, where vectors are given (name, embedding and
    entity_id, embedding), cosine: the best of at least `least` among the type's newest entities. Ties go to the
    smaller id, those of the cosine to the newer entity.
    """
    key = ["name", "type"]
    n = names.select(*key).distinct()
    e = entities.select("entity_id", F.col("name").alias("e_name"), F.col("entity_type").alias("type"))
    low = lambda df, c: df.withColumn("_low", F.lower(c))
    first = low(e, "e_name").groupBy("_low", "type").agg(F.min("entity_id").alias("entity_id"))
    exact = low(n, "name").join(first, ["_low", "type"]).select(*key, "entity_id", F.lit("exact").alias("how"))
    rest = n.join(exact.select(*key), key, "left_anti")
    # Names with the same tokens have the same matches: only sets of tokens are compared, each with its smallest id.
    bag = lambda c: F.array_sort(F.array_distinct(X.tokens(F.col(c))))
    named = rest.withColumn("a", bag("name"))
    x = named.select("type", "a").distinct().withColumn("t", F.explode("a"))
    y = e.groupBy("type", bag("e_name").alias("b")).agg(F.min("entity_id").alias("entity_id")).withColumn("t", F.explode("b"))
    pairs = x.join(y, ["t", "type"]).withColumn("j", F.size(F.array_intersect("a", "b")) / F.size(F.array_union("a", "b"))).where(F.col("j") >= fuzzy)
    sets = pairs.groupBy("type", "a").agg(F.max_by("entity_id", F.struct("j", -F.col("entity_id"))).alias("entity_id"))
    best = named.join(sets, ["type", "a"]).select(*key, "entity_id", F.lit("fuzzy").alias("how"))
    found = exact.unionByName(best)
    if name_vectors is None or entity_vectors is None:
        return found
    left = rest.join(best.select(*key), key, "left_anti").join(name_vectors.where("embedding is not null").select("name", F.col("embedding").alias("embedding")), "name")
    nth = F.row_number().over(Window.partitionBy("entity_type").orderBy(F.desc("created_at"), "entity_id"))
    recent = entities.withColumn("_nth", nth).where(F.col("_nth") <= newest).join(entity_vectors.where("embedding is not null"), "entity_id").select("entity_id", F.col("entity_type").alias("type"), "_nth", "embedding")
    # Names of a type are dealt into shares, and its newest entities go to each of them.
    shares = max(1, -(-name_vectors.count() // SHARE_NAMES))
    left = left.withColumn("_share", F.pmod(F.xxhash64("name"), F.lit(shares)))
    recent = recent.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)).cast("array<bigint>")))
    schema = ", ".join(f"{c} {dict(df.dtypes)[c]}" for df, c in ((n, "name"), (n, "type"), (e, "entity_id"))) + ", s double, _nth int"
    near = left.groupBy("type", "_share").cogroup(recent.groupBy("type", "_share")).applyInArrow(lambda a, b: _closest(a, b, least), schema)
    return found.unionByName(near.groupBy(*key).agg(F.max_by("entity_id", F.struct("s", -F.col("_nth"))).alias("entity_id")).withColumn("how", F.lit("cosine")))


#: Vectors of names that are compared with a type's newest entities by one task at a time.
SHARE_NAMES = 20_000


def _closest(names: pa.Table, entities: pa.Table, least: float) -> pa.Table:
    """(name, type, entity_id, s, _nth): of each name the entity of the best cosine of at least `least`, the first by _nth."""
    entities = entities.sort_by("_nth")
    (q, size, length), (v, dims, norms) = filled(names), filled(entities)
    best, whom = np.full(len(q), -np.inf), np.zeros(len(q), np.int64)
    for k, d in enumerate(dims):
        over = length * norms[k]
        fits = (size == d) & (over > 0)
        w = min(int(d), q.shape[1])
        s = np.where(fits, np.einsum("ij,j->i", q[:, :w], v[k, :w]) / np.where(fits, over, 1.0), 0.0)
        better = s > best
        best[better], whom[better] = s[better], k
    mine = np.flatnonzero(best >= least)
    e = entities.take(pa.array(whom[mine]))
    return pa.table({"name": names["name"].take(pa.array(mine)), "type": names["type"].take(pa.array(mine)), "entity_id": e["entity_id"], "s": best[mine], "_nth": e["_nth"]})


def normalized_id(name: Column, type_: Column) -> Column:
    clean = F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), r"(?U)[^\w\s-]", ""), r"[\s_]+", "_")
    return F.concat(F.lower(F.trim(type_)), F.lit(":"), clean)


def canonical_predicate(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), r"(?U)[^\w\s-]", ""), r"[\s_-]+", "_")


def rule_mentions(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, mention, offset): capitalised phrases of two words and more, with the place of their first occurrence."""
    found = docs.select(id_col, F.col(text).alias("_t"), F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(r"[A-Z][a-z]+(?: [A-Z][a-z]+)+"), F.lit(0)))).alias("mention"))
    return found.select(id_col, "mention", F.expr("locate(mention, _t)").cast("long").alias("offset"))


def surface(items: DataFrame, mentions: DataFrame, types: list[str], cap: int) -> DataFrame:
    """Per conversation the cap items that mention entities of types, by highest confidence, newest, id."""
    m = mentions.where(F.col("entity_type").isin(types)).groupBy("memory_id").agg(F.max("confidence").alias("confidence"))
    w = Window.partitionBy("conversation_id").orderBy(F.desc("confidence"), F.desc("created_at"), "memory_id")
    return items.join(m, "memory_id").withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= cap)


def block_key(name: Column) -> Column:
    return F.regexp_extract(F.lower(name), r"[a-z0-9]+", 0)


def numeric_collision(a: Column, b: Column) -> Column:
    """Names that are equal but for differing numbers are different things."""
    ta, tb = (F.regexp_extract_all(F.lower(x), F.lit(r"[a-z]+|\d+"), F.lit(0)) for x in (a, b))
    digit = lambda c: c.rlike(r"^\d+$")
    differs = F.zip_with(ta, tb, lambda x, y: F.when(x == y, 0).when(digit(x) | digit(y), 1).otherwise(2))
    return (F.size(ta) == F.size(tb)) & (F.array_max(differs) == 1)


def underscore_collision(a: Column, b: Column) -> Column:
    bare = lambda c: F.regexp_replace(F.lower(c), "^_+", "")
    return (F.lower(a) != F.lower(b)) & (bare(a) == bare(b))


def token_sort_ratio(a: Column, b: Column) -> Column:
    """100 * (1 - edits / length) of the names with their tokens sorted."""
    s = lambda c: F.array_join(F.array_sort(X.tokens(c)), " ")
    longest = F.greatest(F.char_length(s(a)), F.char_length(s(b)))
    return F.when(longest == 0, 0.0).otherwise(100 * (1 - F.levenshtein(s(a), s(b)) / longest))


def segment_keys(text: str, fuzzy: float) -> set[tuple[bool, str]]:
    """(long, key) of a text, as the shorter and as the longer one of a pair.

    A pair of lengths l <= n has at most k = n * (1 - fuzzy / 100) edits, so of k + 1 segments of the shorter text
    one is whole in the longer text, at most k places away (Li, Deng, Wang and Feng, Pass-Join, 2011).
    """
    most = lambda n: int(n * (100 - fuzzy) / 100 + 1e-9)
    size, out = len(text), set()

    def segments(length: int, k: int):
        bounds = [length * i // (k + 1) for i in range(k + 2)]
        return enumerate(zip(bounds, bounds[1:]))

    n = size
    while n - size <= most(n) and most(n) <= n:
        out |= {(False, f"{size}.{n}.{i}.{text[p:q]}") for i, (p, q) in segments(size, most(n))}
        n += 1
        if fuzzy <= 0 or n > size / (fuzzy / 100) + 2:
            break
    k = most(size)
    for less in range(max(0, size - k), size + 1):
        for i, (p, q) in segments(less, k):
            out |= {(True, f"{less}.{size}.{i}.{text[s : s + q - p]}") for s in range(max(0, p - k), min(size - (q - p), p + k) + 1)}
    return out


def _coalescible(entities: DataFrame) -> DataFrame:
    return entities.where(~F.col("name").rlike(r"^\s*$|^[^\w]|^\d"))


def coalesce_candidates(entities: DataFrame, fuzzy: float = MERGE_FUZZY, vectors: DataFrame | None = None) -> DataFrame:
    """(a, b, ratio, band) of names (id, name) that share a block, their first token.

    All pairs with a ratio of at least fuzzy: merge from MERGE_COSINE on, else review, as where a guard objects. With
    vectors (id, embedding), also all pairs of a lesser ratio whose cosine is at least FLAG_COSINE, for review.
    """
    from .lifecycle import block_pairs

    kept = _coalescible(entities).select("id", "name", block_key(F.col("name")).alias("g"))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, g, far, key) for i, g, s in zip(*(b[c].to_pylist() for c in ("id", "g", "s"))) for far, key in segment_keys(s, fuzzy)]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in enumerate((pa.int64(), pa.string(), pa.bool_(), pa.string()))], names=["id", "g", "far", "key"])

    keys = kept.select(F.col("id").cast("long").alias("id"), "g", F.array_join(F.array_sort(X.tokens(F.col("name"))), " ").alias("s")).mapInArrow(send, "id long, g string, far boolean, key string")
    near = keys.where("not far").select(F.col("id").alias("i"), "g", "key").join(keys.where("far").select(F.col("id").alias("j"), "g", "key"), ["g", "key"]).where("i <> j")
    found = near.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).distinct().withColumn("close", F.lit(False))
    if vectors is not None:
        found = found.unionByName(block_pairs(kept.join(vectors, "id"), FLAG_COSINE, CELL_ROWS).select("a", "b").withColumn("close", F.lit(True)))
        found = found.groupBy("a", "b").agg(F.max("close").alias("close"))
    name = kept.select("id", "name")
    both = found.join(name.toDF("a", "na"), "a").join(name.toDF("b", "nb"), "b").withColumn("ratio", token_sort_ratio(F.col("na"), F.col("nb"))).where((F.col("ratio") >= fuzzy) | F.col("close"))
    guarded = numeric_collision(F.col("na"), F.col("nb")) | underscore_collision(F.col("na"), F.col("nb"))
    sure = (F.col("ratio") >= fuzzy) & (F.col("ratio") >= 100 * MERGE_COSINE)
    return both.select("a", "b", "ratio", F.when(guarded | ~sure, "review").otherwise("merge").alias("band"))


def coalesce_classes(entities: DataFrame, fuzzy: float = MERGE_FUZZY, embed: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """coalesce_candidates of names, not of rows: a class is all rows (id, name) of one name, its smallest id stands for it.

    Pairs are those between classes' ids, and (smallest id, id) for each other row of a class. A pair of rows is near as
    the pair of their classes is; rows of one class merge. embed makes vectors (id, embedding) of the classes (id, name).
    """
    kept = _coalescible(entities).select("id", "name")
    classes = kept.groupBy("name").agg(F.min("id").alias("id")).select("id", "name")
    between = coalesce_candidates(classes, fuzzy, embed(classes) if embed else None)
    copies = kept.join(classes.withColumnRenamed("id", "a"), "name").where("id <> a")
    within = copies.select("a", F.col("id").alias("b"), F.lit(100.0).alias("ratio"), F.lit("merge").alias("band"))
    return between.unionByName(within)


def representative(members: DataFrame) -> DataFrame:
    """(cluster, id): the member of the highest degree, then the longest name, then the smallest id."""
    return members.groupBy("cluster").agg(F.max_by("id", F.struct("degree", F.char_length("name"), -F.col("id"))).alias("id"))


def apply_merges(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(id, cluster): components of accepted pairs (a, b), named by their representative; the order-free form."""
    from .graph import components

    c = components(pairs.select(F.col("a").alias("from_id"), F.col("b").alias("to_id"))).withColumnRenamed("component", "cluster")
    named = representative(c.join(members, "id")).withColumnRenamed("id", "rep")
    return c.join(named, "cluster").select("id", F.col("rep").alias("cluster"))


def unapply_cluster(assigned: DataFrame, cluster) -> DataFrame:
    """assigned (id, cluster) with the members of one cluster on their own again."""
    return assigned.withColumn("cluster", F.when(F.col("cluster") == cluster, F.col("id")).otherwise(F.col("cluster")))


def mentions_of(mentions: DataFrame, entity) -> DataFrame:
    """(memory_id): the items that mention an entity, once each."""
    return mentions.where(F.col("entity_id") == entity).select("memory_id").distinct()


def entity_search(entities: DataFrame, links: DataFrame, like: str, limit: int) -> DataFrame:
    """(entity_id, name, neighbours) of entities whose name is LIKE a pattern, by how many others they are linked to.

    links is (entity_id, neighbour).
    """
    found = entities.where(F.col("name").like(like)).join(links, "entity_id", "left")
    return found.groupBy("entity_id", "name").agg(F.countDistinct("neighbour").alias("neighbours")).orderBy(F.desc("neighbours"), "entity_id").limit(limit)


def entity_get(entities: DataFrame, links: DataFrame, mentions: DataFrame, entity) -> DataFrame:
    """(entity_id, name, neighbours, mentions) of one entity: the sorted neighbours, and how many items mention it."""
    one = entities.where(F.col("entity_id") == entity).select("entity_id", "name")
    near = links.where(F.col("entity_id") == entity).groupBy("entity_id").agg(F.array_join(F.array_sort(F.collect_set(F.col("neighbour").cast("string"))), ",").alias("neighbours"))
    n = mentions.where(F.col("entity_id") == entity).groupBy("entity_id").agg(F.countDistinct("memory_id").alias("mentions"))
    return one.join(near, "entity_id", "left").join(n, "entity_id", "left")


def extraction_backlog(items: DataFrame, done: DataFrame, failed: DataFrame, key: str) -> DataFrame:
    """Items from which nothing has been extracted and no extraction has failed."""
    return items.join(done.select(key), key, "left_anti").join(failed.select(key), key, "left_anti")


def entity_expand(mentions: DataFrame, seeds: DataFrame, cap: int) -> DataFrame:
    """(memory_id): items that mention the seeds (entity_id) or entities that share a group with them.

    mentions is (memory_id, entity_id, group_id). At most cap entities are taken, by id: the operator's own bound.
    """
    m = mentions.select("group_id", "entity_id").distinct()
    near = m.join(seeds, "entity_id", "left_semi").select("group_id").distinct().join(m, "group_id").select("entity_id")
    kept = seeds.select("entity_id").union(near).distinct().orderBy("entity_id").limit(cap)
    return mentions.join(kept, "entity_id", "left_semi").select("memory_id").distinct()


def block_sizes(names: DataFrame, name: str) -> DataFrame:
    """(block, n): how many names are compared with each other."""
    return names.groupBy(block_key(F.col(name)).alias("block")).agg(F.count("*").alias("n"))


def _lines(spark, d) -> DataFrame:
    return read(spark, d, "lineitem").select(F.col("l_orderkey").alias("memory_id"), F.col("l_partkey").alias("entity_id"), F.col("l_suppkey").alias("group_id"), F.col("l_suppkey").alias("neighbour"))


def _parts(spark, d):
    return read(spark, d, "part").select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("entity_type"))


@query("count_entities", "SELECT count(DISTINCT l_partkey) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE o_custkey = 7 AND p_brand LIKE 'Brand#%' AND p_name LIKE '%a%'")
def _count(spark, d):
    line = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("memory_id"), F.col("l_partkey").alias("entity_id"))
    items = read(spark, d, "orders").select(F.col("o_orderkey").alias("memory_id"), F.col("o_custkey").alias("conversation_id"))
    return count_entities(items, line, _parts(spark, d), 7, name="%a%")


@query("count_mentions", "WITH n AS (SELECT l_partkey AS entity_id, count(*) AS n FROM lineitem GROUP BY 1) SELECT entity_id, p_name AS name, n, (SELECT count(*) FROM n) AS total FROM n JOIN part ON p_partkey = entity_id ORDER BY n DESC, name, entity_id LIMIT 20")
def _mentions(spark, d):
    m = read(spark, d, "lineitem").select(F.col("l_partkey").alias("entity_id"))
    return count_mentions(m, _parts(spark, d).select("entity_id", "name"), 20).select("entity_id", "name", "n", "total")


@query("list_mentions", "SELECT DISTINCT l_orderkey AS memory_id FROM lineitem WHERE l_partkey = 15")
def _list(spark, d):
    return mentions_of(_lines(spark, d), 15)


@query("entity_search", "SELECT p_partkey AS entity_id, p_name AS name, count(DISTINCT l_suppkey) AS neighbours FROM part LEFT JOIN lineitem ON l_partkey = p_partkey WHERE p_name LIKE '%blue%' AND p_size < 25 GROUP BY ALL ORDER BY neighbours DESC, entity_id LIMIT 25")
def _esearch(spark, d):
    small = read(spark, d, "part").where("p_size < 25").select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("name"))
    return entity_search(small, _lines(spark, d).select("entity_id", "neighbour"), "%blue%", 25)


@query("entity_get", "SELECT p_partkey AS entity_id, p_name AS name, (SELECT string_agg(DISTINCT CAST(l_suppkey AS VARCHAR), ',' ORDER BY CAST(l_suppkey AS VARCHAR)) FROM lineitem WHERE l_partkey = 15) AS suppliers, (SELECT count(DISTINCT l_orderkey) FROM lineitem WHERE l_partkey = 15) AS orders FROM part WHERE p_partkey = 15")
def _eget(spark, d):
    found = entity_get(_parts(spark, d), _lines(spark, d), _lines(spark, d), 15)
    return found.select("entity_id", "name", F.col("neighbours").alias("suppliers"), F.col("mentions").alias("orders"))


@query("token_jaccard", r"WITH t AS (SELECT p_partkey, p_type, list_distinct(list_filter(string_split_regex(lower(p_name), '[^\p{L}\p{N}_]+'), lambda t: t <> '')) AS w FROM part) SELECT a.p_partkey AS a, b.p_partkey AS b, round(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))), 6) AS j FROM t a JOIN t b ON b.p_partkey = a.p_partkey + 1")
def _jaccard(spark, d):
    a = read(spark, d, "part").select(F.col("p_partkey").alias("a"), F.col("p_name").alias("na"))
    b = read(spark, d, "part").select((F.col("p_partkey") - 1).alias("a"), F.col("p_partkey").alias("b"), F.col("p_name").alias("nb"))
    return a.join(b, "a").select("a", "b", F.round(token_jaccard(F.col("na"), F.col("nb")), 6).alias("j"))


@query("entity_resolve", r"""WITH e AS (SELECT p_partkey AS id, p_name AS name, CASE WHEN p_partkey % 4 < 2 THEN 'part' ELSE 'item' END AS type, list_distinct(list_filter(string_split_regex(lower(p_name), '[^\p{L}\p{N}_]+'), lambda t: t <> '')) AS w FROM part),
n0 AS (SELECT CASE WHEN id % 3 = 0 THEN upper(name) WHEN id % 3 = 1 THEN name || ' extra' ELSE 'zz' || id END AS name, id FROM e),
n AS (SELECT DISTINCT name, type FROM n0, (SELECT unnest(['part', 'item']) AS type)),
nw AS (SELECT name, type, list_distinct(list_filter(string_split_regex(lower(name), '[^\p{L}\p{N}_]+'), lambda t: t <> '')) AS w FROM n),
x AS (SELECT n.name, n.type, min(e.id) AS entity_id, 'exact' AS how FROM n JOIN e ON lower(n.name) = lower(e.name) AND n.type = e.type GROUP BY 1, 2),
f AS (SELECT nw.name, nw.type, e.id, len(list_intersect(nw.w, e.w)) / len(list_distinct(list_concat(nw.w, e.w))) AS j FROM nw JOIN e ON nw.type = e.type AND list_has_any(nw.w, e.w) WHERE (nw.name, nw.type) NOT IN (SELECT name, type FROM x)),
g AS (SELECT name, type, max_by(id, (j, -id)) AS entity_id, 'fuzzy' AS how FROM f WHERE j >= 0.6 GROUP BY 1, 2),
q AS (SELECT 'zz' || (vec_id * 3 + 2) AS name, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
r AS (SELECT e.id, e.type, row_number() OVER (PARTITION BY type ORDER BY id) AS nth FROM e QUALIFY nth <= 100),
c AS (SELECT n.name, n.type, r.id, r.nth, list_cosine_similarity(q.v, CAST(embedding AS DOUBLE[])) AS s FROM n JOIN q USING (name) JOIN r ON r.type = n.type JOIN embeddings ON vec_id = r.id),
h AS (SELECT name, type, max_by(id, (s, -nth)) AS entity_id, 'cosine' AS how FROM c WHERE s >= 0.25 GROUP BY 1, 2)
SELECT * FROM x UNION ALL SELECT * FROM g UNION ALL SELECT * FROM h""")
def _resolve(spark, d):
    """Two types, with every name in both; names of the last third have no token in common with any entity."""
    e = read(spark, d, "part").select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 4 < 2, "part").otherwise("item").alias("entity_type"), (-F.col("p_partkey")).alias("created_at"))
    k = F.col("entity_id") % 3
    name = F.when(k == 0, F.upper("name")).when(k == 1, F.concat("name", F.lit(" extra"))).otherwise(F.concat(F.lit("zz"), F.col("entity_id").cast("string")))
    names = e.select(name.alias("name"), F.explode(F.array(F.lit("part"), F.lit("item"))).alias("type"))
    v = read(spark, d, "embeddings")
    of_names = v.select(F.concat(F.lit("zz"), (F.col("vec_id") * 3 + 2).cast("string")).alias("name"), "embedding")
    return resolve(names, e, 0.6, of_names, v.select(F.col("vec_id").alias("entity_id"), "embedding"), least=0.25)


@query("entity_extract_rules", r"SELECT doc_id, mention, CAST(strpos(text, mention) AS BIGINT) AS 'offset' FROM (SELECT doc_id, text, unnest(list_distinct(regexp_extract_all(text, '[A-Z][a-z]+(?: [A-Z][a-z]+)+'))) AS mention FROM documents)")
def _extract(spark, d):
    return rule_mentions(read(spark, d, "documents"), "doc_id", "text")


@query("normalize_entity", r"SELECT p_partkey, lower(trim(p_brand)) || ':' || regexp_replace(regexp_replace(lower(trim(p_name)), '[^\p{L}\p{N}_\s-]', '', 'g'), '[\s_]+', '_', 'g') AS id, regexp_replace(regexp_replace(lower(trim(p_type)), '[^\p{L}\p{N}_\s-]', '', 'g'), '[\s_-]+', '_', 'g') AS predicate FROM part")
def _normalize(spark, d):
    return read(spark, d, "part").select("p_partkey", normalized_id(F.col("p_name"), F.col("p_brand")).alias("id"), canonical_predicate(F.col("p_type")).alias("predicate"))


@query("extraction_backlog", "SELECT doc_id FROM documents WHERE lang IN ('en', 'de') AND doc_id NOT IN (SELECT doc_id FROM labels) AND doc_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error')")
def _backlog(spark, d):
    failed = read(spark, d, "events").where("event_type = 'error'").select(F.col("user_id").alias("doc_id"))
    return extraction_backlog(read(spark, d, "documents").where("lang in ('en', 'de')"), read(spark, d, "labels"), failed, "doc_id").select("doc_id")


@query("build_bypass_surface", "WITH m AS (SELECT l_orderkey, max(l_discount) AS confidence FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_brand IN ('Brand#11', 'Brand#12', 'Brand#13') GROUP BY 1) SELECT o_custkey AS conversation_id, o_orderkey AS memory_id, row_number() OVER (PARTITION BY o_custkey ORDER BY confidence DESC, o_orderdate DESC, o_orderkey) AS pos FROM orders JOIN m ON l_orderkey = o_orderkey QUALIFY pos <= 3")
def _surface(spark, d):
    items = read(spark, d, "orders").select(F.col("o_custkey").alias("conversation_id"), F.col("o_orderkey").alias("memory_id"), F.col("o_orderdate").alias("created_at"))
    m = read(spark, d, "lineitem").join(read(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("memory_id"), F.col("p_brand").alias("entity_type"), F.col("l_discount").alias("confidence"))
    return surface(items, m, ["Brand#11", "Brand#12", "Brand#13"], 3).select("conversation_id", "memory_id", "pos")


@query("entity_graph_expand", "WITH m AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem), s0 AS (SELECT p_partkey AS p FROM part WHERE p_name LIKE '%blue%' ORDER BY p_name, p_partkey LIMIT 5), h1 AS (SELECT DISTINCT b.p FROM m a JOIN m b ON a.s = b.s WHERE a.p IN (SELECT p FROM s0)), k AS (SELECT p FROM (SELECT p FROM s0 UNION SELECT p FROM h1) ORDER BY p LIMIT 100) SELECT DISTINCT l_orderkey AS memory_id FROM lineitem WHERE l_partkey IN (SELECT p FROM k)")
def _expand(spark, d):
    seeds = read(spark, d, "part").where("p_name like '%blue%'").orderBy("p_name", "p_partkey").limit(5).select(F.col("p_partkey").alias("entity_id"))
    return entity_expand(_lines(spark, d), seeds, 100)


_NAMES = "(SELECT s_suppkey AS id, s_name AS name FROM supplier)"


@query("coalesce_blocking", "SELECT regexp_extract(lower(c_name), '[a-z0-9]+') AS block, count(*) AS n FROM customer GROUP BY 1")
def _blocks(spark, d):
    return block_sizes(read(spark, d, "customer"), "c_name")


@query("coalesce_detect")
def _coalesce(spark, d):
    from .vector import hash_embedding

    names = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return coalesce_classes(names, embed=lambda c: hash_embedding(c.toDF("doc_id", "text")).toDF("id", "embedding"))


@query("pick_representative", "SELECT s_nationkey AS cluster, max_by(s_suppkey, (n, length(s_name), -s_suppkey)) AS id FROM supplier JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey GROUP BY 1")
def _representative(spark, d):
    degree = read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(F.count("*").alias("degree"))
    return representative(read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("cluster")).join(degree, "id"))


@query("apply_coalescence", "SELECT s_suppkey AS id, first_value(s_suppkey) OVER (PARTITION BY s_suppkey // 4 ORDER BY length(s_name) DESC, s_suppkey) AS cluster FROM supplier")
def _apply(spark, d):
    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit(0).alias("degree"))
    pairs = s.select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).where("a % 4 <> 3").join(s.select(F.col("id").alias("b")), "b", "left_semi")
    return apply_merges(pairs, s)


@query("unapply_coalescence", "SELECT s_suppkey AS id, CASE WHEN s_suppkey // 4 = 3 THEN s_suppkey ELSE s_suppkey // 4 * 4 END AS cluster FROM supplier")
def _unapply(spark, d):
    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.floor(F.col("s_suppkey") / 4) * 4).alias("cluster"))
    return unapply_cluster(s, 12)
