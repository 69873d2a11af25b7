"""Vector retrieval: cosine and its batch and pooled forms, top-n search, validation, backlog and audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..registry import query, read


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0 or the lengths differ."""
    size = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (size == 0), 0.0).otherwise(dot(a, b) / size)


def with_query(vectors: DataFrame, query_vectors: DataFrame, name: str = "q") -> DataFrame:
    """vectors beside one query row, which is broadcast."""
    return vectors.crossJoin(F.broadcast(query_vectors.select(F.col("embedding").alias(name)).limit(1)))


def vector_search(vectors: DataFrame, query_vectors: DataFrame, k: int, id_col: str = "vec_id") -> DataFrame:
    """The k rows nearest to the query by cosine; ties go to the smaller id."""
    return with_query(vectors, query_vectors).withColumn("score", cosine(F.col("embedding"), F.col("q"))).drop("q").orderBy(F.desc("score"), id_col).limit(k)


def maxpool(vectors: DataFrame, anchors: DataFrame, id_col: str = "vec_id", most: int = 64) -> DataFrame:
    """(id, score): the best cosine over the anchors (a handful of query vectors), -1 without any."""
    pooled = anchors.orderBy("vec_id").limit(most).agg(F.collect_list("embedding").alias("anchors"))
    best = F.array_max(F.transform("anchors", lambda a: cosine(F.col("embedding"), a)))
    return vectors.crossJoin(F.broadcast(pooled)).select(id_col, F.coalesce(best, F.lit(-1.0)).alias("score"))


def mean_pool(vectors: DataFrame, by: str) -> DataFrame:
    """(by, embedding): vectors summed by position and scaled to unit length; a lone vector stays as it is."""
    n = vectors.groupBy(by).agg(F.count("*").alias("n"))
    summed = vectors.select(by, F.posexplode("embedding").alias("pos", "v")).groupBy(by, "pos").agg(F.sum(F.col("v").cast("double")).alias("v"))
    whole = summed.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"]).alias("s")).join(n, by)
    size = norm(F.col("s"))
    unit = F.when(F.col("n") == 1, F.col("s")).when(size == 0, F.col("s")).otherwise(F.transform("s", lambda v: v / size))
    return whole.select(by, unit.alias("embedding"))


_COS = "list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"


def _cos(a: str, b: str) -> str:
    return _COS.format(a=a, b=b)


def _rows(spark, d) -> DataFrame:
    return read(spark, d, "embeddings")


@query("cosine", f"SELECT a.vec_id, round({_cos('a.embedding', 'b.embedding')}, 6) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def _cosine(spark, d):
    a = _rows(spark, d)
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return a.join(b, "vec_id").select("vec_id", F.round(cosine(F.col("embedding"), F.col("other")), 6).alias("score"))


@query("cosine_batch", f"SELECT a.vec_id, round({_cos('a.embedding', 'q.embedding')}, 6) AS score FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) q")
def _batch(spark, d):
    v = _rows(spark, d)
    return with_query(v, v.where("vec_id = 0")).select("vec_id", F.round(cosine(F.col("embedding"), F.col("q")), 6).alias("score"))


@query("cosine_maxpool", f"SELECT a.vec_id, round(max({_cos('a.embedding', 'q.embedding')}), 6) AS score FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id < 3) q GROUP BY 1")
def _maxpool(spark, d):
    v = _rows(spark, d)
    return maxpool(v, v.where("vec_id < 3")).withColumn("score", F.round("score", 6))


@query("vector_search", f"SELECT a.vec_id, a.label, round({_cos('a.embedding', 'q.embedding')}, 6) AS score FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY {_cos('a.embedding', 'q.embedding')} DESC, a.vec_id LIMIT 10")
def _search(spark, d):
    v = _rows(spark, d)
    return vector_search(v, v.where("vec_id = 0"), 10).select("vec_id", "label", F.round("score", 6).alias("score"))


@query("vector_kind_max", f"SELECT label, max_by(vec_id, (s, -vec_id)) AS vec_id, round(max(s), 6) AS score FROM (SELECT a.label, a.vec_id, round({_cos('a.embedding', 'q.embedding')}, 9) AS s FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) q) GROUP BY label")
def _kind(spark, d):
    v = _rows(spark, d)
    scored = with_query(v, v.where("vec_id = 0")).select("label", "vec_id", F.round(cosine(F.col("embedding"), F.col("q")), 9).alias("s"))
    best = scored.groupBy("label").agg(F.max_by("vec_id", F.struct("s", -F.col("vec_id"))).alias("vec_id"), F.max("s").alias("s"))
    return best.select("label", "vec_id", F.round("s", 6).alias("score"))


@query("mean_pool", """WITH p AS (SELECT label, i, sum(CAST(embedding[i] AS DOUBLE)) AS v FROM (SELECT label, embedding, unnest(range(1, 65)) AS i FROM embeddings) GROUP BY ALL),
s AS (SELECT label, sqrt(sum(v * v)) AS norm, max(v) AS most, sum(CASE WHEN i = 1 THEN v END) AS first FROM p GROUP BY label) SELECT label, round(first / norm, 6) AS first, round(most / norm, 6) AS most FROM s""")
def _pool(spark, d):
    return mean_pool(_rows(spark, d), "label").select("label", F.round(F.col("embedding")[0], 6).alias("first"), F.round(F.array_max("embedding"), 6).alias("most"))


@query("identity_validate", "SELECT vec_id, abs(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) - 1) <= 0.05 AS unit FROM embeddings")
def _validate(spark, d):
    return _rows(spark, d).select("vec_id", (F.abs(norm(F.col("embedding")) - 1) <= 0.05).alias("unit"))


def embed_backlog(items: DataFrame, vectors: DataFrame, key: str, size: str, most: int) -> DataFrame:
    """Items without a vector that aren't too long for the model."""
    return items.where(F.col(size) <= most).join(vectors.select(key), key, "left_anti")


def space_audit(vectors: DataFrame, kind: Column, low: Column, embedding: str = "embedding") -> DataFrame:
    """(dim, kind, n, n_low): vectors by size and kind, and how many meet a condition."""
    return vectors.groupBy(F.size(embedding).cast("long").alias("dim"), kind.alias("kind")).agg(F.count("*").alias("n"), F.count_if(low).alias("n_low"))


@query("embed_backlog", "SELECT doc_id, n_chars FROM documents WHERE NOT EXISTS (SELECT 1 FROM embeddings WHERE vec_id = doc_id) AND n_chars <= 8000")
def _backlog(spark, d):
    have = _rows(spark, d).select(F.col("vec_id").alias("doc_id"))
    return embed_backlog(read(spark, d, "documents"), have, "doc_id", "n_chars", 8000).select("doc_id", "n_chars")


@query("embed_space_audit", "SELECT len(embedding) AS dim, label % 2 AS kind, count(*) AS n, count(*) FILTER (WHERE label < 5) AS n_low FROM embeddings GROUP BY ALL")
def _audit(spark, d):
    return space_audit(_rows(spark, d), F.col("label") % 2, F.col("label") < 5)


def hash_embedding(docs: DataFrame) -> DataFrame:
    """(doc_id, embedding) of (doc_id, text): signed token counts by hash, unit length; without tokens no row."""
    from ..functions.text import tokens

    h = F.explode(F.transform(tokens(F.col("text")), lambda t: F.xxhash64(t))).alias("h")
    placed = docs.select("doc_id", h).groupBy("doc_id", F.pmod("h", F.lit(32)).alias("pos")).agg(F.sum(F.when(F.pmod(F.shiftright("h", 8), F.lit(2)) == 0, 1.0).otherwise(-1.0)).alias("v"))
    whole = placed.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("pos", "v"))).alias("m"))
    full = whole.select("doc_id", F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.coalesce(F.element_at("m", i.cast("long")), F.lit(0.0))).alias("e"))
    size = norm(F.col("e"))
    return full.select("doc_id", F.transform("e", lambda x: F.when(size == 0, 0.0).otherwise(x / size)).alias("embedding"))


@query("embed_text", None)
def _embed(spark, d):
    """A deterministic hashing embedder in place of a model server."""
    return hash_embedding(read(spark, d, "documents"))
