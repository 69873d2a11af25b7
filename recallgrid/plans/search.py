"""The whole retrieval pipelines, composed from the ranking operators, and their expansions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import graph, ranking
from ..operators.ranking import candidates
from ..registry import query, read


def scored(hits: DataFrame, k: int, dates: list[str] | None = None, recency: float = 0.0, diversify: bool = True) -> DataFrame:
    """hits (id, content, score, valid_from, embedding) in the order that is kept: temporal boost, recency, elbow,
    content dedup to 3k, diversity to k. -> (id, score, position)."""
    pool = hits.orderBy(F.desc("score"), "id").limit(max(60, 3 * k))
    if dates:
        pool = pool.withColumn("score", F.col("score") + ranking.temporal_boost(F.col("valid_from").try_cast("date"), dates))
    if recency:
        pool = ranking.recency_bonus(pool, recency)
    pool = ranking.content_dedup(ranking.elbow_trim(pool), "content", 3 * k)
    if diversify:
        return ranking.mmr(pool.withColumn("query", F.lit(0)), k).drop("query")
    best = pool.orderBy(F.desc("score"), "id").limit(k)
    return best.select("id", "score", F.row_number().over(Window.orderBy(F.desc("score"), "id")).cast("long").alias("position"))


def smart_expand(hits: DataFrame, neighbours: DataFrame, weight: float = 0.1) -> DataFrame:
    """hits and neighbours (id, score, valid_from) fused by the higher score, plus a bonus by recency rank, newest full."""
    both = hits.select("id", "score", "valid_from").unionByName(neighbours.select("id", "score", "valid_from"))
    fused = both.groupBy("id").agg(F.max("score").alias("score"), F.max("valid_from").alias("valid_from"))
    w, n = Window.orderBy("valid_from", "id"), F.count("*").over(Window.partitionBy())  # over the pools' rows only
    return fused.withColumn("score", F.col("score") + F.when(n > 1, weight * (F.row_number().over(w) - 1) / (n - 1)).otherwise(weight))


def expanded(hits: DataFrame, edges: DataFrame, rows: DataFrame, scope: str, k: int, depth: int = 1) -> DataFrame:
    """hits with their graph neighbours of the same scope, fused; expansions are held back at the first ranks."""
    near = graph.khop(edges, hits.select("id"), depth).join(rows.where(F.col("scope") == scope), "id").select("id", "score")
    both = hits.select("id", "score", F.lit(False).alias("expansion")).unionByName(near.select("id", "score", F.lit(True).alias("expansion")))
    fused = both.groupBy("id").agg(F.max_by("expansion", F.struct("score", "expansion")).alias("expansion"), F.max("score").alias("score"))
    pool = fused.orderBy(F.desc("score"), "id").limit(2 * k).withColumn("query", F.lit(0))
    return ranking.displacement_guard(pool).where(F.col("position") <= k).drop("query")


def formatted(hits: DataFrame) -> DataFrame:
    """(position, line) of hits (id, score, position, and type, title and reason where there are such)."""
    of = lambda c: F.coalesce(F.col(c), F.lit("")) if c in hits.columns else F.lit("")
    kind = F.when(of("type") == "", "unknown").otherwise(of("type"))
    line = F.format_string("%d. [%s] score=%.4f  type: %s  title: %s", F.col("position"), F.col("id").cast("string"), F.col("score"), kind, of("title"))
    return hits.select("position", F.concat(line, F.when(of("reason") != "", F.concat(F.lit("\n   Why: "), of("reason"))).otherwise("")).alias("line"))


def once(df: DataFrame) -> DataFrame:
    """df computed once, in the shared folder, for a composed query that uses it several times."""
    graph._shared(df.sparkSession)
    return df.checkpoint()


@query("search_scored")
def _scored(spark, d):
    return scored(candidates(spark, d), 10, ["2024-01-10"], 0.05)


@query("search_formatted")
def _formatted(spark, d):
    return formatted(scored(candidates(spark, d), 10, diversify=False))


@query("suggest", f"WITH {ranking._H}, t AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS position FROM h QUALIFY position <= 5) SELECT CAST(position AS INT) AS position, printf('%d. [%d] score=%.4f  type: %s  title: %s', position, id, score, lang, source) || chr(10) || '   Why: keyword=' || printf('%.3f', 0.3 / (1 + abs(bm25))) || CASE WHEN importance > 0 THEN '; importance=' || printf('%.3f', 0.15 * importance) ELSE '' END AS line FROM t")
def _suggest(spark, d):
    """What would be retrieved, and why."""
    reason = ranking.explain({"keyword": 0.3 / (1 + F.abs("bm25")), "title": ranking.TITLE_BOOST * F.col("title"), "importance": ranking.IMPORTANCE_WEIGHT * F.col("importance")})
    best = candidates(spark, d).withColumn("reason", reason).orderBy(F.desc("score"), "id").limit(5)
    hits = best.select("id", "score", "reason", F.col("lang").alias("type"), F.col("source").alias("title"), F.row_number().over(Window.orderBy(F.desc("score"), "id")).alias("position"))
    return formatted(hits)


@query("smart_expand", f"WITH {ranking._H}, a AS (SELECT id, score, valid_from FROM h ORDER BY score DESC, id LIMIT 20), b AS (SELECT id, cos AS score, valid_from FROM h ORDER BY cos DESC, id LIMIT 20), f AS (SELECT id, max(score) AS score, max(valid_from) AS v FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY id) SELECT id, round(score + 0.1 * (row_number() OVER (ORDER BY v, id) - 1) / (count(*) OVER () - 1), 6) AS score FROM f")
def _smart(spark, d):
    c = once(candidates(spark, d).select("id", "score", "cos", "valid_from"))
    a = c.orderBy(F.desc("score"), "id").limit(20)
    b = c.orderBy(F.desc("cos"), "id").limit(20).withColumn("score", F.col("cos"))
    return smart_expand(a, b).select("id", F.round("score", 6).alias("score"))


@query("expand_routed")
def _expand(spark, d):
    c = once(candidates(spark, d).select("id", "score", "cos", F.when(F.col("lang") == "en", "agent").otherwise("org").alias("scope")))
    edges = c.select(F.col("id").alias("from_id"), (F.col("id") + 1).alias("to_id"))
    return expanded(c.orderBy(F.desc("score"), "id").limit(10), edges, c.select("id", "score", "scope"), "agent", 10)


@query("search_routed")
def _routed(spark, d):
    """Fused retrieval, expansion under the guard, a sharp trim, and the penalty for superseded hits."""
    c = once(candidates(spark, d).select("id", "score", "cos", F.when(F.col("lang") == "en", "agent").otherwise("org").alias("scope")))
    near = c.select("id", F.col("cos").alias("score")).orderBy(F.desc("score"), "id").limit(30)
    fused = ranking.max_fusion([near, c.select("id", "score").orderBy(F.desc("score"), "id").limit(30)], 15)
    edges = c.select(F.col("id").alias("from_id"), (F.col("id") + 1).alias("to_id"))
    wide = expanded(fused, edges, c.select("id", "score", "scope"), "agent", 15)
    old = read(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("to_id"), F.lit("supersedes").alias("relationship_type"))
    return ranking.supersedes_penalty(ranking.sharp_trim(wide.select("id", "score"), 0.6, 5, 15), old).orderBy(F.desc("score"), "id")


def entry(spark, sf_dir: str) -> DataFrame:
    """The flagship: hybrid keyword and vector retrieval over documents, ten best."""
    pool = ranking.content_dedup(candidates(spark, sf_dir).select("id", "content", "score", "bm25", "cos"), "content", 10)
    return pool.select("id", F.round("score", 6).alias("score"), F.round("bm25", 6).alias("bm25"), F.round("cos", 6).alias("cos"))
