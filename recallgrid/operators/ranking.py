"""Scoring and ranking of candidates: hybrid score, boosts, trims, dedup, diversity, fusion, expansion guards."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..registry import query, read
from .keyword import bm25_sql, documents_index
from .vector import cosine, with_query

VECTOR_WEIGHT, TITLE_BOOST, IMPORTANCE_WEIGHT, SHORT_TURN = 0.7, 0.15, 0.15, 20
ROLE_BOOST = PROCEDURE_BOOST = 0.20
CONFIDENCE_WEIGHT = 0.10
RRF_K = 60


def hybrid_score(cos: Column, bm: Column, length: Column, title: Column, importance: Column, weight: float = VECTOR_WEIGHT, bm25_norm: str = "inverted") -> Column:
    """Weighted cosine and keyword term, damped for short contents, with title overlap and importance added.

    The keyword term is 1 / (1 + |bm25|), which falls as matches get better; that is the behaviour which is
    reproduced. bm25_norm="monotone" gives |bm25| / (1 + |bm25|) instead.
    """
    keyword = 1 / (1 + F.abs(bm)) if bm25_norm == "inverted" else F.abs(bm) / (1 + F.abs(bm))
    penalty = F.when(length < SHORT_TURN, F.greatest(F.lit(0.3), length / SHORT_TURN)).otherwise(1.0)
    return (cos * weight + keyword * (1 - weight)) * penalty + TITLE_BOOST * title + IMPORTANCE_WEIGHT * importance


def temporal_boost(valid_from: Column, dates: list[str]) -> Column:
    """By the nearest of the query's dates: the same day .25, within two days .15, within seven .05."""
    if not dates:
        return F.lit(0.0)
    gaps = [F.abs(F.datediff(valid_from, F.lit(d).cast("date"))) for d in dates]
    gap = F.least(*gaps) if len(gaps) > 1 else gaps[0]
    return F.coalesce(F.when(gap == 0, 0.25).when(gap <= 2, 0.15).when(gap <= 7, 0.05), F.lit(0.0))


def recency_bonus(pool: DataFrame, weight: float, valid_from: str = "valid_from", order: str = "id") -> DataFrame:
    """A pool of candidates (bounded by its limit) with score raised linearly by the rank of valid_from."""
    dated = F.col(valid_from).isNotNull() & (F.col(valid_from) != "")
    w = Window.partitionBy(dated).orderBy(valid_from, order)
    n = F.count("*").over(Window.partitionBy(dated))
    bonus = F.when(dated & (n > 1), weight * (F.row_number().over(w) - 1) / (n - 1)).otherwise(0.0)
    return pool.withColumn("score", F.col("score") + bonus)


def elbow_trim(pool: DataFrame, sensitivity: float = 1.5, least_gap: float = 0.05, min_input: int = 20, min_return: int = 8, floor: float = 0.75, order: str = "id") -> DataFrame:
    """A pool (bounded by its limit) cut at the first gap above max(least_gap, sensitivity * mean gap)."""
    w = Window.orderBy(F.desc("score"), order)
    all_rows = Window.partitionBy()
    ranked = pool.withColumns({"_rank": F.row_number().over(w), "_gap": F.col("score") - F.lead("score").over(w)})
    ranked = ranked.withColumns({"_n": F.count("*").over(all_rows), "_mean": F.avg("_gap").over(all_rows), "_top": F.max("score").over(all_rows)})
    big = F.col("_gap") > F.greatest(F.lit(least_gap), sensitivity * F.col("_mean"))
    cut = F.min(F.when(big, F.col("_rank"))).over(all_rows)
    applies = (F.col("_n") >= min_input) & (F.col("_top") >= floor)
    kept = ranked.withColumn("_cut", cut).where(~applies | F.col("_cut").isNull() | (F.col("_rank") <= F.greatest(F.col("_cut"), F.lit(min_return))))
    return kept.drop("_rank", "_gap", "_n", "_mean", "_top", "_cut")


def content_dedup(pool: DataFrame, content: str, keep: int | None = None, order: str = "id") -> DataFrame:
    """The best-scored row of each trimmed content; empty contents are never duplicates."""
    key = F.trim(F.coalesce(content, F.lit("")))
    w = Window.partitionBy(key).orderBy(F.desc("score"), order)
    kept = pool.withColumn("_r", F.row_number().over(w)).where((F.col("_r") == 1) | (key == "")).drop("_r")
    return kept.orderBy(F.desc("score"), order).limit(keep) if keep else kept


def mmr(pool: DataFrame, k: int, by: str = "query", lam: float = 0.7) -> DataFrame:
    """Maximal marginal relevance in each query's pool: rows (by, id, score, embedding) -> (by, id, score, position).

    Greedy: the best score first, then the largest lam * score - (1 - lam) * closest cosine to what is chosen;
    a missing vector is similar to nothing, ties go to the row that comes first by score and id. Pools of at
    most k rows keep their order. A pool is a query's candidates, bounded by the limit they were cut at.
    (Carbonell and Goldstein, 1998.)
    """

    def choose(rows: pa.Table) -> pa.Table:
        t = rows.to_pandas().sort_values(["score", "id"], ascending=[False, True], kind="stable").reset_index(drop=True)
        order = list(range(len(t)))
        if len(t) > k:
            dim = max((len(v) for v in t["embedding"] if v is not None), default=1)
            m = np.zeros((len(t), dim))
            for i, v in enumerate(t["embedding"]):
                if v is not None and len(v) == dim:
                    n = float(np.linalg.norm(v))
                    m[i] = np.asarray(v, float) / n if n else 0
            score, closest, order = t["score"].to_numpy(float), np.full(len(t), -np.inf), [0]
            left = np.ones(len(t), bool)
            left[0] = False
            while len(order) < k:
                closest = np.maximum(closest, m @ m[order[-1]])
                value = np.where(left, lam * score - (1 - lam) * closest, -np.inf)
                order.append(int(value.argmax()))
                left[order[-1]] = False
        t = t.iloc[order]
        return pa.table({by: pa.array(t[by], rows.schema.field(by).type), "id": pa.array(t["id"], rows.schema.field("id").type), "score": pa.array(t["score"], pa.float64()), "position": pa.array(np.arange(1, len(t) + 1), pa.int64())})

    kinds = dict(pool.dtypes)
    return pool.select(by, "id", F.col("score").cast("double").alias("score"), "embedding").groupBy(by).applyInArrow(choose, f"{by} {kinds[by]}, id {kinds['id']}, score double, position long")


def displacement_guard(pool: DataFrame, by: str = "query", protected: int = 3, margin: float = 2.0) -> DataFrame:
    """At the first ranks of each query an expansion must score margin times the next primary row, or they swap.

    Rows (by, id, score, expansion) in pools bounded by k -> (by, id, score, expansion, position).
    """

    def guard(rows: pa.Table) -> pa.Table:
        got = sorted(zip(*(rows[c].to_pylist() for c in (by, "id", "score", "expansion"))), key=lambda r: (-r[2], not r[3], r[1]))
        for rank in range(min(protected, len(got))):
            if got[rank][3]:
                other = next((i for i in range(rank + 1, len(got)) if not got[i][3]), None)
                if other is not None and not (got[rank][2] > 0 and got[other][2] > 0 and got[rank][2] >= margin * got[other][2]):
                    got[rank], got[other] = got[other], got[rank]
        columns = list(zip(*got))
        return pa.table({n: pa.array(c, rows.schema.field(n).type) for n, c in zip((by, "id", "score", "expansion"), columns)} | {"position": pa.array(range(1, len(got) + 1), pa.int64())})

    kinds = dict(pool.dtypes)
    return pool.select(by, "id", "score", "expansion").groupBy(by).applyInArrow(guard, f"{by} {kinds[by]}, id {kinds['id']}, score {kinds['score']}, expansion boolean, position long")


def rrf(channels: list[DataFrame], k: int = RRF_K) -> DataFrame:
    """(id, score): the sum over channels (id, rank) of 1 / (k + rank). (Cormack et al., 2009.)"""
    each = channels[0]
    for c in channels[1:]:
        each = each.unionByName(c)
    return each.groupBy("id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"))


def max_fusion(lists: list[DataFrame], k: int) -> DataFrame:
    """The k best ids by their highest score in any list."""
    each = lists[0]
    for c in lists[1:]:
        each = each.unionByName(c)
    return each.groupBy("id").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "id").limit(k)


def sharp_trim(pool: DataFrame, ratio: float, k_min: int, k_max: int, order: str = "id") -> DataFrame:
    """Rows that score at least ratio of the best, at least k_min and at most k_max of them."""
    w = Window.orderBy(F.desc("score"), order)
    ranked = pool.withColumns({"_rank": F.row_number().over(w), "_top": F.max("score").over(Window.partitionBy())})
    return ranked.where((F.col("_rank") <= k_max) & ((F.col("_rank") <= k_min) | (F.col("score") >= ratio * F.col("_top")))).drop("_rank", "_top")


def supersedes_penalty(hits: DataFrame, edges: DataFrame, factor: float = 0.5) -> DataFrame:
    """Scores of hits that a `supersedes` edge points at are halved."""
    old = edges.where("relationship_type = 'supersedes'").select(F.col("to_id").alias("id")).distinct().withColumn("_old", F.lit(True))
    return hits.join(old, "id", "left").withColumn("score", F.when(F.col("_old"), F.col("score") * factor).otherwise(F.col("score"))).drop("_old")


def predecessor_pull(hits: DataFrame, turns: DataFrame, top: int = 10, factor: float = 0.85) -> DataFrame:
    """hits (conv_id, turn, score) and, for the first `top`, the turn before, at factor of the score, unless it is there."""
    best = hits.orderBy(F.desc("score"), "conv_id", "turn").limit(top).where("turn > 0")
    before = best.select("conv_id", (F.col("turn") - 1).alias("turn"), (F.col("score") * factor).alias("score"))
    new = before.join(hits.select("conv_id", "turn"), ["conv_id", "turn"], "left_anti").join(turns.select("conv_id", "turn"), ["conv_id", "turn"], "left_semi")
    return hits.select("conv_id", "turn", "score").unionByName(new)


def explain(row: dict[str, Column]) -> Column:
    """A text reason from named components that are above zero."""
    return F.concat_ws("; ", *[F.when(c > 0, F.concat(F.lit(f"{n}="), F.format_string("%.3f", c))) for n, c in row.items()])


# The candidates that the queries below rank: documents with a vector, importance from labels.
TERMS = ["license", "the"]


def candidates(spark, d) -> DataFrame:
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), "source", "lang")
    hits = documents_index(spark, d).bm25(TERMS).select("id", "bm25")
    scored = docs.join(hits, "id", "left").withColumn("bm25", F.coalesce("bm25", F.lit(-0.0)))
    v = read(spark, d, "embeddings")
    near = with_query(v, v.where("vec_id = 0")).select(F.col("vec_id").alias("id"), cosine(F.col("embedding"), F.col("q")).alias("cos"), "embedding")
    importance = read(spark, d, "labels").groupBy(F.col("doc_id").alias("id")).agg(F.max("quality").cast("double").alias("importance"))
    both = scored.join(near, "id").join(importance, "id", "left").withColumn("importance", F.coalesce("importance", F.lit(0.0)))
    title = X.title_overlap(F.lit("the license"), F.col("source"))
    score = hybrid_score(F.col("cos"), F.col("bm25"), F.char_length("content"), title, F.col("importance"))
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("id", F.lit(40)).cast("int")), "yyyy-MM-dd")
    return both.withColumns({"title": title, "score": F.round(score, 9), "valid_from": F.when(F.col("id") % 7 == 0, "").otherwise(day)})


_H = f"""{bm25_sql('documents', 'doc_id', 'text', TERMS, ', source, lang')},
v AS (SELECT e.vec_id AS id, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS cos FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q),
l AS (SELECT doc_id AS id, max(quality) AS importance FROM labels GROUP BY 1),
h AS (SELECT s.id, s.content, s.source, s.lang, s.bm25, v.cos, coalesce(l.importance, 0) AS importance,
  round((cos * 0.7 + 0.3 / (1 + abs(bm25))) * CASE WHEN length(content) < 20 THEN greatest(0.3, length(content) / 20.0) ELSE 1.0 END + 0.15 * coalesce(l.importance, 0), 9) AS score,
  CASE WHEN s.id % 7 = 0 THEN '' ELSE strftime(DATE '2024-01-01' + CAST(s.id % 40 AS INT), '%Y-%m-%d') END AS valid_from
  FROM scored s JOIN v USING (id) LEFT JOIN l USING (id))"""
_POOL = f"{_H}, pool AS (SELECT * FROM h ORDER BY score DESC, id LIMIT 60)"


def pool(spark, d, n: int = 60) -> DataFrame:
    return candidates(spark, d).orderBy(F.desc("score"), "id").limit(n)


def _out(df: DataFrame) -> DataFrame:
    return df.select("id", F.round("score", 6).alias("score"))


@query("candidates_semantic", f"WITH {_H} SELECT id, round(cos, 6) AS cos FROM h ORDER BY id LIMIT 50")
def _semantic(spark, d):
    return candidates(spark, d).orderBy("id").limit(50).select("id", F.round("cos", 6).alias("cos"))


@query("candidates_hybrid", f"WITH {_H} SELECT id, round(bm25, 6) AS bm25, round(cos, 6) AS cos FROM h WHERE bm25 < 0 ORDER BY h.bm25, id LIMIT 200")
def _hybrid(spark, d):
    return candidates(spark, d).where("bm25 < 0").orderBy("bm25", "id").limit(200).select("id", F.round("bm25", 6).alias("bm25"), F.round("cos", 6).alias("cos"))


@query("candidates_union", f"WITH {_H} SELECT id FROM (SELECT id FROM h ORDER BY bm25, id LIMIT 30) UNION SELECT id FROM (SELECT id FROM h ORDER BY cos DESC, id LIMIT 30)")
def _union(spark, d):
    c = candidates(spark, d)
    return c.orderBy("bm25", "id").limit(30).select("id").union(c.orderBy(F.desc("cos"), "id").limit(30).select("id")).distinct()


@query("hybrid_score", f"WITH {_H} SELECT id, round(score, 6) AS score FROM h")
def _score(spark, d):
    return _out(candidates(spark, d))


@query("role_boost", f"WITH {_H} SELECT id, round(score + CASE WHEN lang = 'en' THEN 0.2 ELSE 0 END, 6) AS score FROM h")
def _role(spark, d):
    return _out(candidates(spark, d).withColumn("score", F.col("score") + F.when(F.col("lang") == "en", ROLE_BOOST).otherwise(0.0)))


@query("procedure_boost", f"WITH {_H} SELECT id, round(score + CASE WHEN source = 'src0' THEN 0.2 ELSE 0 END, 6) AS score FROM h")
def _procedure(spark, d):
    return _out(candidates(spark, d).withColumn("score", F.col("score") + F.when(F.col("source") == "src0", PROCEDURE_BOOST).otherwise(0.0)))


@query("confidence_boost", f"WITH {_H} SELECT id, round(score + 0.1 * coalesce(CASE WHEN id % 3 = 0 THEN 0.9 END, importance), 6) AS score FROM h")
def _confidence(spark, d):
    confidence = F.coalesce(F.when(F.col("id") % 3 == 0, 0.9), F.col("importance"))
    return _out(candidates(spark, d).withColumn("score", F.col("score") + CONFIDENCE_WEIGHT * confidence))


@query("recency_bonus", f"WITH {_POOL} SELECT id, round(score + CASE WHEN valid_from <> '' THEN 0.1 * (row_number() OVER (PARTITION BY valid_from <> '' ORDER BY valid_from, id) - 1) / (count(*) OVER (PARTITION BY valid_from <> '') - 1) ELSE 0 END, 6) AS score FROM pool")
def _recency(spark, d):
    return _out(recency_bonus(pool(spark, d), 0.1))


@query("temporal_boost", f"WITH {_H}, g AS (SELECT *, least(abs(TRY_CAST(valid_from AS DATE) - DATE '2024-01-10'), abs(TRY_CAST(valid_from AS DATE) - DATE '2024-02-01')) AS gap FROM h) SELECT id, round(score + CASE WHEN gap = 0 THEN 0.25 WHEN gap <= 2 THEN 0.15 WHEN gap <= 7 THEN 0.05 ELSE 0 END, 6) AS score FROM g")
def _temporal(spark, d):
    boost = temporal_boost(F.col("valid_from").try_cast("date"), ["2024-01-10", "2024-02-01"])
    return _out(candidates(spark, d).withColumn("score", F.col("score") + boost))


_ELBOW = f"{_POOL}, e AS (SELECT *, row_number() OVER w AS r, score - lead(score) OVER w AS gap FROM pool WINDOW w AS (ORDER BY score DESC, id)), f AS (SELECT *, avg(gap) OVER () AS mean, count(*) OVER () AS n, max(score) OVER () AS top FROM e), c AS (SELECT min(r) AS cut FROM f WHERE gap > greatest(0.05, 1.5 * mean))"


@query("elbow_trim", f"WITH {_ELBOW} SELECT id, round(score, 6) AS score FROM f, c WHERE NOT (n >= 20 AND top >= 0.3) OR cut IS NULL OR r <= greatest(cut, 8)")
def _elbow(spark, d):
    return _out(elbow_trim(pool(spark, d), floor=0.3))


@query("adaptive_k", f"WITH {_ELBOW} SELECT least(greatest(count(*) FILTER (WHERE NOT (n >= 20 AND top >= 0.3) OR cut IS NULL OR r <= greatest(cut, 8)), 5), 15) AS k FROM f, c")
def _adaptive(spark, d):
    return elbow_trim(pool(spark, d), floor=0.3).agg(F.least(F.greatest(F.count("*"), F.lit(5)), F.lit(15)).alias("k"))


@query("content_dedup", f"WITH {_H}, r AS (SELECT *, row_number() OVER (PARTITION BY trim(content) ORDER BY score DESC, id) AS r FROM h) SELECT id, round(score, 6) AS score FROM r WHERE r = 1 OR trim(content) = '' ORDER BY r.score DESC, id LIMIT 30")
def _dedup(spark, d):
    return _out(content_dedup(candidates(spark, d), "content", 30))


@query("explain", f"WITH {_H} SELECT id, 'keyword=' || printf('%.3f', 0.3 / (1 + abs(bm25))) || CASE WHEN importance > 0 THEN '; importance=' || printf('%.3f', 0.15 * importance) ELSE '' END AS reason FROM h")
def _explain(spark, d):
    return candidates(spark, d).select("id", explain({"keyword": 0.3 / (1 + F.abs("bm25")), "title": TITLE_BOOST * F.col("title"), "importance": IMPORTANCE_WEIGHT * F.col("importance")}).alias("reason"))


@query("rrf", f"WITH {_H}, a AS (SELECT id, row_number() OVER (ORDER BY bm25, id) AS r FROM h QUALIFY r <= 50), b AS (SELECT id, row_number() OVER (ORDER BY cos DESC, id) AS r FROM h QUALIFY r <= 50) SELECT id, round(sum(1.0 / (60 + r)), 6) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY id")
def _rrf(spark, d):
    c = candidates(spark, d)

    def channel(*order):  # fifty rows, ranked after the limit
        return c.orderBy(*order, "id").limit(50).withColumn("rank", F.row_number().over(Window.orderBy(*order, "id"))).select("id", "rank")

    return _out(rrf([channel(F.asc("bm25")), channel(F.desc("cos"))]))


@query("max_fusion", f"WITH {_H}, a AS (SELECT id, cos AS score FROM h ORDER BY cos DESC, id LIMIT 20), b AS (SELECT id, score FROM h ORDER BY score DESC, id LIMIT 20) SELECT id, round(max(score), 6) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY id ORDER BY max(score) DESC, id LIMIT 15")
def _fusion(spark, d):
    c = candidates(spark, d)
    near = c.select("id", F.col("cos").alias("score")).orderBy(F.desc("score"), "id").limit(20)
    return _out(max_fusion([near, c.select("id", "score").orderBy(F.desc("score"), "id").limit(20)], 15))


@query("sharp_trim", f"WITH {_POOL}, r AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS r, max(score) OVER () AS top FROM pool) SELECT id, round(score, 6) AS score FROM r WHERE r <= 20 AND (r <= 3 OR score >= 0.8 * top)")
def _sharp(spark, d):
    return _out(sharp_trim(pool(spark, d), 0.8, 3, 20))


@query("supersedes_penalty", f"WITH {_POOL} SELECT id, round(CASE WHEN id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN score * 0.5 ELSE score END, 6) AS score FROM pool")
def _supersedes(spark, d):
    edges = read(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("to_id"), F.lit("supersedes").alias("relationship_type"))
    return _out(supersedes_penalty(pool(spark, d), edges))


@query("bypass_union", f"WITH {_POOL} SELECT id, round(score, 6) AS score FROM pool UNION ALL SELECT doc_id, 0.0 FROM documents WHERE source = 'src1' AND lang = 'en' AND doc_id NOT IN (SELECT id FROM pool)")
def _bypass(spark, d):
    hits = pool(spark, d).select("id", "score")
    surface = read(spark, d, "documents").where("source = 'src1' and lang = 'en'").select(F.col("doc_id").alias("id"))
    return _out(hits.unionByName(surface.join(hits, "id", "left_anti").withColumn("score", F.lit(0.0))))


_TURNS = "t AS (SELECT conv_id, turn, round(1.0 / (1 + length(text)), 9) AS score FROM conversations), hits AS (SELECT * FROM t WHERE turn % 2 = 1 ORDER BY score DESC, conv_id, turn LIMIT 30)"


@query("predecessor_pull", f"WITH {_TURNS}, best AS (SELECT * FROM hits ORDER BY score DESC, conv_id, turn LIMIT 10) SELECT conv_id, turn, round(score, 6) AS score FROM hits UNION ALL SELECT conv_id, turn - 1, round(score * 0.85, 6) FROM best WHERE (conv_id, turn - 1) NOT IN (SELECT (conv_id, turn) FROM hits)")
def _predecessor(spark, d):
    turns = read(spark, d, "conversations").select("conv_id", "turn", F.round(1.0 / (1 + F.char_length("text")), 9).alias("score"))
    hits = turns.where("turn % 2 = 1").orderBy(F.desc("score"), "conv_id", "turn").limit(30)
    return predecessor_pull(hits, turns).withColumn("score", F.round("score", 6))


@query("observation_preference", f"WITH {_POOL}, o AS (SELECT *, source IN ('src0', 'src1') AS obs FROM pool) SELECT id, obs, round(score, 6) AS score FROM o WHERE obs OR (SELECT sum(length(content)) / 4.0 FROM o WHERE obs) < 4000")
def _observation(spark, d):
    p = pool(spark, d).withColumn("obs", F.col("source").isin("src0", "src1"))
    size = F.sum(F.when(F.col("obs"), F.char_length("content") / 4)).over(Window.partitionBy())  # over the pool's rows
    return p.withColumn("_size", size).where("obs or coalesce(_size, 0) < 4000").select("id", "obs", F.round("score", 6).alias("score"))


@query("two_stage_expansion", f"WITH {_POOL}, s AS (SELECT id, score, unnest([id + 1, id + 2, id + 3]) AS turn FROM pool WHERE source = 'src0') SELECT turn AS id, round(greatest(0.01, min(score) * 0.7), 6) AS score FROM s JOIN documents d ON d.doc_id = turn WHERE turn NOT IN (SELECT id FROM pool) GROUP BY turn")
def _two_stage(spark, d):
    p = pool(spark, d)
    named = p.where("source = 'src0'").select("score", F.explode(F.from_json(F.to_json(F.array(*[F.col("id") + i for i in (1, 2, 3)])), "array<long>")).alias("id"))
    found = named.join(read(spark, d, "documents").select(F.col("doc_id").alias("id")), "id", "left_semi").join(p, "id", "left_anti")
    return found.groupBy("id").agg(F.round(F.greatest(F.lit(0.01), F.min("score") * 0.7), 6).alias("score"))


@query("mmr")
def _mmr(spark, d):
    return mmr(pool(spark, d).withColumn("query", F.lit(0)), 20)


@query("displacement_guard")
def _guard(spark, d):
    return displacement_guard(pool(spark, d, 20).select(F.lit(0).alias("query"), "id", "score", (F.col("id") % 2 == 0).alias("expansion")))


def cross_encoder_rerank(hits: DataFrame, scorer, blend: float, k: int) -> DataFrame:
    """hits (id, content, score) blended with scorer, a function from batches of contents to scores; blend 0 does nothing."""
    if blend == 0:
        return hits.orderBy(F.desc("score"), "id").limit(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ce = np.asarray(scorer(b["content"].to_pylist()), float)
            mixed = blend * ce + (1 - blend) * b["score"].to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([b["id"], b["content"], pa.array(mixed)], names=["id", "content", "score"])

    head = hits.select("id", "content", F.col("score").cast("double").alias("score")).orderBy(F.desc("score"), "id").limit(3 * k)
    return head.mapInArrow(run, head.schema).orderBy(F.desc("score"), "id").limit(k)


@query("cross_encoder_rerank", f"WITH {_POOL}, b AS (SELECT id, 0.4 / (1 + length(content)) + 0.6 * score AS score FROM pool ORDER BY pool.score DESC, id LIMIT 30) SELECT id, round(score, 6) AS score FROM b ORDER BY b.score DESC, id LIMIT 10")
def _rerank(spark, d):
    return _out(cross_encoder_rerank(pool(spark, d), lambda texts: [1 / (1 + len(t)) for t in texts], 0.4, 10))
