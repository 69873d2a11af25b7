"""Aggregations and reports: usage cost, conversations, queues, history, corroboration, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..registry import query, read

NOW = "2024-01-25 00:00:00"


def cost_report(items: DataFrame, by: list[str]) -> DataFrame:
    """Rows, tokens and cost by the given columns; a missing cost is never counted as zero."""
    return items.groupBy(*by).agg(
        F.count("*").alias("n"), F.sum("tokens").alias("tokens"), F.sum("cost").alias("cost"), F.count("cost").alias("priced")
    )


def compute_cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """usage (model, tokens) with `cost`: tokens per million at the model's price, by exact name, else by the
    longest name that is a prefix; unknown models have none. prices is a list of a few rows, broadcast."""
    u = usage.withColumn("usage_model", F.col("model")).drop("model")
    models = u.select("usage_model").distinct()
    hit = models.join(F.broadcast(prices), F.startswith("usage_model", F.col("model")))
    w = Window.partitionBy("usage_model").orderBy(F.desc(F.char_length("model")))
    best = hit.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("usage_model", "price")
    return u.join(best, "usage_model", "left").withColumn("cost", F.round(F.col("tokens") / 1e6 * F.col("price"), 6)).withColumnRenamed("usage_model", "model")


def windowed_counts(rows: DataFrame, column: str, now: str, minutes: list[int]) -> list[Column]:
    """One conditional count for each window that ends at now."""
    t = F.to_timestamp(F.lit(now))
    return [F.count_if((F.col(column) >= t - F.expr(f"INTERVAL {m} MINUTES")) & (F.col(column) < t)).alias(f"last_{m}") for m in minutes]


def current_state(history: DataFrame, by: list[str], value: str, order: list[str]) -> DataFrame:
    return history.groupBy(*by).agg(F.max_by(value, F.struct(*order)).alias(value))


def corroboration_inputs(ledger: DataFrame, by: str) -> DataFrame:
    """(by, trust_sum, contradictions): the sum over distinct sources of their highest trust, and negative rows."""
    positive = ledger.where("delta > 0").groupBy(by, "source_kind", "source_ref").agg(F.max("delta").alias("t")).groupBy(by).agg(F.sum("t").alias("trust_sum"), F.count("*").alias("sources"))
    negative = ledger.where("delta < 0").groupBy(by).agg(F.count("*").alias("contradictions"))
    return positive.join(negative, by, "full_outer").na.fill(0, ["trust_sum", "sources", "contradictions"])


SIZE_BANDS = [(4, "0-4k"), (8, "4-8k"), (16, "8-16k"), (32, "16-32k")]


def size_band(n: Column) -> Column:
    out = F
    for k, name in SIZE_BANDS:
        out = out.when(n < k * 1000, name)
    return out.otherwise("32k+")


def content_hash(turns: DataFrame, by: str, id_col: str, order: str, content: str) -> DataFrame:
    """(by, source_hash, size_k): sha256 over each group's ordered id NUL content SOH, and KiB rounded up, at least 1."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(order, id_col, content))), lambda x: F.concat(x[id_col].cast("string"), F.lit("\0"), x[content], F.lit("\1")))
    whole = turns.groupBy(by).agg(F.array_join(parts, "").alias("w"), F.sum(F.octet_length(content)).alias("n"))
    return whole.select(by, F.sha2(F.col("w").cast("binary"), 256).alias("source_hash"), F.greatest(F.lit(1), F.ceil(F.col("n") / 1024)).cast("long").alias("size_k"))


def conversations(turns: DataFrame, by: str = "conv_id", order: str = "turn", role: str = "role") -> DataFrame:
    """(by, turns, first, last, last_role) of each conversation."""
    return turns.groupBy(by).agg(F.count("*").alias("turns"), F.min(order).alias("first"), F.max(order).alias("last"), F.max_by(role, order).alias("last_role"))


def lifecycle_summary(history: DataFrame, now: str, kind: str, owner: str, against: list[str], days: int = 7, top: int = 5, time: str = "ts") -> DataFrame:
    """(part, key, n) over the days before now: changes by kind, and the owners most often revised and contradicted."""
    t = F.to_timestamp(F.lit(now))
    recent = history.where((F.col(time) >= t - F.expr(f"INTERVAL {int(days)} DAYS")) & (F.col(time) < t))
    most = lambda rows, name: rows.groupBy(owner).agg(F.count("*").alias("n")).orderBy(F.desc("n"), owner).limit(top).select(F.lit(name).alias("part"), F.col(owner).cast("string").alias("key"), "n")
    every = recent.groupBy(F.lit("event").alias("part"), F.col(kind).alias("key")).agg(F.count("*").alias("n"))
    return every.union(most(recent, "revised")).union(most(recent.where(F.col(kind).isin(against)), "contradicted"))


def consolidation_candidates(items: DataFrame, by: list[str], order: str, keep: int) -> DataFrame:
    """Of each group larger than keep, all rows but the last keep in order."""
    big = items.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") > keep)
    w = Window.partitionBy(*by).orderBy(order)
    return items.join(big, by).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= F.col("_n") - keep).drop("_n", "_r")


def counts_by(rows: DataFrame, *by, least: int = 0, n: str = "n") -> DataFrame:
    """How many rows each group has, of groups with at least least."""
    counted = rows.groupBy(*by).agg(F.count("*").alias(n))
    return counted.where(F.col(n) >= least) if least else counted


def eligible_groups(turns: DataFrame, least: int, limit: int, by: str = "conv_id", order: str = "turn", role: str = "role") -> DataFrame:
    """(by, turns, n) of the largest groups with at least least turns; turns are role:order, in order."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct(order, role))), lambda x: F.concat(x[role], F.lit(":"), x[order].cast("string")))
    grouped = turns.groupBy(by).agg(F.array_join(listed, ",").alias("turns"), F.count("*").alias("n"))
    return grouped.where(F.col("n") >= least).orderBy(F.desc("n"), by).limit(limit)


def timeline(history: DataFrame, by: str, value: str, order: list[str]) -> DataFrame:
    """history with prev_<value>: the value before, of the same kind."""
    return history.withColumn(f"prev_{value}", F.lag(value).over(Window.partitionBy(by).orderBy(*order)))


def recently_changed(history: DataFrame, by: str, limit: int, time: str = "ts") -> DataFrame:
    """(by, last): the owners changed last."""
    return history.groupBy(by).agg(F.max(time).alias("last")).orderBy(F.desc("last"), by).limit(limit)


def files_stats(files: DataFrame, by: str, source: str, size: str) -> DataFrame:
    return files.groupBy(by).agg(F.count("*").alias("files"), F.sum(size).alias("chars"), F.countDistinct(source).alias("sources"), F.max(size).alias("longest"))


def corpora(files: DataFrame, url: str = "url") -> DataFrame:
    """(corpus, files) by host."""
    return files.groupBy(F.regexp_extract(url, r"^https?://([^/]+)", 1).alias("corpus")).agg(F.count("*").alias("files"))


def failures(log: DataFrame, by: str, id_col: str, time: str = "ts") -> DataFrame:
    """(by, failed, last_error) of a log of failures."""
    return log.groupBy(by).agg(F.count("*").alias("failed"), F.max_by(id_col, F.struct(time, id_col)).alias("last_error"))


def dashboard_counts(turns: DataFrame, session: Column, content: str) -> DataFrame:
    """(sessions, texts, n); turns without a session are one legacy session."""
    named = F.coalesce(F.nullif(session, F.lit("")), F.lit("legacy"))
    return turns.agg(F.countDistinct(named).alias("sessions"), F.countDistinct(F.md5(content)).alias("texts"), F.count("*").alias("n"))


def embedded_counts(items: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """(total, unembedded)"""
    have = vectors.select(key).distinct().withColumn("_have", F.lit(True))
    return items.join(have, key, "left").agg(F.count("*").alias("total"), F.count_if(F.col("_have").isNull()).alias("unembedded"))


def weekly_audit(log: DataFrame, owner: str, failed: Column, time: str = "ts") -> DataFrame:
    """(week, n, users, errors)"""
    return log.groupBy(F.date_trunc("week", time).alias("week")).agg(F.count("*").alias("n"), F.countDistinct(owner).alias("users"), F.count_if(failed).alias("errors"))


def ledger(spark, d) -> DataFrame:
    """events as a trust ledger: errors contradict, everything else corroborates with its value."""
    e = read(spark, d, "events")
    delta = F.when(F.col("event_type") == "error", -F.col("value")).otherwise(F.col("value"))
    return e.select("user_id", F.col("event_type").alias("source_kind"), (F.col("event_id") % 7).alias("source_ref"), (delta / 1000).alias("delta"), "ts", "event_id")


LEDGER_SQL = "(SELECT user_id, event_type AS source_kind, event_id % 7 AS source_ref, CASE WHEN event_type = 'error' THEN -value ELSE value END / 1000 AS delta, ts, event_id FROM events)"
INPUTS_SQL = f"p AS (SELECT user_id, sum(t) AS trust_sum, count(*) AS sources FROM (SELECT user_id, source_kind, source_ref, max(delta) AS t FROM {LEDGER_SQL} WHERE delta > 0 GROUP BY ALL) GROUP BY 1), n AS (SELECT user_id, count(*) AS contradictions FROM {LEDGER_SQL} WHERE delta < 0 GROUP BY 1), i AS (SELECT user_id, coalesce(trust_sum, 0) AS trust_sum, coalesce(sources, 0) AS sources, coalesce(contradictions, 0) AS contradictions FROM p FULL JOIN n USING (user_id))"


@query("cost_report", "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS tokens, round(sum(CASE WHEN value > 50 THEN value END), 4) AS cost, count(CASE WHEN value > 50 THEN value END) AS priced FROM events GROUP BY ALL")
def _cost(spark, d):
    items = read(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type", F.get_json_object("props", "$.k").cast("long").alias("tokens"), F.when(F.col("value") > 50, F.col("value")).alias("cost"))
    return cost_report(items, ["day", "event_type"]).withColumn("cost", F.round("cost", 4))


@query("compute_cost", "WITH p(model, price) AS (VALUES ('click', 3.0), ('pur', 15.0), ('purchase', 12.5), ('view', 0.25)), m AS (SELECT event_type, price FROM (SELECT e.event_type, p.price, row_number() OVER (PARTITION BY e.event_type ORDER BY length(model) DESC) AS r FROM (SELECT DISTINCT event_type FROM events) e JOIN p ON starts_with(e.event_type, model)) WHERE r = 1) SELECT event_id, event_type AS model, round(CAST(json_extract_string(props, '$.k') AS BIGINT) / 1e6 * price, 6) AS cost FROM events LEFT JOIN m USING (event_type)")
def _price(spark, d):
    usage = read(spark, d, "events").select("event_id", F.col("event_type").alias("model"), F.get_json_object("props", "$.k").cast("long").alias("tokens"))
    prices = spark.createDataFrame([("click", 3.0), ("pur", 15.0), ("purchase", 12.5), ("view", 0.25)], "model string, price double")
    return compute_cost(usage, prices).select("event_id", "model", "cost")


@query("list_conversations", "SELECT conv_id, count(*) AS turns, min(turn) AS first, max(turn) AS last, max_by(role, turn) AS last_role FROM conversations GROUP BY 1 ORDER BY conv_id DESC LIMIT 40 OFFSET 10")
def _conversations(spark, d):
    return conversations(read(spark, d, "conversations")).orderBy(F.desc("conv_id")).offset(10).limit(40)


@query("lifecycle_summary", f"WITH w AS (SELECT * FROM events WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY AND ts < TIMESTAMP '{NOW}') SELECT 'event' AS part, event_type AS key, count(*) AS n FROM w GROUP BY ALL UNION ALL SELECT 'revised', CAST(user_id AS VARCHAR), n FROM (SELECT user_id, count(*) AS n FROM w GROUP BY 1 ORDER BY n DESC, user_id LIMIT 5) UNION ALL SELECT 'contradicted', CAST(user_id AS VARCHAR), n FROM (SELECT user_id, count(*) AS n FROM w WHERE event_type = 'error' GROUP BY 1 ORDER BY n DESC, user_id LIMIT 5)")
def _summary(spark, d):
    return lifecycle_summary(read(spark, d, "events"), NOW, "event_type", "user_id", ["error"])


@query("consolidation_candidates", "WITH c AS (SELECT source, lang, count(*) AS cnt FROM documents WHERE source <> 'src0' GROUP BY ALL HAVING count(*) > 20) SELECT doc_id, source, lang FROM (SELECT doc_id, source, lang, cnt, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS r FROM documents JOIN c USING (source, lang)) WHERE r <= cnt - 20")
def _consolidation(spark, d):
    docs = read(spark, d, "documents").where("source <> 'src0'")  # src0 stands for a protected type
    return consolidation_candidates(docs, ["source", "lang"], "doc_id", 20).select("doc_id", "source", "lang")


@query("queue_stats", f"WITH s AS (SELECT count(*) FILTER (WHERE event_type = 'view') AS queued, {', '.join(f'count(*) FILTER (WHERE ts >= TIMESTAMP {chr(39)}{NOW}{chr(39)} - INTERVAL {m} MINUTE AND ts < TIMESTAMP {chr(39)}{NOW}{chr(39)}) AS last_{m}' for m in (1, 10, 30, 60, 600))} FROM events) SELECT *, CASE WHEN last_600 = 0 THEN NULL ELSE round(queued / (last_600 / 36000.0), 3) END AS eta_seconds FROM s")
def _queue(spark, d):
    e = read(spark, d, "events")
    stats = e.agg(F.count_if(F.col("event_type") == "view").alias("queued"), *windowed_counts(e, "ts", NOW, [1, 10, 30, 60, 600]))
    return stats.withColumn("eta_seconds", F.when(F.col("last_600") == 0, None).otherwise(F.round(F.col("queued") / (F.col("last_600") / 36000), 3)))


@query("enrichment_report", "SELECT CASE WHEN n_chars < 4000 THEN '0-4k' WHEN n_chars < 8000 THEN '4-8k' WHEN n_chars < 16000 THEN '8-16k' WHEN n_chars < 32000 THEN '16-32k' ELSE '32k+' END AS band, count(*) FILTER (WHERE lang = 'en') AS en, count(*) FILTER (WHERE lang = 'fr') AS fr, count(*) FILTER (WHERE lang = 'de') AS de, count(*) FILTER (WHERE lang = 'es') AS es FROM documents GROUP BY 1")
def _enrichment(spark, d):
    b = read(spark, d, "documents").select(size_band(F.col("n_chars")).alias("band"), "lang")
    return b.groupBy("band").pivot("lang", ["en", "fr", "de", "es"]).count().na.fill(0)


@query("enrichment_status_counts", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def _status(spark, d):
    return counts_by(read(spark, d, "orders"), F.col("o_orderstatus").alias("status"))


@query("eligible_groups", "SELECT conv_id, string_agg(role || ':' || turn, ',' ORDER BY turn) AS turns, count(*) AS n FROM conversations GROUP BY 1 HAVING count(*) >= 3 ORDER BY n DESC, conv_id LIMIT 50")
def _eligible(spark, d):
    return eligible_groups(read(spark, d, "conversations"), 3, 50)


@query("group_content_hash", "SELECT conv_id, sha256(string_agg(turn || chr(0) || text || chr(1), '' ORDER BY turn)) AS source_hash, greatest(1, CAST(ceil(sum(strlen(text)) / 1024.0) AS BIGINT)) AS size_k FROM conversations GROUP BY 1")
def _hash(spark, d):
    return content_hash(read(spark, d, "conversations").withColumn("id", F.col("turn")), "conv_id", "id", "turn", "text")


@query("reflect_candidates", "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL HAVING count(*) >= 15")
def _reflect(spark, d):
    return counts_by(read(spark, d, "events"), "user_id", "event_type", least=15)


@query("history_current_state", "SELECT user_id, event_type, max_by(value, (ts, event_id)) AS value FROM events GROUP BY ALL")
def _current(spark, d):
    return current_state(read(spark, d, "events"), ["user_id", "event_type"], "value", ["ts", "event_id"])


@query("history_timeline", "SELECT event_id, ts, event_type, value, lag(value) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS prev_value FROM events WHERE user_id = 11")
def _timeline(spark, d):
    return timeline(read(spark, d, "events").where("user_id = 11"), "event_type", "value", ["ts", "event_id"]).select("event_id", "ts", "event_type", "value", "prev_value")


@query("history_recent_ids", "SELECT user_id, max(ts) AS last FROM events GROUP BY 1 ORDER BY last DESC, user_id LIMIT 20")
def _recent(spark, d):
    return recently_changed(read(spark, d, "events"), "user_id", 20)


@query("corroboration_inputs", f"WITH {INPUTS_SQL} SELECT user_id, round(trust_sum, 6) AS trust_sum, sources, contradictions FROM i")
def _inputs(spark, d):
    return corroboration_inputs(ledger(spark, d), "user_id").withColumn("trust_sum", F.round("trust_sum", 6))


@query("corroboration_count", f"SELECT user_id, count(DISTINCT (source_kind, source_ref)) AS n FROM {LEDGER_SQL} WHERE delta > 0 GROUP BY 1")
def _corroboration(spark, d):
    return ledger(spark, d).where("delta > 0").groupBy("user_id").agg(F.countDistinct("source_kind", "source_ref").alias("n"))


@query("files_stats", "SELECT lang, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS chars, count(DISTINCT source) AS sources, max(n_chars) AS longest FROM documents GROUP BY 1")
def _files(spark, d):
    return files_stats(read(spark, d, "documents"), "lang", "source", "n_chars")


@query("corpus_list", "SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS corpus, count(*) AS files FROM pages GROUP BY 1")
def _corpora(spark, d):
    return corpora(read(spark, d, "pages"))


@query("extraction_failures", "SELECT user_id, count(*) AS failed, max_by(event_id, (ts, event_id)) AS last_error FROM events WHERE event_type = 'error' GROUP BY 1")
def _failures(spark, d):
    return failures(read(spark, d, "events").where("event_type = 'error'"), "user_id", "event_id")


@query("dashboard_counts", "SELECT count(DISTINCT coalesce(nullif(CASE WHEN conv_id % 9 = 0 THEN '' ELSE CAST(conv_id AS VARCHAR) END, ''), 'legacy')) AS sessions, count(DISTINCT md5(text)) AS texts, count(*) AS n FROM conversations")
def _dashboard(spark, d):
    session = F.when(F.col("conv_id") % 9 == 0, "").otherwise(F.col("conv_id").cast("string"))
    return dashboard_counts(read(spark, d, "conversations"), session, "text")


@query("chatlog_row_counts", "SELECT count(*) AS total, count(*) FILTER (WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)) AS unembedded FROM documents")
def _rows(spark, d):
    return embedded_counts(read(spark, d, "documents"), read(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id")


@query("weekly_audit", "SELECT date_trunc('week', ts) AS week, count(*) AS n, count(DISTINCT user_id) AS users, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY 1")
def _weekly(spark, d):
    return weekly_audit(read(spark, d, "events"), "user_id", F.col("event_type") == "error")
