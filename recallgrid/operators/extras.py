"""Scalar helpers with tables behind them, pluggable extraction, communities, synthesis reviews, join rewrites."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..registry import query, read
from .graph import both_ways, components, turn_edges

# Prefixes of model names and keywords of agents, in the order in which they are tried.
PROVIDERS = [
    ("anthropic", ["claude-"]),
    ("google", ["gemini-", "palm-"]),
    ("openai", ["gpt-", "o1-", "o3-"]),
    ("xai", ["grok-"]),
    ("deepseek", ["deepseek-"]),
    ("local", ["llama-", "mistral-", "qwen-"]),
]
CHANGE_AGENTS = [
    ("claude", ["claude", "sonnet", "opus", "haiku", "anthropic"]),
    ("gemini", ["gemini", "gemma", "google"]),
    ("aider", ["aider"]),
    ("openclaw", ["openclaw", "claw"]),
    ("deepseek", ["deepseek", "r1"]),
    ("grok", ["grok", "xai"]),
    ("system", ["system", "auditor", "cron", "debug_agent"]),
    ("manual", ["manual"]),
]
PATHS = r"(?:[A-Za-z]:\\(?:[^\\\s]+\\)*|/(?:home|Users)/(?:[^/\s]+/)*)([^\\/\s]+)"
#: Members of a cluster; larger ones are cut in order, as the reference does.
CLUSTER_CAP = 60


def infer_provider(model: Column) -> Column:
    out = F
    for name, prefixes in PROVIDERS:
        out = out.when(F.coalesce(model, F.lit("")).rlike("^(?:" + "|".join(prefixes) + ")"), name)
    return out.otherwise("other")


def infer_change_agent(agent: Column, model: Column, default: str = "unknown") -> Column:
    both = F.lower(F.concat_ws(" ", agent, model))
    out = F
    for name, words in CHANGE_AGENTS:
        out = out.when(both.rlike("|".join(words)), name)
    return out.otherwise(default)


def derive_title(role: Column, content: Column, host: Column) -> Column:
    head = F.substring(F.translate(F.trim(F.coalesce(content, F.lit(""))), "\n", " "), 1, 60)
    return F.concat(role, F.lit("@"), host, F.lit(": "), head)


def scrub_shared(text: Column, names: list[str]) -> Column:
    """Text fit for sharing: secrets and personal data redacted, home paths cut to their last part, names replaced."""
    out = F.regexp_replace(X.redact(text)[0], PATHS, "$1")
    for n in sorted(names, key=len, reverse=True):
        out = F.regexp_replace(out, rf"(?iU)(?<!\w)\Q{n}\E(?!\w)", "[user]")
    return out


def extract_with(docs: DataFrame, extractor: Callable[[str], list[tuple[str, str]]], id_col: str, text: str) -> DataFrame:
    """(id, name, kind) from a pluggable extractor, a function from a text to (name, kind) pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, n, k) for i, t in zip(b[id_col].to_pylist(), b[text].to_pylist()) for n, k in extractor(t or "")]
            cols = list(zip(*rows)) if rows else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.schema.field(id_col).type), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())], names=[id_col, "name", "kind"])

    return docs.select(id_col, text).mapInArrow(run, f"{id_col} {dict(docs.dtypes)[id_col]}, name string, kind string")


def greedy_modularity(edges: list[tuple[int, int, float]], total: float) -> list[list[int]]:
    """Communities of one component's edges (a, b, weight), total being the weight of the whole graph's edges.

    The pair of the best gain is merged until none gains; ties go to smaller ids. A gain only falls while a
    pair's weight stays, so what the heap holds is a bound that is looked at again when it comes up.
    """
    between: dict = {}
    degree: dict = {}
    for x, y, z in edges:
        between.setdefault(x, {})[y] = between.setdefault(y, {})[x] = z / (2 * total)
        for n in (x, y):
            degree[n] = degree.get(n, 0.0) + z / (2 * total)
    members = {n: [n] for n in degree}
    gain = lambda p, q: 2 * (between[p][q] - degree[p] * degree[q])
    heap = [(-gain(p, q), p, q) for p in between for q in between[p] if p < q]
    heapq.heapify(heap)
    while heap:
        bound, x, y = heapq.heappop(heap)
        if y not in between.get(x, ()):
            continue
        now = -gain(x, y)
        if now != bound:
            if now > bound:  # else a later entry has its new weight
                heapq.heappush(heap, (now, x, y))
            continue
        if -now <= 1e-12:
            break
        degree[x] += degree.pop(y)
        members[x] += members.pop(y)
        for n, z in between.pop(y).items():
            del between[n][y]
            if n != x:
                between[x][n] = between[n][x] = between[x].get(n, 0.0) + z
                p, q = min(x, n), max(x, n)
                heapq.heappush(heap, (-gain(p, q), p, q))
    return [sorted(group) for group in members.values()]


def communities(edges: DataFrame, cap: int = CLUSTER_CAP, nodes: DataFrame | None = None) -> DataFrame:
    """(id, cluster): greedy modularity communities (Clauset, Newman and Moore, 2004) of weighted edges.

    Merges never leave a component, so components are found on Spark and each is clustered by itself, whole, with
    the weight of the whole graph: the result is that of one run over all edges. The merges of one component are
    sequential and are done in one task. Clusters above cap are cut in order; a cluster is named by its smallest
    member. nodes (id), if given, that no edge touches are clusters of their own.
    """
    e = edges.where("from_id <> to_id").groupBy(F.least("from_id", "to_id").alias("a"), F.greatest("from_id", "to_id").alias("b")).agg(F.sum("weight").alias("w"))
    c = components(e.select(F.col("a").alias("from_id"), F.col("b").alias("to_id")))
    total = e.agg(F.sum("w").cast("double").alias("total"))
    inner = e.join(c.select(F.col("id").alias("a"), "component"), "a").crossJoin(F.broadcast(total)).select("a", "b", "w", "component", "total")

    def merge(rows: pa.Table) -> pa.Table:
        found = greedy_modularity(sorted(zip(*(rows[x].to_pylist() for x in ("a", "b", "w")))), rows["total"][0].as_py())
        out = [(i, part[0]) for group in found for k in range(0, len(group), cap) for part in [group[k : k + cap]] for i in part]
        return pa.table({"id": pa.array([o[0] for o in out], pa.int64()), "cluster": pa.array([o[1] for o in out], pa.int64())})

    found = inner.groupBy("component").applyInArrow(merge, "id long, cluster long")
    if nodes is None:
        return found
    linked = c.select("id")
    alone = nodes.select(F.col("id").cast("long").alias("id")).distinct().join(linked, "id", "left_anti")
    return found.unionByName(alone.select("id", F.col("id").alias("cluster")))


def any_end_join(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, from_id, to_id): edges that touch a node at either end, as a union of two equi joins instead of an OR."""
    a = nodes.join(edges, nodes["id"] == edges["from_id"]).select("id", "from_id", "to_id")
    return a.union(nodes.join(edges, nodes["id"] == edges["to_id"]).select("id", "from_id", "to_id")).distinct()


def set_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """(part, n): how many distinct rows are in both, and only in a."""
    return a.intersect(b).agg(F.lit("both").alias("part"), F.count("*").alias("n")).union(a.subtract(b).agg(F.lit("only"), F.count("*")))


def citation_drift(sources: DataFrame, by: str, survives: Column) -> DataFrame:
    """(by, sources, surviving) of syntheses some of whose sources don't survive."""
    counted = sources.groupBy(by).agg(F.count("*").alias("sources"), F.count_if(survives).alias("surviving"))
    return counted.where("surviving < sources")


def feedback_importance(importance: Column, kind: Column, good: str, bad: str, step: float = 0.1) -> Column:
    """Importance after feedback, between 0 and 1."""
    change = F.when(kind == good, step).when(kind == bad, -step).otherwise(0.0)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), importance + change))


_KINDS = "(SELECT event_id, CASE event_id % 9 WHEN 0 THEN 'claude-x' WHEN 1 THEN 'gemini-2' WHEN 2 THEN 'gpt-4o' WHEN 3 THEN 'o1-mini' WHEN 4 THEN 'grok-1' WHEN 5 THEN 'qwen-7' WHEN 6 THEN '' ELSE 'other' END AS model, CASE event_id % 4 WHEN 0 THEN 'cron' WHEN 1 THEN 'Manual' ELSE '' END AS agent FROM events)"


@query("scalar_inference", f"SELECT event_id, CASE WHEN starts_with(model, 'claude-') THEN 'anthropic' WHEN starts_with(model, 'gemini-') THEN 'google' WHEN starts_with(model, 'gpt-') OR starts_with(model, 'o1-') THEN 'openai' WHEN starts_with(model, 'grok-') THEN 'xai' WHEN starts_with(model, 'qwen-') THEN 'local' ELSE 'other' END AS provider, CASE WHEN contains(model, 'claude') THEN 'claude' WHEN contains(model, 'gemini') THEN 'gemini' WHEN contains(model, 'grok') THEN 'grok' WHEN agent = 'cron' THEN 'system' WHEN agent = 'Manual' THEN 'manual' ELSE 'unknown' END AS change_agent FROM {_KINDS}")
def _inference(spark, d):
    k, a = F.col("event_id") % 9, F.col("event_id") % 4
    model = F.when(k == 0, "claude-x").when(k == 1, "gemini-2").when(k == 2, "gpt-4o").when(k == 3, "o1-mini").when(k == 4, "grok-1").when(k == 5, "qwen-7").when(k == 6, "").otherwise("other")
    agent = F.when(a == 0, "cron").when(a == 1, "Manual").otherwise("")
    return read(spark, d, "events").select("event_id", infer_provider(model).alias("provider"), infer_change_agent(agent, model).alias("change_agent"))


@query("derive_title", "SELECT conv_id, turn, role || '@host: ' || replace(trim(text), chr(10), ' ')[1:60] AS title FROM conversations")
def _title(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", derive_title(F.col("role"), F.col("text"), F.lit("host")).alias("title"))


@query("wiki_pii_scrub", "SELECT doc_id, 'by [user] in notes.txt and notes.md, mail [REDACTED:pii] ' || source AS text FROM documents")
def _scrub(spark, d):
    text = F.concat(F.lit("by Alice in /home/alice/work/notes.txt and C:\\Users\\alice\\notes.md, mail a.b@example.org "), "source")
    return read(spark, d, "documents").select("doc_id", scrub_shared(text, ["alice"]).alias("text"))


def _mentions(text: str) -> list[tuple[str, str]]:
    import re

    return [(m, "phrase") for m in sorted(set(re.findall(r"[A-Z][a-z]+ License", text)))]


@query("custom_extract", "SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[A-Z][a-z]+ License')) AS name, 'phrase' AS kind FROM documents")
def _custom(spark, d):
    return extract_with(read(spark, d, "documents"), _mentions, "doc_id", "text")


@query("community_cluster")
def _communities(spark, d):
    return communities(turn_edges(spark, d).withColumn("weight", F.lit(1.0)))


@query("or_condition_join", "WITH e AS (SELECT conv_id * 1000 + turn AS from_id, lead(conv_id * 1000 + turn) OVER (PARTITION BY conv_id ORDER BY turn) AS to_id FROM conversations QUALIFY to_id IS NOT NULL), n AS (SELECT conv_id * 1000 + turn AS id FROM conversations WHERE turn = 1) SELECT DISTINCT id, from_id, to_id FROM n JOIN e ON id = from_id OR id = to_id")
def _or(spark, d):
    nodes = read(spark, d, "conversations").where("turn = 1").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"))
    return any_end_join(nodes, turn_edges(spark, d))


@query("set_operations", "SELECT 'both' AS part, count(*) AS n FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels) UNION ALL SELECT 'only', count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)")
def _sets(spark, d):
    return set_counts(read(spark, d, "documents").select("doc_id"), read(spark, d, "labels").select("doc_id"))


@query("citation_drift", "SELECT conv_id, count(*) AS sources, count(*) FILTER (WHERE length(text) >= 100) AS surviving FROM conversations WHERE turn > 0 GROUP BY 1 HAVING surviving < sources")
def _drift(spark, d):
    return citation_drift(read(spark, d, "conversations").where("turn > 0"), "conv_id", F.char_length("text") >= 100)


@query("feedback_update", "SELECT event_id, round(least(1, greatest(0, value / 100 + CASE event_type WHEN 'purchase' THEN 0.1 WHEN 'error' THEN -0.1 ELSE 0 END)), 6) AS importance FROM events")
def _feedback(spark, d):
    after = feedback_importance(F.col("value") / 100, F.col("event_type"), "purchase", "error")
    return read(spark, d, "events").select("event_id", F.round(after, 6).alias("importance"))
