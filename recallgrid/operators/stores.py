"""Batch work on stores: queues of work, claims, links, variants, vocabularies, hashes, browsing, scopes, reviews.

Every operator takes DataFrames and gives the rows that a store should hold afterwards, or those that were asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..registry import query, read
from ..sources.transfer import newer_wins
from .nearby import TILE_COLUMNS, TILE_ROWS, better, filled, grouped, near_neighbours, shares_for

NOW = "2024-01-25 00:00:00"
# Renamed vocabulary, types that aren't knowledge, relations of provenance, days a review may take.
ENTITY_TYPE_RENAMES = {"concept": "legacy_concept", "object": "legacy_object"}
PREDICATE_RENAMES = {"relates_to": "mentions", "contradicts": "supersedes"}
NOT_KNOWLEDGE = ["conversation", "message", "thought"]
OPEN_STATES = ["pending", "failed"]
DONE_RESULTS = ["done_text", "done_empty"]
PROVENANCE = ["consolidates", "distills_from"]
REVIEW_DAYS = 30
MAX_ATTEMPTS = 5
STEPS = 50


# Links and variants


def link_adjacent(turns: DataFrame, id_col: str, conversation: str, order: str, relation: str = "related") -> DataFrame:
    """(from_id, to_id, relationship_type): each turn to the next of its conversation; rows without either are left out."""
    w = Window.partitionBy(conversation).orderBy(order, id_col)
    known = turns.where(F.col(conversation).isNotNull() & F.col(order).isNotNull())
    return known.select(F.col(id_col).alias("from_id"), F.lead(id_col).over(w).alias("to_id"), F.lit(relation).alias("relationship_type")).where("to_id is not null")


def knn_graph(vectors: DataFrame, top: int, threshold: float, id_col: str = "id", cell_rows: int | None = None) -> DataFrame:
    """(from_id, to_id, score): of each vector the top others with cosine of at least threshold, exactly; ties to smaller ids.

    Rows are dealt into shares by hash, as few as memory allows (nearby.shares_for); every two shares meet in a cell,
    which keeps each row's best alone, so a cell gives top rows for each of its rows at most. The work grows with the
    square of the rows: for thresholds above some 0.8, nearby.near_neighbours looks at buckets of near vectors only.
    """
    v = vectors.select(F.col(id_col).cast("long").alias("id"), "embedding").dropna()
    shares = shares_for(v, cell_rows)
    dealt = v.withColumn("share", F.pmod(F.xxhash64("id"), F.lit(shares))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(shares - 1).cast("bigint"))))
    cells = dealt.withColumns({"x": F.least("share", "other"), "y": F.greatest("share", "other")})

    found = grouped(cells, ["x", "y"], lambda cell: _nearest(cell, top, threshold), "from_id long, to_id long, score double")
    w = Window.partitionBy("from_id").orderBy(F.desc("score"), "to_id")
    return found.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top).drop("_r")


def _nearest(cell: pa.Table, top: int, threshold: float) -> Iterator[pa.Table]:
    """(from_id, to_id, score): of each row of a cell the top others of the other side, by tiles of the two sides.

    A tile's scores go both ways. They only say which pairs are looked at: a pair's score is then summed in one order, so
    that equal vectors have equal scores wherever they stand.
    """
    ids, share = cell["id"].to_numpy(), cell["share"].to_numpy()
    m, size, norm = filled(cell)
    m /= np.where(norm > 0, norm, 1.0)[:, None]
    one_size = size.min() == size.max()
    rows = np.flatnonzero(norm > 0)
    x, y = cell["x"][0].as_py(), cell["y"][0].as_py()
    left, right = rows[share[rows] == x], rows[share[rows] == y]
    best = np.full((len(ids), top), -2.0)
    whom = np.zeros((len(ids), top), np.int64)
    for at in range(0, len(left), TILE_ROWS):
        one = left[at : at + TILE_ROWS]
        for nth in range(at // TILE_COLUMNS * TILE_COLUMNS if x == y else 0, len(right), TILE_COLUMNS):
            two = right[nth : nth + TILE_COLUMNS]
            score = m[one] @ m[two].T
            least = [np.maximum(best[side, -1], threshold) - 1e-9 for side in (one, two)]
            good = (score >= least[0][:, None]) | (score >= least[1])
            if not one_size:
                good &= size[one][:, None] == size[two]
            if x == y:
                good &= (one[:, None] < two) & (ids[one][:, None] != ids[two])
            p, q = np.nonzero(good)
            for k in range(0, len(p), 1 << 16):
                i, j = one[p[k : k + (1 << 16)]], two[q[k : k + (1 << 16)]]
                s = (m[i] * m[j]).sum(1)
                i, j, s = i[s >= threshold], j[s >= threshold], s[s >= threshold]
                better(best, whom, np.concatenate((i, j)), ids[np.concatenate((j, i))], np.concatenate((s, s)))
    row, nth = np.nonzero(best > -2)
    yield pa.table({"from_id": ids[row], "to_id": whom[row, nth], "score": best[row, nth]})


def copy_variant(items: DataFrame, vectors: DataFrame, source: str, target: str, id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """(items, vectors) of the live rows of variant source, as new rows of variant target; new ids follow from the old.

    Refuses a target that has rows. An item's first vector (the smallest by its columns) is copied.
    """
    if not items.where(F.col("variant") == target).isEmpty():
        raise ValueError(f"variant {target!r} has rows already")
    new_id = lambda c: F.md5(F.concat(F.lit(target + "|"), F.col(c).cast("string")))
    chosen = items.where((F.col("variant") == source) & ~F.coalesce("is_deleted", F.lit(False)))
    first = vectors.join(chosen.select(id_col), id_col, "left_semi").groupBy(id_col).agg(F.min(F.struct(*[c for c in vectors.columns if c != id_col])).alias("_v"))
    copied = chosen.withColumns({id_col: new_id(id_col), "variant": F.lit(target)})
    return copied, first.select(new_id(id_col).alias(id_col), "_v.*")


# Vocabulary, titles, hashes


def renamed(column: Column, names: dict[str, str]) -> Column:
    """A column with old names replaced by new ones."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(table, column), column)


def rename_audit(before: DataFrame, after: DataFrame, column: str, names: dict[str, str]) -> DataFrame:
    """(when, name, n): how many rows had old names before, and have the new ones after."""
    count = lambda df, when, of: df.where(F.col(column).isin(list(of))).groupBy(F.lit(when).alias("when"), F.col(column).alias("name")).agg(F.count("*").alias("n"))
    return count(before, "before", names.keys()).unionByName(count(after, "after", set(names.values())))


def derive_title(content: Column, limit: int = 100) -> Column:
    """A title from the first line that isn't blank, without a leading tag, cut at a word where it is too long."""
    body = F.regexp_replace(X.strip(F.coalesce(content, F.lit(""))), r"^<[^>]+>(?U:\s*)", "")
    line = F.regexp_extract(body, r"(?U)^(?:\s*\n)*[^\S\n]*(\S[^\n]*)", 1)
    line = F.regexp_replace(X.strip(F.when(line == "", body).otherwise(line)), r"(?U)\s+", " ")
    cut = F.substring(line, 1, limit)
    space = limit - F.locate(" ", F.reverse(cut))  # the place of the last space, from 0
    word = F.when((F.locate(" ", cut) > 0) & (space > limit * 0.5), F.substring(cut, F.lit(1), space)).otherwise(cut)
    return F.when(F.char_length(line) <= limit, line).otherwise(F.concat(F.regexp_replace(word, r"(?U)\s+$", ""), F.lit("…")))


def backfill_hash(vectors: DataFrame, items: DataFrame, key: str, content: str = "content", stored: str = "content_hash") -> DataFrame:
    """(key, content_hash) of vectors without a hash whose live item has content."""
    live = items.where(~F.coalesce("is_deleted", F.lit(False)) & (F.trim(F.coalesce(content, F.lit(""))) != "")).select(key, F.sha2(F.col(content).cast("binary"), 256).alias("_hash"))
    return vectors.where(F.col(stored).isNull()).select(key).join(live, key).withColumnRenamed("_hash", stored)


# Queues and claims


def assign_route(queue: DataFrame, source_variant: str, target_variant: str, send_to: str | None, min_size: int | None = None, max_size: int | None = None, only_unassigned: bool = False, include_completed: bool = False) -> DataFrame:
    """queue with send_to set on the rows of two variants, within sizes; pending and failed ones unless told otherwise."""
    hit = (F.col("source_variant") == source_variant) & (F.col("target_variant") == target_variant)
    for wanted, also in ((min_size is not None, F.col("content_size_k") >= (min_size or 0)), (max_size is not None, F.col("content_size_k") <= (max_size or 0)), (only_unassigned, F.col("send_to").isNull()), (not include_completed, F.col("status").isin(OPEN_STATES))):
        hit = hit & also if wanted else hit
    return queue.withColumn("send_to", F.when(F.coalesce(hit, F.lit(False)), F.lit(send_to).cast("string")).otherwise(F.col("send_to")))


def release_claims(groups: DataFrame, run_id: str | None = None, older_than: int | None = None, now: str = NOW, everything: bool = False, results: DataFrame | None = None) -> DataFrame:
    """groups with claims in progress of a run, older than so many minutes, or all, set back to pending.

    Exactly one of the three is given. results (group_key, result), if given, keeps groups that are done as they are.
    """
    if sum((run_id is not None, older_than is not None, everything)) != 1:
        raise ValueError("give one of run_id, older_than and everything")
    hit = F.col("status") == "in_progress"
    if run_id is not None:
        hit = hit & (F.col("enrich_run_id") == run_id)
    elif older_than is not None:
        hit = hit & (F.col("claimed_at") < F.to_timestamp(F.lit(now)) - F.expr(f"INTERVAL {int(older_than)} MINUTES"))
    if results is not None:
        done = results.where(F.col("result").isin(DONE_RESULTS)).select("group_key").distinct().withColumn("_done", F.lit(True))
        groups = groups.join(done, "group_key", "left")
        hit = hit & F.col("_done").isNull()
    hit = F.coalesce(hit, F.lit(False))
    out = groups.withColumn("_hit", hit)
    for c in ("claim_token", "claimed_at", "enrich_run_id"):
        out = out.withColumn(c, F.when(~F.col("_hit"), F.col(c)))
    return out.withColumn("status", F.when(F.col("_hit"), "pending").otherwise(F.col("status"))).drop("_hit", "_done")


def queue_open(queue: DataFrame, stage: str, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    return queue.where((F.col("attempts") < max_attempts) & (F.col("stage") == stage))


def queue_pop(queue: DataFrame, stage: str, limit: int, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """The next limit rows of a stage: fewest attempts first, then the oldest; rows aren't locked."""
    return queue_open(queue, stage, max_attempts).orderBy("attempts", "enqueued_at", "id").limit(limit)


def queue_depth(queue: DataFrame, stage: str, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """(n): how many rows of a stage can still be popped."""
    return queue_open(queue, stage, max_attempts).agg(F.count("*").alias("n"))


def queue_settle(queue: DataFrame, acked: DataFrame, failed: DataFrame, now: str = NOW) -> DataFrame:
    """queue without the acknowledged ids, and with one more attempt and the error (500 characters) on failed ones (id, error)."""
    error = failed.groupBy("id").agg(F.max("error").alias("_error"))
    rest = queue.join(acked.select("id").distinct(), "id", "left_anti").join(error, "id", "left")
    hit = F.col("_error").isNotNull()
    rest = rest.withColumns({"attempts": F.col("attempts") + hit.cast("int"), "last_error": F.when(hit, F.substring("_error", 1, 500)).otherwise(F.col("last_error")), "last_attempt_at": F.when(hit, F.to_timestamp(F.lit(now))).otherwise(F.col("last_attempt_at"))})
    return rest.drop("_error")


def distill_candidates(tasks: DataFrame, items: DataFrame, now: str, stale_days: int = 3, threshold: int = 1, most: int = 20, steps: int = STEPS) -> DataFrame:
    """(task_id, source_ids, texts): of completed tasks with a result, the result and then the steps of its conversation.

    The oldest `most` tasks completed more than stale_days ago, none if there are fewer than threshold; a task's
    sources are its live result and the first `steps` other live items of the result's conversation.
    """
    done = tasks.where((F.col("state") == "completed") & F.col("deleted_at").isNull() & F.col("result_memory_id").isNotNull())
    if stale_days > 0:
        done = done.where(F.col("completed_at") < F.to_timestamp(F.lit(now)) - F.expr(f"INTERVAL {int(stale_days)} DAYS"))
    n = done.agg(F.count("*").alias("_n"))
    first = done.orderBy("completed_at", "id").limit(most).crossJoin(F.broadcast(n)).where(F.col("_n") >= max(threshold, 1))
    live = items.where(~F.coalesce("is_deleted", F.lit(False)))
    line = lambda kind: F.concat(F.lit(f"- {kind}: "), F.coalesce("title", F.lit("")), F.lit(": "), F.coalesce("content", F.lit("")))
    result = first.select(F.col("id").alias("task_id"), F.col("result_memory_id").alias("rid")).join(live.withColumnRenamed("id", "rid"), "rid")
    head = result.select("task_id", F.lit(0).alias("pos"), F.col("rid").alias("id"), line("RESULT").alias("text"))
    other = result.select("task_id", "rid", "conversation_id").join(live.select("id", "conversation_id", "title", "content", "created_at"), "conversation_id").where("id <> rid")
    w = Window.partitionBy("task_id").orderBy("created_at", "id")
    tail = other.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= steps).select("task_id", "pos", "id", line("STEP").alias("text"))
    gathered = head.unionByName(tail).groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct("pos", "id", "text"))).alias("s"))  # steps + 1 rows a task at most
    return gathered.select("task_id", F.col("s.id").alias("source_ids"), F.col("s.text").alias("texts"))


def fact_backlog(items: DataFrame, edges: DataFrame, queue: DataFrame, max_attempts: int = MAX_ATTEMPTS, variants: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """(id, content) waiting for facts: queued with attempts left, and live items of no (or an allowed) variant that are
    no facts, aren't queued and have no fact that references them."""
    fact = "fact_enriched"
    facts = items.where(F.col("type") == fact).select(F.col("id").alias("from_id"))
    covered = edges.where("relationship_type = 'references'").join(facts, "from_id", "left_semi").select(F.col("to_id").alias("id"))
    variant = F.col("variant").isNull() | F.col("variant").isin(variants) if variants else F.col("variant").isNull()
    able = items.where((F.col("type") != fact) & ~F.coalesce("is_deleted", F.lit(False)) & variant).join(covered, "id", "left_anti")
    new = able.join(queue.select(F.col("memory_id").alias("id")), "id", "left_anti")
    again = items.join(queue.where(F.col("attempts") < max_attempts).select(F.col("memory_id").alias("id")), "id", "left_semi")
    out = again.select("id", "content").union(new.select("id", "content")).distinct()
    return out.orderBy("id").limit(limit) if limit is not None else out


# Moving rows between stores


def split_store(source: DataFrame, target: DataFrame, moves: Column, key: str) -> tuple[DataFrame, DataFrame]:
    """(source without the rows that move, target with those it lacks by key); columns that target hasn't are dropped,
    columns that source hasn't are null."""
    shared = [c for c in source.columns if c in target.columns]
    moved = source.where(moves).select(*shared).join(target.select(key), key, "left_anti")
    return source.where(~F.coalesce(moves, F.lit(False))), target.unionByName(moved, allowMissingColumns=True).select(*target.columns)


def sync_sets(primary: DataFrame, warehouse: DataFrame, key: str, time: str, pushed: str | None = None, pulled: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(primary, warehouse) after a sync both ways: rows later than each watermark, the later row of a key wins."""
    after = lambda df, mark: df if mark is None else df.where(F.col(time) > F.to_timestamp(F.lit(mark)))
    warehouse = newer_wins(warehouse, after(primary, pushed), [key], time)
    return newer_wins(primary, after(warehouse, pulled), [key], time), warehouse


def sync_inserts(local: DataFrame, remote: DataFrame, key: str, time: str, pushed: str | None = None, pulled: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(local, remote) after an insert-only sync both ways: rows later than each watermark whose key the other side lacks."""

    def inserted(into: DataFrame, rows: DataFrame, mark: str | None) -> DataFrame:
        new = rows if mark is None else rows.where(F.col(time) > F.to_timestamp(F.lit(mark)))
        return into.unionByName(new.select(*into.columns).join(into.select(key), key, "left_anti"))

    there = inserted(remote, local, pushed)
    return inserted(local, there, pulled), there


# Browsing, scopes and reviews


def _quoted(raw: str) -> tuple[bool, str]:
    exact = len(raw) > 1 and raw[0] == raw[-1] and raw[0] in "\"'"
    return exact, raw[1:-1] if exact else raw


def _like(column: str, pattern: str) -> Column:
    """LIKE in any case, % and _ being wildcards."""
    return F.lower(column).like(pattern.lower().replace("\\", "\\\\"))


def kb_browse(items: DataFrame, type_: str | None = None, search: str | None = None, limit: int | None = None) -> DataFrame:
    """Live items, the most important and then the latest first. A quoted type or search is exact, in its case; else a type
    is a prefix (* being anything) and a search is found anywhere in title or content, in any case."""
    rows = items.where(~F.coalesce("is_deleted", F.lit(False)))
    if type_:
        exact, t = _quoted(type_)
        t = t if exact else t.replace("*", "%")
        rows = rows.where(F.col("type") == t if exact else _like("type", t if t.endswith("%") else t + "%"))
    if search:
        exact, s = _quoted(search)
        found = (lambda c: F.col(c).rlike(X.glob_pattern(f"*{s}*"))) if exact else (lambda c: _like(c, f"%{s}%"))
        rows = rows.where(F.coalesce(found("title"), F.lit(False)) | F.coalesce(found("content"), F.lit(False)))
    rows = rows.orderBy(F.desc("importance"), F.desc("updated_at"), "id")
    return rows.limit(limit) if limit else rows


def item_types(items: DataFrame) -> DataFrame:
    """(type): the distinct types in order."""
    return items.where("type is not null and type <> ''").select("type").distinct().orderBy("type")


def list_knowledge(items: DataFrame, limit: int = 50, type_: str = "") -> DataFrame:
    """The newest live items of a type (a quoted one exactly, else as LIKE does), or of all types that are knowledge."""
    exact, t = _quoted(type_)
    chosen = ~F.col("type").isin(NOT_KNOWLEDGE) if not type_ else F.col("type") == t if exact else _like("type", t)
    return items.where(chosen & ~F.coalesce("is_deleted", F.lit(False))).orderBy(F.desc("created_at"), "id").limit(limit)


def scope_prefix(raw: str | None) -> str:
    """A scope path with a leading stroke and no trailing one; empty for everything."""
    path = (raw or "").strip().strip("/")
    return f"/{path}" if path else ""


def in_scope(scope: Column, prefix: str) -> Column:
    """Whether a path is the prefix or under it; segments are whole."""
    path = F.coalesce(scope, F.lit("/"))
    return F.lit(True) if not prefix else (path == prefix) | F.startswith(path, F.lit(prefix + "/"))


def category_counts(items: DataFrame, scope: str | None = None) -> DataFrame:
    """(category, n) of items (scope, categories) in a scope."""
    rows = items.where(in_scope(F.col("scope"), scope_prefix(scope)))
    return rows.select(F.explode("categories").alias("category")).groupBy("category").agg(F.count("*").alias("n"))


def child_scopes(items: DataFrame, parent: str = "/") -> DataFrame:
    """(scope): the immediate children of a path on the way to items' paths."""
    base = scope_prefix(parent)
    rest = F.ltrim(F.substring(F.col("scope"), F.lit(len(base) + 1), F.greatest(F.char_length("scope"), F.lit(1))), F.lit("/"))
    first = F.split(rest, "/")[0]
    rows = items.where(in_scope(F.col("scope"), base) & F.startswith("scope", F.lit(base))).select(first.alias("first")).where("first <> ''")
    return rows.select(F.concat(F.lit(base + "/"), "first").alias("scope")).distinct()


def scope_count(items: DataFrame, scope: str | None = None) -> DataFrame:
    """(n, oldest, newest) of a scope."""
    return items.where(in_scope(F.col("scope"), scope_prefix(scope))).agg(F.count("*").alias("n"), F.min("created_at").alias("oldest"), F.max("created_at").alias("newest"))


def activity_view(log: DataFrame) -> DataFrame:
    """(time, project, preview, full_size): time of day, 500 characters of what follows the thinking tag, and the length."""
    tag = "<think>"
    after = F.substring("response", F.locate(tag, F.col("response")) + len(tag), F.char_length("response"))
    start = F.when(F.lower("response").contains(tag) & (F.locate(tag, F.col("response")) > 0), after).otherwise(F.col("response"))
    return log.select(F.date_format("timestamp", "HH:mm:ss").alias("time"), F.col("query").alias("project"), F.concat(F.substring(start, 1, 500), F.lit("...")).alias("preview"), F.char_length("response").alias("full_size"))


def derivability_review(members: DataFrame, edges: DataFrame, now: str, days: int = REVIEW_DAYS) -> DataFrame:
    """Restricted syntheses (id, type, restricted, erased_at array, pinned, importance) to be reviewed, in order of rank.

    (id, surviving_sources, erasures, erased_at, age_days, overdue, derivable_candidate, position): sources that are
    still among the members, and how long ago the last one was erased. An opinion of a model can be joined to it.
    """
    live = members.select("id").distinct()
    syntheses = members.where((F.col("type") == "synthesis") & F.col("restricted")).dropDuplicates(["id"])
    sources = edges.where(F.col("relationship_type").isin(PROVENANCE)).join(live.withColumnRenamed("id", "to_id"), "to_id", "left_semi")
    n = sources.groupBy(F.col("from_id").alias("id")).agg(F.count("*").alias("_n"))
    last = F.array_max("erased_at")
    age = (F.to_timestamp(F.lit(now)).cast("double") - last.cast("timestamp").cast("double")) / 86400
    w = Window.orderBy(F.desc("_pin"), F.desc(F.coalesce("importance", F.lit(0.0))), "id")  # the review's rows only
    out = syntheses.join(n, "id", "left").withColumn("_pin", F.coalesce("pinned", F.lit(False)))
    return out.select(
        "id", F.coalesce("_n", F.lit(0)).alias("surviving_sources"), F.greatest(F.size(F.coalesce("erased_at", F.array().cast("array<timestamp>"))), F.lit(0)).alias("erasures"), last.alias("erased_at"), age.alias("age_days"),
        F.coalesce(age > days, F.lit(False)).alias("overdue"), (F.coalesce("_n", F.lit(0)) > 0).alias("derivable_candidate"), F.row_number().over(w).alias("position"),
    )


# Queries


def _turns(spark, d) -> DataFrame:
    return read(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "conv_id", "turn", "role", "text")


@query("link_adjacent", "SELECT * FROM (SELECT conv_id * 1000 + turn AS from_id, lead(conv_id * 1000 + turn) OVER (PARTITION BY conv_id ORDER BY turn) AS to_id, 'related' AS relationship_type FROM conversations) WHERE to_id IS NOT NULL")
def _adjacent(spark, d):
    return link_adjacent(_turns(spark, d), "id", "conv_id", "turn")


@query("knn_graph", "WITH p AS (SELECT a.vec_id AS from_id, b.vec_id AS to_id, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS s FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) SELECT from_id, to_id, round(s, 6) AS score FROM p WHERE s >= 0.25 QUALIFY row_number() OVER (PARTITION BY from_id ORDER BY s DESC, to_id) <= 3")
def _knn(spark, d):
    return knn_graph(read(spark, d, "embeddings"), 3, 0.25, "vec_id").withColumn("score", F.round("score", 6))


@query("knn_graph_near", "WITH e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), v AS (SELECT id * 4 + k AS id, list_prepend(e[1] + 0.05 * k, e[2:]) AS e FROM e, (SELECT unnest(range(0, 4)) AS k)), p AS (SELECT a.id AS from_id, b.id AS to_id, list_cosine_similarity(a.e, b.e) AS s FROM v a JOIN v b ON a.id <> b.id) SELECT from_id, to_id, round(s, 6) AS score FROM p WHERE s >= 0.9 QUALIFY row_number() OVER (PARTITION BY from_id ORDER BY s DESC, to_id) <= 2")
def _knn_near(spark, d):
    """Each vector, and three that are turned a little further each."""
    k = F.explode(F.sequence(F.lit(0), F.lit(3)))
    e = read(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"), k.alias("k"))
    v = e.select((F.col("vec_id") * 4 + F.col("k")).alias("id"), F.expr("transform(e, (x, i) -> if(i = 0, x + 0.05D * k, x))").alias("embedding"))
    return near_neighbours(v, 2, 0.9).withColumn("score", F.round("score", 6))


@query("copy_variant", "SELECT md5('v2|' || doc_id) AS id, 'v2' AS variant, source, CASE WHEN vec_id IS NOT NULL THEN 1 ELSE 0 END AS vectors FROM documents LEFT JOIN embeddings ON vec_id = doc_id WHERE lang = 'en' AND doc_id % 9 <> 0")
def _copy(spark, d):
    items = read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("variant"), "source", (F.col("doc_id") % 9 == 0).alias("is_deleted"))
    copied, vectors = copy_variant(items, read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), "en", "v2")
    return copied.drop("is_deleted").join(vectors.select("id", F.lit(1).alias("vectors")), "id", "left").fillna(0, ["vectors"])


@query("vocab_rename", "WITH e AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'concept' WHEN 'click' THEN 'object' ELSE event_type END AS t FROM events) SELECT 'before' AS \"when\", t AS name, count(*) AS n FROM e WHERE t IN ('concept', 'object') GROUP BY t UNION ALL SELECT 'after', 'legacy_' || t, count(*) FROM e WHERE t IN ('concept', 'object') GROUP BY t")
def _vocab(spark, d):
    before = read(spark, d, "events").select("event_id", renamed(F.col("event_type"), {"view": "concept", "click": "object"}).alias("t"))
    after = before.withColumn("t", renamed(F.col("t"), ENTITY_TYPE_RENAMES))
    return rename_audit(before, after, "t", ENTITY_TYPE_RENAMES)


@query("derive_title_100", r"WITH b AS (SELECT conv_id, turn, regexp_replace(regexp_replace(CASE turn % 3 WHEN 0 THEN '<tag a=1> ' || chr(10) || ' ' WHEN 1 THEN '  ' ELSE '' END || text, '^\s+|\s+$', '', 'g'), '^<[^>]+>\s*', '') AS b FROM conversations), l AS (SELECT conv_id, turn, regexp_replace(regexp_replace(coalesce(list_filter(string_split(b, chr(10)), lambda x: regexp_matches(x, '\S'))[1], ''), '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g') AS t FROM b), c AS (SELECT *, t[1:100] AS c, 100 - instr(reverse(t[1:100]), ' ') AS sp FROM l) SELECT conv_id, turn, CASE WHEN length(t) <= 100 THEN t ELSE rtrim(CASE WHEN instr(c, ' ') > 0 AND sp > 50 THEN c[1:sp] ELSE c END) || '…' END AS title FROM c")
def _title(spark, d):
    head = F.when(F.col("turn") % 3 == 0, "<tag a=1> \n ").when(F.col("turn") % 3 == 1, "  ").otherwise("")
    return read(spark, d, "conversations").select("conv_id", "turn", derive_title(F.concat(head, "text")).alias("title"))


@query("backfill_hash", "SELECT doc_id AS id, sha256(text) AS content_hash FROM documents JOIN embeddings ON vec_id = doc_id WHERE doc_id % 4 = 0 AND doc_id % 3 <> 0 AND trim(text) <> ''")
def _hash(spark, d):
    items = read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), (F.col("doc_id") % 3 == 0).alias("is_deleted"))
    vectors = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 4 != 0, "x").alias("content_hash"))
    return backfill_hash(vectors, items, "id")


_QUEUE = f"(SELECT event_id AS id, 'q' || user_id AS group_key, 's' || user_id % 2 AS source_variant, 't' AS target_variant, CAST(event_id % 9 AS BIGINT) AS content_size_k, CASE WHEN event_id % 5 = 0 THEN 'grok' END AS send_to, CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'in_progress' WHEN 'error' THEN 'failed' ELSE 'success' END AS status, CASE WHEN event_type = 'click' THEN ts END AS claimed_at, CASE WHEN event_type = 'click' THEN 'r' || event_id % 3 END AS enrich_run_id, CAST(event_id % 4 AS INT) AS attempts, CASE WHEN event_id % 2 = 0 THEN 'observe' ELSE 'reflect' END AS stage, ts AS enqueued_at FROM events)"


def _queue(spark, d) -> DataFrame:
    e, t = read(spark, d, "events"), F.col("event_type")
    claimed = t == "click"
    text = lambda s, c: F.concat(F.lit(s), c.cast("string"))
    return e.select(
        F.col("event_id").alias("id"), text("q", F.col("user_id")).alias("group_key"), text("s", F.col("user_id") % 2).alias("source_variant"), F.lit("t").alias("target_variant"), (F.col("event_id") % 9).alias("content_size_k"),
        F.when(F.col("event_id") % 5 == 0, "grok").alias("send_to"), F.when(t == "view", "pending").when(claimed, "in_progress").when(t == "error", "failed").otherwise("success").alias("status"), F.when(claimed, F.col("ts")).alias("claimed_at"),
        F.when(claimed, "token").alias("claim_token"), F.when(claimed, text("r", F.col("event_id") % 3)).alias("enrich_run_id"), (F.col("event_id") % 4).cast("int").alias("attempts"), F.when(F.col("event_id") % 2 == 0, "observe").otherwise("reflect").alias("stage"),
        F.col("ts").alias("enqueued_at"), F.lit(None).cast("string").alias("last_error"), F.lit(None).cast("timestamp").alias("last_attempt_at"),
    )


@query("assign_route", f"SELECT id, CASE WHEN source_variant = 's1' AND content_size_k BETWEEN 2 AND 6 AND send_to IS NULL AND status IN ('pending', 'failed') THEN 'gemini' ELSE send_to END AS send_to FROM {_QUEUE}")
def _route(spark, d):
    return assign_route(_queue(spark, d), "s1", "t", "gemini", 2, 6, only_unassigned=True).select("id", "send_to")


@query("release_claims", f"SELECT id, CASE WHEN hit THEN 'pending' ELSE status END AS status, CASE WHEN NOT hit THEN enrich_run_id END AS run FROM (SELECT *, coalesce(status = 'in_progress' AND claimed_at < TIMESTAMP '{NOW}' - INTERVAL 600 MINUTE AND group_key NOT IN (SELECT 'q' || user_id FROM events WHERE event_type = 'purchase'), false) AS hit FROM {_QUEUE})")
def _release(spark, d):
    bought = read(spark, d, "events").where("event_type = 'purchase'").select(F.concat(F.lit("q"), F.col("user_id").cast("string")).alias("group_key"), F.lit("done_text").alias("result"))
    return release_claims(_queue(spark, d), older_than=600, results=bought).select("id", "status", F.col("enrich_run_id").alias("run"))


@query("queue_pop", f"SELECT id, attempts, stage FROM {_QUEUE} WHERE attempts < 3 AND stage = 'reflect' ORDER BY attempts, enqueued_at, id LIMIT 40")
def _pop(spark, d):
    return queue_pop(_queue(spark, d), "reflect", 40, 3).select("id", "attempts", "stage")


@query("queue_depth", f"SELECT count(*) AS n FROM {_QUEUE} WHERE attempts < 3 AND stage = 'observe'")
def _depth(spark, d):
    return queue_depth(_queue(spark, d), "observe", 3)


@query("queue_settle", f"SELECT id, attempts + CASE WHEN status = 'failed' THEN 1 ELSE 0 END AS attempts, CASE WHEN status = 'failed' THEN repeat('e', 500) END AS last_error FROM {_QUEUE} WHERE status <> 'success'")
def _settle(spark, d):
    q = _queue(spark, d)
    failed = q.where("status = 'failed'").select("id", F.repeat(F.lit("e"), F.lit(600)).alias("error"))
    return queue_settle(q, q.where("status = 'success'"), failed).select("id", "attempts", "last_error")


@query("distill_candidates", "WITH t AS (SELECT DISTINCT conv_id FROM conversations WHERE conv_id % 3 = 0 ORDER BY conv_id LIMIT 15), s AS (SELECT conv_id, turn, CASE WHEN turn = 0 THEN '- RESULT: ' ELSE '- STEP: ' END || role || ': ' || text AS line FROM conversations JOIN t USING (conv_id) WHERE turn <> 2) SELECT conv_id AS task_id, count(*) AS n, sha256(string_agg(line, chr(10) ORDER BY turn)) AS texts FROM s GROUP BY conv_id HAVING min(turn) = 0")
def _distil(spark, d):
    c = read(spark, d, "conversations")
    items = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("conversation_id"), F.col("role").alias("title"), F.col("text").alias("content"), F.col("turn").alias("created_at"), (F.col("turn") == 2).alias("is_deleted"))
    tasks = c.select("conv_id").distinct().select(
        F.col("conv_id").alias("id"), F.when(F.col("conv_id") % 3 == 0, "completed").otherwise("pending").alias("state"), F.lit(None).cast("timestamp").alias("deleted_at"), (F.col("conv_id") * 1000).alias("result_memory_id"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("completed_at")
    )
    out = distill_candidates(tasks, items, NOW, most=15)
    return out.select("task_id", F.size("source_ids").cast("long").alias("n"), F.sha2(F.array_join("texts", "\n").cast("binary"), 256).alias("texts"))


@query("fact_backlog", "WITH i AS (SELECT doc_id AS id, CASE WHEN doc_id % 10 = 0 THEN 'fact_enriched' ELSE 'note' END AS type, CASE WHEN doc_id % 6 = 5 THEN 'b' END AS variant, doc_id % 11 = 0 AS gone FROM documents), q AS (SELECT doc_id AS id, doc_id % 4 AS attempts FROM documents WHERE doc_id % 7 = 0), f AS (SELECT id + 1 AS id FROM i WHERE type = 'fact_enriched') SELECT id FROM i WHERE id IN (SELECT id FROM q WHERE attempts < 3) UNION SELECT id FROM i WHERE type <> 'fact_enriched' AND NOT gone AND variant IS NULL AND id NOT IN (SELECT id FROM f) AND id NOT IN (SELECT id FROM q)")
def _facts(spark, d):
    id_ = F.col("doc_id")
    docs = read(spark, d, "documents")
    items = docs.select(id_.alias("id"), F.col("text").alias("content"), F.when(id_ % 10 == 0, "fact_enriched").otherwise("note").alias("type"), F.when(id_ % 6 == 5, "b").alias("variant"), (id_ % 11 == 0).alias("is_deleted"))
    edges = docs.select(id_.alias("from_id"), (id_ + 1).alias("to_id"), F.lit("references").alias("relationship_type"))
    queue = docs.where("doc_id % 7 = 0").select(id_.alias("memory_id"), (id_ % 4).alias("attempts"))
    return fact_backlog(items, edges, queue, 3).select("id")


@query("split_store", "SELECT 'source' AS store, event_id, event_type, CAST(value AS DOUBLE) AS value FROM events WHERE event_type <> 'error' UNION ALL SELECT 'target', event_id, event_type, NULL FROM events WHERE event_type = 'error'")
def _split(spark, d):
    e = read(spark, d, "events").select("event_id", "event_type", "value")
    target = e.where("event_id % 50 = 0 and event_type = 'error'").select("event_id", "event_type", F.lit(None).cast("string").alias("note"))
    left, right = split_store(e, target, F.col("event_type") == "error", "event_id")
    return left.select(F.lit("source").alias("store"), "*").unionByName(right.drop("note").select(F.lit("target").alias("store"), "*"), allowMissingColumns=True)


_SIDE = "(SELECT user_id AS id, max(ts) AS ts, max_by(event_id, (ts, event_id)) AS v FROM events WHERE event_id % 2 = {} GROUP BY 1)"


def _side(spark, d, k: int) -> DataFrame:
    return read(spark, d, "events").where(F.col("event_id") % 2 == k).groupBy(F.col("user_id").alias("id")).agg(F.max("ts").alias("ts"), F.max_by("event_id", F.struct("ts", "event_id")).alias("v"))


@query("fdw_sync", f"WITH p AS {_SIDE.format(0)}, w AS {_SIDE.format(1)}, w2 AS (SELECT coalesce(w.id, p.id) AS id, CASE WHEN w.id IS NULL OR p.ts > w.ts THEN p.ts ELSE w.ts END AS ts, CASE WHEN w.id IS NULL OR p.ts > w.ts THEN p.v ELSE w.v END AS v FROM w FULL JOIN (SELECT * FROM p WHERE ts > TIMESTAMP '{NOW}') p ON p.id = w.id) SELECT coalesce(p.id, w2.id) AS id, CASE WHEN p.id IS NULL OR w2.ts > p.ts THEN w2.v ELSE p.v END AS mine, w2.v AS theirs FROM p FULL JOIN w2 ON p.id = w2.id")
def _fdw(spark, d):
    mine, theirs = sync_sets(_side(spark, d, 0), _side(spark, d, 1), "id", "ts", pushed=NOW)
    return mine.select("id", F.col("v").alias("mine")).join(theirs.select("id", F.col("v").alias("theirs")), "id", "full_outer")


@query("sync_edges", "WITH a AS (SELECT event_id, user_id, ts FROM events WHERE event_id % 3 <> 0), b AS (SELECT event_id, user_id + 1000 AS user_id, ts FROM events WHERE event_id % 3 <> 1), b2 AS (SELECT * FROM b UNION ALL SELECT * FROM a WHERE ts > TIMESTAMP '2024-01-10 00:00:00' AND event_id NOT IN (SELECT event_id FROM b)) SELECT 'local' AS side, event_id, user_id FROM (SELECT * FROM a UNION ALL SELECT * FROM b2 WHERE event_id NOT IN (SELECT event_id FROM a)) UNION ALL SELECT 'remote', event_id, user_id FROM b2")
def _edges(spark, d):
    e = read(spark, d, "events").select("event_id", "user_id", "ts")
    here, there = sync_inserts(e.where("event_id % 3 <> 0"), e.where("event_id % 3 <> 1").withColumn("user_id", F.col("user_id") + 1000), "event_id", "ts", pushed="2024-01-10 00:00:00")
    return here.select(F.lit("local").alias("side"), "event_id", "user_id").unionByName(there.select(F.lit("remote").alias("side"), "event_id", "user_id"))


_ITEMS = "(SELECT doc_id AS id, source AS type, CASE WHEN doc_id % 2 = 0 THEN 'Title ' || doc_id ELSE 'other' END AS title, text AS content, CAST(doc_id % 17 AS DOUBLE) / 17 AS importance, TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id * 37 % 5000) AS created_at, doc_id % 13 = 0 AS is_deleted FROM documents)"


def _items(spark, d) -> DataFrame:
    id_ = F.col("doc_id")
    made = F.to_timestamp(F.lit("2024-01-01 00:00:00")) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (id_ * 37 % 5000).cast("decimal(18,6)"))
    title = F.when(id_ % 2 == 0, F.concat(F.lit("Title "), id_.cast("string"))).otherwise("other")
    return read(spark, d, "documents").select(id_.alias("id"), F.col("source").alias("type"), title.alias("title"), F.col("text").alias("content"), ((id_ % 17).cast("double") / 17).alias("importance"), made.alias("created_at"), made.alias("updated_at"), (id_ % 13 == 0).alias("is_deleted"))


@query("kb_browse", f"SELECT id FROM {_ITEMS} WHERE NOT is_deleted AND lower(type) LIKE 'src1%' AND (lower(title) LIKE '%title 1%' OR lower(content) LIKE '%title 1%') ORDER BY importance DESC, created_at DESC, id LIMIT 30")
def _browse(spark, d):
    return kb_browse(_items(spark, d), "SRC1*", "TITLE 1", 30).select("id")


@query("knowledge_types", f"SELECT DISTINCT type FROM {_ITEMS} WHERE type <> ''")
def _types(spark, d):
    return item_types(_items(spark, d))


@query("list_knowledge", f"SELECT id FROM {_ITEMS} WHERE type = 'src2' AND NOT is_deleted ORDER BY created_at DESC, id LIMIT 25")
def _knowledge(spark, d):
    return list_knowledge(_items(spark, d), 25, "'src2'").select("id")


def _scoped(spark, d) -> DataFrame:
    path = F.concat(F.lit("/crew"), F.when(F.col("event_id") % 7 == 0, "ers").otherwise(""), F.lit("/"), F.col("event_type"), F.lit("/u"), (F.col("user_id") % 3).cast("string"))
    return read(spark, d, "events").select(F.when(F.col("event_id") % 11 == 0, "/").otherwise(path).alias("scope"), F.split(F.concat_ws(",", F.col("event_type"), F.when(F.col("event_id") % 2 == 0, "even")), ",").alias("categories"), F.col("ts").alias("created_at"))


_SCOPED = "(SELECT *, CASE WHEN event_id % 11 = 0 THEN '/' ELSE '/crew' || CASE WHEN event_id % 7 = 0 THEN 'ers' ELSE '' END || '/' || event_type || '/u' || user_id % 3 END AS scope FROM events)"


@query("category_counts", f"SELECT c AS category, count(*) AS n FROM (SELECT unnest(CASE WHEN event_id % 2 = 0 THEN [event_type, 'even'] ELSE [event_type] END) AS c FROM {_SCOPED} WHERE starts_with(scope, '/crew/')) GROUP BY 1")
def _categories(spark, d):
    return category_counts(_scoped(spark, d), "/crew/")


@query("child_scopes", f"SELECT DISTINCT '/crew/' || event_type AS scope FROM {_SCOPED} WHERE starts_with(scope, '/crew/')")
def _children(spark, d):
    return child_scopes(_scoped(spark, d), "/crew")


@query("scope_count", f"SELECT count(*) AS n, min(ts) AS oldest, max(ts) AS newest FROM {_SCOPED} WHERE starts_with(scope, '/crew/view/')")
def _scope_count(spark, d):
    return scope_count(_scoped(spark, d), "/crew/view")


@query("activity_view", "SELECT event_id AS project, strftime(ts, '%H:%M:%S') AS time, CASE WHEN event_id % 2 = 0 THEN repeat('ab', 250) || '...' ELSE repeat('ab', 20) || '...' END AS preview, CASE WHEN event_id % 2 = 0 THEN 1210 ELSE 40 END AS full_size FROM events")
def _activity(spark, d):
    said = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("so <think>"), F.repeat(F.lit("ab"), F.lit(600)))).otherwise(F.repeat(F.lit("ab"), F.lit(20)))
    return activity_view(read(spark, d, "events").select(F.col("ts").alias("timestamp"), F.col("event_id").alias("query"), said.alias("response")))


@query("derivability_review", f"WITH s AS (SELECT conv_id AS id, max(CASE WHEN turn = 0 THEN 1 ELSE 0 END) AS pin, count(*) AS n FROM conversations GROUP BY 1), r AS (SELECT id, CASE WHEN id % 4 = 0 THEN 0 ELSE (SELECT count(*) FROM conversations c WHERE c.conv_id = s.id AND c.turn % 2 = 1) END AS surviving_sources, id % 60 AS age FROM s WHERE id % 2 = 0) SELECT id, surviving_sources, CAST(age AS DOUBLE) AS age_days, age > 30 AS overdue, surviving_sources > 0 AS derivable_candidate, row_number() OVER (ORDER BY (id % 17) / 17.0 DESC, id) AS position FROM r")
def _review(spark, d):
    c = read(spark, d, "conversations")
    of = lambda kind, turn: F.struct(F.lit(kind).alias("kind"), F.col("conv_id").alias("conv_id"), turn.alias("turn"))
    page, source = of("page", F.lit(0).cast("long")), of("turn", F.col("turn"))  # no page has a turn's id, however many there are
    erased = F.to_timestamp(F.lit(NOW)) - F.make_dt_interval((F.col("conv_id") % 60).cast("int"))
    pages = c.select("conv_id").distinct().select(page.alias("id"), F.lit("synthesis").alias("type"), (F.col("conv_id") % 2 == 0).alias("restricted"), F.array(erased - F.expr("INTERVAL 5 DAYS"), erased).alias("erased_at"), F.lit(False).alias("pinned"), ((F.col("conv_id") % 17) / 17).alias("importance"))
    turns = c.where("turn % 2 = 1").select(source.alias("id"), F.lit("note").alias("type"), F.lit(False).alias("restricted"), F.lit(None).cast("array<timestamp>").alias("erased_at"), F.lit(False).alias("pinned"), F.lit(0.0).alias("importance"))
    edges = c.select(page.alias("from_id"), source.alias("to_id"), F.when(F.col("conv_id") % 4 == 0, "related").otherwise("distills_from").alias("relationship_type"))
    return derivability_review(pages.unionByName(turns), edges, NOW).select(F.col("id.conv_id").alias("id"), "surviving_sources", "age_days", "overdue", "derivable_candidate", "position")
