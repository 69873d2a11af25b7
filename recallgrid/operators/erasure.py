"""Erasure over every table that holds a subject's data, and supersession with its edge and history rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..registry import query, read

# The relation from a synthesis to what it was made of, and the one from a new version to the old one.
CONSOLIDATES, SUPERSEDES = "consolidates", "supersedes"


def erase(tables: dict[str, DataFrame], subjects: DataFrame, at: str) -> dict[str, DataFrame]:
    """The tables without all that is of subjects (user_id), and a record of it.

    items (id, user_id, restricted), vectors and history (memory_id), edges (from_id, to_id, relationship_type),
    surface (memory_id, user_id), archive (id, user_id), members (run_id, memory_id): those that are given. What an
    erased item was consolidated into is restricted until it is reviewed (before the edges go). A run whose members
    hold an erased item loses all its cached members; `runs` says which and how many of them were erased. `requests`
    has a row for each subject, with the number of its items; none of these tables holds a content.
    """
    who = subjects.select("user_id").where("user_id is not null").distinct()
    items = tables["items"]
    gone = items.join(who, "user_id", "left_semi").select(F.col("id").alias("memory_id"))
    without = lambda df, column: df.join(gone.select(F.col("memory_id").alias(column)), column, "left_anti").select(*df.columns)
    owned = lambda df: df.join(who, "user_id", "left_anti").select(*df.columns)
    out = {"items": owned(items)}
    if edges := tables.get("edges"):
        made = edges.where(F.col("relationship_type") == CONSOLIDATES).join(gone.select(F.col("memory_id").alias("to_id")), "to_id", "left_semi")
        derived = made.select(F.col("from_id").alias("id")).distinct().withColumn("_derived", F.lit(True))
        out["items"] = out["items"].join(derived, "id", "left").withColumn("restricted", F.coalesce("_derived", "restricted", F.lit(False))).select(*items.columns)
        out["edges"] = without(without(edges, "from_id"), "to_id")
    out |= {name: without(tables[name], "memory_id") for name in ("vectors", "history") if name in tables}
    if surface := tables.get("surface"):
        out["surface"] = owned(without(surface, "memory_id"))
    if archive := tables.get("archive"):
        out["archive"] = owned(without(archive, "id"))
    if members := tables.get("members"):
        hit = members.join(gone, "memory_id", "left_semi").groupBy("run_id").agg(F.countDistinct("memory_id").alias("erased"))
        out["runs"] = hit.withColumn("flushed_at", F.to_timestamp(F.lit(at)))
        out["members"] = members.join(hit.select("run_id"), "run_id", "left_anti").select(*members.columns)
    n = items.join(who, "user_id").groupBy("user_id").agg(F.count("*").alias("items_affected"))
    done = who.join(n, "user_id", "left").select(F.col("user_id").alias("subject_id"), F.lit("forget").alias("request_type"), F.lit("completed").alias("status"), F.coalesce("items_affected", F.lit(0)).alias("items_affected"), F.to_timestamp(F.lit(at)).alias("completed_at"))
    return out | {"requests": done}


def mark_superseded(items: DataFrame, pairs: DataFrame, edges: DataFrame, history: DataFrame, at: str, actor: str = "", only_active: bool = True) -> dict[str, DataFrame]:
    """items, edges and history after the versions of pairs (old_id, new_id, close_at) have taken the old ones' place.

    An old item is deleted, and its interval closed at close_at unless it is closed already. Of several successors of
    one item the first counts (by close_at, then id); with only_active, an item that is deleted already isn't touched
    and gets neither an edge nor history. The edge leads from new to old and is there once; history keeps the old content.
    """
    first = Window.partitionBy("old_id").orderBy(F.asc_nulls_last("close_at"), "new_id")
    chosen = pairs.withColumn("_n", F.row_number().over(first)).where("_n = 1 and old_id <> new_id").select(F.col("old_id").alias("id"), "new_id", "close_at")
    fits = items.join(chosen, "id")
    fits = fits.where(~F.coalesce("is_deleted", F.lit(False))) if only_active else fits
    taken = fits.select("id", "new_id", "close_at", F.col("content").alias("_old"))
    after = items.join(taken.drop("_old"), "id", "left")
    closed = F.col("new_id").isNotNull()
    changed = {"is_deleted": F.when(closed, True).otherwise(F.col("is_deleted")), "valid_to": F.when(closed, F.coalesce("valid_to", "close_at")).otherwise(F.col("valid_to")), "updated_at": F.when(closed, F.to_timestamp(F.lit(at))).otherwise(F.col("updated_at"))}
    new_edges = taken.select(F.col("new_id").alias("from_id"), F.col("id").alias("to_id"), F.lit(SUPERSEDES).alias("relationship_type"))
    key = ["from_id", "to_id", "relationship_type"]
    log = taken.select(F.col("id").alias("memory_id"), F.lit("supersede").alias("event"), F.col("_old").alias("prev_value"), F.col("new_id").cast("string").alias("new_value"), F.lit("content").alias("field"), F.lit(actor).alias("actor_id"), F.to_timestamp(F.lit(at)).alias("created_at"))
    return {
        "items": after.withColumns(changed).select(*items.columns),
        "edges": edges.unionByName(new_edges.join(edges.select(*key), key, "left_anti"), allowMissingColumns=True),
        "history": history.unionByName(log.select(*history.columns)),
    }


def failed_files(leaves: DataFrame, attempts: DataFrame, files: DataFrame) -> DataFrame:
    """(path, failed, total, last_error) of current files with leaves (leaf_id, file_id, status) whose extraction failed."""
    current = files.where("superseded_by is null").select("file_id", "path")
    n = leaves.groupBy("file_id").agg(F.count_if(F.col("status") == "failed").alias("failed"), F.count("*").alias("total")).where("failed > 0")
    tried = attempts.where("status = 'failed'").join(leaves.where("status = 'failed'").select("leaf_id", "file_id"), "leaf_id")
    last = tried.groupBy("file_id").agg(F.max_by("error", F.struct("attempted_at", "leaf_id")).alias("last_error"))
    return n.join(current, "file_id").join(last, "file_id", "left").select("path", "failed", "total", "last_error")


def drifted_promotions(markers: DataFrame, files: DataFrame, leaves: DataFrame, facts: DataFrame) -> DataFrame:
    """(marker_id, promoted_to, path) of promotions (marker_id, promoted_to, source) of a file, a leaf or a fact whose
    file has been superseded since."""
    old = files.where("superseded_by is not null").select("file_id", "path")
    of = files.select(F.col("file_id").alias("source"), "file_id").unionByName(leaves.select(F.col("leaf_id").alias("source"), "file_id")).unionByName(facts.select(F.col("fact_id").alias("source"), "file_id"))
    return markers.join(of, "source").join(old, "file_id").select("marker_id", "promoted_to", "path").distinct()


def entity_profile(entities: DataFrame, relations: DataFrame, mentions: DataFrame, items: DataFrame, entity, most: int = 50) -> DataFrame:
    """(entity_id, name, outgoing, incoming, items) of one entity: (predicate, other) of its relations in either
    direction, and ids of the newest items (at most `most`) that mention it; all sorted."""
    one = entities.where(F.col("entity_id") == entity).select("entity_id", "name")
    ends = lambda mine, other, name: relations.where(F.col(mine) == entity).groupBy(F.col(mine).alias("entity_id")).agg(F.array_sort(F.collect_set(F.struct("predicate", F.col(other).alias("other")))).alias(name))
    newest = items.join(mentions.where(F.col("entity_id") == entity).select("memory_id").distinct(), "memory_id").orderBy(F.desc("created_at"), "memory_id").limit(most)
    ids = newest.agg(F.array_sort(F.collect_list(F.struct(-F.unix_micros(F.col("created_at").cast("timestamp")), "memory_id"))).alias("x")).select(F.lit(entity).cast(entities.schema["entity_id"].dataType).alias("entity_id"), F.transform("x", lambda r: r["memory_id"]).alias("items"))
    return one.join(ends("from_entity", "to_entity", "outgoing"), "entity_id", "left").join(ends("to_entity", "from_entity", "incoming"), "entity_id", "left").join(ids, "entity_id", "left")


def _store(spark, d) -> dict[str, DataFrame]:
    """Events as items of users; other tables of a store follow from them. Ids of the archive are below 0, so no item has them."""
    e = read(spark, d, "events").select(F.col("event_id").alias("id"), "user_id", "event_type", F.lit(False).alias("restricted"))
    m = e.select(F.col("id").alias("memory_id"), "user_id", "event_type")
    kind = F.when(F.col("id") % 4 == 0, CONSOLIDATES).otherwise("related")
    return {
        "items": e, "vectors": m.where("event_type <> 'view'").select("memory_id"), "history": m.where("event_type = 'purchase'").select("memory_id"),
        "edges": e.select(F.col("id").alias("from_id"), (F.col("id") + 1).alias("to_id"), kind.alias("relationship_type")),
        "surface": m.where("event_type = 'click'").select("memory_id", "user_id"), "archive": e.where("event_type = 'signup'").select((-1 - F.col("id")).alias("id"), "user_id"),
        "members": m.select((F.col("memory_id") % 97).alias("run_id"), "memory_id").where("memory_id % 5 = 0"),
    }


@query("gdpr_erase", """WITH w AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'signup' AND user_id % 50 = 0), g AS (SELECT event_id FROM events WHERE user_id IN (SELECT user_id FROM w)), k AS (SELECT * FROM events WHERE user_id NOT IN (SELECT user_id FROM w)),
r AS (SELECT DISTINCT event_id % 97 AS run FROM g WHERE event_id % 5 = 0)
SELECT 'items' AS "table", count(*) AS n FROM k UNION ALL SELECT 'restricted', count(*) FROM k WHERE event_id % 4 = 0 AND event_id + 1 IN (SELECT event_id FROM g) UNION ALL SELECT 'vectors', count(*) FROM k WHERE event_type <> 'view' UNION ALL SELECT 'history', count(*) FROM k WHERE event_type = 'purchase'
UNION ALL SELECT 'edges', count(*) FROM k WHERE event_id + 1 NOT IN (SELECT event_id FROM g) UNION ALL SELECT 'surface', count(*) FROM k WHERE event_type = 'click' UNION ALL SELECT 'archive', count(*) FROM k WHERE event_type = 'signup'
UNION ALL SELECT 'members', count(*) FROM events WHERE event_id % 5 = 0 AND event_id % 97 NOT IN (SELECT run FROM r) UNION ALL SELECT 'runs', count(*) FROM r UNION ALL SELECT 'requests', count(*) FROM w""")
def _erase(spark, d):
    """How many rows each table of the store has left, after some users' erasure."""
    store = _store(spark, d)
    after = erase(store, store["items"].where("event_type = 'signup' and user_id % 50 = 0"), "2024-02-01 00:00:00")
    after["restricted"] = after["items"].where("restricted")
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n") for name, df in after.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


@query("supersede_marked", """WITH v AS (SELECT event_id, user_id, lead(event_id) OVER w AS new_id, lead(ts) OVER w AS close_at FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)), t AS (SELECT * FROM v WHERE new_id IS NOT NULL AND event_id % 7 <> 0)
SELECT 'item' AS kind, event_id AS a, CAST(close_at AS VARCHAR) AS b FROM t UNION ALL SELECT 'edge', new_id, CAST(event_id AS VARCHAR) FROM t UNION ALL SELECT 'history', event_id, CAST(new_id AS VARCHAR) FROM t""")
def _marked(spark, d):
    """Each event replaced by its user's next one of the type; a seventh was deleted before."""
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    e = read(spark, d, "events").withColumns({"new_id": F.lead("event_id").over(w), "close_at": F.lead("ts").over(w)})
    items = e.select(F.col("event_id").alias("id"), F.col("event_type").alias("content"), (F.col("event_id") % 7 == 0).alias("is_deleted"), F.lit(None).cast("timestamp_ntz").alias("valid_to"), F.lit(None).cast("timestamp").alias("updated_at"))
    edges = items.select(F.col("id").alias("from_id"), F.col("id").alias("to_id"), F.lit(SUPERSEDES).alias("relationship_type")).where("false")
    history = spark.createDataFrame([], "memory_id long, event string, prev_value string, new_value string, field string, actor_id string, created_at timestamp")
    after = mark_superseded(items, e.where("new_id is not null").select(F.col("event_id").alias("old_id"), "new_id", "close_at"), edges, history, "2024-02-01 00:00:00")
    rows = after["items"].where("valid_to is not null").select(F.lit("item").alias("kind"), F.col("id").alias("a"), F.col("valid_to").cast("string").alias("b"))
    rows = rows.unionByName(after["edges"].select(F.lit("edge").alias("kind"), F.col("from_id").alias("a"), F.col("to_id").cast("string").alias("b")))
    return rows.unionByName(after["history"].select(F.lit("history").alias("kind"), F.col("memory_id").alias("a"), F.col("new_value").alias("b")))


@query("entity_profile", """SELECT p_partkey AS entity_id, p_name AS name, (SELECT string_agg(DISTINCT l_returnflag || ':' || l_suppkey, ',' ORDER BY l_returnflag || ':' || l_suppkey) FROM lineitem WHERE l_partkey = 15) AS outgoing, (SELECT string_agg(DISTINCT l_linestatus || ':' || l_suppkey, ',' ORDER BY l_linestatus || ':' || l_suppkey) FROM lineitem WHERE l_partkey = 15) AS incoming,
(SELECT string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderdate DESC, o_orderkey) FROM (SELECT DISTINCT o_orderkey, o_orderdate FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_partkey = 15 ORDER BY o_orderdate DESC, o_orderkey LIMIT 10)) AS items FROM part WHERE p_partkey = 15""")
def _profile(spark, d):
    line, offset = read(spark, d, "lineitem"), 10_000_000
    parts = read(spark, d, "part").select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("name"))
    supplier = F.col("l_suppkey") + offset  # suppliers are entities, too
    relations = line.select(F.col("l_partkey").alias("from_entity"), supplier.alias("to_entity"), F.col("l_returnflag").alias("predicate")).unionByName(line.select(supplier.alias("from_entity"), F.col("l_partkey").alias("to_entity"), F.col("l_linestatus").alias("predicate")))
    items = read(spark, d, "orders").select(F.col("o_orderkey").alias("memory_id"), F.col("o_orderdate").alias("created_at"))
    found = entity_profile(parts, relations, line.select(F.col("l_orderkey").alias("memory_id"), F.col("l_partkey").alias("entity_id")), items, 15, 10)
    said = lambda c: F.array_join(F.array_sort(F.transform(c, lambda r: F.concat(r["predicate"], F.lit(":"), (r["other"] - offset).cast("string")))), ",")
    return found.select("entity_id", "name", said("outgoing").alias("outgoing"), said("incoming").alias("incoming"), F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("items"))
