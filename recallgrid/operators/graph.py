"""Graph operators on edge tables: bounded neighbourhoods, session expansion, trees, components, cluster measures."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..registry import query, read


def both_ways(edges: DataFrame, src: str = "from_id", dst: str = "to_id") -> DataFrame:
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b"))
    return e.union(e.select("b", "a")).distinct()


def khop(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(id, hop): nodes within depth (at most 3) of seeds (id), without the seeds; hop is the least."""
    pairs = both_ways(edges)
    reached = seeds.select("id").distinct().withColumn("hop", F.lit(0))
    frontier = reached
    for hop in range(1, min(depth, 3) + 1):
        step = frontier.join(pairs, frontier["id"] == pairs["a"]).select(F.col("b").alias("id")).distinct()
        frontier = step.join(reached.select("id"), "id", "left_anti").withColumn("hop", F.lit(hop))
        reached = reached.union(frontier)
    return reached.where("hop > 0")


def edges_between(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends both are among nodes (id)."""
    ids = nodes.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi")


def session_expand(turns: DataFrame, seeds: DataFrame, cap: int = 12) -> DataFrame:
    """Other turns of the seeds' sessions: the oldest cap of each, taken before the seeds are removed."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    near = turns.join(seeds.select("conv_id").distinct(), "conv_id", "left_semi").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= cap).drop("_r")
    return near.join(seeds.select("conv_id", "turn"), ["conv_id", "turn"], "left_anti")


def neighbor_sessions(turns: DataFrame, seeds: DataFrame, width: int = 1, cap: int = 12) -> DataFrame:
    """Turns of sessions up to width before or after the seeds' own, not these; at most cap of each."""
    own = seeds.select("conv_id").distinct()
    near = own.select(F.explode(F.sequence(F.col("conv_id") - width, F.col("conv_id") + width)).alias("conv_id")).distinct().where("conv_id >= 0").join(own, "conv_id", "left_anti")
    w = Window.partitionBy("conv_id").orderBy("turn")
    return turns.join(near, "conv_id", "left_semi").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= cap).drop("_r")


def tree(nodes: DataFrame, root, depth: int = 20) -> DataFrame:
    """(id, parent_id, depth) of the living descendants of root; a dead node cuts off what is below it.

    A level is joined to its children at a time, and stored, so a tree of any width or depth is walked.
    """
    _shared(nodes.sparkSession)
    live = nodes.where("live").select("id", "parent_id")
    level = live.where(F.col("id") == F.lit(root)).withColumn("depth", F.lit(0)).checkpoint()
    found = level
    for k in range(1, depth + 1):
        level = live.join(level.select(F.col("id").alias("parent_id")), "parent_id").select("id", "parent_id", F.lit(k).alias("depth")).checkpoint()
        if level.isEmpty():
            break
        found = found.union(level)
    return found


def neighborhood(edges: DataFrame, root, depth: int) -> DataFrame:
    """(id, hop) of a walk in both directions; a node may stand at several hops, the root too."""
    pairs = both_ways(edges)
    level = edges.sparkSession.range(1).select(F.lit(root).cast(edges.schema["from_id"].dataType).alias("id"))
    found = level.withColumn("hop", F.lit(0))
    for hop in range(1, depth + 1):
        level = level.join(pairs, level["id"] == pairs["a"]).select(F.col("b").alias("id")).distinct()
        found = found.union(level.withColumn("hop", F.lit(hop)))
    return found


def _shared(spark) -> str:
    """The folder that all executors share; a temporary one where none is set, as in local tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().getOrElse(None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.sparkContext.setCheckpointDir(str(found))
    return str(found)


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(id, component): the smallest id reached, by alternating stars; lineage is cut by checkpoints."""
    _shared(edges.sparkSession)
    now = both_ways(edges).where("a > b").checkpoint()
    seen = None
    for _ in range(rounds):
        state = tuple(now.agg(F.count("*"), F.expr("coalesce(bit_xor(xxhash64(a, b)), 0)")).first())
        if state == seen:
            break
        seen = state
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        now = large.join(small, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct().checkpoint()
    else:
        raise RuntimeError("components didn't settle")
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(now.select("b", "b").distinct()).distinct()


#: Levels of a walk after which what has been reached is put together again.
LEVELS = 8


def dependents(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(id): what depends on seeds (id) over edges from_id -> to_id (from depends on to), seeds excluded.

    The walk goes on for as many levels as there are; cycles end, as no node is walked twice. Each level reads its
    frontier's edges only and ends in a checkpoint.
    """
    _shared(edges.sparkSession)
    start = seeds.select("id").distinct().checkpoint()
    back = edges.where("from_id <> to_id").select(F.col("to_id").alias("id"), F.col("from_id").alias("next")).distinct().checkpoint()
    reached, frontier, level = start, start, 0
    while not frontier.isEmpty():
        level += 1
        step = back.join(frontier, "id", "left_semi").select(F.col("next").alias("id")).distinct()
        frontier = step.join(reached, "id", "left_anti").checkpoint()
        reached = reached.union(frontier)
        if level % LEVELS == 0:
            reached = reached.checkpoint()
    return reached.join(start, "id", "left_anti")


def comention_edges(mentions: DataFrame, low: int = 2, high: int = 8) -> DataFrame:
    """(a, b): consecutive members, in order, of each entity that low to high members mention: a chain, not a clique."""
    m = mentions.distinct()
    sized = m.groupBy("entity_id").agg(F.count("*").alias("_n")).where(F.col("_n").between(low, high)).drop("_n")
    chain = m.join(sized, "entity_id", "left_semi").withColumn("b", F.lead("memory_id").over(Window.partitionBy("entity_id").orderBy("memory_id")))
    return chain.where("b is not null").select(F.col("memory_id").alias("a"), "b").distinct()


def cluster_measures(members: DataFrame, edges: DataFrame) -> DataFrame:
    """Anchor score of each cluster from its inner edges: weighted mean of backbone .15, provenance .40,
    confidence .10 and backbone ratio .35, counts saturating as x / (x + 2)."""
    m = members.select("id", "cluster", "confidence")
    inner = edges.join(m.select(F.col("id").alias("from_id"), F.col("cluster").alias("c1")), "from_id").join(m.select(F.col("id").alias("to_id"), F.col("cluster").alias("c2")), "to_id").where("c1 = c2")
    counts = inner.groupBy(F.col("c1").alias("cluster")).agg(F.count_if(F.col("kind") == "backbone").alias("backbone"), F.count_if(F.col("kind") == "provenance").alias("provenance"), F.count("*").alias("edges"))
    base = m.groupBy("cluster").agg(F.count("*").alias("size"), F.avg("confidence").alias("confidence"))
    x = base.join(counts, "cluster", "left").na.fill(0, ["backbone", "provenance", "edges"])
    ratio = F.when(F.col("edges") > 0, F.col("backbone") / F.col("edges")).otherwise(0.0)
    kas = 0.15 * F.col("backbone") / (F.col("backbone") + 2) + 0.40 * F.col("provenance") / (F.col("provenance") + 2) + 0.10 * F.col("confidence") + 0.35 * ratio
    return x.select("cluster", "size", ratio.alias("backbone_ratio"), (F.col("provenance") / (F.col("provenance") + 2)).alias("provenance"), kas.alias("kas"))


#: Bins of scores from 0 to 1.
BINS = 10_000


def low_anchor_flags(measures: DataFrame, adrift: float = 0.15) -> DataFrame:
    """Clusters adrift, or among five and more at or under the 20th percentile (by index) and half the median.

    The percentiles are index picks over the sorted scores; one row of scores is broadcast back.
    """
    # The picks need order statistics only: scores are counted in bins of bounded number, and ranked within a bin.
    bin_of = F.floor(F.col("kas") * BINS)
    bins = measures.groupBy(bin_of.alias("bin")).agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("bin")) - F.col("n")).select("bin", "before")
    inside = F.sum("n").over(Window.partitionBy("bin").orderBy("kas"))
    ranked = measures.groupBy(bin_of.alias("bin"), "kas").agg(F.count("*").alias("n")).withColumn("inside", inside).join(bins, "bin").select("kas", (F.col("before") + F.col("inside")).alias("upto"))
    total = measures.agg(F.count("*").alias("total"))
    pick = lambda q: F.min(F.when(F.col("upto") > F.floor(q * F.col("total")), F.col("kas")))
    stats = ranked.crossJoin(F.broadcast(total)).agg(pick(0.2).alias("p20"), pick(0.5).alias("p50"), F.max("total").alias("total"))
    low = (F.col("total") >= 5) & (F.col("kas") <= F.col("p20")) & (F.col("kas") < 0.5 * F.col("p50"))
    return measures.crossJoin(F.broadcast(stats)).select("cluster", ((F.col("kas") < adrift) | low).alias("low"))


def coverage(items: DataFrame, covered: DataFrame, key: str, by: str) -> DataFrame:
    """(by, covered): the share of each group's items that are among the covered ones."""
    have = covered.select(key).distinct().withColumn("_have", F.lit(1.0))
    return items.join(have, key, "left").groupBy(by).agg(F.avg(F.coalesce("_have", F.lit(0.0))).alias("covered"))


def stale_share(items: DataFrame, by: str, end: str = "valid_to") -> DataFrame:
    """(by, stale): the share of each group's items that have ended."""
    return items.groupBy(by).agg(F.avg(F.col(end).isNotNull().cast("double")).alias("stale"))


def redundant_pairs(members: DataFrame, least: float) -> DataFrame:
    """(a, b, jaccard) of clusters (c) that share at least some part of their members (x), a < b.

    Only clusters that share a member meet; how many they share is counted by pair, so no member's list is gathered.
    """
    m = members.select("c", "x").distinct()
    n = m.groupBy("c").agg(F.count("*").alias("n"))
    a, b = m.select(F.col("c").alias("a"), "x"), m.select(F.col("c").alias("b"), "x")
    both = a.join(b, "x").where("a < b").groupBy("a", "b").agg(F.count("*").alias("k"))
    whole = both.join(n.select(F.col("c").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("c").alias("b"), F.col("n").alias("nb")), "b")
    j = F.col("k") / (F.col("na") + F.col("nb") - F.col("k"))
    return whole.where(j >= least).select("a", "b", j.alias("jaccard"))


def cluster_ledger(items: DataFrame, by: str, id_col: str, order: str) -> DataFrame:
    """(id, by): the latest item of each cluster, which stands for its state."""
    return items.groupBy(by).agg(F.max_by(id_col, F.struct(order, id_col)).alias(id_col)).select(id_col, by)


# Edges between consecutive turns, one graph of conversations; nodes are conv_id * 1000 + turn.
_EDGES = "e AS (SELECT conv_id * 1000 + turn AS from_id, lead(conv_id * 1000 + turn) OVER (PARTITION BY conv_id ORDER BY turn) AS to_id FROM conversations QUALIFY to_id IS NOT NULL), p AS (SELECT from_id AS a, to_id AS b FROM e UNION SELECT to_id, from_id FROM e)"


def turn_edges(spark, d) -> DataFrame:
    node = F.col("conv_id") * 1000 + F.col("turn")
    t = read(spark, d, "conversations").select("conv_id", "turn", node.alias("from_id"))
    return t.withColumn("to_id", F.lead("from_id").over(Window.partitionBy("conv_id").orderBy("turn"))).where("to_id is not null").select("from_id", "to_id")


def _seeds(spark, d) -> DataFrame:
    return read(spark, d, "conversations").where("conv_id % 10 = 0 and turn = 1").select("conv_id", "turn", (F.col("conv_id") * 1000 + F.col("turn")).alias("id"))


@query("graph_khop", f"WITH RECURSIVE {_EDGES}, s AS (SELECT conv_id * 1000 + turn AS id FROM conversations WHERE conv_id % 10 = 0 AND turn = 1), w(id, hop) AS (SELECT id, 0 FROM s UNION SELECT p.b, w.hop + 1 FROM w JOIN p ON p.a = w.id WHERE w.hop < 2) SELECT id, CAST(min(hop) AS INT) AS hop FROM w WHERE id NOT IN (SELECT id FROM s) GROUP BY id")
def _khop(spark, d):
    return khop(turn_edges(spark, d), _seeds(spark, d), 2)


@query("graph_neighborhood", f"WITH RECURSIVE {_EDGES}, w(id, hop) AS (SELECT 0::BIGINT, 0 UNION ALL SELECT p.b, w.hop + 1 FROM w JOIN p ON p.a = w.id WHERE w.hop < 3) SELECT DISTINCT id, CAST(hop AS INT) AS hop FROM w")
def _neighborhood(spark, d):
    return neighborhood(turn_edges(spark, d), 0, 3)


@query("graph_edges_induced", f"WITH {_EDGES} SELECT from_id, to_id FROM e WHERE from_id % 1000 < 3 AND to_id % 1000 < 3")
def _induced(spark, d):
    nodes = read(spark, d, "conversations").where("turn < 3").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"))
    return edges_between(turn_edges(spark, d), nodes).select("from_id", "to_id")


@query("session_expand", "SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations WHERE conv_id % 10 = 0 AND conv_id IN (SELECT conv_id FROM conversations WHERE turn = 1)) WHERE r <= 3 AND turn <> 1")
def _session(spark, d):
    return session_expand(read(spark, d, "conversations"), _seeds(spark, d), 3).select("conv_id", "turn")


@query("neighbor_sessions", "WITH s AS (SELECT DISTINCT conv_id FROM conversations WHERE conv_id % 10 = 0 AND turn = 1), n AS (SELECT conv_id + x AS conv_id FROM s, (VALUES (-1), (1)) v(x)) SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) WHERE r <= 4 AND conv_id IN (SELECT conv_id FROM n) AND conv_id NOT IN (SELECT conv_id FROM s)")
def _neighbors(spark, d):
    return neighbor_sessions(read(spark, d, "conversations"), _seeds(spark, d), 1, 4).select("conv_id", "turn")


@query("score_extras", "SELECT d.doc_id AS id, round(coalesce(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 0.1), 6) AS score FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id, (SELECT embedding FROM embeddings WHERE vec_id = 0) q")
def _extras(spark, d):
    from .vector import cosine, with_query

    v = read(spark, d, "embeddings")
    near = with_query(v, v.where("vec_id = 0")).select(F.col("vec_id").alias("id"), cosine(F.col("embedding"), F.col("q")).alias("s"))
    rows = read(spark, d, "documents").select(F.col("doc_id").alias("id"))
    return rows.join(near, "id", "left").select("id", F.round(F.coalesce("s", F.lit(0.1)), 6).alias("score"))


_HIER = """n AS (SELECT 'r' || r_regionkey AS id, NULL AS parent_id, true AS live FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_nationkey % 7 <> 0 FROM nation
 UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, true FROM supplier)"""


def hierarchy(spark, d) -> DataFrame:
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    r = read(spark, d, "region").select(name("r", "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent_id"), F.lit(True).alias("live"))
    n = read(spark, d, "nation").select(name("n", "n_nationkey").alias("id"), name("r", "n_regionkey").alias("parent_id"), (F.col("n_nationkey") % 7 != 0).alias("live"))
    return r.union(n).union(read(spark, d, "supplier").select(name("s", "s_suppkey").alias("id"), name("n", "s_nationkey").alias("parent_id"), F.lit(True).alias("live")))


@query("task_tree", f"WITH RECURSIVE {_HIER}, t(id, parent_id, depth) AS (SELECT id, parent_id, 0 FROM n WHERE id = 'r1' UNION ALL SELECT n.id, n.parent_id, t.depth + 1 FROM t JOIN n ON n.parent_id = t.id WHERE n.live AND t.depth < 5) SELECT id, parent_id, CAST(depth AS INT) AS depth FROM t")
def _tree(spark, d):
    return tree(hierarchy(spark, d), "r1", 5)


@query("connected_components", f"WITH {_EDGES} SELECT conv_id * 1000 + turn AS id, min(conv_id * 1000 + turn) OVER (PARTITION BY conv_id) AS component FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations GROUP BY 1 HAVING count(DISTINCT turn) > 1)")
def _components(spark, d):
    return components(turn_edges(spark, d))


@query("connected_edges", f"WITH {_EDGES} SELECT from_id, to_id FROM e WHERE from_id IN (SELECT conv_id * 1000 + turn FROM conversations WHERE role = 'user') AND to_id IN (SELECT conv_id * 1000 + turn FROM conversations WHERE length(text) > 100) AND from_id <> to_id")
def _connected(spark, d):
    t = read(spark, d, "conversations").withColumn("id", F.col("conv_id") * 1000 + F.col("turn"))
    e = turn_edges(spark, d).join(t.where("role = 'user'").select(F.col("id").alias("from_id")), "from_id", "left_semi")
    return e.join(t.where("length(text) > 100").select(F.col("id").alias("to_id")), "to_id", "left_semi").where("from_id <> to_id").select("from_id", "to_id")


@query("comention_edges", "WITH m AS (SELECT DISTINCT l_orderkey AS e, l_suppkey AS s FROM lineitem), k AS (SELECT e FROM m GROUP BY e HAVING count(*) BETWEEN 2 AND 8), c AS (SELECT s AS a, lead(s) OVER (PARTITION BY e ORDER BY s) AS b FROM m WHERE e IN (SELECT e FROM k)) SELECT DISTINCT a, b FROM c WHERE b IS NOT NULL")
def _comention(spark, d):
    return comention_edges(read(spark, d, "lineitem").select(F.col("l_orderkey").alias("entity_id"), F.col("l_suppkey").alias("memory_id")))


@query("blast_radius", f"WITH {_EDGES} SELECT from_id AS id FROM e JOIN (SELECT conv_id, max(turn) AS bad FROM conversations WHERE length(text) < 200 GROUP BY 1) x ON from_id // 1000 = conv_id AND from_id % 1000 < bad WHERE from_id NOT IN (SELECT conv_id * 1000 + turn FROM conversations WHERE length(text) < 200)")
def _blast(spark, d):
    seeds = read(spark, d, "conversations").where("length(text) < 200").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"))
    return dependents(turn_edges(spark, d), seeds)


@query("delta_scope", f"WITH {_EDGES}, c AS (SELECT conv_id * 1000 + turn AS id FROM conversations WHERE turn = 2) SELECT id FROM c UNION SELECT from_id FROM e WHERE to_id IN (SELECT id FROM c)")
def _delta(spark, d):
    changed = read(spark, d, "conversations").where("turn = 2").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"))
    direct = turn_edges(spark, d).join(changed.select(F.col("id").alias("to_id")), "to_id", "left_semi").select(F.col("from_id").alias("id"))
    return changed.union(direct).distinct()


_M = """m AS (SELECT s_suppkey AS id, s_nationkey AS cluster, (s_suppkey % 10) / 10.0 AS confidence FROM supplier),
g AS (SELECT DISTINCT l_suppkey AS from_id, ps AS to_id, CASE WHEN (l_suppkey + ps) % 3 = 0 THEN 'backbone' WHEN (l_suppkey + ps) % 3 = 1 THEN 'provenance' ELSE 'other' END AS kind FROM (SELECT l_suppkey, lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey) AS ps FROM lineitem) WHERE ps IS NOT NULL AND ps <> l_suppkey),
c AS (SELECT a.cluster, count(*) FILTER (WHERE kind = 'backbone') AS bb, count(*) FILTER (WHERE kind = 'provenance') AS pv, count(*) AS n FROM g JOIN m a ON a.id = from_id JOIN m b ON b.id = to_id WHERE a.cluster = b.cluster GROUP BY 1),
k AS (SELECT m.cluster, count(*) AS size, coalesce(bb, 0) AS bb, coalesce(pv, 0) AS pv, coalesce(bb / n, 0.0) AS ratio, avg(confidence) AS conf FROM m LEFT JOIN c USING (cluster) GROUP BY ALL),
kas AS (SELECT cluster, size, round(ratio, 6) AS backbone_ratio, round(pv / (pv + 2), 6) AS provenance, round(0.15 * bb / (bb + 2) + 0.4 * pv / (pv + 2) + 0.1 * conf + 0.35 * ratio, 6) AS kas FROM k)"""


def measures(spark, d) -> DataFrame:
    members = read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("cluster"), ((F.col("s_suppkey") % 10) / 10).alias("confidence"))
    pairs = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("from_id"), F.lead("l_suppkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey")).alias("to_id")).where("to_id is not null and to_id <> from_id").distinct()
    rest = (F.col("from_id") + F.col("to_id")) % 3
    edges = pairs.withColumn("kind", F.when(rest == 0, "backbone").when(rest == 1, "provenance").otherwise("other"))
    out = cluster_measures(members, edges)
    return out.select("cluster", "size", *[F.round(c, 6).alias(c) for c in ("backbone_ratio", "provenance", "kas")])


@query("cluster_kas", f"WITH {_M} SELECT * FROM kas")
def _kas(spark, d):
    return measures(spark, d)


@query("low_anchor_flags", f"WITH {_M}, o AS (SELECT *, row_number() OVER (ORDER BY kas) - 1 AS i, count(*) OVER () AS total FROM kas), s AS (SELECT min(kas) FILTER (WHERE i = floor(0.2 * total)) AS p20, min(kas) FILTER (WHERE i = floor(0.5 * total)) AS p50, max(total) AS total FROM o) SELECT cluster, kas < 0.15 OR (total >= 5 AND kas <= p20 AND kas < 0.5 * p50) AS low FROM kas, s")
def _low(spark, d):
    return low_anchor_flags(measures(spark, d))


@query("admission_gate", f"WITH {_M} SELECT cluster FROM kas WHERE kas >= 0.5 OR backbone_ratio >= 0.6 OR provenance >= 0.5 OR size = 1")
def _gate(spark, d):
    return measures(spark, d).where("kas >= 0.5 or backbone_ratio >= 0.6 or provenance >= 0.5 or size = 1").select("cluster")


@query("coverage", "SELECT source, round(avg(CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 1.0 ELSE 0.0 END), 6) AS covered FROM documents GROUP BY 1")
def _coverage(spark, d):
    return coverage(read(spark, d, "documents"), read(spark, d, "labels"), "doc_id", "source").withColumn("covered", F.round("covered", 6))


@query("stale_share", "SELECT user_id, round(avg(CASE WHEN valid_to IS NULL THEN 0.0 ELSE 1.0 END), 6) AS stale FROM (SELECT user_id, lead(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS valid_to FROM events) GROUP BY 1")
def _stale(spark, d):
    from .predicates import validity

    return stale_share(validity(read(spark, d, "events")), "user_id").withColumn("stale", F.round("stale", 6))


@query("redundant_pairs", "WITH m AS (SELECT DISTINCT s_nationkey AS c, o_custkey % 200 AS x FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey), n AS (SELECT c, count(*) AS n FROM m GROUP BY 1), o AS (SELECT a.c AS a, b.c AS b, count(*) AS k FROM m a JOIN m b ON a.x = b.x AND a.c < b.c GROUP BY ALL) SELECT a, b, round(k / (p.n + q.n - k), 6) AS jaccard FROM o JOIN n p ON p.c = a JOIN n q ON q.c = b WHERE k / (p.n + q.n - k) >= 0.6")
def _redundant(spark, d):
    line = read(spark, d, "lineitem").join(read(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(read(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    members = line.select(F.col("s_nationkey").alias("c"), (F.col("o_custkey") % 200).alias("x"))
    return redundant_pairs(members, 0.6).withColumn("jaccard", F.round("jaccard", 6))


@query("cluster_ledger", "WITH r AS (SELECT source, max_by(doc_id, (n_chars, doc_id)) AS latest FROM documents WHERE n_chars < 5000 GROUP BY 1) SELECT d.doc_id, d.source FROM documents d JOIN r ON r.source = d.source AND r.latest = d.doc_id")
def _ledger(spark, d):
    return cluster_ledger(read(spark, d, "documents").where("n_chars < 5000"), "source", "doc_id", "n_chars")
