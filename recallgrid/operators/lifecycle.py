"""Lifecycle operators as table transforms: decay, confidence, retention, supersession, dedup, erasure, plans."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..registry import query, read
from .nearby import SHARE_BYTES, TILE_COLUMNS, TILE_ROWS, document_pairs, filled, grouped, shares_for
from .predicates import validity
from .reports import INPUTS_SQL, LEDGER_SQL, corroboration_inputs, ledger

NOW = "2024-01-25 00:00:00"
DAY = "INTERVAL {} DAYS"

# Priors, units and caps of the confidence formula.
USER_PRIOR, AGENT_PRIOR, INTERNET_PRIOR, NEUTRAL = 0.95, 0.70, 0.40, 0.50
CORROBORATION_UNIT, CORROBORATION_CAP = 0.05, 0.20
CONTRADICTION_UNIT, CONTRADICTION_CAP = 0.10, 0.30
DECAY_RATE = 0.02
ACCESS_UNIT, ACCESS_CAP = 0.01, 0.05


def clamp01(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def source_prior(source: Column, agent: Column, trust: Column) -> Column:
    s, a = F.lower(F.trim(F.coalesce(source, F.lit("")))), F.lower(F.trim(F.coalesce(agent, F.lit(""))))
    by_agent = clamp01(AGENT_PRIOR * F.least(F.lit(1.0), F.greatest(F.lit(0.5), trust)))
    return F.when((s == "user") | (a == "manual"), USER_PRIOR).when(s.isin("internet", "web", "web_research"), INTERNET_PRIOR).when((a != "") & ~a.isin("unknown", "system"), by_agent).otherwise(NEUTRAL)


def confidence(prior: Column, trust_sum: Column, contradictions: Column) -> Column:
    bonus = F.when(trust_sum <= 0, 0.0).otherwise(F.least(F.lit(CORROBORATION_CAP), CORROBORATION_UNIT * trust_sum))
    penalty = F.when(contradictions <= 0, 0.0).otherwise(F.least(F.lit(CONTRADICTION_CAP), CONTRADICTION_UNIT * contradictions))
    return clamp01(prior + bonus - penalty)


def decay_toward_neutral(c: Column) -> Column:
    return clamp01(clamp01(c) + (NEUTRAL - clamp01(c)) * DECAY_RATE)


def access_reinforcement(n: Column) -> Column:
    return F.when(n <= 0, 0.0).otherwise(F.least(F.lit(ACCESS_CAP), ACCESS_UNIT * F.log2(1 + n)))


def importance_decay(items: DataFrame, now: str, rate: float = 0.995, days: int = 7) -> DataFrame:
    old = (F.col("created_at") < F.to_timestamp(F.lit(now)) - F.expr(DAY.format(days))) & ~F.coalesce("pinned", F.lit(False))
    return items.withColumn("importance", F.when(old, F.greatest(F.lit(0.0), F.col("importance") * rate)).otherwise(F.col("importance")))


def retention(items: DataFrame, policies: DataFrame, by: str, created: str, id_col: str, now: str) -> DataFrame:
    """Rows that stay under their owner's policy (ttl_days, keep): younger than the TTL, then the newest `keep`;
    pinned rows stay, owners without a policy keep all."""
    joined = items.join(policies, by, "left")
    alive = F.col("ttl_days").isNull() | (F.col(created) >= F.to_timestamp(F.lit(now)) - F.make_dt_interval(F.col("ttl_days")))
    young = joined.where(alive | F.coalesce("pinned", F.lit(False)))
    w = Window.partitionBy(by).orderBy(F.desc(created), F.desc(id_col))
    ranked = young.withColumn("_r", F.row_number().over(w))
    return ranked.where(F.col("keep").isNull() | (F.col("_r") <= F.col("keep")) | F.coalesce("pinned", F.lit(False))).drop("_r", "ttl_days", "keep")


def supersede(items: DataFrame, by: list[str], start: str, id_col: str) -> DataFrame:
    """The versions of each key with their interval closed by the next one's start, and whether they are live."""
    w = Window.partitionBy(*by).orderBy(start, id_col)
    nxt = F.lead(F.struct(start, id_col)).over(w)
    return items.withColumns({"valid_from": F.col(start), "valid_to": nxt[start], "superseded_by": nxt[id_col], "is_deleted": nxt.isNotNull()})


def latest(changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Changes folded to the live state: the last write of each key, without keys whose last change is a delete."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return changes.withColumn("_r", F.row_number().over(w)).where("_r = 1 and op <> 'delete'").drop("_r", "op")


def similar_pairs(vectors: DataFrame, threshold: float, id_col: str, block: str) -> DataFrame:
    """(a, b, score) of all vectors of one block (a model, an owner, a label) with cosine of at least threshold, a < b.

    Exact; a block of any size is dealt into pairs of shares, as in block_pairs.
    """
    return block_pairs(vectors.select(F.col(id_col).alias("id"), "embedding", F.col(block).alias("g")), threshold)


def cross_pairs(vectors: DataFrame, threshold: float, id_col: str, group: str, cell_rows: int | None = None) -> DataFrame:
    """(a, b, score) of all vectors of different groups with cosine of at least threshold, a < b.

    Exact, for thresholds too low for nearby.near_pairs: ids are dealt by hash into shares, and each pair of shares
    meets in one task; shares are as large as memory allows (nearby.SHARE_BYTES, or cell_rows), as a vector is copied
    once for each share. The work grows with the square of the rows.
    """
    v = vectors.select(F.col(id_col).cast("long").alias("id"), "embedding", F.col(group).alias("g")).dropna()
    shares = shares_for(v, cell_rows)
    share = F.pmod(F.xxhash64("id"), F.lit(shares))
    both = F.explode(F.sequence(F.lit(0), F.lit(shares - 1)).cast("array<bigint>"))
    dealt = v.withColumn("share", share).withColumn("other", both).withColumns({"x": F.least("share", "other"), "y": F.greatest("share", "other")})
    return grouped(dealt, ["x", "y"], lambda cell: _pairs(cell, threshold, True), PAIRS)


def block_pairs(vectors: DataFrame, threshold: float, cell_rows: int | None = None) -> DataFrame:
    """(a, b, score) of all (id, embedding, g) of equal g with cosine of at least threshold, a < b; a block is
    dealt into shares as in cross_pairs."""
    v = vectors.select("id", "embedding", "g")
    return grouped(_blocks(v, cell_rows), ["g", "x", "y"], lambda cell: _pairs(cell, threshold, False), PAIRS)


def _blocks(vectors: DataFrame, cell_rows: int | None) -> DataFrame:
    """(id, embedding, g and other columns) in cells of two shares of one block. Shares are of one size in all blocks: as
    large as memory allows, but with cells for all cores."""
    v = vectors.withColumn("id", F.col("id").cast("long")).dropna(subset=["id", "embedding", "g"])
    if not cell_rows:
        n = v.groupBy("g").agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("size"))
        pairs, size = n.agg(F.coalesce(F.sum(F.col("n").cast("double") * F.col("n")), F.lit(0.0)), F.coalesce(F.max("size"), F.lit(1))).first()
        cores = v.sparkSession.sparkContext.defaultParallelism
        cell_rows = min(max(1000, math.ceil(math.sqrt(pairs / (4 * cores)))), max(1, SHARE_BYTES // (8 * max(1, size))))
    shares = v.groupBy("g").agg(F.ceil(F.count("*") / cell_rows).alias("shares"))
    dealt = v.join(shares, "g").withColumn("share", F.pmod(F.xxhash64("id"), F.col("shares"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("shares") - 1)))
    return dealt.drop("shares").withColumns({"x": F.least("share", "other"), "y": F.greatest("share", "other")})


PAIRS = "a long, b long, score double"


def _pairs(cell: pa.Table, threshold: float, differ: bool) -> Iterator[pa.Table]:
    ids = cell["id"].to_numpy()
    for i, j, score in _scored(cell, threshold, differ):
        yield pa.table({"a": ids[i], "b": ids[j], "score": score})


def _scored(cell: pa.Table, threshold: float, differ: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, row, cosine) of a cell's pairs, that of the smaller id first, by tiles of the two sides; the cosine is 0 where
    a vector has no length or the sizes differ."""
    ids, share = (cell[c].to_numpy() for c in ("id", "share"))
    codes = cell["g"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    m, size, norm = filled(cell)
    norm = np.where(norm > 0, norm, 1.0)
    unit = m / norm[:, None]
    one_size = size.min() == size.max()
    order = np.argsort(ids, kind="stable")
    left = order[share[order] == cell["x"][0].as_py()]
    right = order[share[order] == cell["y"][0].as_py()]
    alone = cell["x"][0] == cell["y"][0]
    for at in range(0, len(left), TILE_ROWS):
        one = left[at : at + TILE_ROWS]
        for nth in range(0, len(right), TILE_COLUMNS):
            two = right[nth : nth + TILE_COLUMNS]
            if alone and ids[two[-1]] <= ids[one[0]]:
                continue
            score = unit[one] @ unit[two].T
            if not one_size:
                score[size[one][:, None] != size[two]] = 0.0
            p, q = np.nonzero(score >= threshold - 1e-9)
            i, j, s = one[p], two[q], score[p, q]
            keep = ids[i] < ids[j] if alone else np.ones(len(i), bool)
            if differ:
                keep &= codes[i] != codes[j]
            edge = np.flatnonzero(keep & (np.abs(s - threshold) < 1e-9) & (size[i] == size[j]))
            s[edge] = (m[i[edge]] * m[j[edge]]).sum(1) / (norm[i[edge]] * norm[j[edge]])
            keep &= s >= threshold
            if keep.any():
                i, j, s = i[keep], j[keep], s[keep]
                turned = ids[i] > ids[j]
                yield np.where(turned, j, i), np.where(turned, i, j), s


#: Pairs of a component beyond which it is settled in rounds and not by one task.
COMPONENT_PAIRS = 500_000


def _claimed(rows: pa.Table) -> pa.Table:
    """(id, parent) of the pairs of one component, in one pass over them in order."""
    parent: dict[int, int] = {}
    order = np.lexsort((rows["a"].to_numpy(), rows["b"].to_numpy()))
    for a, b in zip(rows["a"].to_numpy()[order].tolist(), rows["b"].to_numpy()[order].tolist()):
        if a not in parent and b not in parent:  # a's own pairs came before, as a < b
            parent[b] = a
    return pa.table({"id": pa.array(list(parent), pa.int64()), "parent": pa.array(list(parent.values()), pa.int64())})


def greedy_dedup(pairs: DataFrame, component_pairs: int = COMPONENT_PAIRS) -> DataFrame:
    """(id, parent): each row claimed by its first unclaimed earlier neighbour, from sparse pairs (a < b).

    The lexicographically first maximal independent set: a row whose earlier neighbours are all settled is kept
    if none of them is kept, else it belongs to the earliest kept one. Components are found in rounds whose number
    grows with the logarithm of their size; each is settled in one pass by one task, whatever the length of its
    chains. A component with more than component_pairs pairs is settled by settle_in_rounds.
    """
    from .graph import _shared, components

    _shared(pairs.sparkSession)
    p = pairs.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a < b").distinct().checkpoint()
    label = components(p.toDF("from_id", "to_id")).checkpoint()
    sizes = p.join(label, p["a"] == label["id"]).groupBy("component").agg(F.count("*").alias("n"))
    large = sizes.where(F.col("n") > component_pairs).select("component").checkpoint()
    of = p.join(label.withColumnRenamed("id", "a"), "a").select("a", "b", "component")
    small = of.join(large, "component", "left_anti").groupBy("component").applyInArrow(_claimed, "id long, parent long")
    if large.isEmpty():
        return small
    return small.unionByName(settle_in_rounds(of.join(large, "component", "left_semi").select("a", "b")))


def settle_in_rounds(pairs: DataFrame) -> DataFrame:
    """greedy_dedup in rounds of joins, as many as the longest chain of waiting rows needs; the smallest open row of
    all is always settled, so they end."""
    from .graph import _shared

    _shared(pairs.sparkSession)
    nodes = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    state = nodes.withColumn("parent", F.lit(None).cast("long")).withColumn("done", F.lit(False)).checkpoint()
    while True:
        if state.where("not done").isEmpty():
            return state.where("parent is not null").select("id", "parent")
        open_ = pairs.join(state.where("not done").select(F.col("id").alias("b")), "b")
        earlier = open_.join(state.select(F.col("id").alias("a"), F.col("done").alias("a_done"), F.col("parent").alias("a_parent")), "a")
        seen = earlier.groupBy(F.col("b").alias("id")).agg(F.min(F.when(F.col("a_done") & F.col("a_parent").isNull(), F.col("a"))).alias("kept"), F.min(F.when(~F.col("a_done"), F.col("a"))).alias("waiting"))
        merged = state.join(seen, "id", "left")
        # An earliest kept neighbour settles a row once no earlier one is still open.
        ready = ~F.col("done") & F.coalesce(F.col("waiting").isNull() | (F.col("kept") < F.col("waiting")), F.lit(False))
        state = merged.select("id", F.when(ready, F.col("kept")).otherwise(F.col("parent")).alias("parent"), (F.col("done") | ready).alias("done")).checkpoint()


# Cosines above which items are related, contradict (with equal titles) and corroborate each other.
RELATED, CONFLICT, CORROBORATE = 0.70, 0.92, 0.95


def contradictions(items: DataFrame, related: float = RELATED, conflict: float = CONFLICT, corroborate: float = CORROBORATE, cell_rows: int | None = None) -> DataFrame:
    """(a, b, kind) of items (id, type, embedding, title, content) of one type with cosine above related, a < b.

    supersede: above conflict with equal titles and other contents; else corroborate from its cosine on; else related.
    Contents and titles are compared by hash; the hashes go with the vectors, so pairs are made whole in their cell and aren't
    shuffled.
    """
    digest = lambda c: F.unhex(F.sha2(F.col(c).cast("binary"), 256))
    v = items.select("id", "embedding", F.col("type").alias("g"), digest("title").alias("title"), digest("content").alias("content"))

    def kinds(cell: pa.Table) -> Iterator[pa.Table]:
        ids = cell["id"].to_numpy()
        title, content = (cell[c].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False) for c in ("title", "content"))
        for i, j, score in _scored(cell, related, False):
            above = score > related
            i, j, score = i[above], j[above], score[above]
            differs = (title[i] == title[j]) & (title[i] >= 0) & (content[i] != content[j])
            kind = np.where((score > conflict) & differs, 1, np.where(score >= corroborate, 2, 3))
            yield pa.table({"a": ids[i], "b": ids[j], "kind": kind.astype(np.int32)})

    named = F.element_at(F.array(*map(F.lit, ["supersede", "corroborate", "related"])), F.col("kind"))
    return grouped(_blocks(v, cell_rows), ["g", "x", "y"], kinds, "a long, b long, kind int").withColumn("kind", named)


def forget(table: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    return table.join(ids.select(F.col("id").alias(column)), column, "left_anti")


# Patterns and words that decide whether a chat turn is noise, and how far into a turn they are looked for.
EPHEMERAL = (
    r"(?i)(?:\bPID\s*\d+|\bprocess[_\s]+id[\s:=]*\d+|\bport\s*\d{4,5}"
    r"|\bbatches/[A-Za-z0-9_-]{12,}"
    r"|\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b"
    r"|/tmp/[A-Za-z0-9._/-]+|AppData[\\/]+Local[\\/]+Temp)"
)
STATUS = (
    r"(?i)\b(?:completion[:\s]+\d+\.?\d*\s*%|cost[:\s]+\$?\d+\.\d+"
    r"|\d+\s*/\s*\d+\s+(?:in_?progress|done|pending|sessions)"
    r"|workers?\s+alive[:\s]+\d+|slice\s+\d+\s+poll\s*#?\d+)"
)
REFUSALS = ["no", "stop", "kill", "abort", "wait", "hold"]
STATUS_REQUEST = (
    r"(?i)\b(status|progress|any\s+update|update\??|how('?s| is)\s+it\s+going"
    r"|where\s+are\s+we|eta|done\s*\??|finished\s*\??|ready\s*\??)\b"
)
STATUS_RESPONSE = (
    r"(?i)(\bstatus\b|\bprogress\b|\d+\s*%|\d+\s*/\s*\d+|\bremaining\b|\bso far\b"
    r"|\bin[_\s]?progress\b|\bcompleted?\b|\bpending\b|\bworkers?\b|\beta\b)"
)
SIGNAL = (
    r"(?i)```|\bdecid(e|ed|ing|sion)\b|\bbecause\b|\btherefore\b|\bremember\b"
    r"|\bnever\b|\balways\b|\bIMPORTANT\b|\bnote that\b|\bgotcha\b|\bTODO\b"
)
DURABLE = (
    r"(?i)\b(we (decided|chose|went with|will use)|decision:|settled on|going with"
    r"|the plan is to|production footgun|the rule is|canonical (form|way) is"
    r"|from now on|going forward|always (use|do|prefer)|never (use|do)"
    r"|by default|prefer \w+ (over|to)|hostname is|runs on port \d|listening on \d"
    r"|configured (to|with)|the (endpoint|url|path|model|db|database) (is|=|:)"
    r"|installed (at|in)|API key|lives (at|in) /|stored (at|in))\b"
)
STRUCTURE = r"(?m)(^|\n)\s*(#{1,3}\s|\*\s|-\s|\d+[.)]\s)"
HARD_NOISE = ["short_cmd", "repeat_status_req", "repeat_status_resp"]
SNIPPET, SCANNED, KEY_HEAD, KEY_LENGTH, QUESTION_HEAD = 2000, 20_000, 400, 120, 200


def is_ephemeral(content: Column) -> Column:
    head = F.substring(content, 1, SNIPPET)
    short = X.strip(head)
    return head.rlike(EPHEMERAL) | head.rlike(STATUS) | ((F.char_length(short) <= 30) & (short.rlike(r"^\{") | short.rlike(r"^[-+]*\d+$")))


def is_short_command(role: Column, content: Column) -> Column:
    s = X.strip(F.lower(content))
    words = F.split(s, r"(?U)\s+")
    return (F.lower(role) == "user") & (content != "") & ~s.contains("?") & ~F.arrays_overlap(words, F.array(*[F.lit(w) for w in REFUSALS])) & (F.size(words) <= 4)


def decay_factor(role: Column, content: Column, age_days: Column) -> Column:
    """The importance factor of a turn by its class and age; null where nothing changes."""
    short = F.when(age_days < 1, 0.5).when(age_days < 3, 0.1).otherwise(0.02)
    general = F.when(age_days < 1, 1.0).when(age_days < 3, 0.5).when(age_days < 7, 0.2).otherwise(0.05)
    return F.when(is_short_command(role, content), short).when(is_ephemeral(content), general)


def norm_key(content: Column) -> Column:
    """What turns that repeat each other share: the head in lower case, without ids, hexadecimal and other numbers and marks."""
    s = F.regexp_replace(F.lower(F.substring(content, 1, KEY_HEAD)), EPHEMERAL, " ")
    for p in (r"[0-9a-f]{6,}", r"\d+", r"[^a-z ]+", r"\s+"):
        s = F.regexp_replace(s, p, " ")
    return F.substring(F.trim(s), 1, KEY_LENGTH)


def chat_class(role: Column, content: Column, importance: Column, cluster: Column, min_cluster: int = 5, keep_floor: float = 0.4, generic_max: float | None = 0.3) -> Column:
    """Noise class of a turn, null to keep it: keep rules first, then ephemeral, short command, repeated requests for a
    status and answers to them, and what is of low importance (generic_max None: not that). cluster is how many turns
    have the same norm_key; turns whose key is empty have 0."""
    content, role = F.coalesce(content, F.lit("")), F.lower(F.coalesce(role, F.lit("")))
    probe = F.substring(content, 1, SCANNED)
    out = F.when(importance > keep_floor, None).when(F.substring(content, 1, QUESTION_HEAD).contains("?"), None).when(probe.rlike(SIGNAL), None)
    out = out.when((content != "") & is_ephemeral(content), "ephemeral").when(is_short_command(role, content), "short_cmd")
    out = out.when((cluster >= min_cluster) & (role == "user") & probe.rlike(STATUS_REQUEST), "repeat_status_req")
    out = out.when((cluster >= min_cluster) & role.isin("assistant", "tool", "") & probe.rlike(STATUS_RESPONSE), "repeat_status_resp")
    return out if generic_max is None else out.when(importance.isNull() | (importance <= generic_max), "generic_low")


def is_protected(content: Column, long: int = 300) -> Column:
    """Whether a turn is at most suppressed: durable or strong signals, or long and structured."""
    probe = F.substring(content, 1, SCANNED)
    structured = (F.char_length(content) >= long) & (F.regexp_count(content, F.lit(STRUCTURE)) >= 2)
    return F.coalesce((content != "") & (probe.rlike(DURABLE) | probe.rlike(SIGNAL) | structured), F.lit(False))


def chat_prune(turns: DataFrame, now: str, fresh_days: int = 14, prune_days: int = 45, long: int = 300, delete_below: int = 300, **classes) -> DataFrame:
    """(id, class, action, importance) of noisy turns (id, role, content, importance, created_at, decayed) older than fresh_days.

    `decay` lowers the importance of noise that is younger than prune_days or protected, once; `prune` is for deletion;
    `kept` has been decayed before. Repeats are counted over all turns that are old enough.
    """
    old = turns.where(F.col("created_at") < F.to_timestamp(F.lit(now)) - F.expr(DAY.format(fresh_days)))
    keyed = old.withColumns({"_key": norm_key(F.coalesce("content", F.lit(""))), "importance": F.coalesce("importance", F.lit(0.3))})
    sizes = keyed.where("_key <> ''").groupBy("_key").agg(F.count("*").alias("_size"))
    sized = keyed.join(sizes, "_key", "left")
    named = sized.withColumn("class", chat_class(F.col("role"), F.col("content"), F.col("importance"), F.coalesce("_size", F.lit(0)), **classes)).where("class is not null")
    generic = (F.col("class") == "generic_low") & (F.char_length("content") >= delete_below)
    guarded = ~F.col("class").isin(HARD_NOISE) & (is_protected(F.col("content"), long) | generic)
    young = F.col("created_at") >= F.to_timestamp(F.lit(now)) - F.expr(DAY.format(prune_days))
    action = F.when((young | guarded) & F.col("decayed"), "kept").when(young | guarded, "decay").otherwise("prune")
    lower = F.round(F.least("importance", F.lit(0.3)) * 0.2, 4)
    return named.withColumn("action", action).select("id", "class", "action", F.when(F.col("action") == "decay", lower).otherwise(F.col("importance")).alias("importance"))


# From each task state, the states that may follow.
TRANSITIONS = {
    "pending": ["in_progress", "blocked", "cancelled"],
    "in_progress": ["blocked", "completed", "failed", "cancelled"],
    "blocked": ["in_progress", "cancelled"],
    "completed": [],
    "failed": [],
    "cancelled": [],
}


def invalid_transitions(log: DataFrame, by: str, state: str, order: list[str]) -> DataFrame:
    """Log rows whose state isn't allowed after the one before."""
    allowed = F.create_map(*[x for k, v in TRANSITIONS.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]).cast("array<string>"))])
    seen = log.withColumn("prev", F.lag(state).over(Window.partitionBy(by).orderBy(*order)))
    ok = F.col("prev").isNull() | (F.col("prev") == F.col(state)) | F.array_contains(F.element_at(allowed, F.col("prev")), F.col(state))
    return seen.where(~F.coalesce(ok, F.lit(False)))


def chain_breaks(log: DataFrame, order: list[str], by: str) -> DataFrame:
    """Entries whose hash isn't theirs, or whose prev_hash isn't the hash of the entry before in their log."""
    prev = F.coalesce(F.lag("hash").over(Window.partitionBy(by).orderBy(*order)), F.lit("0" * 64))
    own = F.sha2(F.concat_ws("|", "prev_hash", "payload").cast("binary"), 256)
    return log.withColumns({"_prev": prev, "_own": own}).where("hash <> _own or prev_hash <> _prev").drop("_prev", "_own")


def beta_posterior(feedback: DataFrame, by: str, good: Column) -> DataFrame:
    """(by, mean) of a Beta(1, 1) prior after each group's feedback, good or not."""
    alpha, beta = 1 + F.count_if(good), 1 + F.count_if(~good)
    return feedback.groupBy(by).agg((alpha / (alpha + beta)).alias("mean"))


def expired(items: DataFrame, now: str, days: int) -> DataFrame:
    """Items that aren't pinned and were made more than so many days ago."""
    return items.where((F.col("created_at") + F.expr(DAY.format(int(days))) < F.to_timestamp(F.lit(now))) & ~F.col("pinned"))


def archivable(items: DataFrame, now: str, below: float = 0.05, days: int = 10) -> DataFrame:
    """Items of low importance that aren't pinned and are old enough."""
    return items.where((F.col("importance") < below) & (F.col("created_at") < F.to_timestamp(F.lit(now)) - F.expr(DAY.format(int(days)))) & ~F.col("pinned"))


def orphans(vectors: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """Vectors whose item is gone."""
    return vectors.join(items.select(key), key, "left_anti")


def refresh_reminders(items: DataFrame, told: DataFrame, by: str, id_col: str, now: str, days: int, time: str = "ts") -> DataFrame:
    """(by, due, sample) of owners with items older than so many days that haven't been told since now."""
    t = F.to_timestamp(F.lit(now))
    since = told.where(F.col(time) >= t).select(by)
    due = items.where(F.col(time) < t - F.expr(DAY.format(int(days)))).join(since, by, "left_anti")
    return due.groupBy(by).agg(F.count("*").alias("due"), F.min(id_col).alias("sample"))


def linked(links: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """Edges (from_id, to_id, relationship_type) with links added, each once."""
    keys = ["from_id", "to_id", "relationship_type"]
    return (links if edges is None else edges.select(*keys).union(links.select(*keys))).select(*keys).distinct()


def promotable_texts(items: DataFrame, id_col: str, content: str, least: int, most: int, excluded: str, key_chars: int = 60) -> DataFrame:
    """(id): of items of a fitting length without an excluded mark, the first of each key, the letters of a text's head."""
    fits = items.where(F.char_length(content).between(least, most) & ~F.col(content).contains(excluded))
    key = F.lower(F.regexp_replace(F.substring(content, 1, key_chars), "[^A-Za-z]+", " "))
    return fits.groupBy(key.alias("_key")).agg(F.min(id_col).alias(id_col)).select(id_col)


def erasure_flush(derived: DataFrame, erased: DataFrame, key: str) -> DataFrame:
    """(key): derived rows that hold something of what was erased, once each."""
    return derived.select(key).distinct().join(erased.select(key), key, "left_semi")


def apply_plan(items: DataFrame, plan: DataFrame, id_col: str, step: float = 0.1) -> DataFrame:
    """items with `action` and importance after a plan (id, action): pins are marked, deletions are left out, boosts add
    a step, up to 1; items without a plan have action none."""
    done = items.join(plan, id_col, "left").where("action is null or action <> 'delete'")
    raised = F.when(F.col("action") == "boost", F.least(F.lit(1.0), F.col("importance") + step)).otherwise(F.col("importance"))
    return done.withColumns({"importance": raised, "action": F.when(F.col("action") == "pin", "pin").otherwise("none")})


def _items(spark, d) -> DataFrame:
    e = read(spark, d, "events")
    return e.select("event_id", "user_id", "event_type", F.col("ts").alias("created_at"), (F.col("value") / 100).alias("importance"), (F.col("event_id") % 50 == 0).alias("pinned"))


_ITEMS = "(SELECT event_id, user_id, event_type, ts AS created_at, value / 100 AS importance, event_id % 50 = 0 AS pinned FROM events)"


@query("importance_decay", f"SELECT event_id, round(CASE WHEN created_at < TIMESTAMP '{NOW}' - INTERVAL 7 DAY AND NOT pinned THEN greatest(0, importance * 0.995) ELSE importance END, 9) AS importance FROM {_ITEMS}")
def _importance(spark, d):
    return importance_decay(_items(spark, d), NOW).select("event_id", F.round("importance", 9).alias("importance"))


@query("confidence_aggregate", f"WITH {INPUTS_SQL} SELECT user_id, round(least(1, greatest(0, CASE user_id % 4 WHEN 0 THEN 0.95 WHEN 1 THEN 0.4 WHEN 2 THEN 0.7 * 0.8 ELSE 0.5 END + CASE WHEN trust_sum <= 0 THEN 0 ELSE least(0.2, 0.05 * trust_sum) END - CASE WHEN contradictions <= 0 THEN 0 ELSE least(0.3, 0.1 * contradictions) END)), 9) AS confidence FROM i")
def _confidence(spark, d):
    kind = F.col("user_id") % 4
    prior = source_prior(F.when(kind == 0, "user").when(kind == 1, "web").otherwise(""), F.when(kind == 2, "helper").otherwise(""), F.lit(0.8))
    return corroboration_inputs(ledger(spark, d), "user_id").select("user_id", F.round(confidence(prior, F.col("trust_sum"), F.col("contradictions")), 9).alias("confidence"))


@query("confidence_decay", f"SELECT event_id, round(c + (0.5 - c) * 0.02, 6) AS c FROM (SELECT event_id, user_id, least(1, greatest(0, value / 100)) AS c FROM events) WHERE user_id NOT IN (SELECT user_id FROM {LEDGER_SQL} WHERE ts >= TIMESTAMP '{NOW}' + INTERVAL 5 DAY)")
def _cdecay(spark, d):
    active = ledger(spark, d).where(F.col("ts") >= F.to_timestamp(F.lit(NOW)) + F.expr("INTERVAL 5 DAYS")).select("user_id").distinct()
    return read(spark, d, "events").join(active, "user_id", "left_anti").select("event_id", F.round(decay_toward_neutral(F.col("value") / 100), 6).alias("c"))


@query("access_reinforcement", "SELECT user_id, round(least(0.05, 0.01 * log2(1 + count(*))), 6) AS boost FROM events GROUP BY 1")
def _access(spark, d):
    return read(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n")).select("user_id", F.round(access_reinforcement(F.col("n")), 6).alias("boost"))


@query("beta_posterior", "SELECT user_id, round((1 + sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END)) / (2.0 + count(*)), 6) AS mean FROM events GROUP BY 1")
def _beta(spark, d):
    return beta_posterior(read(spark, d, "events"), "user_id", F.col("event_type") != "error").withColumn("mean", F.round("mean", 6))


@query("expire", f"SELECT event_id FROM {_ITEMS} WHERE created_at + INTERVAL 20 DAY < TIMESTAMP '{NOW}' AND NOT pinned")
def _expire(spark, d):
    return expired(_items(spark, d), NOW, 20).select("event_id")


@query("archive_low_importance", f"SELECT event_id, importance FROM {_ITEMS} WHERE importance < 0.05 AND created_at < TIMESTAMP '{NOW}' - INTERVAL 10 DAY AND NOT pinned")
def _archive(spark, d):
    return archivable(_items(spark, d), NOW).select("event_id", "importance")


@query("orphan_prune", "SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels)")
def _orphans(spark, d):
    return orphans(read(spark, d, "embeddings"), read(spark, d, "labels").select(F.col("doc_id").alias("vec_id")), "vec_id").select("vec_id")


@query("retention", f"WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, event_id DESC) AS r FROM {_ITEMS} WHERE user_id % 2 = 1 OR pinned OR created_at >= TIMESTAMP '{NOW}' - INTERVAL 20 DAY) SELECT event_id, user_id FROM r WHERE user_id % 2 = 1 OR r <= 30 OR pinned")
def _retention(spark, d):
    owners = read(spark, d, "events").select("user_id").distinct().where("user_id % 2 = 0")
    return retention(_items(spark, d), owners.withColumn("ttl_days", F.lit(20)).withColumn("keep", F.lit(30)), "user_id", "created_at", "event_id", NOW).select("event_id", "user_id")


@query("refresh_due", f"SELECT user_id, count(*) AS due, min(event_id) AS sample FROM events WHERE ts < TIMESTAMP '{NOW}' - INTERVAL 14 DAY AND event_type = 'view' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'signup' AND ts >= TIMESTAMP '{NOW}') GROUP BY 1")
def _refresh(spark, d):
    e = read(spark, d, "events")
    return refresh_reminders(e.where("event_type = 'view'"), e.where("event_type = 'signup'"), "user_id", "event_id", NOW, 14)


_SHORT_SQL = "lower(role) = 'user' AND text <> '' AND NOT contains(text, '?') AND NOT list_has_any(string_split_regex(trim(lower(text)), '\\s+'), ['no', 'stop', 'kill', 'abort', 'wait', 'hold']) AND len(string_split_regex(trim(lower(text)), '\\s+')) <= 4"
_SAID = ["run PID 123 now please and then go on", "it lies in C:\\Users\\me\\AppData\\Local\\Temp for now", "so far 40% is through, I would say", "we go with plan b because it scales", "from now on we go by train"]
_SAID_SQL = "['run PID 123 now please and then go on', 'it lies in C:\\Users\\me\\AppData\\Local\\Temp for now', 'so far 40% is through, I would say', 'we go with plan b because it scales', 'from now on we go by train']"
_CHAT = f"""(WITH c AS (SELECT conv_id, turn, role, TIMESTAMP '{NOW}' - to_days(CAST(conv_id % 60 AS INT)) AS created_at, text FROM conversations)
 SELECT * FROM c UNION ALL SELECT conv_id, turn + 500, role, created_at, text[1:12] FROM c WHERE turn % 3 = 0 UNION ALL SELECT conv_id, turn + 500, role, created_at, {_SAID_SQL}[CAST((conv_id + turn) % 5 + 1 AS INT)] FROM c WHERE turn % 3 <> 0)"""
# What the patterns find in these texts, written as SQL by itself.
_EPH_SQL = r"(regexp_matches(text[1:2000], '\bPID \d+|AppData[\\/]+Local[\\/]+Temp') OR (length(trim(text[1:2000])) <= 30 AND regexp_matches(trim(text[1:2000]), '^\{|^[-+]*\d+$')))"
_SIGNAL_SQL = r"regexp_matches(text[1:20000], '(?i)```|\b(?:decide|decided|because|therefore|remember|never|always|important|note that|gotcha|todo)\b')"
_NORM = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text[1:400]), '\bpid \d+|appdata[\\/]+local[\\/]+temp', ' ', 'g'), '[0-9a-f]{6,}', ' ', 'g'), '\d+', ' ', 'g'), '[^a-z ]+', ' ', 'g'), '\s+', ' ', 'g'))[1:120]"
_CLASS_SQL = f"CASE WHEN imp > 0.4 OR contains(text[1:200], '?') OR {_SIGNAL_SQL} THEN NULL WHEN {_EPH_SQL} THEN 'ephemeral' WHEN {_SHORT_SQL} THEN 'short_cmd' WHEN size >= 5 AND k <> '' AND role = 'user' AND regexp_matches(text, '(?i)\\b(?:status|progress|update|eta|done|finished|ready)\\b') THEN 'repeat_status_req' WHEN size >= 5 AND k <> '' AND role <> 'user' AND regexp_matches(text, '(?i)\\d\\s*%|\\b(?:status|progress|remaining|so far|completed?|pending|workers?|eta)\\b') THEN 'repeat_status_resp' WHEN imp <= 0.3 THEN 'generic_low' END"


def _chat(spark, d) -> DataFrame:
    """All turns, whole; and beside each one more of a few words, as the patterns look for."""
    created = F.to_timestamp(F.lit(NOW)) - F.make_dt_interval((F.col("conv_id") % 60).cast("int"))
    c = read(spark, d, "conversations").select("conv_id", "turn", "role", "text", created.alias("created_at"))
    said = F.element_at(F.array(*map(F.lit, _SAID)), ((F.col("conv_id") + F.col("turn")) % 5 + 1).cast("int"))
    brief = c.withColumns({"text": F.when(F.col("turn") % 3 == 0, F.substring("text", 1, 12)).otherwise(said), "turn": F.col("turn") + 500})
    return c.unionByName(brief).withColumn("imp", (F.col("turn") % 5) / 10)


@query("chatlog_decay", f"SELECT conv_id, turn, CASE WHEN {_SHORT_SQL} THEN CASE WHEN conv_id % 10 < 1 THEN 0.5 WHEN conv_id % 10 < 3 THEN 0.1 ELSE 0.02 END WHEN {_EPH_SQL} THEN CASE WHEN conv_id % 10 < 1 THEN 1.0 WHEN conv_id % 10 < 3 THEN 0.5 WHEN conv_id % 10 < 7 THEN 0.2 ELSE 0.05 END END AS factor FROM {_CHAT}")
def _decay(spark, d):
    return _chat(spark, d).select("conv_id", "turn", decay_factor(F.col("role"), F.col("text"), F.col("conv_id") % 10).alias("factor"))


@query("chatlog_classify", f"WITH c AS (SELECT *, {_NORM} AS k, (turn % 5) / 10.0 AS imp FROM {_CHAT}), n AS (SELECT *, count(*) OVER (PARTITION BY k) AS size FROM c) SELECT conv_id, turn, {_CLASS_SQL} AS class FROM n")
def _classify(spark, d):
    c = _chat(spark, d).withColumn("k", norm_key(F.col("text")))
    sizes = c.where("k <> ''").groupBy("k").agg(F.count("*").alias("size"))
    return c.join(sizes, "k", "left").select("conv_id", "turn", chat_class(F.col("role"), F.col("text"), F.col("imp"), F.coalesce("size", F.lit(0))).alias("class"))


@query("chatlog_prune", f"WITH c AS (SELECT *, {_NORM} AS k, (turn % 5) / 10.0 AS imp FROM {_CHAT} WHERE created_at < TIMESTAMP '{NOW}' - INTERVAL 14 DAY), n AS (SELECT *, count(*) OVER (PARTITION BY k) AS size FROM c), x AS (SELECT *, {_CLASS_SQL} AS class FROM n), g AS (SELECT *, class NOT IN ('short_cmd', 'repeat_status_req', 'repeat_status_resp') AND (regexp_matches(text, '(?i)\\bfrom now on\\b') OR (class = 'generic_low' AND length(text) >= 300)) AS guarded FROM x WHERE class IS NOT NULL), a AS (SELECT *, CASE WHEN created_at >= TIMESTAMP '{NOW}' - INTERVAL 45 DAY OR guarded THEN CASE WHEN turn % 2 = 1 THEN 'kept' ELSE 'decay' END ELSE 'prune' END AS action FROM g) SELECT conv_id * 1000 + turn AS id, class, action, CASE WHEN action = 'decay' THEN round(least(imp, 0.3) * 0.2, 4) ELSE imp END AS importance FROM a")
def _prune(spark, d):
    turns = _chat(spark, d).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "role", F.col("text").alias("content"), F.col("imp").alias("importance"), "created_at", (F.col("turn") % 2 == 1).alias("decayed"))
    return chat_prune(turns, NOW)


@query("contradiction_detect", "WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e, text[1:3] AS title, text FROM embeddings JOIN documents ON doc_id = vec_id), p AS (SELECT a.vec_id AS a, b.vec_id AS b, a.title = b.title AS titled, a.text = b.text AS same, list_cosine_similarity(a.e, b.e) AS s FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id) SELECT a, b, CASE WHEN s > 0.25 AND titled AND NOT same THEN 'supersede' WHEN s >= 0.4 THEN 'corroborate' ELSE 'related' END AS kind FROM p WHERE s > 0.2")
def _contradiction(spark, d):
    texts = read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.substring("text", 1, 3).alias("title"), F.col("text").alias("content"))
    items = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.col("label").alias("type")).join(texts, "id")
    return contradictions(items, related=0.2, conflict=0.25, corroborate=0.4)


@query("supersede", "SELECT event_id, user_id, lead(event_id) OVER w AS superseded_by, lead(ts) OVER w AS valid_to, lead(ts) OVER w IS NOT NULL AS is_deleted FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)")
def _supersede(spark, d):
    return supersede(read(spark, d, "events"), ["user_id", "event_type"], "ts", "event_id").select("event_id", "user_id", "superseded_by", "valid_to", "is_deleted")


_CHANGES = "(SELECT user_id AS id, event_id, ts, value, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'write' END AS op FROM events)"


@query("write_update_delete", f"SELECT id, event_id, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts DESC, event_id DESC) AS r FROM {_CHANGES}) WHERE r = 1 AND op <> 'delete'")
def _writes(spark, d):
    changes = read(spark, d, "events").select(F.col("user_id").alias("id"), "event_id", "ts", "value", F.when(F.col("event_type") == "error", "delete").otherwise("write").alias("op"))
    return latest(changes, ["id"], ["ts", "event_id"])


@query("link_bulk", "SELECT DISTINCT l_orderkey AS from_id, l_partkey AS to_id, l_returnflag AS relationship_type FROM lineitem")
def _link(spark, d):
    return linked(read(spark, d, "lineitem").select(F.col("l_orderkey").alias("from_id"), F.col("l_partkey").alias("to_id"), F.col("l_returnflag").alias("relationship_type")))


@query("dedup_pairs", """WITH RECURSIVE p AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= 0.3),
n AS (SELECT id, row_number() OVER (ORDER BY id) AS k FROM (SELECT a AS id FROM p UNION SELECT b FROM p)),
s(k, kept, claimed) AS (SELECT 0::BIGINT, []::BIGINT[], []::STRUCT(id BIGINT, parent BIGINT)[] UNION ALL
 SELECT s.k + 1, CASE WHEN c.parent IS NULL THEN list_append(kept, n.id) ELSE kept END, CASE WHEN c.parent IS NULL THEN claimed ELSE list_append(claimed, {'id': n.id, 'parent': c.parent}) END
 FROM s JOIN n ON n.k = s.k + 1, LATERAL (SELECT min(p.a) AS parent FROM p WHERE p.b = n.id AND list_contains(s.kept, p.a)) c)
SELECT x.id, x.parent FROM (SELECT unnest(claimed) AS x FROM (SELECT claimed FROM s ORDER BY k DESC LIMIT 1))""")
def _dedup(spark, d):
    return greedy_dedup(similar_pairs(read(spark, d, "embeddings"), 0.3, "vec_id", "label").select("a", "b"))


@query("files_dedup", "WITH e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings), v AS (SELECT id, e, label % 2 AS model, label AS file FROM e UNION ALL SELECT -1 - id, list_prepend(e[1] + 0.1, e[2:]), label % 2, CASE WHEN id % 3 = 0 THEN label ELSE label + 100 END FROM e) SELECT a.id AS a, b.id AS b, round(list_cosine_similarity(a.e, b.e), 6) AS score FROM v a JOIN v b ON a.model = b.model AND a.id < b.id WHERE a.file <> b.file AND NOT (a.id = -1 - b.id AND (b.id % 5 = 0 OR b.id % 7 = 0)) AND list_cosine_similarity(a.e, b.e) >= 0.92")
def _fdedup(spark, d):
    """All vectors, and beside each one a slightly turned one of another file (or, each third, of the same)."""
    e = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"), "label")
    turned = F.transform("embedding", lambda x, i: F.when(i == 0, x + 0.1).otherwise(x))
    none = F.lit(None).cast("long")
    old = e.select("id", "embedding", (F.col("label") % 2).alias("model"), F.col("label").alias("file"), none.alias("evolved_from"))
    new = e.select((-1 - F.col("id")).alias("id"), turned.alias("embedding"), (F.col("label") % 2).alias("model"), F.when(F.col("id") % 3 == 0, F.col("label")).otherwise(F.col("label") + 100).alias("file"), F.when(F.col("id") % 5 == 0, F.col("id")).otherwise(none).alias("evolved_from"))
    pending = e.where("id % 7 = 0").select(F.col("id").alias("a"), (-1 - F.col("id")).alias("b"))
    return document_pairs(old.unionByName(new), pending).select("a", "b", F.round("score", 6).alias("score"))


@query("cross_pairs", "SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE a.label <> b.label AND list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= 0.4")
def _cross(spark, d):
    p = cross_pairs(read(spark, d, "embeddings"), 0.4, "vec_id", "label")
    return p.select("a", "b", F.round("score", 6).alias("score"))


@query("promotability", f"SELECT user_id, round(ln(1 + count(*)) * least(1, greatest(0, avg(value) / 100)) * exp(-date_diff('second', max(ts), TIMESTAMP '2024-02-10 00:00:00') / 86400.0 / 30), 6) AS score FROM events WHERE user_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY 1 HAVING score >= 0.3 ORDER BY score DESC, user_id LIMIT 40")
def _promotable(spark, d):
    done = read(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("user_id"))
    age = (F.unix_timestamp(F.lit("2024-02-10 00:00:00").cast("timestamp")) - F.unix_timestamp(F.max("ts"))) / 86400
    score = F.log1p(F.count("*")) * clamp01(F.avg("value") / 100) * F.exp(-age / 30)
    return read(spark, d, "events").join(done, "user_id", "left_anti").groupBy("user_id").agg(F.round(score, 6).alias("score")).where("score >= 0.3").orderBy(F.desc("score"), "user_id").limit(40)


@query("promotion_select", "WITH s AS (SELECT doc_id, lower(regexp_replace(text[1:60], '[^A-Za-z]+', ' ', 'g')) AS k FROM documents WHERE length(text) BETWEEN 200 AND 20000 AND NOT regexp_matches(text, '!!')) SELECT min(doc_id) AS doc_id FROM s GROUP BY k")
def _select(spark, d):
    return promotable_texts(read(spark, d, "documents"), "doc_id", "text", 200, 20_000, "!!")


@query("gdpr_forget", "SELECT event_id, user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'signup' AND user_id % 5 = 0)")
def _forget(spark, d):
    e = read(spark, d, "events")
    return forget(e, e.where("event_type = 'signup' and user_id % 5 = 0").select(F.col("user_id").alias("id")).distinct(), "user_id").select("event_id", "user_id")


@query("erasure_flush", "SELECT DISTINCT conv_id FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations WHERE length(text) < 100)")
def _flush(spark, d):
    c = read(spark, d, "conversations")
    return erasure_flush(c, c.where("length(text) < 100"), "conv_id")


@query("curator_plan", "SELECT event_id, CASE WHEN event_id % 40 = 0 THEN 'pin' WHEN event_id % 40 = 1 THEN 'delete' ELSE 'none' END AS action, round(CASE WHEN event_id % 40 = 2 THEN least(1, value / 100 + 0.1) ELSE value / 100 END, 6) AS importance FROM events WHERE event_id % 40 <> 1")
def _plan(spark, d):
    kind = F.col("event_id") % 40
    e = read(spark, d, "events").select("event_id", (F.col("value") / 100).alias("importance"))
    plan = e.where(kind < 3).select("event_id", F.when(kind == 0, "pin").when(kind == 1, "delete").otherwise("boost").alias("action"))
    return apply_plan(e, plan, "event_id").select("event_id", "action", F.round("importance", 6).alias("importance"))


@query("task_transition", "WITH s AS (SELECT event_id, user_id, ts, CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'in_progress' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'blocked' END AS state FROM events), l AS (SELECT *, lag(state) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM s) SELECT event_id, prev, state FROM l WHERE prev IS NOT NULL AND prev <> state AND NOT ((prev = 'pending' AND state IN ('in_progress', 'blocked', 'cancelled')) OR (prev = 'in_progress' AND state IN ('blocked', 'completed', 'failed', 'cancelled')) OR (prev = 'blocked' AND state IN ('in_progress', 'cancelled')))")
def _transition(spark, d):
    t = F.col("event_type")
    state = F.when(t == "view", "pending").when(t == "click", "in_progress").when(t == "purchase", "completed").when(t == "error", "failed").otherwise("blocked")
    return invalid_transitions(read(spark, d, "events").withColumn("state", state), "user_id", "state", ["ts", "event_id"]).select("event_id", "prev", "state")


@query("audit_chain_verify", "SELECT event_id FROM (SELECT event_id, event_id % 97 = 0 AS bad FROM events) WHERE bad")
def _chain(spark, d):
    # A log per user whose entries are linked by hash, with a payload changed afterwards in one of 97.
    e = read(spark, d, "events").select("event_id", "user_id", "ts", F.concat_ws(":", "event_type", F.col("value").cast("string")).alias("payload"))
    chain = F.aggregate(F.col("log"), F.struct(F.lit("0" * 64).alias("h"), F.array().cast("array<struct<event_id:bigint,prev_hash:string,hash:string,payload:string>>").alias("out")), _append)
    logs = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "payload"))).alias("log"))
    entries = logs.select("user_id", F.posexplode(chain["out"]).alias("pos", "x")).select("user_id", "pos", "x.*")
    tampered = entries.withColumn("payload", F.when(F.col("event_id") % 97 == 0, F.concat("payload", F.lit("!"))).otherwise(F.col("payload")))
    return chain_breaks(tampered, ["pos"], "user_id").select("event_id")


def _append(acc, x):
    h = F.sha2(F.concat_ws("|", acc["h"], x["payload"]).cast("binary"), 256)
    row = F.struct(x["event_id"].alias("event_id"), acc["h"].alias("prev_hash"), h.alias("hash"), x["payload"].alias("payload"))
    return F.struct(h.alias("h"), F.array_append(acc["out"], row).alias("out"))
