"""Typed mentions and relations by rules, as table functions for SQL, and the walk from a query's names over a graph.

Vocabulary terms are found whatever their case, as whole words; capitalised phrases are persons unless a cue makes
them an organisation or a place. Relations join a person with a place, an organisation or a topic over a cue verb that
stands between them, in one line, not too far from either. Each cue is looked at once, with the names near it, so the
work follows the number of cues and names and not of pairs of names.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..registry import query, read
from .graph import both_ways

# The vocabulary, words that are no names, cues of kinds, cue verbs and how far names may be from them.
VOCABULARY = {"Rust": "topic", "Python": "topic", "C++": "topic", "SQLite": "topic", "Postgres": "topic", "ChromaDB": "topic", "workflow": "topic", "FIPS": "topic", "cryptography": "topic"}
NO_NAMES = {"i", "i'm", "me", "my", "the", "a", "an", "and", "or", "but"}
ORGANIZATION_CUES = ("corp", "inc", "ltd", "google", "microsoft", "amazon", "github", "apple")
PLACE_CUES = ("city", "roanoke", "enclave", "valley", "mount", "lake", "ocean", "river")
PHRASE = r"\b([A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+)*)\b"
TERM_SURE, PHRASE_SURE = 0.80, 0.70
#: Predicate, kind of its target, cue verbs, how far before and behind them, whether either side may come first, confidence.
RELATIONS = [
    ("located_in", "place", r"lives\s+in|moved\s+to|located\s+in|resides\s+in", 100, 100, True, 0.75),
    ("works_at", "organization", r"works\s+at|employed\s+by|joined|hired\s+by", 100, 100, True, 0.80),
    ("prefers", "topic", r"learning|knows|uses|programming|skills\s+in|writes", 150, 100, False, 0.75),
]
#: Words that stand for whoever the text is about, and how far they may be before a topic's verb.
PRONOUN, PRONOUN_FAR = r"\b(?:he|she|they)\b", 50

Mention = tuple[str, str, int, float]


@functools.lru_cache(maxsize=16)
def _terms(vocabulary: tuple[tuple[str, str], ...]) -> tuple[re.Pattern, dict[str, str]]:
    """One pattern of all terms, longest first; a term's ends are word ends where they are word characters."""
    edge = lambda c: r"\b" if re.match(r"\w", c) else ""
    ordered = sorted(vocabulary, key=lambda t: -len(t[0]))
    body = "|".join(edge(t[0]) + re.escape(t) + edge(t[-1]) for t, _ in ordered)
    return re.compile(f"(?:{body})", re.IGNORECASE), {t.lower(): kind for t, kind in vocabulary}


def mentions(text: str | None, vocabulary: dict[str, str] | None = None, kinds: frozenset[str] | None = None) -> list[Mention]:
    """(name, kind, offset, confidence) of each different name, where it is first met: vocabulary first, then phrases."""
    pattern, kind_of = _terms(tuple((VOCABULARY if vocabulary is None else vocabulary).items()))
    found: dict[str, Mention] = {}
    for m in pattern.finditer(text or "") if kind_of else ():
        found.setdefault(m[0], (m[0], kind_of[m[0].lower()], m.start(), TERM_SURE))
    for m in re.finditer(PHRASE, text or ""):
        name, low = m[1], m[1].lower()
        if low not in NO_NAMES:
            kind = "organization" if any(c in low for c in ORGANIZATION_CUES) else "place" if any(c in low for c in PLACE_CUES) else "person"
            found.setdefault(name, (name, kind, m.start(), PHRASE_SURE))
    return [x for x in found.values() if kinds is None or x[1] in kinds]


def _lower(text: str) -> str:
    """Lower case that keeps every character's place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _near(low: str, names: list[str], start: int, end: int, before: bool, far: int) -> list[str]:
    """The names that stand before start, or behind end, at most far characters away and in the same line."""
    out = []
    for name in names:
        n = _lower(name)
        if before:
            at = low.rfind(n, max(0, start - far - len(n)), start)
            gap = low[at + len(n) : start]
        else:
            at = low.find(n, end, end + far + len(n))
            gap = low[end:at]
        if at >= 0 and "\n" not in gap:
            out.append(name)
    return out


def _pronoun_before(low: str, start: int) -> bool:
    """A pronoun stands before start, in the same line and not too far away."""
    words = re.compile(PRONOUN).finditer(low, max(0, start - PRONOUN_FAR - 6), start)
    return any(start - p.end() <= PRONOUN_FAR and "\n" not in low[p.end() : start] for p in words)


def relations(text: str | None, found: list[Mention]) -> list[tuple[str, str, str, float]]:
    """(source, target, predicate, confidence) between the mentions of a text, sorted."""
    low, out = _lower(text or ""), set()
    named = lambda kind: [m[0] for m in found if m[1] == kind]
    persons = named("person")
    for predicate, kind, verbs, left, right, both, sure in RELATIONS:
        targets = named(kind)
        for cue in re.finditer(verbs, low) if persons and targets else ():
            behind = functools.partial(_near, low, start=cue.start(), end=cue.end(), before=False, far=right)
            ahead = functools.partial(_near, low, start=cue.start(), end=cue.end(), before=True, far=left)
            who = ahead(persons)
            if not both and _pronoun_before(low, cue.start()):
                who = persons
            out |= {(p, t, predicate, sure) for p in who for t in behind(targets)} if who else set()
            if both and (first := ahead(targets)):
                out |= {(p, t, predicate, sure) for p in behind(persons) for t in first}
    return sorted(out)


@udtf(returnType="name string, kind string, at int, sure double")
class EntityMentions:
    """SQL: entity_mentions(text)."""

    def eval(self, text: str) -> Iterator[Mention]:
        yield from mentions(text)


@udtf(returnType="source string, target string, predicate string, sure double")
class EntityRelations:
    """SQL: entity_relations(text)."""

    def eval(self, text: str) -> Iterator[tuple[str, str, str, float]]:
        yield from relations(text, mentions(text))


@udtf(returnType="part int, path string, label string, start int, stop int, sure double, chunk string")
class MarkdownSections:
    """SQL: markdown_sections(text)."""

    def eval(self, text: str) -> Iterator[tuple]:
        from .documents import markdown_sections

        for k, s in enumerate(markdown_sections(text or "")):
            yield k, s.path, s.label, s.start, s.end, s.sure, s.text


def register(spark: SparkSession) -> None:
    """Makes the table functions known to SQL: entity_mentions, entity_relations and markdown_sections."""
    for name, function in (("entity_mentions", EntityMentions), ("entity_relations", EntityRelations), ("markdown_sections", MarkdownSections)):
        spark.udtf.register(name, function)


# The walk

#: Hops and nodes of a walk, and entities that a name which none has exactly may stand for.
HOPS, NODES, LIKE_MOST = 3, 100, 5


def entity_walk(entities: DataFrame, edges: DataFrame, names: list[str], depth: int = 1, nodes: int = NODES, types: list[str] | None = None, predicates: list[str] | None = None, stoplist: list[str] = ()) -> DataFrame:
    """(entity_id, hop): the entities that names stand for (hop 0), and what is within depth hops of them.

    entities (entity_id, name, entity_type), edges (from_entity, to_entity, predicate), walked both ways. A name
    stands for the entities that have it; if there are none, for at most LIKE_MOST whose names hold it, whatever the
    case (smaller ids first). types restrict the start, predicates the edges; names on the stoplist neither start nor
    carry a walk. At most nodes entities are reached (the start always counts whole), nearer and smaller ids first.
    """
    stopped = [s.strip().lower() for s in stoplist if s.strip()]
    low = F.lower("name")
    allowed = entities.where(low.isin(stopped) == F.lit(False)) if stopped else entities
    start = allowed.where(F.col("entity_type").isin(types)) if types else allowed
    exact = start.where(F.col("name").isin(names)).select("entity_id", "name")
    seeds = exact.select("entity_id")
    have = {r[0] for r in exact.select("name").distinct().collect()}  # no more than there are names
    for name in [n for n in dict.fromkeys(names) if n not in have]:
        like = low.contains(name.lower()) if not re.search("[%_]", name) else low.like(f"%{name.lower()}%")
        seeds = seeds.union(start.where(like).select("entity_id").orderBy("entity_id").limit(LIKE_MOST))
    seen = seeds.distinct().withColumn("hop", F.lit(0))
    walked = edges.where(F.col("predicate").isin(predicates)) if predicates else edges
    pairs = both_ways(walked, "from_entity", "to_entity")
    if stopped:
        gone = entities.where(low.isin(stopped)).select(F.col("entity_id").alias("b"))
        pairs = pairs.join(gone, "b", "left_anti")
    for hop in range(1, min(depth, HOPS) + 1):
        level = pairs.join(F.broadcast(seen.where(F.col("hop") == hop - 1).select(F.col("entity_id").alias("a"))), "a").select(F.col("b").alias("entity_id")).distinct()
        new = level.join(F.broadcast(seen.select("entity_id")), "entity_id", "left_anti").withColumn("hop", F.lit(hop))
        left = seen.agg(F.greatest(F.lit(0), F.lit(nodes) - F.count("*")).alias("_left"))
        first = new.orderBy("entity_id").limit(nodes)  # no more can be taken
        placed = first.withColumn("_n", F.rank().over(_by_id())).crossJoin(F.broadcast(left)).where(F.col("_n") <= F.col("_left")).select("entity_id", "hop")
        seen = seen.union(placed)
    return seen


def _by_id():
    from pyspark.sql import Window

    return Window.orderBy("entity_id")  # over the rows that a limit has left


def walked_items(walk: DataFrame, mentions_of: DataFrame) -> DataFrame:
    """(memory_id): the items that mention (memory_id, entity_id) what a walk has reached."""
    return mentions_of.join(walk.select("entity_id"), "entity_id", "left_semi").select("memory_id").distinct()


def _told(spark: SparkSession, d: str) -> DataFrame:
    """Whole documents, and behind each a line with names, cues and topics that follow from its id."""
    who, where, at, what = (F.element_at(F.array(*map(F.lit, x)), (F.col("doc_id") % n + 1).cast("int")) for x, n in ((["Ann Lee", "Bo", "Cy Dent"], 3), (["Roanoke", "Lake Tahoe"], 2), (["Acme Corp", "GitHub"], 2), (["Rust", "python", "SQLite", "C++"], 4)))
    said = F.concat(F.lit("\n"), who, F.lit(" lives in "), where, F.lit(", joined "), at, F.lit(" and is learning "), what, F.lit("."))
    return read(spark, d, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), said).alias("text"))


@query("entity_extract_typed")
def _typed(spark, d):
    register(spark)
    return spark.sql("SELECT doc_id, m.name, m.kind, m.at, m.sure FROM {told}, LATERAL entity_mentions(text) m", told=_told(spark, d))


@query("entity_extract_relations")
def _related(spark, d):
    register(spark)
    return spark.sql("SELECT doc_id, r.source, r.target, r.predicate, r.sure FROM {told}, LATERAL entity_relations(text) r", told=_told(spark, d))


@query("entity_walk", """WITH e AS (SELECT p_partkey AS id, p_name AS name FROM part WHERE lower(p_name) NOT IN ('blue ring', 'hot plate', 'red plate')), x AS (SELECT l_partkey AS a, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS b, l_returnflag AS p FROM lineitem), r AS (SELECT a, b FROM x WHERE b IS NOT NULL AND p IN ('R', 'N')), g AS (SELECT * FROM (SELECT a, b FROM r UNION SELECT b, a FROM r) WHERE b IN (SELECT id FROM e)),
s AS (SELECT id, 0 AS hop FROM (SELECT id FROM e WHERE lower(name) LIKE '%blue%' ORDER BY id LIMIT 5)), h1 AS (SELECT id, 1 AS hop FROM (SELECT DISTINCT b AS id FROM g WHERE a IN (SELECT id FROM s) AND b NOT IN (SELECT id FROM s)) ORDER BY id LIMIT (SELECT 60 - count(*) FROM s)),
s1 AS (SELECT * FROM s UNION ALL SELECT * FROM h1), h2 AS (SELECT id, 2 AS hop FROM (SELECT DISTINCT b AS id FROM g WHERE a IN (SELECT id FROM h1) AND b NOT IN (SELECT id FROM s1)) ORDER BY id LIMIT (SELECT greatest(0, 60 - count(*)) FROM s1)), k AS (SELECT * FROM s1 UNION ALL SELECT * FROM h2)
SELECT DISTINCT l_orderkey AS memory_id FROM lineitem WHERE l_partkey IN (SELECT id FROM k)""")
def _walk(spark, d):
    from pyspark.sql import Window

    parts = read(spark, d, "part").select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("entity_type"))
    line = read(spark, d, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    edges = line.select(F.col("l_partkey").alias("from_entity"), F.lead("l_partkey").over(w).alias("to_entity"), F.col("l_returnflag").alias("predicate")).where("to_entity is not null")
    found = entity_walk(parts, edges, ["BLUE"], 2, 60, predicates=["R", "N"], stoplist=["Blue ring", "hot plate", "red plate"])
    return walked_items(found, line.select(F.col("l_orderkey").alias("memory_id"), F.col("l_partkey").alias("entity_id")))
