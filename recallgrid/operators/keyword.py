"""Keyword retrieval: query compilation, BM25 by stored postings or from one scan, short circuit, fallback, chat search."""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..registry import query, read
from .postings import KeywordIndex, index_of

K1, B = 1.2, 0.75


@dataclass
class Compiled:
    """A compiled query: a phrase, or terms of which any or all must match; the last may be a prefix."""

    ok: bool
    terms: list[str]
    kind: str = "all"
    prefix: bool = False

    def matches(self, text: Column) -> Column:
        """Whether a text matches; words are whole but for a prefix, those of a phrase follow each other."""
        if not self.ok:
            return F.lit(False)
        if self.kind == "phrase":
            return _rlike_words(F.lower(text), self.terms, False)
        hits = [_rlike_words(F.lower(text), [t], self.prefix) for t in self.terms]
        return functools.reduce(lambda a, b: a | b if self.kind == "any" else a & b, hits)


def compile_query(raw: str, mode: str = "hybrid") -> Compiled:
    """Quoted: a phrase. Else sanitised terms: any of them in mode fts5, else all; one alphanumeric term is a prefix."""
    if len(raw) > 1 and raw[0] == raw[-1] and raw[0] in "\"'":
        terms = [t for t in re.split(r"[^\w]+", raw[1:-1].lower()) if t]
        return Compiled(bool(terms), terms, "phrase")
    clean = re.sub(r"[^\w\s]", " ", re.sub(r"\b(?:OR|AND|NOT|NEAR)\b", " ", raw[:500])).lower()
    terms = clean.split()
    if not terms:
        return Compiled(False, [])
    return Compiled(True, terms, "any" if mode == "fts5" else "all", len(terms) == 1 and terms[0].isalnum())


def compile_fts(q: Column, mode: str = "hybrid") -> tuple[Column, Column]:
    """(match expression, whether there is anything to match) of a raw query.

    Quoted: that phrase, with quotes inside doubled. Else the sanitised words, in lower case: any of them in mode
    fts5, all of them otherwise; a single alphanumeric word is a prefix.
    """
    ends = lambda mark: F.startswith(q, F.lit(mark)) & F.endswith(q, F.lit(mark))
    exact = ends('"') | ends("'")
    inner = F.substring(q, F.lit(2), F.greatest(F.char_length(q) - 2, F.lit(0)))
    phrase = F.concat(F.lit('"'), F.replace(inner, F.lit('"'), F.lit('""')), F.lit('"'))
    clean = X.strip(X.searchable(X.sanitize(q)))
    words = F.split(clean, r"(?U)\s+")
    one = F.when(clean.rlike(r"^[\p{L}\p{N}]+$"), F.concat(clean, F.lit("*"))).otherwise(clean)
    plain = F.when(F.size(words) > 1, F.array_join(words, " OR ")).otherwise(one) if mode == "fts5" else one
    return F.when(exact, phrase).when(clean == "", "").otherwise(plain), exact | (clean != "")


# A word is a run of letters, digits and _ of any script, as in functions.text.tokens.
_WORD = r"[\p{L}\p{N}_]"


def _word_pattern(terms: list[str], prefix: bool) -> str:
    """A regular expression of words that follow each other in a lower-cased text."""
    body = rf"[^\p{{L}}\p{{N}}_]+".join(re.escape(t) for t in terms)
    return rf"(?<!{_WORD}){body}" + ("" if prefix else rf"(?!{_WORD})")


def _holds(low: Column, terms: list[str]) -> Column:
    """A cheap test that every text with the terms passes."""
    return functools.reduce(lambda a, b: a & b, [low.contains(t) for t in terms])


def _rlike_words(low: Column, terms: list[str], prefix: bool) -> Column:
    return _holds(low, terms) & low.rlike(_word_pattern(terms, prefix))


def _occurrences(low: Column, term: str, prefix: bool) -> Column:
    return F.when(low.contains(term), F.regexp_count(low, F.lit(_word_pattern([term], prefix)))).otherwise(0)


def bm25(items: DataFrame, terms: list[str], text: str = "content", k1: float = K1, b: float = B, prefix: bool = False) -> DataFrame:
    """items with `bm25`, the negated score (lower is better).

    Term counts come from each row's own text, and the collection's counts from one aggregate row that is
    broadcast: no postings are exploded or shuffled, and terms are only looked for in texts that hold their letters.
    """
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    columns = {f"_tf{i}": _occurrences(low, t, prefix) for i, t in enumerate(terms)}
    counted = items.withColumns({"_length": F.regexp_count(low, F.lit(_WORD + "+")), **columns})
    stats = counted.agg(F.count("*").alias("_n"), F.avg("_length").alias("_mean"), *[F.sum((F.col(f"_tf{i}") > 0).cast("int")).alias(f"_df{i}") for i in range(len(terms))])
    score = F.lit(0.0)
    for i in range(len(terms)):
        idf = F.log(1 + (F.col("_n") - F.col(f"_df{i}") + 0.5) / (F.col(f"_df{i}") + 0.5))
        some = idf * F.col(f"_tf{i}") * (k1 + 1) / (F.col(f"_tf{i}") + k1 * (1 - b + b * F.col("_length") / F.col("_mean")))
        score = score + F.when(F.col(f"_tf{i}") > 0, some).otherwise(0.0)
    return counted.crossJoin(F.broadcast(stats)).withColumn("bm25", -score).select(*items.columns, "bm25")


def keyword_search(items: DataFrame, raw: str, limit: int = 20, mode: str = "hybrid", id_col: str = "id", text: str = "content", index: KeywordIndex | None = None) -> DataFrame:
    """Matching rows with bm25, best first; by the index of items where there is one, else by a scan of their texts."""
    q = compile_query(raw, mode)
    if index is not None:
        hits = index.matches(q).orderBy("bm25", "id").limit(limit).withColumnRenamed("id", id_col)
        if items.columns == [id_col]:
            return hits
        return items.join(F.broadcast(hits), id_col).select(*items.columns, "bm25").orderBy("bm25", id_col)
    scored = bm25(items, q.terms, text, prefix=q.prefix).where(q.matches(F.col(text)))
    return scored.orderBy("bm25", id_col).limit(limit)


def short_circuit(items: DataFrame, raw: str, k: int, id_col: str = "id", text: str = "content", index: KeywordIndex | None = None) -> DataFrame:
    """The first k of max(4k, 20) keyword hits that hold the query verbatim, whatever its case; score 1."""
    hits = keyword_search(items, raw, max(4 * k, 20), id_col=id_col, text=text, index=index)
    exact = hits.where(F.lower(text).contains(raw.lower()))
    return exact.orderBy("bm25", id_col).limit(k).withColumn("score", F.lit(1.0))


TOKENS_SQL = r"list_filter(string_split_regex(lower({}), '[^\p{{L}}\p{{N}}_]+'), lambda t: t <> '')"


def bm25_sql(source: str, id_col: str, text: str, terms: list[str], extra: str = "", prefix: bool = False) -> str:
    """A DuckDB CTE list that ends in `scored` (id, words, bm25, and extra columns)."""
    words = TOKENS_SQL.format(text)
    same = "starts_with(w, '{}')" if prefix else "w = '{}'"
    tf = ", ".join(f"len(list_filter(words, lambda w: {same.format(t)})) AS tf{i}" for i, t in enumerate(terms))
    df = ", ".join(f"sum(CAST(tf{i} > 0 AS INT)) AS df{i}" for i in range(len(terms)))
    total = " + ".join(f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * len(words) / mean))" for i in range(len(terms)))
    return f"tok AS (SELECT {id_col} AS id, {text} AS content, {words} AS words{extra} FROM {source}), tfs AS (SELECT *, {tf} FROM tok), st AS (SELECT count(*) AS n, avg(len(words)) AS mean, {df} FROM tfs), scored AS (SELECT tfs.*, -({total}) AS bm25 FROM tfs, st)"


def _items(spark, d) -> DataFrame:
    return read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), "lang", "source")


def documents_index(spark, d) -> KeywordIndex:
    return index_of(spark, d, "documents", F.col("doc_id"), "text")


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("bm25", F.round("bm25", 6))


@query("keyword_search", f"WITH {bm25_sql('documents', 'doc_id', 'text', ['mit', 'license'])} SELECT id, round(bm25, 6) AS bm25 FROM scored WHERE list_contains(words, 'mit') AND list_contains(words, 'license') ORDER BY scored.bm25, id LIMIT 20")
def _search(spark, d):
    return _rounded(keyword_search(_items(spark, d).select("id"), "MIT License!", index=documents_index(spark, d)))


@query("keyword_search_rows", f"WITH {bm25_sql('documents', 'doc_id', 'text', ['apache', 'gnu'], ', lang, source')} SELECT id, lang, source, round(bm25, 6) AS bm25, content[1:40] AS head FROM scored WHERE list_contains(words, 'apache') OR list_contains(words, 'gnu') ORDER BY scored.bm25, id LIMIT 20")
def _search_rows(spark, d):
    return _rounded(keyword_search(_items(spark, d), "Apache OR GNU", mode="fts5", index=documents_index(spark, d)).select("id", "lang", "source", "bm25", F.substring("content", 1, 40).alias("head")))


@query("keyword_search_prefix", f"WITH {bm25_sql('documents', 'doc_id', 'text', ['licens'], prefix=True)} SELECT id, round(bm25, 6) AS bm25 FROM scored WHERE len(list_filter(words, lambda w: starts_with(w, 'licens'))) > 0 ORDER BY scored.bm25, id LIMIT 20")
def _search_prefix(spark, d):
    return _rounded(keyword_search(_items(spark, d).select("id"), "licens", index=documents_index(spark, d)))


@query("keyword_search_phrase", f"WITH {bm25_sql('documents', 'doc_id', 'text', ['gnu', 'general', 'public'])} SELECT id, round(bm25, 6) AS bm25 FROM scored WHERE contains(' ' || array_to_string(words, ' ') || ' ', ' gnu general public ') ORDER BY scored.bm25, id LIMIT 20")
def _search_phrase(spark, d):
    return _rounded(keyword_search(_items(spark, d).select("id"), '"GNU General Public"', index=documents_index(spark, d)))


@query("fts_sanitize", r"SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(text[1:500], '\b(?:OR|AND|NOT|NEAR)\b', ' ', 'g'), '[^\p{L}\p{N}\p{M}_\s]', ' ', 'g'), '^\s+|\s+$', '', 'g')) AS q FROM documents")
def _sanitize(spark, d):
    return read(spark, d, "documents").select("doc_id", F.sha2(X.sanitize(F.col("text")).cast("binary"), 256).alias("q"))


@query("fts_normalize", "SELECT doc_id, sha256(replace(replace(translate(lower(text), '?!:.,;/', '       '), chr(34), ' '), chr(39), ' ')) AS q FROM documents")
def _normalize(spark, d):
    return read(spark, d, "documents").select("doc_id", F.sha2(X.searchable(F.col("text")).cast("binary"), 256).alias("q"))


@query("fts_short_circuit", f"WITH {bm25_sql('documents', 'doc_id', 'text', ['apache', 'license'])}, hits AS (SELECT * FROM scored WHERE list_contains(words, 'apache') AND list_contains(words, 'license') ORDER BY bm25, id LIMIT 40) SELECT id, 1.0 AS score FROM hits WHERE contains(lower(content), 'apache license') ORDER BY bm25, id LIMIT 10")
def _short(spark, d):
    return short_circuit(_items(spark, d).select("id", "content"), "Apache License", 10, index=documents_index(spark, d)).select("id", "score")


@query("fts_only_fallback", f"WITH {bm25_sql('documents', 'doc_id', 'text', ['mit', 'license'])} SELECT id, 1.0 AS score, row_number() OVER (ORDER BY bm25, id) AS pos FROM scored WHERE list_contains(words, 'mit') AND list_contains(words, 'license') QUALIFY pos <= 10")
def _fallback(spark, d):
    from pyspark.sql import Window

    hits = keyword_search(_items(spark, d).select("id"), "mit license", 10, index=documents_index(spark, d))
    return hits.select("id", F.lit(1.0).alias("score"), F.row_number().over(Window.orderBy("bm25", "id")).alias("pos"))  # at most ten rows


_TITLE_SQL = TOKENS_SQL.format("p_name")


@query("title_overlap", f"WITH t AS (SELECT p_partkey, list_distinct(list_filter({_TITLE_SQL}, lambda x: length(x) > 2)) AS w, ['antique', 'blue', 'green', 'steel'] AS q FROM part) SELECT p_partkey, round(len(list_intersect(q, w)) / 4.0, 6) AS overlap FROM t")
def _overlap(spark, d):
    return read(spark, d, "part").select("p_partkey", F.round(X.title_overlap(F.lit("antique-blue GREEN of steel"), F.col("p_name")), 6).alias("overlap"))


@query("title_role_augment", "SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN t WHEN 1 THEN t WHEN 2 THEN trim('[Caroline] ' || t) WHEN 3 THEN '[x] ' || t ELSE trim('[unknown] ' || t) END AS title FROM (SELECT conv_id, turn, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM conversations)")
def _role(spark, d):
    k = F.col("turn") % 5
    role = F.when(k == 0, "Tool").when(k == 1, " user ").when(k == 2, " Caroline ").when(k == 3, "Caroline").otherwise("unknown")
    title = F.concat(F.when(k == 3, "  [x] ").otherwise(" "), F.col("text"), F.lit(" \n"))
    clean = F.when(k == 3, F.concat(F.lit("[x] "), X.strip(F.col("text")))).otherwise(title)
    return read(spark, d, "conversations").select("conv_id", "turn", X.title_with_role(clean, role).alias("title"))


_ASKED = ['"alpha"beta"', "'MIT License'", "who is Anna", "licence", "  AND, OR! ", "C++", "well-known snake_case", "\""]


@query("fts_compile", "SELECT event_id, CASE event_id % 8 WHEN 0 THEN '\"alpha\"\"beta\"' WHEN 1 THEN '\"MIT License\"' WHEN 2 THEN 'who OR is OR anna' WHEN 3 THEN 'licence*' WHEN 4 THEN '' WHEN 5 THEN 'c*' WHEN 6 THEN 'well OR known OR snake_case' ELSE '\"\"' END AS fts5, CASE event_id % 8 WHEN 0 THEN '\"alpha\"\"beta\"' WHEN 1 THEN '\"MIT License\"' WHEN 2 THEN 'who is anna' WHEN 3 THEN 'licence*' WHEN 4 THEN '' WHEN 5 THEN 'c*' WHEN 6 THEN 'well known snake_case' ELSE '\"\"' END AS hybrid, event_id % 8 <> 4 AS ok FROM events")
def _compile(spark, d):
    q = F.element_at(F.array(*map(F.lit, _ASKED)), (F.col("event_id") % len(_ASKED) + 1).cast("int"))
    any_of, all_of = compile_fts(q, "fts5"), compile_fts(q, "hybrid")
    return read(spark, d, "events").select("event_id", any_of[0].alias("fts5"), all_of[0].alias("hybrid"), any_of[1].alias("ok"))


@query("chatlog_search", f"WITH {bm25_sql('conversations', 'conv_id * 1000 + turn', 'text', ['the'], ', role', True)} SELECT id, role, round(bm25, 6) AS bm25 FROM scored WHERE len(list_filter(words, lambda w: starts_with(w, 'the'))) > 0 AND role = 'assistant' ORDER BY scored.bm25, id LIMIT 15")
def _chat(spark, d):
    number = F.col("conv_id") * 1000 + F.col("turn")
    turns = read(spark, d, "conversations").select(number.alias("id"), "role").where("role = 'assistant'")
    hits = index_of(spark, d, "conversations", number, "text").matches(compile_query("the")).join(turns, "id")
    return _rounded(hits.orderBy("bm25", "id").limit(15).select("id", "role", "bm25"))


@query("chatlog_newest", "SELECT conv_id, turn, role FROM conversations WHERE role = 'user' ORDER BY conv_id DESC, turn DESC LIMIT 20")
def _newest(spark, d):
    return read(spark, d, "conversations").where("role = 'user'").orderBy(F.desc("conv_id"), F.desc("turn")).limit(20).select("conv_id", "turn", "role")
