"""The document store: chunking, identity, version diffs, staleness, search over leaves."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..registry import query, read
from .keyword import bm25_sql, documents_index, keyword_search

TARGET, MAX, MIN = 1800, 2400, 300
WINDOW, OVERLAP = 28_000, 8_000


def chunk_windows(docs: DataFrame, id_col: str, text: str, window: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """(id, part, start, chunk): overlapping windows of characters; the last one ends where the text ends."""
    n, stride = F.char_length(text), window - overlap
    last = F.greatest(F.lit(0), F.ceil((n - window) / stride)).cast("int")
    starts = F.transform(F.sequence(F.lit(0), last), lambda i: i * stride)
    return docs.where(F.col(text).isNotNull()).select(id_col, text, F.posexplode(starts).alias("part", "start")).select(id_col, "part", "start", F.col(text).substr(F.col("start") + 1, F.lit(window)).alias("chunk"))


def subdivided(length: Column, tokens: Column, cap: int = 7000) -> tuple[Column, Column]:
    """(size, stride) for a chunk that had too many tokens: by its density, at least 2000 characters, half kept."""
    size = F.greatest(F.lit(2000), F.floor(cap * length / tokens * 0.9)).cast("int")
    overlap = F.floor(500 * length / tokens).cast("int")
    return size, F.greatest(F.floor(size / 2).cast("int"), size - overlap)


def pack_paragraphs(text: str, target: int = TARGET, most: int = MAX, least: int = MIN) -> list[str]:
    """Paragraphs packed in order into chunks of about target characters; oversize ones are cut after sentences,
    and a chunk below least joins the one before."""
    chunks: list[str] = []
    held: list[str] = []
    size = 0
    for p in (x for x in re.split(r"\n\s*\n", text.strip()) if x.strip()):
        if len(p) > most or (held and size + len(p) > target):
            chunks += ["\n\n".join(held).strip()] if held else []
            held, size = [], 0
        if len(p) > most:
            part = ""
            for s in re.split(r"(?<=[.!?])\s+", p):
                if part and len(part) + len(s) + 1 > most:
                    chunks.append(part)
                    part = ""
                part = f"{part} {s}" if part else s
            chunks += [part] if part else []
            continue
        held.append(p)
        size += len(p) + 2
    chunks += ["\n\n".join(held).strip()] if held else []
    out: list[str] = []
    for c in chunks:
        if out and len(c) < least:
            out[-1] = f"{out[-1]}\n\n{c}".strip()
        else:
            out.append(c)
    return out


# Deepest heading that starts a section, least length of a preamble, most of a section.
HEADING_DEPTH, PREAMBLE_LEAST, SECTION_MOST = 3, 50, 16_000


@dataclass
class Section:
    """A part of a Markdown text: its path of heading anchors, its heading, where it is and how sure its bounds are."""

    path: str
    label: str
    start: int
    end: int
    sure: float
    text: str


def anchor(label: str) -> str:
    """A heading as part of a path: lower case, words joined by dashes."""
    kept = "".join(c for c in label.lower() if c.isalnum() or c in "_-" or c.isspace())
    return "-".join(x for x in re.split(r"[\s_-]+", kept) if x) or "section"


def _body_start(text: str) -> int:
    """Where a text begins after YAML (---) or TOML (+++) front matter."""
    for mark in ("---", "+++"):
        lines = text.splitlines(keepends=True)
        if lines and lines[0].rstrip() == mark and lines[0].endswith("\n"):
            at = len(lines[0])
            for line in lines[1:]:
                at += len(line)
                if line.rstrip() == mark and line.endswith("\n"):
                    return at
    return 0


def _headings(text: str, begin: int) -> Iterator[tuple[int, int, str]]:
    """(where, depth, label) of each heading that starts a section, outside fenced code."""
    fenced, at = False, begin
    for line in text[begin:].split("\n"):
        if line.startswith("```"):
            fenced = not fenced
        depth = len(line) - len(line.lstrip("#"))
        label = line[depth:].strip()
        if not fenced and 0 < depth <= HEADING_DEPTH and label and line[depth].isspace():
            yield at, depth, re.sub(r"\s+#+$", "", label)
        at += len(line) + 1


def _cut(path: str, label: str, start: int, text: str) -> Iterator[Section]:
    """A section that is too long, in runs of whole paragraphs."""
    runs: list[list[str]] = [[]]
    size = 0
    for p in re.split(r"\n\s*\n", text):
        if runs[-1] and size + len(p) + 2 > SECTION_MOST:
            runs.append([])
            size = 0
        runs[-1].append(p)
        size += len(p) + 2
    for k, run in enumerate(runs, 1):
        chunk = "\n\n".join(run).strip()
        alone = len(runs) == 1
        sure = 1.0 if alone else 0.7 if k == len(runs) else 0.6
        yield Section(path if alone else f"{path}/part-{k}", label if alone else f"{label} (part {k})", start, start + len(chunk), sure, chunk)
        start += len(chunk) + 2


def markdown_sections(text: str) -> list[Section]:
    """The sections of a Markdown text, each with the path of the headings above it.

    Front matter is left out. What stands before the first heading is a preamble if it is long enough; a text
    without headings is one, whatever its length. Too long sections are cut between paragraphs.
    """
    begin = _body_start(text)
    heads = list(_headings(text, begin))
    out: list[Section] = []

    def add(path: str, label: str, start: int, end: int, sure: float) -> None:
        body = text[start:end].strip()
        if len(body) > SECTION_MOST:
            out.extend(_cut(path, label, start, body))
        elif body:
            out.append(Section(path, label, start, end, sure, body))

    if not heads:
        add("preamble", "(whole file)", begin, len(text), 0.9)
    elif len(text[begin : heads[0][0]].strip()) >= PREAMBLE_LEAST:
        add("preamble", "preamble", begin, heads[0][0], 0.9)
    above: list[tuple[int, str]] = []
    for (start, depth, label), end in zip(heads, [*(h[0] for h in heads[1:]), len(text)]):
        above = [x for x in above if x[0] < depth] + [(depth, anchor(label))]
        add("/".join(x[1] for x in above), label, start, end, 1.0)
    return out


def chunk_markdown(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, part, path, label, start, end, sure, chunk): the sections of each Markdown text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, k, s.path, s.label, s.start, s.end, s.sure, s.text) for i, t in zip(b[id_col].to_pylist(), b[text].to_pylist()) for k, s in enumerate(markdown_sections(t or ""))]
            kinds = [b.schema.field(id_col).type, pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.string()]
            columns = zip(*rows) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[id_col, "part", "path", "label", "start", "end", "sure", "chunk"])

    return docs.select(id_col, text).mapInArrow(run, f"{id_col} {dict(docs.dtypes)[id_col]}, part int, path string, label string, start long, end long, sure double, chunk string")


def chunk_with(docs: DataFrame, id_col: str, text: str, chunker) -> DataFrame:
    """(id, part, chunk) by a function from a text to its chunks, run on Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, parts, chunks = [], [], []
            for i, t in zip(b[id_col].to_pylist(), b[text].to_pylist()):
                for k, c in enumerate(chunker(t or "")):
                    ids.append(i)
                    parts.append(k)
                    chunks.append(c)
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(id_col).type), pa.array(parts, pa.int32()), pa.array(chunks, pa.string())], names=[id_col, "part", "chunk"])

    return docs.select(id_col, text).mapInArrow(run, f"{id_col} {dict(docs.dtypes)[id_col]}, part int, chunk string")


def leaf_diff(prior: DataFrame, new: DataFrame, by: str, place: str = "part") -> DataFrame:
    """(by, part, kind, prior_part) of new leaves (by, part, place, chunk) against the prior version's.

    New leaves are taken in order: one carries the first prior leaf with its text if that is still unused, else it
    evolves the first prior leaf of its place if that is unused, else it is new. A file's leaves meet in one task
    as hashes and places, without their texts.
    """
    kind = dict(new.dtypes)[by]
    h = lambda df: df.select(F.col(by).alias("file"), F.col("part").cast("long").alias("part"), F.col(place).cast("string").alias("place"), F.sha2(F.col("chunk").cast("binary"), 256).alias("h"))

    def fold(key: tuple, before: pa.Table, after: pa.Table) -> pa.Table:
        texts: dict[str, int] = {}
        places: dict[str, int] = {}
        for part, where, text in sorted(zip(*(before[c].to_pylist() for c in ("part", "place", "h"))), key=lambda r: r[0]):
            texts.setdefault(text, part)
            places.setdefault(where, part)
        used: set[int] = set()
        out = []
        for part, where, text in sorted(zip(*(after[c].to_pylist() for c in ("part", "place", "h"))), key=lambda r: r[0]):
            found = ("new", None)
            for name, was in (("carry", texts.get(text)), ("evolve", places.get(where))):
                if was is not None and was not in used:
                    used.add(was)
                    found = (name, was)
                    break
            out.append((part, *found))
        columns = zip(*out) if out else ([], [], [])
        parts, kinds, was = (pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int64())))
        return pa.table({by: pa.array([key[0].as_py()] * len(out), after["file"].type), "part": parts, "kind": kinds, "prior_part": was})

    return h(prior).groupBy("file").cogroup(h(new).groupBy("file")).applyInArrow(fold, f"{by} {kind}, part long, kind string, prior_part long")


def staleness(disk: DataFrame, known: DataFrame) -> DataFrame:
    """(path, state) over files on disk and known ones (path, sha, mtime): new, missing, stale, touched, renamed, ok."""
    d, k = disk.select("path", F.col("sha").alias("d_sha"), F.col("mtime").alias("d_time")), known.select("path", F.col("sha").alias("k_sha"), F.col("mtime").alias("k_time"))
    both = d.join(k, "path", "full_outer")
    gone = both.where("d_sha is null").groupBy(F.col("k_sha").alias("d_sha")).agg(F.min("path").alias("was"))
    named = both.join(gone, "d_sha", "left")
    state = (
        F.when(F.col("k_sha").isNull() & F.col("was").isNotNull(), "renamed").when(F.col("k_sha").isNull(), "new").when(F.col("d_sha").isNull(), "missing")
        .when(F.col("d_sha") != F.col("k_sha"), "stale").when(F.col("d_time") != F.col("k_time"), "touched").otherwise("ok")
    )
    return named.select("path", state.alias("state"))


def file_identity(files: DataFrame, declared: Column, path: str, content: str, *columns: str) -> DataFrame:
    """columns, identity (the declared one, else the path) and content_sha256 of each file."""
    named = F.coalesce(F.concat(F.lit("doc:"), declared), F.concat(F.lit("path:"), F.col(path)))
    return files.select(*columns, named.alias("identity"), F.sha2(F.col(content).cast("binary"), 256).alias("content_sha256"))


def ingest_actions(files: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """(key, action) of files (key, sha) against current versions (key, sha): new, unchanged or new_version."""
    was = current.select(key, F.col("sha").alias("_was"))
    action = F.when(F.col("_was").isNull(), "new").when(F.col("_was") == F.col("sha"), "unchanged").otherwise("new_version")
    return files.join(was, key, "left").select(key, action.alias("action"))


def _docs(spark, d) -> DataFrame:
    return read(spark, d, "documents")


@query("chunk_window", "WITH d AS (SELECT doc_id, text, unnest(range(0, CAST(greatest(0, ceil((length(text) - 500) / 400.0)) AS INT) + 1)) AS part FROM documents) SELECT doc_id, CAST(part AS INT) AS part, CAST(part * 400 AS INT) AS start, sha256(text[part * 400 + 1 : part * 400 + 500]) AS chunk FROM d")
def _window(spark, d):
    return chunk_windows(_docs(spark, d), "doc_id", "text", 500, 100).withColumn("chunk", F.sha2(F.col("chunk").cast("binary"), 256))


@query("subdivide_dense", "SELECT doc_id, CAST(s AS INT) AS size, CAST(greatest(floor(s / 2), s - floor(500 * n / t)) AS INT) AS stride FROM (SELECT doc_id, n_chars AS n, greatest(1, n_chars // 2) AS t, greatest(2000, floor(7000 * n_chars / greatest(1, n_chars // 2) * 0.9)) AS s FROM documents)")
def _dense(spark, d):
    tokens = F.greatest(F.lit(1), F.floor(F.col("n_chars") / 2))
    size, stride = subdivided(F.col("n_chars"), tokens)
    return _docs(spark, d).select("doc_id", size.alias("size"), stride.alias("stride"))


@query("chunk_text")
def _text(spark, d):
    return chunk_with(_docs(spark, d).withColumn("text", F.regexp_replace("text", "\n", "\n\n")), "doc_id", "text", pack_paragraphs)


@query("chunk_markdown", "WITH l AS (SELECT conv_id, turn, len(string_split(text, chr(10))) AS n, text FROM conversations WHERE NOT contains(text, '#')) SELECT conv_id, turn, 0 AS part, 'head' AS path, sha256('# Head' || chr(10) || regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS chunk FROM l UNION ALL SELECT conv_id, turn, 1, 'head/sub-part', sha256('## Sub_part!' || chr(10) || '```' || chr(10) || '# no head' || chr(10) || '```') FROM l UNION ALL SELECT conv_id, turn, 2, 'next', sha256('# Next #' || chr(10) || 'end') FROM l")
def _markdown(spark, d):
    text = F.concat(F.lit("---\ntitle: x\n---\nshort\n# Head\n"), F.regexp_replace("text", r"^\s+|\s+$", ""), F.lit("\n\n## Sub_part!\n```\n# no head\n```\n# Next #\nend\n"))
    docs = read(spark, d, "conversations").where("not contains(text, '#')").select(F.struct("conv_id", "turn").alias("k"), text.alias("text"))
    out = chunk_markdown(docs.select((F.col("k.conv_id") * 1000 + F.col("k.turn")).alias("id"), "text"), "id", "text")
    return out.select(F.floor(F.col("id") / 1000).alias("conv_id"), (F.col("id") % 1000).alias("turn"), "part", "path", F.sha2(F.col("chunk").cast("binary"), 256).alias("chunk"))


@query("file_identity", "SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'doc:' || page_id ELSE 'path:' || url END AS identity, sha256(html) AS content_sha256 FROM pages")
def _identity(spark, d):
    declared = F.when(F.col("page_id") % 5 == 0, F.col("page_id").cast("string"))
    return file_identity(read(spark, d, "pages"), declared, "url", "html", "page_id")


@query("ingest_one_file", "SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'unchanged' WHEN page_id % 4 = 1 THEN 'new' ELSE 'new_version' END AS action FROM pages")
def _ingest(spark, d):
    new = read(spark, d, "pages").select("page_id", F.sha2(F.col("html").cast("binary"), 256).alias("sha"))
    current = new.where("page_id % 4 <> 1").select("page_id", F.when(F.col("page_id") % 4 == 0, F.col("sha")).otherwise("old").alias("sha"))
    return ingest_actions(new, current, "page_id")


@query("leaf_diff", "WITH c AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) SELECT conv_id, turn AS part, CASE WHEN conv_id % 3 = 0 THEN CASE WHEN turn = 0 THEN 'carry' WHEN turn < n - 1 THEN 'evolve' ELSE 'new' END WHEN conv_id % 3 = 1 THEN CASE WHEN turn < n - 1 THEN 'evolve' ELSE 'new' END ELSE CASE WHEN turn < n - 1 THEN 'carry' ELSE 'new' END END AS kind, CASE WHEN turn = n - 1 THEN NULL WHEN conv_id % 3 = 2 THEN n - 2 - turn ELSE turn END AS prior_part FROM c WHERE n > 1")
def _leaves(spark, d):
    """A third keeps its first turn, rewrites the others and adds one; a third puts a new first turn before the old
    ones, so each place is taken before its text is met again; a third turns its order round and adds one."""
    n, turn, kind = F.col("n"), F.col("turn"), F.col("conv_id") % 3
    c = read(spark, d, "conversations").withColumn("n", F.count("*").over(Window.partitionBy("conv_id"))).where("n > 1").withColumn("said", F.concat(turn.cast("string"), F.lit(":"), F.coalesce("text", F.lit(""))))
    old = c.where("turn < n - 1")
    prior = old.select("conv_id", turn.alias("part"), F.col("said").alias("chunk"))
    rewritten = c.where(kind == 0).select("conv_id", turn.alias("part"), F.concat("said", F.when(turn == 0, "").otherwise("!")).alias("chunk"))
    pushed = old.where(kind == 1).select("conv_id", (turn + 1).alias("part"), F.col("said").alias("chunk")).unionByName(c.where((kind == 1) & (turn == 0)).select("conv_id", F.lit(0).alias("part"), F.lit("new first").alias("chunk")))
    turned = old.where(kind == 2).select("conv_id", (n - 2 - turn).alias("part"), F.col("said").alias("chunk")).unionByName(c.where((kind == 2) & (turn == 0)).select("conv_id", (n - 1).alias("part"), F.lit("new last").alias("chunk")))
    return leaf_diff(prior, rewritten.unionByName(pushed).unionByName(turned), "conv_id").select("conv_id", "part", "kind", "prior_part")


@query("staleness_review", "SELECT url AS path, CASE page_id % 6 WHEN 0 THEN 'ok' WHEN 1 THEN 'stale' WHEN 2 THEN 'touched' WHEN 3 THEN 'new' WHEN 4 THEN 'missing' ELSE 'ok' END AS state FROM (SELECT page_id, page_id || url AS url FROM pages) UNION ALL SELECT page_id || url || '.old', 'missing' FROM pages WHERE page_id % 6 = 5 AND page_id % 4 = 1 UNION ALL SELECT page_id || url || '.moved', 'renamed' FROM pages WHERE page_id % 6 = 5 AND page_id % 4 = 1")
def _stale(spark, d):
    p = read(spark, d, "pages").select("page_id", F.concat(F.col("page_id").cast("string"), "url").alias("path"), F.sha2(F.concat(F.col("page_id").cast("string"), "html").cast("binary"), 256).alias("sha"), F.lit(1).alias("mtime"))
    k = F.col("page_id") % 6
    moved = p.where((k == 5) & (F.col("page_id") % 4 == 1)).withColumn("sha", F.concat("sha", F.lit("m")))
    disk = p.where(k != 4).withColumn("mtime", F.when(k == 2, 2).otherwise(1)).unionByName(moved.withColumn("path", F.concat("path", F.lit(".moved"))))
    known = p.where(k != 3).withColumn("sha", F.when(k == 1, F.lit("before")).otherwise(F.col("sha"))).unionByName(moved.withColumn("path", F.concat("path", F.lit(".old"))))
    return staleness(disk, known)


@query("files_search", f"WITH {bm25_sql('documents', 'doc_id', 'text', ['license'], prefix=True)}, k AS (SELECT id, row_number() OVER (ORDER BY bm25, id) AS r FROM scored WHERE tf0 > 0 QUALIFY r <= 50), v AS (SELECT e.vec_id AS id, row_number() OVER (ORDER BY list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) DESC, e.vec_id) AS r FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q QUALIFY r <= 50), f AS (SELECT id, sum(1.0 / (60 + r)) AS score FROM (SELECT * FROM k UNION ALL SELECT * FROM v) GROUP BY id) SELECT f.id, round(score, 9) AS score, content[1:80] AS head FROM f LEFT JOIN scored USING (id) ORDER BY round(f.score, 9) DESC, f.id LIMIT 10")
def _search(spark, d):
    from .ranking import rrf
    from .vector import cosine, with_query

    docs = _docs(spark, d).select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    words = keyword_search(docs.select("id"), "license", 50, index=documents_index(spark, d)).withColumn("rank", F.row_number().over(Window.orderBy("bm25", "id"))).select("id", "rank")
    v = read(spark, d, "embeddings")
    near = with_query(v, v.where("vec_id = 0")).select(F.col("vec_id").alias("id"), cosine(F.col("embedding"), F.col("q")).alias("s")).orderBy(F.desc("s"), "id").limit(50)
    fused = rrf([words, near.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("s"), "id"))).select("id", "rank")])
    return fused.withColumn("score", F.round("score", 9)).orderBy(F.desc("score"), "id").limit(10).join(docs.select("id", F.substring("content", 1, 80).alias("head")), "id", "left")
