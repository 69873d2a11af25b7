"""Sources and sinks: stores searched together, exports and imports, transcripts, file walks, incremental sync."""

from __future__ import annotations

import functools
import os
import warnings
from collections.abc import Callable, Iterator
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..registry import query, read


def jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A table of a relational store; bounds for partitioned reads go through options."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def multi_source(sources: dict[str, Callable[[], DataFrame]], k: int) -> DataFrame:
    """Hits (id, score) of several stores, tagged with the store, best k; a store that can't be read is skipped."""
    found = []
    for name, open_ in sources.items():
        try:
            found.append(open_().select("id", "score").withColumn("store", F.lit(name)))
        except AnalysisException as e:
            warnings.warn(f"{name} is skipped: {e}", stacklevel=2)
    if not found:
        raise ValueError("no store could be read")
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    return every.orderBy(F.desc("score"), "store", "id").limit(k)


def export_rows(items: DataFrame, vectors: DataFrame, edges: DataFrame, id_col: str) -> DataFrame:
    """Items with nested vectors (kind, embedding) and relationships (to_id, relationship_type), each sorted."""
    v = vectors.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("kind", "embedding"))).alias("embeddings"))
    e = edges.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("to_id", "relationship_type"))).alias("relationships"))
    return items.join(v, id_col, "left").join(e, id_col, "left")


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """current with the rows of incoming put in place of those with their keys; of rows that repeat a key, one is taken."""
    once = incoming.select(*current.columns).dropDuplicates(keys)
    return current.join(once.select(*keys), keys, "left_anti").unionByName(once)


def delta(rows: DataFrame, column: str, mark: str) -> DataFrame:
    """Rows later than the watermark, and those without a time."""
    return rows.where(F.col(column).isNull() | (F.col(column) > F.to_timestamp(F.lit(mark))))


def newer_wins(target: DataFrame, source: DataFrame, keys: list[str], time: str) -> DataFrame:
    """Both sides' rows, of each key the one with the later time; the target's where times are equal or missing."""
    both = target.withColumn("_s", F.lit(0)).unionByName(source.select(*target.columns).withColumn("_s", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(time), "_s")
    return both.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_s")


def sync_items(target: DataFrame, source: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """target, with columns taken from source where that is newer (or target has no time) and the stored row isn't
    a person's or the system's, unless the incoming one is a person's; rows that are only in source are added.
    Of source's rows of one key only the newest counts."""
    newest = Window.partitionBy(key).orderBy(F.desc_nulls_last("updated_at"), *[F.desc_nulls_last(c) for c in columns if c != key])
    source = source.withColumn("_nth", F.row_number().over(newest)).where("_nth = 1").drop("_nth")
    s = source.select(key, *[F.col(c).alias(f"_{c}") for c in [*columns, "updated_at", "change_agent"] if c != key])
    j = target.join(s, key, "left")
    newer = F.col("_updated_at").isNotNull() & (F.col("updated_at").isNull() | (F.col("_updated_at") > F.col("updated_at")))
    allowed = ~F.coalesce(F.col("change_agent").isin("manual", "system"), F.lit(False)) | (F.col("_change_agent") == "manual")
    take = newer & allowed
    cols = [F.when(take, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in [*columns, "updated_at", "change_agent"] else F.col(c) for c in target.columns]
    return j.select(*cols).unionByName(source.select(*target.columns).join(target.select(key), key, "left_anti"))


def promote(source: DataFrame, target: DataFrame, key: str, type_: str) -> DataFrame:
    """target with source's rows that it lacks, under another type."""
    return target.unionByName(source.join(target.select(key), key, "left_anti").withColumn("type", F.lit(type_)).select(*target.columns))


def walk(spark: SparkSession, path: str | list[str], ignore: list[str] | None = None, most_bytes: int = 10 << 20, listed: bool = False) -> DataFrame:
    """(path, length, sha256, text, left_out) of the text files under path, or paths, without those that ignored globs match.

    With listed, every file has a row: those that aren't taken have no text, and say why in left_out: large (more than
    most_bytes; their content isn't read), binary (a zero byte in the first 8,000) or encoding (not UTF-8).
    """
    from ..functions.text import glob_pattern

    files = _many_files(spark).read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    for g in ignore or []:
        files = files.where(~F.col("path").rlike(glob_pattern(f"*{g}*")))
    none = F.lit(None).cast("string")
    large = files.where(F.col("length") > most_bytes).select("path", "length", none.alias("sha256"), none.alias("text"), F.lit("large").alias("left_out"))
    binary = F.position(F.lit(b"\0"), F.substring("content", 1, 8000)) > 0
    text = F.try_validate_utf8(F.col("content").cast("string"))
    why = F.when(binary, "binary").when(text.isNull(), "encoding")
    small = files.where(F.col("length") <= most_bytes).select("path", "length", F.sha2("content", 256).alias("sha256"), F.when(why.isNull(), text).alias("text"), why.alias("left_out"))
    return small.unionByName(large) if listed else small.where("left_out is null")


#: Bytes and files of a task at most. Spark's 4 MB for opening a file would give a task 32 files. But it goes over a file of which
#: a filter leaves no row by a call within a call, so that a task of thousands of such files ends by a StackOverflowError.
TASK_BYTES, TASK_FILES = 128 << 20, 512


def _many_files(spark: SparkSession) -> SparkSession:
    """A session with spark's own settings, but for tasks of many small files; spark's session stays as it is."""
    own = spark.newSession()
    for k, v in spark.conf.getAll.items():
        if spark.conf.isModifiable(k):
            own.conf.set(k, v)
    own.conf.set("spark.sql.files.maxPartitionBytes", TASK_BYTES)
    own.conf.set("spark.sql.files.openCostInBytes", TASK_BYTES // TASK_FILES)
    return own


#: Files in a folder that tasks write, and files that walk_parts lists at a time.
FOLDER_FILES, LISTED_FILES = 2_000, 100_000


def write_files(texts: DataFrame, path: str) -> list[tuple[str, int]]:
    """Writes the text of each row (its only column) and a line feed as a file of its own; (folder, number of its files).

    In a local folder that is shared, tasks write the files themselves: without its native library, Hadoop's local file
    system starts chmod as a process, several times for each file. An attempt of a task has folders of its own, and
    those of attempts that succeed count. In other stores Spark's writer does it, and path is the only folder.
    """
    at = urlsplit(path)
    if at.scheme not in ("", "file"):
        column = texts.columns[0]
        folder = F.concat_ws("-", F.spark_partition_id(), F.pmod(F.xxhash64(column), F.lit(16)))
        texts.withColumn("_folder", folder).write.partitionBy("_folder").option("maxRecordsPerFile", 1).text(path)
        return [(path, 0)]
    local = unquote(at.path)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get(), 0
        name = lambda k: f"{task.partitionId()}-{task.attemptNumber()}-{task.taskAttemptId()}-{k}"
        for b in batches:
            for text in b.column(0).cast(pa.binary()):
                folder = f"{local}/{name(n // FOLDER_FILES)}"
                if n % FOLDER_FILES == 0:
                    os.makedirs(folder)
                with open(f"{folder}/{n}.txt", "wb") as f:
                    f.write((text.as_py() or b"") + b"\n")
                n += 1
        sizes = [min(FOLDER_FILES, n - k) for k in range(0, n, FOLDER_FILES)]
        yield pa.RecordBatch.from_arrays([pa.array([name(k) for k in range(len(sizes))], pa.string()), pa.array(sizes, pa.int64())], names=["folder", "n"])

    written = texts.mapInArrow(write, "folder string, n long").collect()
    os.makedirs(local, exist_ok=True)  # no rows, no folders
    return [(f"{path}/{r['folder']}", r["n"]) for r in written] or [(path, 0)]


def walk_parts(spark: SparkSession, folders: list[tuple[str, int]], columns: list, **options) -> DataFrame:
    """columns of walk(**options) over folders with known numbers of files, stored.

    Spark's driver holds the names of all files of a table, so about LISTED_FILES are listed, walked and stored at a time.
    """
    parts: list[list[str]] = []
    held = 0
    for folder, n in folders:
        if not parts or held + n > LISTED_FILES:
            parts.append([])
            held = 0
        parts[-1].append(folder)
        held += n
    out = _shared(spark)
    for part in parts:
        found = walk(spark, part, **options).select(*columns)
        found.write.mode("append").parquet(out)
    return spark.read.schema(found.schema).parquet(out)


TURN = "session string, id string, ts string, role string, model string, text string, tokens_in long, tokens_out long"


def transcript_lines(spark: SparkSession, path: str) -> DataFrame:
    """Turns of JSON-lines transcripts: user and assistant events; content is a string or a list of text parts."""
    raw = spark.read.text(path).select(F.try_parse_json("value").alias("v")).where("v is not null")
    get = lambda p, t="string": F.try_variant_get("v", p, t)
    parts = F.from_json(get("$.message.content"), "array<struct<type:string,text:string>>")
    listed = F.array_join(F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: p["text"]), "\n")
    text = F.when(get("$.message.content").startswith("["), listed).otherwise(get("$.message.content"))
    rows = raw.where(get("$.type").isin("user", "assistant"))
    return rows.select(
        get("$.sessionId").alias("session"), get("$.uuid").alias("id"), get("$.timestamp").alias("ts"), get("$.message.role").alias("role"), get("$.message.model").alias("model"), text.alias("text"),
        get("$.message.usage.input_tokens", "long").alias("tokens_in"), get("$.message.usage.output_tokens", "long").alias("tokens_out"),
    ).where("text is not null and trim(text) <> ''")


def transcript_sessions(spark: SparkSession, path: str, per_line: bool = False) -> DataFrame:
    """Turns of whole-session JSON transcripts; message types other than user are the assistant's.

    A file is one session, or each of its lines is (per_line).
    """
    raw = spark.read.option("wholetext", str(not per_line).lower()).text(path).select(F.try_parse_json("value").alias("v")).where("v is not null")
    m = raw.select(F.try_variant_get("v", "$.sessionId", "string").alias("session"), F.explode(F.try_variant_get("v", "$.messages", "array<variant>")).alias("m"))
    get = lambda p, t="string": F.try_variant_get("m", p, t)
    parts = F.from_json(get("$.content"), "array<struct<text:string>>")
    text = F.when(get("$.content").startswith("["), F.array_join(F.transform(parts, lambda p: p["text"]), "\n")).otherwise(get("$.content"))
    return m.select(
        "session", get("$.id").alias("id"), get("$.timestamp").alias("ts"), F.when(get("$.type") == "user", "user").otherwise("assistant").alias("role"), get("$.model").alias("model"), text.alias("text"),
        get("$.tokens.input", "long").alias("tokens_in"), get("$.tokens.output", "long").alias("tokens_out"),
    ).where("text is not null and trim(text) <> ''")


def unseen(turns: DataFrame, cursor: DataFrame) -> DataFrame:
    """Turns that the cursor (session, id) hasn't seen."""
    return turns.join(cursor.select("session", "id"), ["session", "id"], "left_anti")


def subject_rows(tables: dict[str, DataFrame], column: str, subject) -> dict[str, DataFrame]:
    """Of every table that has the column, the rows of one person."""
    return {name: t.where(F.col(column) == subject) for name, t in tables.items() if column in t.columns}


@query("multi_source_search", "SELECT id, score, store FROM (SELECT event_id AS id, value AS score, 'a' AS store FROM events WHERE event_type = 'view' UNION ALL SELECT event_id, value, 'b' FROM events WHERE event_type = 'click') ORDER BY score DESC, store, id LIMIT 25")
def _multi(spark, d):
    hits = lambda t: lambda: read(spark, d, "events").where(F.col("event_type") == t).select(F.col("event_id").alias("id"), F.col("value").alias("score"))
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return multi_source({"a": hits("view"), "b": hits("click"), "gone": lambda: read(spark, d, "no_such_table")}, 25)


@query("export_json", "SELECT c_custkey AS id, c_name, (SELECT string_agg(o_orderkey || ':' || o_orderstatus, ',' ORDER BY o_orderkey) FROM orders WHERE o_custkey = c_custkey) AS relationships FROM customer WHERE c_mktsegment = 'BUILDING'")
def _export(spark, d):
    items = read(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("id"), "c_name")
    vectors = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.lit("default").alias("kind"), "embedding")
    edges = read(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("to_id"), F.col("o_orderstatus").alias("relationship_type"))
    rows = export_rows(items, vectors, edges, "id")
    names = F.transform("relationships", lambda r: F.concat(r["to_id"].cast("string"), F.lit(":"), r["relationship_type"]))
    return rows.select("id", "c_name", F.when(F.col("relationships").isNotNull(), F.array_join(names, ",")).alias("relationships"))


@query("import_json", "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN upper(s_name) ELSE s_name END AS name FROM supplier UNION ALL SELECT 1000000, 'NEW'")
def _import(spark, d):
    current = read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    added = spark.createDataFrame([(1_000_000, "NEW")], "id long, name string")
    incoming = current.where("id % 3 = 0").withColumn("name", F.upper("name")).unionByName(added)
    carried = incoming.select(F.to_json(F.struct("id", "name")).alias("line")).select(F.from_json("line", "id long, name string").alias("r")).select("r.*")
    return upsert(current, carried, ["id"])


@query("gdpr_export", "SELECT event_id, ts, event_type, value FROM events WHERE user_id = 42")
def _gdpr(spark, d):
    found = subject_rows({"events": read(spark, d, "events"), "nation": read(spark, d, "nation")}, "user_id", 42)
    return found["events"].select("event_id", "ts", "event_type", "value")


@query("ingest_cursor", "SELECT conv_id, turn FROM conversations WHERE turn > conv_id % 3")
def _cursor(spark, d):
    t = read(spark, d, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("id"))
    return unseen(t, t.where("id <= session % 3")).select(F.col("session").alias("conv_id"), F.col("id").alias("turn"))


@query("delta_sync", "SELECT o_orderkey, o_totalprice, o_orderdate FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice + 1 ELSE o_totalprice END, CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate + INTERVAL 1 DAY ELSE o_orderdate END FROM orders WHERE o_orderkey % 3 = 0")
def _delta(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    even = F.col("o_orderkey") % 2 == 0
    changed = o.where("o_orderkey % 3 = 0").select("o_orderkey", (F.col("o_totalprice") + 1).alias("o_totalprice"), (F.col("o_orderdate") + F.when(even, F.expr("INTERVAL 1 DAY")).otherwise(F.expr("INTERVAL '-1' DAY"))).alias("o_orderdate"))
    return newer_wins(o, changed, ["o_orderkey"], "o_orderdate")


@query("watermark_delta", "SELECT event_id, CASE WHEN event_id % 100 = 0 THEN NULL ELSE ts END AS ts FROM events WHERE event_id % 100 = 0 OR ts > TIMESTAMP '2024-01-28 00:00:00'")
def _mark(spark, d):
    e = read(spark, d, "events").select("event_id", F.when(F.col("event_id") % 100 == 0, None).otherwise(F.col("ts")).alias("ts"))
    return delta(e, "ts", "2024-01-28 00:00:00")


@query("sync_items", "SELECT event_id, CASE WHEN event_id % 2 = 0 AND event_type <> 'error' THEN value + 1 ELSE value END AS value FROM events")
def _items(spark, d):
    e = read(spark, d, "events").select("event_id", "value", F.col("ts").alias("updated_at"), F.when(F.col("event_type") == "error", "manual").otherwise("agent").alias("change_agent"))
    step = F.when(F.col("event_id") % 2 == 0, F.expr("INTERVAL 1 HOUR")).otherwise(F.expr("INTERVAL '-1' HOUR"))
    incoming = e.select("event_id", (F.col("value") + 1).alias("value"), (F.col("updated_at") + step).alias("updated_at"), F.lit("agent").alias("change_agent"))
    return sync_items(e, incoming, "event_id", ["value"]).select("event_id", "value")


@query("promote_across_stores", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lang ELSE 'promoted' END AS type FROM documents")
def _promote(spark, d):
    docs = read(spark, d, "documents").select("doc_id", F.col("lang").alias("type"))
    return promote(docs, docs.where("doc_id % 2 = 0"), "doc_id", "promoted")


def _shared(spark: SparkSession) -> str:
    """A new folder that all executors share."""
    from ..streaming.jobs import shared

    return shared(spark)


def _written(df: DataFrame, name: str) -> str:
    """df's lines as text files in a folder that all executors share."""
    path = f"{_shared(df.sparkSession)}/{name}"
    df.write.text(path)
    return path


@query("ingest_transcript_lines", "SELECT CAST(conv_id AS VARCHAR) AS session, conv_id || '-' || turn AS id, role, text FROM conversations WHERE role IN ('user', 'assistant') AND trim(text) <> ''")
def _lines(spark, d):
    c = read(spark, d, "conversations")
    message = F.when(F.col("turn") % 2 == 0, F.to_json(F.struct("role", F.array(F.struct(F.lit("text").alias("type"), "text")).alias("content")))).otherwise(F.to_json(F.struct("role", F.col("text").alias("content"))))
    head = F.to_json(F.struct(F.col("role").alias("type"), F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("uuid"), F.col("conv_id").cast("string").alias("sessionId")))
    line = F.concat(F.regexp_replace(head, r"\}$", ""), F.lit(',"message":'), message, F.lit("}"))
    return transcript_lines(spark, _written(c.select(line.alias("value")), "transcript")).select("session", "id", "role", "text")


@query("ingest_transcript_sessions", "SELECT CAST(conv_id AS VARCHAR) AS session, CAST(turn AS VARCHAR) AS id, CASE WHEN role = 'user' THEN 'user' ELSE 'assistant' END AS role, text, CAST(turn AS BIGINT) AS tokens_in FROM conversations WHERE trim(text) <> ''")
def _sessions(spark, d):
    c = read(spark, d, "conversations")
    said = F.struct(F.col("turn").cast("string").alias("id"), F.col("role").alias("type"), F.col("text").alias("content"), F.struct(F.col("turn").alias("input")).alias("tokens"))
    whole = c.groupBy(F.col("conv_id").cast("string").alias("sessionId")).agg(F.array_sort(F.collect_list(said)).alias("messages"))  # one session is one file
    path = _written(whole.select(F.to_json(F.struct("sessionId", "messages")).alias("value")), "sessions")
    return transcript_sessions(spark, path, per_line=True).select("session", "id", "role", "text", "tokens_in")


@query("walk_files", "WITH f AS (SELECT coalesce(text, '') || chr(10) AS t FROM documents) SELECT CAST(octet_length(encode(t)) AS BIGINT) AS length, CASE WHEN octet_length(encode(t)) <= 20000 THEN sha256(t) END AS sha256, CASE WHEN octet_length(encode(t)) > 20000 THEN 'large' END AS left_out, CASE WHEN octet_length(encode(t)) <= 20000 THEN length(t) END AS n_chars FROM f")
def _walk(spark, d):
    """Every document as a file of its own; those above 20,000 bytes are left out, and listed as such."""
    folders = write_files(read(spark, d, "documents").select("text"), f"{_shared(spark)}/tree")
    columns = ["length", "sha256", "left_out", F.char_length("text").cast("long").alias("n_chars")]
    return walk_parts(spark, folders, columns, ignore=["_SUCCESS", ".crc"], most_bytes=20_000, listed=True)


@query("sync_tasks", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'X' ELSE o_orderstatus END AS status FROM orders")
def _tasks(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), "o_orderdate")
    later = o.where("o_orderkey % 4 = 0").withColumn("status", F.lit("X")).withColumn("o_orderdate", F.col("o_orderdate") + F.expr("INTERVAL 1 DAY"))
    return newer_wins(o, later, ["o_orderkey"], "o_orderdate").select("o_orderkey", "status")


@query("sync_embeddings", "SELECT vec_id, count(*) AS n FROM embeddings GROUP BY 1")
def _vectors(spark, d):
    """Vectors are keyed by item, kind and content, so that running an import again adds nothing."""
    v = read(spark, d, "embeddings").select("vec_id", F.lit("default").alias("kind"), F.sha2(F.to_json("embedding").cast("binary"), 256).alias("content_hash"), "embedding")
    twice = upsert(upsert(v, v, ["vec_id", "kind", "content_hash"]), v, ["vec_id", "kind", "content_hash"])
    return twice.groupBy("vec_id").agg(F.count("*").alias("n"))
