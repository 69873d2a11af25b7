"""Continuous work as Structured Streaming: write-behind sinks, windows with watermarks, leases, notices.

Every function takes a streaming (or batch) DataFrame; the queries run the same transforms over a bounded
directory source with availableNow, so that their sinks can be held against SQL.
"""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..registry import query, read
from .leases import leases, with_rocksdb

LEASE_SECONDS, ATTEMPTS, BACKOFF = 3600, 3, 30


def shared(spark: SparkSession) -> str:
    """A new folder in what all executors share (spark.checkpoint.dir), or a temporary one in local tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp"))
    return f"{base}/{uuid.uuid4().hex}"


def stream_of(spark: SparkSession, sf_dir: str, table: str, **options: str) -> DataFrame:
    """A table's files as a stream of their rows; the pattern matches one name, be it a file's or a folder's."""
    whole = read(spark, sf_dir, table)
    return spark.readStream.schema(whole.schema).options(**options).parquet(f"{sf_dir}/[{table[0]}]{table[1:]}.parquet")


def run_now(stream: DataFrame, mode: str = "append", keys: list[str] | None = None) -> DataFrame:
    """What a stream gives for the files that are there now, exactly once, from its sink.

    In mode update, keys name the rows: of each, the one of the latest micro-batch counts.
    """
    spark, out = stream.sparkSession, shared(stream.sparkSession)
    schema = stream.schema
    if mode == "append":
        q = stream.writeStream.outputMode("append").format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    else:
        at = (lambda n: f"{out}/rows/batch={n}") if mode == "update" else (lambda n: f"{out}/rows/batch=0")
        write = lambda df, n: df.write.mode("overwrite").parquet(at(n))
        q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    if mode == "append":
        return spark.read.schema(schema).parquet(f"{out}/rows")
    rows = spark.read.option("basePath", f"{out}/rows").parquet(f"{out}/rows")
    if mode == "update":
        newest = Window.partitionBy(*(keys or stream.columns)).orderBy(F.desc("batch"))
        rows = rows.withColumn("_r", F.row_number().over(newest)).where("_r = 1")
    return rows.select(*stream.columns)


def tumbling(events: DataFrame, minutes: int = 10, late: str | None = "1 hour") -> DataFrame:
    """(start, n, total) of windows by event time; times without a zone are taken in the session's.

    On a stream, for output mode append: a window comes out once, when the watermark (the latest time less late) has
    passed its end, and its state goes; rows of windows that are gone are dropped. Without late, for complete: all windows.
    """
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    w = events.withWatermark("ts", late) if events.isStreaming and late else events
    return w.groupBy(F.window("ts", f"{minutes} minutes").alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "n", "total")


def write_behind(stream: DataFrame, keys: list[str], path: str, checkpoint: str):
    """Appends rows whose keys haven't been seen, in this micro-batch or any before; the checkpoint replays what wasn't
    finished. The keys seen are kept as state; with a watermark on the stream and its column among keys, old ones go."""

    def flush(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")  # a replay overwrites itself

    return stream.dropDuplicates(keys).writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = "1 hour") -> DataFrame:
    """(user_id, start, end, n): on a stream, for append, a session comes out once the watermark has passed its end;
    without late, for complete, all sessions do."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    w = events.withWatermark("ts", late) if events.isStreaming and late else events
    return w.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n")).select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def turn_windows(turns: DataFrame, size: int = 3) -> DataFrame:
    """(conv_id, window, text): every `size` turns of a conversation, joined; a last window may be shorter."""
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    placed = turns.withColumn("window", F.floor(n / size).cast("long"))
    return placed.groupBy("conv_id", "window").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n").alias("text"))


def gist_turns(turns: DataFrame, first: int = 10, stride: int = 5) -> DataFrame:
    """Turns after which a gist is due: the tenth of a conversation, then every fifth."""
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    return turns.withColumn("n", n).where((F.col("n") >= first) & ((F.col("n") - first) % stride == 0))


def turn_windows_stream(turns: DataFrame, size: int = 3) -> DataFrame:
    """turn_windows of a stream (conv_id, turn, text), for output mode update: a window's text grows as its turns arrive.

    A conversation's state is how many turns it has had and the texts of its last, open window.
    """

    def extend(key, batches, state):
        n, held = (state.get[0], list(state.get[1])) if state.exists else (0, [])
        rows = pd.concat(list(batches)).sort_values("turn")
        out: dict[int, str] = {}
        for text in rows["text"]:
            held = [text] if n % size == 0 else [*held, text]
            out[n // size] = "\n".join(x for x in held if x is not None)
            n += 1
        state.update((n, held))
        yield pd.DataFrame({"conv_id": key[0], "window": list(out), "text": list(out.values())})

    kind = dict(turns.dtypes)["conv_id"]
    return turns.select("conv_id", "turn", "text").groupBy("conv_id").applyInPandasWithState(extend, f"conv_id {kind}, window long, text string", "n long, held array<string>", "update", "NoTimeout")


def gist_turns_stream(turns: DataFrame, by: str, order: list[str], first: int = 10, stride: int = 5) -> DataFrame:
    """gist_turns of a stream: (by, order columns, n) of the turns after which a gist is due; the state is a count."""

    def count(key, batches, state):
        n = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values(order)
        rows["n"] = np.arange(n + 1, n + 1 + len(rows))
        state.update((n + len(rows),))
        yield rows[(rows["n"] >= first) & ((rows["n"] - first) % stride == 0)][[by, *order, "n"]]

    kinds = dict(turns.dtypes)
    shape = ", ".join(f"{c} {kinds[c]}" for c in [by, *order])
    return turns.select(by, *order).groupBy(by).applyInPandasWithState(count, f"{shape}, n long", "n long", "append", "NoTimeout")


def lease_state(log: DataFrame, now: str, by: str = "group_id") -> DataFrame:
    """(by, state, attempts, retry_at) of work items from their log (by, ts, event: claim, success, failed, limited).

    A claim older than the lease is pending again; a failure waits 30 * 2 ** (n - 1) seconds and is dead after
    three; hitting a rate limit doesn't count as an attempt. The clock is a parameter.
    """
    last = log.groupBy(by).agg(F.max_by(F.struct("event", "ts"), F.struct("ts", "event")).alias("l"), F.count_if(F.col("event") == "failed").alias("attempts"))
    t = F.to_timestamp(F.lit(now))
    stale = F.col("l.ts") < t - F.expr(f"INTERVAL {LEASE_SECONDS} SECONDS")
    state = (
        F.when(F.col("l.event") == "success", "success").when(F.col("attempts") >= ATTEMPTS, "dead_letter")
        .when((F.col("l.event") == "claim") & ~stale, "in_progress").when(F.col("l.event") == "failed", "failed").otherwise("pending")
    )
    wait = (BACKOFF * F.pow(F.lit(2.0), F.col("attempts") - 1)).cast("long")
    return last.select(by, state.alias("state"), "attempts", F.when(state == "failed", F.timestamp_seconds(F.unix_timestamp("l.ts") + wait)).alias("retry_at"))


def notices(events: DataFrame, key: list[str], column: str, order: str, seconds: int = 3600, late: str | None = "1 hour") -> DataFrame:
    """The first row of each key within each period (by time, then order); on a stream, for append, when the period is over,
    and without late, for complete, of all periods."""
    timed = events.withColumn(column, F.col(column).cast("timestamp"))
    timed = timed.withWatermark(column, late) if events.isStreaming and late else timed
    first = F.min_by(F.struct(*events.columns), F.struct(column, order)).alias("e")
    return timed.groupBy(*key, F.window(column, f"{seconds} seconds").alias("_w")).agg(first).select("e.*")


def notices_now(events: DataFrame, key: list[str], column: str, seconds: int = 3600, late: str = "1 hour") -> DataFrame:
    """A row of each key within each period, at once: the first that arrives; with period, the start of its period.

    Keys are kept until the watermark has passed them by late, and go then.
    """
    timed = events.withColumn(column, F.col(column).cast("timestamp"))
    timed = timed.withColumn("period", F.window(column, f"{seconds} seconds")["start"])
    if not events.isStreaming:
        return timed.dropDuplicates([*key, "period"])
    return timed.withWatermark(column, late).dropDuplicatesWithinWatermark([*key, "period"])


@query("tumbling_throughput", "SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def _tumbling(spark, d):
    """All windows, the last ones too."""
    out = run_now(tumbling(stream_of(spark, d, "events"), late=None), "complete")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("total", 4).alias("total"))


@query("session_grouping", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS \"end\", count(*) AS n FROM s GROUP BY user_id, k")
def _sessions(spark, d):
    """All sessions, the last ones too."""
    out = run_now(sessions(stream_of(spark, d, "events"), late=None), "complete")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("write_behind", "SELECT DISTINCT user_id, event_type FROM events")
def _behind(spark, d):
    out = shared(spark)
    write_behind(stream_of(spark, d, "events").select("user_id", "event_type"), ["user_id", "event_type"], f"{out}/rows", f"{out}/state").awaitTermination()
    return spark.read.parquet(f"{out}/rows").select("user_id", "event_type")


@query("sliding_turn_window", "WITH n AS (SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 3 AS win FROM conversations) SELECT conv_id, win AS \"window\", sha256(string_agg(text, chr(10) ORDER BY turn)) AS text FROM n GROUP BY ALL")
def _turns(spark, d):
    turns = stream_of(spark, d, "conversations").select("conv_id", "turn", "text")
    out = run_now(turn_windows_stream(turns), "update", ["conv_id", "window"])
    return out.withColumn("text", F.sha2(F.col("text").cast("binary"), 256))


@query("turn_windows", "WITH n AS (SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 3 AS win FROM conversations) SELECT conv_id, win AS \"window\", sha256(string_agg(text, chr(10) ORDER BY turn)) AS text FROM n GROUP BY ALL")
def _turns_batch(spark, d):
    return turn_windows(read(spark, d, "conversations")).withColumn("text", F.sha2(F.col("text").cast("binary"), 256))


@query("gist_stride", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n >= 10 AND (n - 10) % 5 = 0")
def _gist(spark, d):
    e = stream_of(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id")
    return run_now(gist_turns_stream(e, "user_id", ["ts", "event_id"])).select("user_id", "event_id")


_LOG = "(SELECT user_id AS group_id, ts, event_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'claim' WHEN 'click' THEN 'claim' WHEN 'purchase' THEN 'success' ELSE 'limited' END AS event FROM events)"


@query("claim_lease", f"WITH l AS (SELECT group_id, max_by(event, (ts, event)) AS event, max(ts) AS ts, count(*) FILTER (WHERE event = 'failed') AS attempts FROM {_LOG} GROUP BY 1), s AS (SELECT *, CASE WHEN event = 'success' THEN 'success' WHEN attempts >= 3 THEN 'dead_letter' WHEN event = 'claim' AND ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 3600 SECOND THEN 'in_progress' WHEN event = 'failed' THEN 'failed' ELSE 'pending' END AS state FROM l) SELECT group_id, state, attempts, CASE WHEN state = 'failed' THEN strftime(date_trunc('second', ts) + INTERVAL 1 SECOND * CAST(30 * pow(2, attempts - 1) AS INT), '%Y-%m-%d %H:%M:%S') END AS retry_at FROM s")
def _lease(spark, d):
    t = F.col("event_type")
    event = F.when(t == "error", "failed").when(t.isin("view", "click"), "claim").when(t == "purchase", "success").otherwise("limited")
    log = read(spark, d, "events").select(F.col("user_id").alias("group_id"), "ts", event.alias("event"))
    return lease_state(log, "2024-01-31 00:00:00").withColumn("retry_at", F.date_format("retry_at", "yyyy-MM-dd HH:mm:ss"))


@query("file_watch", "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type, floor(epoch(ts) / 3600) ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def _watch(spark, d):
    return run_now(notices(stream_of(spark, d, "events"), ["user_id", "event_type"], "ts", "event_id", late=None), "complete").select("event_id")


@query("file_watch_now", "SELECT DISTINCT user_id, event_type, time_bucket(INTERVAL 1 HOUR, ts) AS period FROM events")
def _watch_now(spark, d):
    out = run_now(notices_now(stream_of(spark, d, "events").select("user_id", "event_type", "ts"), ["user_id", "event_type"], "ts"))
    return out.select("user_id", "event_type", F.col("period").cast("timestamp_ntz").alias("period"))


@query("claim_stream")
def _claims(spark, d):
    """Every change of every work item, with leases and back-offs that end, from the log of requests."""
    t = F.col("event_type")
    event = F.when(t == "error", "failed").when(t.isin("view", "click"), "claim").when(t == "purchase", "success").otherwise("limited")
    item = F.concat_ws("-", "user_id", F.floor(F.unix_timestamp("ts") / 86400))
    log = stream_of(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).select(item.alias("group_id"), "ts", event.alias("event"))
    out = with_rocksdb(spark, lambda: run_now(leases(log)))
    return out.select("group_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS").alias("ts"), "state", "attempts", F.date_format("until", "yyyy-MM-dd HH:mm:ss.SSS").alias("until"))
