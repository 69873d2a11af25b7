"""Streams over several micro-batches: leases against a plain replay, state that goes, late rows."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from recallgrid.plans import catalogue
from recallgrid.streaming import jobs, leases

START = datetime(2024, 1, 1)


def ms(t):
    return round(t.replace(tzinfo=timezone.utc).timestamp() * 1000)


@pytest.fixture
def feed(spark, tmp_path):
    """batches of rows -> a stream that takes one batch at a time."""

    def make(batches, schema):
        for k, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k:03d}")
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")

    return make


def run(stream, path):
    q = stream.writeStream.outputMode("append").format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows"), q.recentProgress


def replay(log, watermark):
    """Item by item: a dictionary, a loop, and time that passes between requests and up to the watermark."""
    out = []
    for g in sorted({r[0] for r in log}):
        status, tries, until = None, 0, None
        for _, ts, event in [*sorted((r for r in log if r[0] == g), key=lambda r: (r[1], r[2])), (g, watermark, "end of time")]:
            if until and until <= ts:
                status, at, until = "pending", until, None
                out.append((g, at, status, tries, None))
            new = None
            if event == "add" and status is None:
                new = ("pending", tries, None)
            elif event == "claim" and status in (None, "pending"):
                tries += 1
                new = ("in_progress", tries, ts + timedelta(hours=1))
            elif status == "in_progress":
                wait = ts + timedelta(seconds=30 * 2 ** (tries - 1))
                new = {"success": ("success", tries, None), "fatal": ("dead_letter", tries, None), "release": ("pending", tries, None), "limited": ("failed", tries, wait), "failed": ("failed", tries, wait) if tries < 3 else ("dead_letter", tries, None)}.get(event)
            if new:
                status, tries, until = new
                out.append((g, ts, *new))
    return sorted(out, key=str)


def test_leases_over_micro_batches_equal_a_replay(spark, feed, tmp_path):
    rng = random.Random(1)
    log, now = [], START
    for _ in range(260):
        now += timedelta(seconds=rng.choice([1, 5, 20, 40, 90, 700]))
        log.append((rng.randrange(8), now, rng.choice(["add", "claim", "claim", "claim", "failed", "failed", "limited", "release", "success" if rng.random() < 0.2 else "claim", "fatal" if rng.random() < 0.1 else "failed"])))
    log.append((99, now + timedelta(hours=3), "add"))
    batches = [log[i : i + 60] for i in range(0, len(log), 60)]
    for b in batches:
        rng.shuffle(b)
    stream = leases.leases(feed(batches, "group_id long, ts timestamp, event string"), late="0 seconds")
    rows, progress = leases.with_rocksdb(spark, lambda: run(stream, tmp_path))
    got = sorted(((r["group_id"], r["ts"], r["state"], r["attempts"], r["until"]) for r in rows.collect()), key=str)
    assert len(progress) >= len(batches)
    assert {r[2] for r in got} == {"pending", "in_progress", "failed", "dead_letter", "success"}
    assert got == replay(log, now + timedelta(hours=3))


def test_items_share_the_state_of_their_bucket(spark, feed, tmp_path):
    log = [(g, START + timedelta(minutes=m), e) for g in range(40) for m, e in ((0, "claim"), (g, "failed" if g % 2 else "release"))]
    log.append((99, START + timedelta(hours=3), "add"))
    stream = leases.leases(feed([log[:30], log[30:]], "group_id long, ts timestamp, event string"), late="2 hours", buckets=3)
    rows, progress = leases.with_rocksdb(spark, lambda: run(stream, tmp_path))
    got = sorted(((r["group_id"], r["ts"], r["state"], r["attempts"], r["until"]) for r in rows.collect()), key=str)
    assert got == replay(log, START + timedelta(hours=1))
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in progress) <= 3


def event_batches(hours=8):
    """An hour of events in each batch; the last batch also holds a row that is hours late."""
    out = []
    for h in range(hours):
        out.append([(h * 100 + k, k % 5, START + timedelta(hours=h, minutes=k), 1.0) for k in range(60)])
    out[-1].append((9999, 1, START, 1.0))
    return out


SCHEMA = "event_id long, user_id long, ts timestamp, value double"


def test_windows_are_appended_once_and_their_state_goes(spark, feed, tmp_path):
    rows, progress = run(jobs.tumbling(feed(event_batches(), SCHEMA), late="30 minutes"), tmp_path)
    got = sorted((r["start"], r["n"]) for r in rows.collect())
    last = START + timedelta(hours=7, minutes=59) - timedelta(minutes=30)
    assert got == [(START + timedelta(minutes=10 * k), 10) for k in range(48) if START + timedelta(minutes=10 * k + 10) <= last]
    state = [p["stateOperators"][0] for p in progress]
    assert max(s["numRowsTotal"] for s in state) <= 12  # windows of the last hour and a half, of 48
    assert sum(s["numRowsDroppedByWatermark"] for s in state) == 1


def test_sessions_are_appended_when_they_are_over(spark, feed, tmp_path):
    rows, progress = run(jobs.sessions(feed(event_batches(), SCHEMA), gap="3 minutes", late="10 minutes"), tmp_path)
    got = sorted((r["user_id"], r["start"]) for r in rows.collect())
    watermark = START + timedelta(hours=7, minutes=49)
    want = sorted((k % 5, START + timedelta(hours=h, minutes=k)) for h in range(8) for k in range(60) if START + timedelta(hours=h, minutes=k + 3) <= watermark)
    assert got == want
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in progress) <= 90  # of 480


def test_notices_come_at_once_and_once(spark, feed, tmp_path):
    batches = [[(1, 1, START, 0.0), (2, 1, START + timedelta(minutes=5), 0.0), (3, 2, START, 0.0)], [(4, 1, START + timedelta(minutes=59), 0.0), (5, 1, START + timedelta(minutes=61), 0.0)], [(6, 3, START + timedelta(hours=9), 0.0)], [(7, 3, START + timedelta(hours=9), 0.0), (8, 1, START, 0.0)]]
    rows, progress = run(jobs.notices_now(feed(batches, SCHEMA), ["user_id"], "ts"), tmp_path)
    got = sorted((r["user_id"], r["period"]) for r in rows.select("user_id", "period").collect())
    assert got == [(1, START), (1, START + timedelta(hours=1)), (2, START), (3, START + timedelta(hours=9))]
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] <= 2


def test_first_rows_of_periods_are_appended_when_the_period_is_over(spark, feed, tmp_path):
    rows, _ = run(jobs.notices(feed(event_batches(), SCHEMA), ["user_id"], "ts", "event_id", late="10 minutes"), tmp_path)
    assert sorted(r["event_id"] for r in rows.collect()) == [h * 100 + k for h in range(7) for k in range(5)]


def test_a_table_is_streamed_whether_it_is_a_file_or_a_folder(spark, tmp_path):
    rows = spark.createDataFrame([(1, t, "user", f"t{t}") for t in range(5)], "conv_id long, turn long, role string, text string")
    rows.repartition(1).sortWithinPartitions("turn").write.parquet(f"{tmp_path}/folder/conversations.parquet")
    (tmp_path / "file").mkdir()
    part = next((tmp_path / "folder/conversations.parquet").glob("part-*"))
    (tmp_path / "file/conversations.parquet").write_bytes(part.read_bytes())
    for kind in ("file", "folder"):
        assert catalogue.queries()["sliding_turn_window"](spark, f"{tmp_path}/{kind}").count() == 2


@pytest.mark.parametrize("name, rows", [("tumbling_throughput", 2), ("session_grouping", 3), ("file_watch", 3)])
def test_what_is_open_when_the_files_end_comes_out_too(spark, tmp_path, name, rows):
    events = [(k, u, "view", START + timedelta(minutes=m), 1.0) for k, (u, m) in enumerate([(1, 0), (1, 1), (1, 70), (2, 71)])]
    spark.createDataFrame(events, "event_id long, user_id long, event_type string, ts timestamp, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/events.parquet")
    assert catalogue.queries()[name](spark, str(tmp_path)).count() == rows
