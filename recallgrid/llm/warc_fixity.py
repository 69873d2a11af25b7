"""WARC records and a Merkle fixity audit of replicas.

A replica is a table of records (file_id, start, record): where each record starts in its file, and its
bytes. Records are hashed; ordered ranges of offsets are hashed from their records, wider ranges from the
narrower ones in them, up to one root per file. Two replicas' roots are compared, and only under nodes that
differ are the next narrower ranges compared, down to the records that are corrupt, missing or extra.

No group is larger than what fits a range (or FANOUT ranges), so a large file costs levels and not memory.
Digests are computed where a page is read; only they are shuffled, never the pages.

Defined results: null urls and bodies count as empty; rows that are equal in id, url and body are one record with
a number of copies; an empty table has no files. Records of one replica that claim the same place are compared
together, whatever their order. A body of any length is one record. Other columns are ignored.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table, thrifty

#: Bytes of a narrowest range, and how many ranges make a wider one.
RANGE = 1 << 16
FANOUT = 16
#: Records of a file, in expectation, when pages are laid out as files.
FILE_RECORDS = 1000

END = "\r\n"


def record_text(url: Column, body: Column, kind: str = "response") -> Column:
    """A WARC/1.0 record as text; its UTF-8 bytes are the record."""
    head = F.concat(
        F.lit(f"WARC/1.0{END}WARC-Type: {kind}{END}WARC-Target-URI: "), url, F.lit(f"{END}Content-Type: text/html{END}Content-Length: "), F.octet_length(body).cast("string"), F.lit(END + END)
    )
    return F.concat(head, body, F.lit(END + END))


def described(pages: DataFrame) -> DataFrame:
    """(page_id, url, name, n_bytes, digest, record) of each page, computed where it is read.

    A page's name is a hash of its id, its url and its record, each told apart by its length; so pages of equal
    names are equal.
    """
    one = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    with_record = one.select("page_id", "url", record_text(F.col("url"), F.col("html")).alias("record"))
    measured = with_record.withColumns({"n_bytes": F.octet_length("record").cast("long"), "digest": F.sha2(F.col("record").cast("binary"), 256)})
    sized = lambda c: F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)
    name = F.md5(F.concat(F.coalesce(sized(F.col("page_id").cast("string")), F.lit("-")), sized(F.col("url")), F.col("digest")))
    return measured.withColumn("name", name)


def placed(described_pages: DataFrame, file_records: int = FILE_RECORDS) -> DataFrame:
    """(page_id, copies, name, file_id, record_no, start, n_bytes, and the further columns) of each distinct page.

    A page's file follows from its name, a hash of the whole page, so no id or host can fill a file; within a
    file, pages are in order of id, url and name. What is shuffled is as wide as described_pages: records needn't
    be among its columns.
    """
    files = max(1, -(-described_pages.count() // file_records))
    more = [c for c in described_pages.columns if c not in ("page_id", "url", "name", "n_bytes")]
    distinct = described_pages.groupBy("name").agg(*[F.first(c).alias(c) for c in ("page_id", "url", "n_bytes", *more)], F.count("*").alias("copies"))
    in_file = distinct.withColumn("file_id", F.pmod(F.conv(F.substring("name", 1, 8), 16, 10).cast("long"), F.lit(files)))
    order = Window.partitionBy("file_id").orderBy("page_id", "url", "name")
    start = F.sum("n_bytes").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_bytes")
    return in_file.select("page_id", "copies", "name", "file_id", F.row_number().over(order).cast("long").alias("record_no"), start.alias("start"), "n_bytes", *more)


def laid_out(pages: DataFrame, file_records: int = FILE_RECORDS) -> DataFrame:
    """(page_id, copies, name, file_id, record_no, start, n_bytes, digest, record) of each distinct page."""
    return placed(described(pages), file_records)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, kind, url, body) of each record of .warc and .warc.gz files."""

    @thrifty
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, raw in zip(b["path"].to_pylist(), b["content"].to_pylist()):
                raw = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
                rows, at = [], 0
                while (stop := raw.find(b"\r\n\r\n", at)) >= 0 and raw[at : at + 5] == b"WARC/":
                    head = dict(x.split(b":", 1) for x in raw[at:stop].split(b"\r\n")[1:] if b":" in x)
                    head = {k.strip().lower(): v.strip().decode(errors="replace") for k, v in head.items()}
                    size = int(head.get(b"content-length", 0))
                    rows.append((name, at, head.get(b"warc-type"), head.get(b"warc-target-uri"), raw[stop + 4 : stop + 4 + size]))
                    at = stop + 4 + size
                    while raw[at : at + 2] == b"\r\n":
                        at += 2
                columns = list(zip(*rows)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()))], names=["file", "start", "kind", "url", "body"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(parse, "file string, start long, kind string, url string, body binary")


def leaves(records: DataFrame) -> DataFrame:
    """(file_id, start, digest) of each record of a replica (file_id, start, record)."""
    return records.select("file_id", "start", F.sha2(F.col("record").cast("binary"), 256).alias("digest"))


def places(leaf: DataFrame) -> DataFrame:
    """(file_id, start, digest) of each place. Records that claim one place have one digest together: of their number
    and of the sums of their digests' parts, which are aggregated piece by piece and never gathered."""
    parts = [F.sum(F.conv(F.substring("digest", 1 + 8 * k, 8), 16, 10).cast("long")).cast("string") for k in range(8)]
    many = F.sha2(F.concat_ws(",", F.count("*").cast("string"), *parts).cast("binary"), 256)
    return leaf.groupBy("file_id", "start").agg(F.when(F.count("*") == 1, F.min("digest")).otherwise(many).alias("digest"))


def tree(leaf: DataFrame, depth: int) -> list[DataFrame]:
    """Levels of (file_id, node, digest) over places: level k hashes ranges of RANGE * FANOUT ** k bytes; the last is the roots."""
    levels = []
    below = leaf.select("file_id", F.floor(F.col("start") / RANGE).cast("long").alias("node"), F.col("start").alias("at"), "digest")
    for _ in range(depth):
        parts = F.transform(F.array_sort(F.collect_list(F.struct("at", "digest"))), lambda x: F.concat(x["at"].cast("string"), F.lit(":"), x["digest"]))
        level = stored(below.groupBy("file_id", "node").agg(F.sha2(F.concat_ws(",", parts).cast("binary"), 256).alias("digest")))
        levels.append(level)
        below = level.select("file_id", F.floor(F.col("node") / FANOUT).cast("long").alias("node"), F.col("node").alias("at"), "digest")
    return levels


def differing(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Keys whose digests differ, or that only one side has."""
    other = b.select(*key, F.col("digest").alias("other"))
    return a.join(other, key, "full_outer").where("not (digest <=> other)")


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """(file_id, start, status) of each place where replica isn't as primary: corrupt, missing or extra.

    Both are tables of records (file_id, start, record).
    """
    return audit_leaves(leaves(primary), leaves(replica))


def audit_leaves(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """As audit, of tables of records' digests (file_id, start, digest)."""
    a, b = stored(places(primary)), stored(places(replica))
    last = max(x or 0 for t in (a, b) for x in t.agg(F.max("start")).first())
    depth = 1
    while last >= RANGE * FANOUT ** (depth - 1):
        depth += 1
    ta, tb = tree(a, depth), tree(b, depth)
    suspects = differing(ta[-1], tb[-1], ["file_id", "node"]).select("file_id", "node")
    for k in range(depth - 2, -1, -1):
        parents = suspects.select("file_id", F.col("node").alias("parent"))
        inside = lambda t: t.withColumn("parent", F.floor(F.col("node") / FANOUT).cast("long")).join(parents, ["file_id", "parent"], "left_semi").drop("parent")  # noqa: E731, B023
        suspects = stored(differing(inside(ta[k]), inside(tb[k]), ["file_id", "node"]).select("file_id", "node"))
    inside = lambda t: t.withColumn("node", F.floor(F.col("start") / RANGE).cast("long")).join(suspects, ["file_id", "node"], "left_semi")
    status = F.when(F.col("other").isNull(), "missing").when(F.col("digest").isNull(), "extra").otherwise("corrupt")
    return differing(inside(a), inside(b), ["file_id", "start"]).select("file_id", "start", status.alias("status"))


def _mark(name: Column) -> Column:
    return F.conv(F.substring(name, 9, 8), 16, 10).cast("long")


def changed(record: Column) -> Column:
    """A record with its last character before the closing line ends changed."""
    at = F.length(record) - 4
    return F.overlay(record, F.when(F.substring(record, -5, 1) == "X", "Y").otherwise("X"), at, F.lit(1))


def damaged(records: DataFrame) -> DataFrame:
    """A replica (with name and record) with faults at places that follow from the records' names: one in 89 is lost,
    one in 61 has a character changed. For trying out and measuring audits."""
    mark = _mark(F.col("name"))
    return records.where(mark % 89 != 0).withColumn("record", F.when(mark % 61 == 0, changed(F.col("record"))).otherwise(F.col("record")))


def op5_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = described(table(spark, sf_dir, "pages"))
    # The replica that is audited is damaged() of the records; as its digests follow from a row alone, no record is shuffled.
    bad = F.when(_mark(F.col("name")) % 61 == 0, F.sha2(changed(F.col("record")).cast("binary"), 256)).otherwise(F.col("digest"))
    records = stored(placed(pages.withColumn("replica_digest", bad).drop("record")))
    replica = records.where(_mark(F.col("name")) % 89 != 0).select("file_id", "start", F.col("replica_digest").alias("digest"))
    found = audit_leaves(records.select("file_id", "start", "digest"), replica).withColumnRenamed("start", "start_offset")
    shown = records.select("page_id", "copies", "file_id", "record_no", F.col("start").alias("start_offset"), "n_bytes", F.col("digest").alias("record_sha256"))
    return shown.join(found, ["file_id", "start_offset"], "left").withColumn("status", F.coalesce("status", F.lit("ok")))


_ORACLE = r"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, url, 'WARC/1.0' || e || 'WARC-Type: response' || e || 'WARC-Target-URI: ' || url || e || 'Content-Type: text/html' || e || 'Content-Length: ' || strlen(html) || e || e || html || e || e AS record
      FROM p, (SELECT chr(13) || chr(10) AS e)),
n AS (SELECT *, md5(coalesce(strlen(CAST(page_id AS VARCHAR)) || ':' || page_id, '-') || strlen(url) || ':' || url || sha256(record)) AS name FROM h),
c AS (SELECT CAST(greatest(1, ceil(count(*) / 1000.0)) AS BIGINT) AS files FROM n),
d AS (SELECT name, min(page_id) AS page_id, min(url) AS url, min(record) AS record, count(*) AS copies FROM n GROUP BY name),
r AS (SELECT page_id, url, name, copies, record, CAST('0x' || name[1:8] AS BIGINT) % files AS file_id, CAST('0x' || name[9:16] AS BIGINT) AS mark FROM d, c),
s AS (SELECT *, CAST(strlen(record) AS BIGINT) AS n_bytes, sum(strlen(record)) OVER w - strlen(record) AS start, row_number() OVER w AS record_no FROM r WINDOW w AS (PARTITION BY file_id ORDER BY page_id, url, name ROWS UNBOUNDED PRECEDING))
SELECT page_id, copies, file_id, record_no, CAST(start AS BIGINT) AS start_offset, n_bytes, sha256(record) AS record_sha256,
       CASE WHEN mark % 89 = 0 THEN 'missing' WHEN mark % 61 = 0 THEN 'corrupt' ELSE 'ok' END AS status FROM s
"""

QUERIES = {"op5_warc_fixity": op5_warc_fixity}
ORACLES = {"op5_warc_fixity": _ORACLE}
