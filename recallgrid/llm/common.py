"""What the corpus operators share: reading tables, shared intermediate tables, size-checked semi-joins."""

from __future__ import annotations

import ctypes
import functools
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most ids that are broadcast to filter a table; beyond it the filter is a shuffled semi-join.
BROADCAST_IDS = 1_000_000

#: Bytes of text for which one bucket of packed keys is laid out.
BUCKET_TEXT_BYTES = 8 << 20

_LIBC = ctypes.CDLL(None)


def trim() -> None:
    """Gives what this Python worker has freed back to the system: workers live on, beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def thrifty(run: Callable) -> Callable:
    """run, a function over batches for mapInArrow or mapInPandas, that trims at its end."""

    @functools.wraps(run)
    def trimmed(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            trim()

    return trimmed


def thrifty_group(run: Callable) -> Callable:
    """run, a function of one group for applyInArrow, that trims at its end."""

    @functools.wraps(run)
    def trimmed(rows: pa.Table) -> pa.Table:
        try:
            return run(rows)
        finally:
            trim()

    return trimmed


def thrifty_pair(run: Callable) -> Callable:
    """run, a function of two groups for a cogroup's applyInArrow, that trims at its end."""

    @functools.wraps(run)
    def trimmed(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return run(left, right)
        finally:
            trim()

    return trimmed


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one where none is set (tests)."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if not found:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp"))
        sc.setCheckpointDir(found)
    return str(found)


def stored(df: DataFrame) -> DataFrame:
    """df written as a table in the shared folder and read back: lineage ends here, and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, *names: str) -> list[str]:
    """names, with underscores before those that df has a column of, so that added columns never clash."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        out.append(n)
    return out


def need_whole_ids(docs: DataFrame, id_col: str = "doc_id") -> None:
    """Refuses ids that aren't whole numbers: operators that order or pack ids take them as 64-bit integers."""
    kind = dict(docs.dtypes)[id_col]
    if kind not in ("bigint", "int", "smallint", "tinyint"):
        raise TypeError(f"{id_col} has to be a whole number (bigint, int, smallint or tinyint), not {kind}")


#: Rows of one key from which a join takes the key's other side by broadcast, so that it needn't land in one task.
HOT = 1000


def joined_spread(rows: DataFrame, keyed: DataFrame, keys: list[str], count: str, how: str = "left", row_bytes: int = 200) -> DataFrame:
    """rows joined (left or inner) with keyed, a stored table of one row for each key with the number of rows it meets in count.

    Keys with HOT rows or more are joined by broadcast (their number is at most a thousandth of the rows; its bound
    is checked), the others by a shuffle in which no key is large. count isn't in the result.
    """
    hot = keyed.where(F.col(count) >= HOT)
    n = hot.count()
    if not n or n * row_bytes > BROADCAST_IDS * 64:
        return rows.join(keyed.drop(count), keys, how)
    hot = F.broadcast(hot.drop(count))
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return rows.join(hot, keys).unionByName(rest.join(keyed.where(F.col(count) < HOT).drop(count), keys, how))


def only(df: DataFrame, ids: DataFrame, key: str | list[str], how: str = "left_semi") -> DataFrame:
    """Rows of df whose key is (left_semi) or isn't (left_anti) in ids, a stored table of keys.

    The ids are broadcast only when there are at most BROADCAST_IDS of them; otherwise Spark shuffles.
    """
    small = ids.count() <= BROADCAST_IDS  # a stored table's count is read from its footers
    return df.join(F.broadcast(ids) if small else ids, key, how)


def n_buckets(spark: SparkSession, docs: DataFrame, column: str = "text") -> int:
    """Buckets for packed keys: grows with the text, and is never below the shuffle partitions."""
    total = docs.agg(F.sum(F.octet_length(column))).first()[0] or 0
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + total // BUCKET_TEXT_BYTES)
