"""A stored inverted index for keyword retrieval: postings in buckets of terms, updated from new rows only.

An index is a folder of Parquet tables:

  postings/bucket=B  (term, ids, lengths, positions, generation), sorted by term: lists of rows with the term; positions
                     are those of all the rows, the first of each row as -1 - position. A term's bucket follows from its
                     first two letters, so a term or a prefix of two letters and more is in one folder, and within it
                     the row groups' bounds leave few to be read
  rows               (id, length, generation): what has been indexed
  gone               (id, upto): of these ids, postings of generations up to upto don't count any more
  sums               (n, total, generation): rows and words added by a generation, and with a minus those taken
                     away; written last, so a generation counts once it is whole

A list is put together in the task that reads its rows, from some millions of words at a time, so what is shuffled is a
record for each term of so many words; a frequent term is many lists, dealt to several files. Adding rows appends files
and reads nothing of the index but its ids; changed rows are added again after `remove`.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X

#: Folders of postings.
BUCKETS = 64
#: Bytes of text, on average, of which the words of one bucket are written by one task; beyond it rows are dealt to more.
SALT_BYTES = 4 << 20
#: Rows of a list, as compacting makes them.
LIST_ROWS = 4096
#: Letters of a term that decide its bucket.
LEAD = 2
#: Words of a batch of rows that are put together at once.
_TOGETHER = 4_000_000


def bucket_of(term: Column, buckets: int = BUCKETS) -> Column:
    return (F.crc32(F.left(term, F.lit(LEAD)).cast("binary")) % buckets).cast("int")


def bucket_of_word(term: str, buckets: int = BUCKETS) -> int:
    """bucket_of, for a term that is at hand."""
    return zlib.crc32(term[:LEAD].encode()) % buckets


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, ids, lengths, positions) of rows (id, tokens)."""
    for whole in batches:
        sizes = np.cumsum(whole["tokens"].value_lengths().to_numpy())
        start = 0
        while start < len(whole):
            base = sizes[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, base + _TOGETHER, "right")))
            batch = whole.slice(start, end - start)
            start = end
            length = batch["tokens"].value_lengths().to_numpy()
            words = batch["tokens"].flatten().dictionary_encode()
            if not len(words):
                continue
            row = np.repeat(np.arange(len(batch), dtype=np.int32), length)
            place = np.arange(len(row), dtype=np.int32)
            place -= (np.cumsum(length) - length).astype(np.int32)[row]
            key = words.indices.to_numpy().astype(np.int64)
            key *= len(batch)
            key += row
            del row  # what is as long as the words goes as soon as it can
            order = np.argsort(key, kind="stable")
            key, place = key[order], place[order]
            del order
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))  # where a row's positions begin
            code, rows = np.divmod(key[first], len(batch))
            n = len(key)
            del key
            term = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))  # where a term's rows begin
            ends = np.append(term, len(first))
            begin = first[term]
            place[first] = -1 - place[first]
            of = lambda cuts, values: pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), values)
            yield pa.RecordBatch.from_arrays(
                [
                    words.dictionary.take(pa.array(code[term])), of(ends, batch["id"].take(pa.array(rows))), of(ends, pa.array(length[rows].astype(np.int32))),
                    of(np.append(begin, n), pa.array(place)),
                ],
                names=["term", "ids", "lengths", "positions"],
            )


_LISTS = "term string, ids array<{}>, lengths array<int>, positions array<int>"


class KeywordIndex:
    """The index in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.buckets = spark, path, buckets

    @classmethod
    def build(cls, items: DataFrame, path: str, id_col: str = "id", text: str = "content", buckets: int = BUCKETS) -> KeywordIndex:
        """A new index of items; path must not hold one."""
        index = cls(items.sparkSession, path, buckets)
        index._append(items.select(F.col(id_col).alias("id"), F.col(text).alias("text")), 0)
        index.spark.createDataFrame([], f"id {dict(items.dtypes)[id_col]}, upto int").write.parquet(f"{path}/gone")
        return index

    @functools.cached_property
    def _kind(self) -> str:
        return dict(self.spark.read.parquet(f"{self.path}/rows").dtypes)["id"]

    def _read(self, name: str) -> DataFrame:
        """A table of the index, by its known schema: no file is opened to find it out."""
        fields = {
            "postings": f"{_LISTS.format(self._kind)}, generation int, bucket int", "rows": f"id {self._kind}, length int, generation int",
            "gone": f"id {self._kind}, upto int", "sums": "n long, total long, generation int",
        }
        return self.spark.read.schema(fields[name]).parquet(f"{self.path}/{name}")

    def _state(self) -> tuple[int, int, list[int], bool]:
        """Rows, words, whole generations, and whether any row has been removed; one row of sums for each change."""
        sums = self._read("sums").collect()
        return sum(r["n"] for r in sums), sum(r["total"] for r in sums), [r["generation"] for r in sums if r["generation"] is not None], any(r["generation"] is None for r in sums)

    def _append(self, rows: DataFrame, generation: int) -> int:
        """Writes the postings of rows (id, text) as a generation; the sums come last and make it count."""
        kind = dict(rows.dtypes)["id"]
        tokens = rows.select("id", X.tokens(F.col("text")).alias("tokens"))
        sized = tokens.select("id", F.size("tokens").alias("length"))
        sized.withColumn("generation", F.lit(generation)).write.mode("append").parquet(f"{self.path}/rows")
        mine = self._read("rows").where(F.col("generation") == generation)
        n, total = mine.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
        salts = 1 + total * 6 // (SALT_BYTES * self.buckets)
        self._write(tokens.mapInArrow(_lists, _LISTS.format(kind)), generation, F.pmod(F.xxhash64(F.col("ids")[0]), F.lit(salts).cast("long")))
        self._sum(n, total, generation)
        return n

    def _write(self, lists: DataFrame, generation: int, salt: Column) -> None:
        placed = lists.withColumns({"bucket": bucket_of(F.col("term"), self.buckets), "generation": F.lit(generation), "_salt": salt})
        placed.repartition("bucket", "_salt").sortWithinPartitions("bucket", "term").drop("_salt").write.mode("append").partitionBy("bucket").parquet(f"{self.path}/postings")

    def _sum(self, n: int, total: int, generation: int | None) -> None:
        self.spark.createDataFrame([(n, int(total), generation)], "n long, total long, generation int").coalesce(1).write.mode("append").parquet(f"{self.path}/sums")

    def add(self, items: DataFrame, id_col: str = "id", text: str = "content") -> int:
        """Indexes the items whose ids aren't there (or were removed); the number of them. Nothing else is read or written."""
        last = self._read("rows").agg(F.coalesce(F.max("generation"), F.lit(-1))).first()[0]  # one that was broken off counts as used
        new = items.select(F.col(id_col).alias("id"), F.col(text).alias("text")).join(self.live_rows().select("id"), "id", "left_anti")
        return self._append(new, last + 1)

    def remove(self, ids: DataFrame, id_col: str = "id") -> int:
        """From now on the postings of ids don't count; the number of rows that go."""
        going = self.live_rows().join(ids.select(F.col(id_col).alias("id")).distinct(), "id", "left_semi").select("id", "length", F.col("generation").alias("upto"))
        n, total = going.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
        if n:
            going.select("id", "upto").write.mode("append").parquet(f"{self.path}/gone")
            self._sum(-n, -total, None)
        return n

    def _live(self, rows: DataFrame, state: tuple | None = None) -> DataFrame:
        """Rows with id and generation whose generation is whole and that haven't been removed."""
        _, _, whole, removed = state or self._state()
        rows = rows.where(F.col("generation").isin(whole))
        if not removed:
            return rows
        gone = self._read("gone").groupBy("id").agg(F.max("upto").alias("_upto"))
        return rows.join(gone, "id", "left").where(F.col("_upto").isNull() | (F.col("generation") > F.col("_upto"))).drop("_upto")

    def live_rows(self) -> DataFrame:
        return self._live(self._read("rows"))

    def _rows(self, lists: DataFrame, *columns: Column | str, placed: bool = True, state: tuple | None = None) -> DataFrame:
        """columns, id, length, tf and (placed) positions of the live rows of lists."""
        begin = F.expr("array_append(array_compact(transform(positions, (p, i) -> if(p < 0, i, null))), size(positions))")
        each = lists.withColumn("_begin", begin).select(*columns, "lengths", "_begin", "generation", *["positions"] * placed, F.posexplode("ids").alias("_k", "id"))
        tf = (F.col("_begin")[F.col("_k") + 1] - F.col("_begin")[F.col("_k")]).alias("tf")
        own = F.slice("positions", F.col("_begin")[F.col("_k")] + 1, F.greatest(tf, F.lit(0)))
        places = [F.transform(own, lambda p: F.when(p < 0, -1 - p).otherwise(p)).alias("positions")] * placed
        return self._live(each.select(*columns, "id", "generation", F.col("lengths")[F.col("_k")].alias("length"), tf, *places), state).drop("generation")

    def postings(self, terms: list[str], prefix: bool = False, placed: bool = True, state: tuple | None = None) -> DataFrame:
        """(q, id, length, tf, and, placed, positions): the postings of terms, numbered by q; with prefix, of all words
        that start with a term.

        Only the terms' buckets are read; a prefix shorter than LEAD letters is in all of them.
        """
        if not prefix or all(len(t) >= LEAD for t in terms):
            rows = self._read("postings").where(F.col("bucket").isin(sorted({bucket_of_word(t, self.buckets) for t in terms})))
        else:
            rows = self._read("postings")
        test = lambda t: F.col("term").startswith(t) if prefix else F.col("term") == t
        rows = rows.where(functools.reduce(lambda a, b: a | b, [test(t) for t in terms]))
        q = F.explode(F.array_compact(F.array(*[F.when(test(t), F.lit(i)) for i, t in enumerate(terms)])))
        return self._rows(rows.withColumn("q", q), "q", placed=placed, state=state)

    def bm25(self, terms: list[str], prefix: bool = False, placed: bool = False, k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """(id, tf, bm25) of every row with a term, tf by the terms' numbers; bm25 is negated, lower is better.

        placed adds places, the terms' positions.
        """
        n = len(terms)
        state = self._state()
        each = self.postings(terms, prefix, placed, state)
        here = lambda i, c: F.when(F.col("q") == i, c)
        tf = [F.coalesce(F.sum(here(i, F.col("tf"))), F.lit(0)).alias(f"tf{i}") for i in range(n)]
        places = [F.flatten(F.collect_list(here(i, F.col("positions")))).alias(f"p{i}") for i in range(n)] if placed else []
        rows = each.groupBy("id").agg(F.max("length").alias("length"), *tf, *places)
        count, mean = F.lit(float(state[0])), F.lit(state[1] / max(1, state[0]))
        stats = rows.agg(*[F.count_if(F.col(f"tf{i}") > 0).alias(f"_df{i}") for i in range(n)])  # one row
        score = F.lit(0.0)
        for i in range(n):
            idf = F.log(1 + (count - F.col(f"_df{i}") + 0.5) / (F.col(f"_df{i}") + 0.5))
            some = idf * F.col(f"tf{i}") * (k1 + 1) / (F.col(f"tf{i}") + k1 * (1 - b + b * F.col("length") / mean))
            score = score + F.when(F.col(f"tf{i}") > 0, some).otherwise(0.0)
        every = lambda name: F.array(*[F.col(f"{name}{i}") for i in range(n)])
        return rows.crossJoin(F.broadcast(stats)).select("id", every("tf").alias("tf"), *[every("p").alias("places")] * placed, (-score).alias("bm25"))

    def matches(self, compiled) -> DataFrame:
        """(id, bm25) of the rows that a compiled query (keyword.Compiled) matches."""
        if not compiled.ok:
            return self.live_rows().where("false").select("id", F.lit(0.0).alias("bm25"))
        scored = self.bm25(compiled.terms, compiled.prefix, placed=compiled.kind == "phrase")
        if compiled.kind == "any":
            return scored.select("id", "bm25")
        scored = scored.where(F.array_min("tf") > 0)
        if compiled.kind == "phrase":
            starts = F.col("places")[0]
            for i in range(1, len(compiled.terms)):
                starts = F.array_intersect(starts, F.expr(f"transform(places[{i}], x -> x - {i})"))
            scored = scored.where(F.size(starts) > 0)
        return scored.select("id", "bm25")

    def compact(self, path: str) -> KeywordIndex:
        """This index written anew under path, without what has been removed, as one generation."""
        out = KeywordIndex(self.spark, path, self.buckets)
        rows = self.live_rows().withColumn("generation", F.lit(0))
        rows.write.parquet(f"{path}/rows")
        salt = F.pmod(F.xxhash64("id"), F.lit(1 + rows.count() // LIST_ROWS).cast("long"))
        each = self._rows(self._read("postings"), "term").groupBy("term", salt.alias("_of")).agg(F.array_sort(F.collect_list(F.struct("id", "length", "positions"))).alias("p"))
        marked = F.transform("p", lambda r: F.transform(r["positions"], lambda x, i: F.when(i == 0, -1 - x).otherwise(x)))
        lists = each.select("term", F.col("p.id").alias("ids"), F.col("p.length").alias("lengths"), F.flatten(marked).alias("positions"), "_of")
        out._write(lists.drop("_of"), 0, F.pmod(F.xxhash64(F.col("ids")[0]), F.lit(1).cast("long")))
        rows.select("id", F.col("generation").alias("upto")).where("false").write.parquet(f"{path}/gone")
        n, total = rows.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
        out._sum(n, total, 0)
        return out


_BUILT: dict[tuple[str, str, str], KeywordIndex] = {}


def index_of(spark: SparkSession, sf_dir: str, table: str, id_col: Column, text: str) -> KeywordIndex:
    """The index of a table's texts; it is built once for the table's files as they are, in what all executors share."""
    from ..registry import read
    from ..streaming.jobs import shared

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{sf_dir}/{table}.parquet")
    state = files.agg(F.bit_xor(F.xxhash64("path", "modificationTime", "length"))).first()[0]
    key = (spark.sparkContext.applicationId, f"{sf_dir}/{table}", str(state))
    if key not in _BUILT:
        items = read(spark, sf_dir, table).select(id_col.alias("id"), F.col(text).alias("content"))
        _BUILT[key] = KeywordIndex.build(items, shared(spark))
    return _BUILT[key]
