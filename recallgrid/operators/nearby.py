"""Pairs and neighbours of vectors by random hyperplanes in several tables, with every pair's cosine computed.

The chance that two vectors lie on the same side of a random plane is p = 1 - angle / pi. With b planes to a bucket
number and t tables, a pair at the threshold is missed with a chance of (1 - p**b)**t; b follows from the number of
vectors (about BUCKET_ROWS of random ones to a bucket), t from b and the recall that is asked for, so recall holds at
every size and only the number of tables changes. Closer pairs are missed less. No pair below the threshold is given.

A vector is shuffled once for each table. A bucket with more than CELL_ROWS rows is dealt out as pairs of chunks, so
no task holds more than two chunks; a pair that shares buckets of several tables is given by the first of them.
Where `tables_for` needs too many tables (low thresholds), every pair has to be looked at: `lifecycle.cross_pairs`,
`lifecycle.block_pairs` and `stores.knn_graph` do that, exactly.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RECALL = 0.99
BUCKET_ROWS, LEAST_BITS = 16384, 8
LEAST_CELL_ROWS, CELL_ROWS = 2048, 32768
MOST_TABLES = 128
SEED = 7
#: Bytes of vectors in one side of a cell where all pairs are looked at, and the rows and columns of scores that are
#: held of it at a time.
SHARE_BYTES = 32 << 20
TILE_ROWS, TILE_COLUMNS = 512, 2048


def bits_for(rows: int) -> int:
    return min(24, max(LEAST_BITS, math.ceil(math.log2(max(1, rows / BUCKET_ROWS)))))


def cell_rows_for(rows: int) -> int:
    """Four times a bucket of random vectors, so that only hot ones are split, in bounds."""
    return min(CELL_ROWS, max(LEAST_CELL_ROWS, rows * 4 >> bits_for(rows)))


def tables_for(threshold: float, bits: int, recall: float) -> int:
    """Tables with which a pair at the threshold is found with a chance of recall."""
    p = (1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi) ** bits
    need = 1 if p >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-p))
    if need > MOST_TABLES:
        raise ValueError(f"{need} tables would be needed at a cosine of {threshold}: compare all pairs instead")
    return need


def matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors (zero where there is no direction; shorter ones are filled up) and their lengths."""
    size = np.nan_to_num(np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), dtype=np.float64)).astype(np.int64)
    m = np.zeros((len(column), max(1, int(size.max(initial=0)))))
    m[np.arange(m.shape[1]) < size[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    m[~np.isfinite(m).all(axis=1)] = 0
    top = np.abs(m).max(axis=1, keepdims=True)
    m /= np.where(top > 0, top, 1)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm > 0, norm, 1), size


def grouped(rows: DataFrame, keys: list[str], run: Callable[[pa.Table], Iterator[pa.Table]], schema: str) -> DataFrame:
    """run on each group of rows with equal keys, one after the other in a partition; a group is all that is held, and
    what run yields goes out at once."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        holds = None
        for batch in batches:
            values = list(zip(*(batch[k].to_pylist() for k in keys)))
            start = 0
            for k in range(1, len(values) + 1):
                if k == len(values) or values[k] != values[start]:
                    if held and values[start] != holds:
                        for out in run(pa.Table.from_batches(held)):
                            yield from out.to_batches()
                        held = []
                    holds = values[start]
                    held.append(batch.slice(start, k - start))
                    start = k
        for out in run(pa.Table.from_batches(held)) if held else ():
            yield from out.to_batches()

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(each, schema)


KEYS = ["g", "dim", "tab", "code", "x", "y"]


def dealt(vectors: DataFrame, threshold: float, recall: float, seed: int, cell_rows: int | None) -> DataFrame:
    """vectors (id, g, f, embedding) in cells of KEYS, with the part of a split bucket that each row is of."""
    v = vectors.where("embedding is not null and size(embedding) > 0")
    count = v.count()
    bits, cell_rows = bits_for(count), cell_rows or cell_rows_for(count)
    tables = tables_for(threshold, bits, recall)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 4096):
                b = whole.slice(at, 4096)
                unit, size = matrix(b["embedding"])
                codes = np.zeros((len(b), tables), np.int32)
                for d in np.unique(size):
                    mine = np.flatnonzero(size == d)
                    planes = np.random.default_rng([seed, int(d)]).normal(size=(int(d), tables * bits))
                    sides = (unit[mine, : int(d)] @ planes > 0).reshape(len(mine), tables, bits)
                    codes[mine] = sides @ (1 << np.arange(bits))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(b) + 1, dtype=np.int32) * tables), pa.array(codes.ravel()))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(size.astype(np.int32)), lists], names=[*b.schema.names, "dim", "codes"])

    fields = ", ".join(f"{n} {t}" for n, t in v.dtypes)
    coded = v.mapInArrow(run, f"{fields}, dim int, codes array<int>")
    rows = coded.select("*", F.posexplode("codes").alias("tab", "code"))
    bucket = ["g", "dim", "tab", "code"]
    hot = rows.groupBy(*bucket).agg(F.count("*").alias("n")).where(F.col("n") > cell_rows).select(*bucket, F.ceil(F.col("n") / cell_rows).cast("int").alias("chunks"))
    # As hot buckets are at most one in cell_rows of the rows, they are broadcast; else all vectors would be shuffled twice.
    rows = rows.join(F.broadcast(hot), bucket, "left").withColumn("chunks", F.coalesce("chunks", F.lit(1))).withColumn("part", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    cells = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda d: F.struct(F.least("part", d).alias("x"), F.greatest("part", d).alias("y")))
    return rows.withColumn("cell", F.explode(cells)).select("*", "cell.x", "cell.y").drop("cell", "chunks")


def close(cell: pa.Table, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, row, cosine) of a cell's pairs that no earlier table has, by tiles; the cosine is summed in one order, so that
    equal vectors have equal ones."""
    unit, _ = matrix(cell["embedding"].combine_chunks())
    part, tab, x, y = cell["part"].to_numpy(), cell["tab"][0].as_py(), cell["x"][0].as_py(), cell["y"][0].as_py()
    codes = cell["codes"].combine_chunks().flatten().to_numpy().reshape(len(cell), -1)
    files = cell["f"].combine_chunks()
    known, f = files.is_valid().to_numpy(zero_copy_only=False), files.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    live = np.flatnonzero((unit != 0).any(axis=1))
    left, right = live[part[live] == x], live[part[live] == y]
    for at in range(0, len(left), TILE_ROWS):
        one = left[at : at + TILE_ROWS]
        for nth in range(0 if x != y else at // TILE_COLUMNS * TILE_COLUMNS, len(right), TILE_COLUMNS):
            two = right[nth : nth + TILE_COLUMNS]
            p, q = np.nonzero(unit[one] @ unit[two].T >= threshold - 1e-9)
            for k in range(0, len(p), 1 << 16):
                i, j = one[p[k : k + (1 << 16)]], two[q[k : k + (1 << 16)]]
                good = ~((f[i] == f[j]) & known[i])
                if x == y:
                    good &= i < j
                for t in range(tab):
                    good &= codes[i, t] != codes[j, t]
                i, j = i[good], j[good]
                s = (unit[i] * unit[j]).sum(1)
                if (s >= threshold).any():
                    yield i[s >= threshold], j[s >= threshold], s[s >= threshold]


def near_pairs(vectors: DataFrame, threshold: float, recall: float = RECALL, seed: int = SEED, cell_rows: int | None = None) -> DataFrame:
    """(a, b, score), a < b, of vectors (id, embedding, g, f) of equal g and, where f isn't null, of different f."""

    def run(cell: pa.Table) -> Iterator[pa.Table]:
        ids = cell["id"].to_numpy()
        for i, j, s in close(cell, threshold) if len(cell) > 1 else ():
            yield pa.table({"a": np.minimum(ids[i], ids[j]), "b": np.maximum(ids[i], ids[j]), "score": s})

    v = vectors.select(F.col("id").cast("long").alias("id"), "g", "f", "embedding").where("id is not null and g is not null")
    return grouped(dealt(v, threshold, recall, seed, cell_rows), KEYS, run, "a long, b long, score double")


def better(best: np.ndarray, whom: np.ndarray, row: np.ndarray, to: np.ndarray, score: np.ndarray) -> None:
    """Puts scores of rows where they belong among the rows' best; equal ones by id."""
    met = np.unique(row)
    top = best.shape[1]
    row, to, score = np.concatenate((row, np.repeat(met, top))), np.concatenate((to, whom[met].ravel())), np.concatenate((score, best[met].ravel()))
    order = np.lexsort((to, -score, row))
    row, to, score = row[order], to[order], score[order]
    nth = np.arange(len(row)) - np.searchsorted(row, row)
    keep = nth < top
    best[row[keep], nth[keep]], whom[row[keep], nth[keep]] = score[keep], to[keep]


def near_neighbours(vectors: DataFrame, top: int, threshold: float, recall: float = RECALL, seed: int = SEED, cell_rows: int | None = None) -> DataFrame:
    """(from_id, to_id, score): of each vector (id, embedding) the top others with cosine of at least threshold; ties
    to smaller ids. A cell gives top rows for each of its rows at most."""

    def run(cell: pa.Table) -> Iterator[pa.Table]:
        ids = cell["id"].to_numpy()
        best, whom = np.full((len(ids), top), -2.0), np.zeros((len(ids), top), np.int64)
        for i, j, s in close(cell, threshold):
            better(best, whom, np.concatenate((i, j)), ids[np.concatenate((j, i))], np.concatenate((s, s)))
        row, nth = np.nonzero(best > -2)
        yield pa.table({"from_id": ids[row], "to_id": whom[row, nth], "score": best[row, nth]})

    v = vectors.select(F.col("id").cast("long").alias("id"), F.lit(0).alias("g"), F.lit(None).cast("int").alias("f"), "embedding").where("id is not null")
    found = grouped(dealt(v, threshold, recall, seed, cell_rows), KEYS, run, "from_id long, to_id long, score double")
    w = Window.partitionBy("from_id").orderBy(F.desc("score"), "to_id")
    return found.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top).drop("_r")


def filled(cell: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A cell's vectors as they are (shorter ones are filled up), their numbers of components and their lengths."""
    lists = cell["embedding"].combine_chunks()
    size = lists.value_lengths().to_numpy(zero_copy_only=False)
    m = np.zeros((len(size), int(size.max(initial=0))))
    m[np.arange(m.shape[1]) < size[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return m, size, np.sqrt(np.einsum("ij,ij->i", m, m))


def shares_for(vectors: DataFrame, cell_rows: int | None = None) -> int:
    """Into how many shares all vectors are dealt, so that every two shares meet in one task: as few as fit in memory
    (a vector is copied once for each share), but enough for all cores."""
    rows, size = vectors.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(1))).first()
    if cell_rows:
        return max(1, -(-rows // cell_rows))
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    return max(-(-rows * 8 * max(1, size) // SHARE_BYTES), min(-(-rows // 1000), math.ceil(math.sqrt(4 * cores))), 1)


def document_pairs(leaves: DataFrame, pending: DataFrame, threshold: float = 0.92, recall: float = RECALL) -> DataFrame:
    """(a, b, score) of leaves (id, embedding, model, file, evolved_from) of one model and different files.

    Not given: a leaf and the one it evolved from, and pairs that wait for a review (pending: a, b in either order).
    """
    found = near_pairs(leaves.select("id", "embedding", F.col("model").alias("g"), F.col("file").alias("f")), threshold, recall)
    came = leaves.where("evolved_from is not null").select(F.col("id").alias("u"), F.col("evolved_from").alias("v"))
    out = pending.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(came)
    known = out.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()
    return found.join(known, ["a", "b"], "left_anti")
