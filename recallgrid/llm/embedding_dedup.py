"""Near-duplicate vectors by cross-polytope hashing.

A vector is padded to a power of two and turned by three rounds of random signs and a fast Hadamard transform; the
largest coordinate, with its sign, is its hash (Andoni et al., Practical and Optimal LSH for Angular Distance,
2015). A table's key is two such hashes. A vector lives in its own bucket of each table and is also compared with
those that live in its next best buckets (multiprobe). Every candidate pair's cosine is computed in double
precision from the vectors themselves, so no link is wrong; with the defaults a pair at cosine 0.93 of 64
dimensions is found with a chance of 0.999, closer pairs more surely.

Equal vectors of a label are one class with a weight. A bucket with more than CELL rows is dealt out as pairs of
chunks. Inside a cell cosines are products of blocks; a cell reports numbers of links and, of what its links join,
one link for each vector, never pairs. A pair that meets in several buckets counts in the first of them only, which both
vectors' keys tell.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and those without a
label, link with nothing; vectors of different lengths don't link; rows with equal ids are rows of their own (a
component is named by the smallest id in it, nulls left out); an empty table gives an empty result. Other columns
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, joined_spread, stored, table, thrifty
from .components import components

TABLES, HASHES, PROBES = 6, 2, 4
#: Rows of a bucket beyond which it is dealt out as pairs of chunks.
CELL = 2048
SEED = 2015

#: Coordinates of a rotation that multiprobe looks at, largest first.
_LOOK = 6
_ROWS = 2048
_BLOCK = 256


def hadamard(x: np.ndarray) -> np.ndarray:
    """The normalised Walsh-Hadamard transform of each row; rows have a power of two of columns."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(n, d)
        h *= 2
    return x / math.sqrt(d)


def codes(unit: np.ndarray, tables: int, probes: int, seed: int) -> np.ndarray:
    """Bucket numbers (row, table, probe) of unit vectors: each table's own bucket first, then the next best; -1 where there are fewer."""
    d = 1 << max(0, unit.shape[1] - 1).bit_length()
    signs = np.random.default_rng([seed, d]).choice([-1.0, 1.0], size=(tables, HASHES, 3, d))
    padded = np.zeros((len(unit), d))
    padded[:, : unit.shape[1]] = unit
    out = np.full((len(unit), tables, probes), -1, np.int32)
    look = min(_LOOK, d)
    for t in range(tables):
        code, loss = np.zeros((len(unit), 1), np.int64), np.zeros((len(unit), 1))
        for k in range(HASHES):
            x = padded
            for s in signs[t, k]:
                x = hadamard(x * s)
            best = np.argsort(-np.abs(x), axis=1, kind="stable")[:, :look]
            value = np.take_along_axis(x, best, 1)
            mine, short = best * 2 + (value < 0), (np.abs(value[:, :1]) - np.abs(value)) ** 2
            code = (code[:, :, None] * (2 * d) + mine[:, None, :]).reshape(len(unit), -1)
            loss = (loss[:, :, None] + short[:, None, :]).reshape(len(unit), -1)
        order = np.argsort(loss, axis=1, kind="stable")[:, :probes]
        out[:, t, : order.shape[1]] = np.take_along_axis(code, order, 1)
    return out


def unit_rows(raw: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision; scaled first, so that squares neither overflow nor vanish."""
    x = raw.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def packed(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, dim, vec): vec is the vector's bytes, null for those that link with nothing."""
    width = "f4" if dict(vectors.dtypes)[vector_col] == "array<float>" else "f8"
    types = dict(vectors.dtypes)

    @thrifty
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, column, labels = batch.columns
            vecs: list[bytes | None] = []
            for x in column:
                flat = x.values
                ok = x.is_valid and len(flat) > 0 and flat.null_count == 0
                values = flat.to_numpy(zero_copy_only=False).astype(width) if ok else None
                vecs.append(values.tobytes() if ok and np.isfinite(values).all() and values.any() else None)
            dims = pa.array([None if v is None else len(v) // np.dtype(width).itemsize for v in vecs], pa.int32())
            yield pa.RecordBatch.from_arrays([ids, labels, dims, pa.array(vecs, pa.binary())], names=["id", "label", "dim", "vec"])

    rows = vectors.select(id_col, vector_col, label_col).mapInArrow(run, f"id {types[id_col]}, label {types[label_col]}, dim int, vec binary")
    return rows.withColumn("vec", F.when(F.col("label").isNotNull(), F.col("vec")))


def hashed(classes: DataFrame, width: str, tables: int, probes: int, seed: int) -> DataFrame:
    """classes with codes: the numbers of their buckets, table by table."""

    @thrifty
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), _ROWS):
                batch = whole.slice(at, _ROWS)
                dims, vecs = batch["dim"].to_numpy(), batch["vec"]
                out = np.full((len(batch), tables * probes), -1, np.int32)
                for d in np.unique(dims):
                    mine = np.flatnonzero(dims == d)
                    raw = np.frombuffer(b"".join(vecs[int(i)].as_py() for i in mine), width).reshape(-1, d)
                    out[mine] = codes(unit_rows(raw), tables, probes, seed).reshape(len(mine), -1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1, dtype=np.int32) * (tables * probes)), pa.array(out.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "codes"])

    fields = ", ".join(f"{n} {t}" for n, t in classes.dtypes)
    return classes.mapInArrow(run, f"{fields}, codes array<int>")


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n places, the smallest place that the pairs (i, j) join it with."""
    root = np.arange(n)
    while True:
        old = root.copy()
        low = np.minimum(root[i], root[j])
        np.minimum.at(root, root[i], low)
        np.minimum.at(root, root[j], low)
        root = root[root]
        if (root == old).all():
            return root


def linked(cell: pa.Table, width: str, least: float, tables: int, probes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(class, links that count here, class it is joined with) of a cell's rows that have a link in it."""
    cell = cell.sort_by("cls")
    cls, weight, part, probe = (cell[c].to_numpy() for c in ("cls", "weight", "part", "probe"))
    home = np.flatnonzero(probe == 0)
    if not len(home) or len(cls) < 2:
        return None
    t, across = cell["tab"][0].as_py(), cell["x"][0].as_py() != cell["y"][0].as_py()
    raw = np.frombuffer(b"".join(cell["vec"].to_pylist()), width).reshape(len(cls), -1)
    unit = unit_rows(raw)
    keys = cell["codes"].combine_chunks().flatten().to_numpy().reshape(len(cls), tables, probes)
    left, right = [], []
    for at in range(0, len(home), _BLOCK):
        rows = home[at : at + _BLOCK]
        cosine = unit[rows] @ unit.T
        close = np.abs(cosine - least) < 1e-9
        for a, b in zip(*np.nonzero(close)):  # decided by sums without rounding
            x, y = raw[rows[a]].astype(np.float64).tolist(), raw[b].astype(np.float64).tolist()
            cosine[a, b] = math.fsum(map(float.__mul__, x, y)) / math.sqrt(math.fsum(map(float.__mul__, x, x)) * math.fsum(map(float.__mul__, y, y)))
        good = cosine >= least
        good &= (probe > 0)[None, :] | (np.arange(len(cls))[None, :] > rows[:, None])  # two that live here are compared once
        good &= (part[rows][:, None] != part[None, :]) if across else (part[rows][:, None] == part[None, :])
        a, b = np.nonzero(good)
        left.append(rows[a])
        right.append(b)
    i, j = np.concatenate(left), np.concatenate(right)
    if not len(i):
        return None
    first = np.ones(len(i), bool)
    for s in range(t):
        for p in range(probes):
            first &= (keys[i, s, 0] != keys[j, s, p]) & ((keys[j, s, 0] != keys[i, s, p]) | (p == 0))
    # Both may live in a bucket that the other probes: then the one of the smaller class counts.
    late = (probe[j] > 0) & (cls[j] < cls[i])
    for p in range(1, probes):
        first &= ~(late & (keys[j, t, 0] == keys[i, t, p]))
    n = len(cls)
    links = np.bincount(i[first], weight[j[first]], n) + np.bincount(j[first], weight[i[first]], n)
    root = roots(n, i, j)
    have = np.unique(np.concatenate((i, j)))
    return cls[have], links[have].astype(np.int64), cls[root[have]]


def near_duplicates(vectors: DataFrame, least: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", tables: int = TABLES, probes: int = PROBES, seed: int = SEED, cell_rows: int = CELL) -> DataFrame:
    """(id, n_links, component_id, kept) of each row: links to other rows of its label with cosine least or more."""
    width = "f4" if dict(vectors.dtypes)[vector_col] == "array<float>" else "f8"
    rows = packed(vectors, id_col, vector_col, label_col).withColumn("digest", F.unhex(F.sha2("vec", 256)))
    rows = stored(rows)
    grouped = rows.where("vec is not null").groupBy("label", "dim", "vec", "digest").agg(F.count("*").alias("weight"), F.min("id").alias("least_id"))
    classes = stored(grouped.withColumn("cls", F.monotonically_increasing_id()))
    keyed = stored(hashed(classes.select("cls", "label", "dim", "weight", "vec"), width, tables, probes, seed))

    cell = ["label", "dim", "tab", "code"]
    place = F.posexplode("codes").alias("at", "code")
    where = [(F.col("at") / probes).cast("int").alias("tab"), (F.col("at") % probes).alias("probe")]
    sizes = keyed.select("label", "dim", place).where("code >= 0").select("label", "dim", where[0], "code").groupBy(*cell).agg(F.count("*").alias("size"))
    hot = stored(sizes.where(F.col("size") > cell_rows).select(*cell, F.ceil(F.col("size") / cell_rows).cast("int").alias("chunks")))
    spread = keyed.select("*", place).where("code >= 0").select("*", *where)
    if n := hot.count():
        spread = spread.join(F.broadcast(hot) if n <= BROADCAST_IDS else hot, cell, "left").withColumn("part", F.pmod(F.xxhash64("cls"), F.coalesce("chunks", F.lit(1))).cast("int"))
        pairs = F.transform(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1), lambda d: F.struct(F.least("part", d).alias("x"), F.greatest("part", d).alias("y")))
        spread = spread.withColumn("xy", F.explode(pairs)).withColumns({"x": F.col("xy.x"), "y": F.col("xy.y")})
    else:
        spread = spread.withColumns({c: F.lit(0) for c in ("part", "x", "y")})

    columns = [*cell, "x", "y", "part", "probe", "cls", "weight", "codes", "vec"]
    same = [*cell, "x", "y"]

    @thrifty
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        holds = None

        def done() -> Iterator[pa.RecordBatch]:
            if held and (found := linked(pa.Table.from_batches(held), width, least, tables, probes)):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["cls", "links", "root"])
            held.clear()

        for batch in batches:
            values = [batch[c].to_pylist() for c in same]
            keys = list(zip(*values))
            start = 0
            for k in range(1, len(keys) + 1):
                if k == len(keys) or keys[k] != keys[start]:
                    if keys[start] != holds:
                        yield from done()
                        holds = keys[start]
                    held.append(batch.slice(start, k - start))
                    start = k
        yield from done()

    dealt = spread.select(*columns).repartition(*same).sortWithinPartitions(*same)
    found = stored(dealt.mapInArrow(run, "cls long, links long, root long"))
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("cls").alias("u"), F.col("root").alias("v"))).select(F.col("node").alias("cls"), "component")
    named = classes.select("label", "digest", "cls", "weight", "least_id").join(links, "cls", "left").join(joined, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    named = stored(named.select("label", "digest", "weight", "least_id", "component", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")))
    names = stored(named.groupBy("component").agg(F.min("least_id").alias("component_id"), F.count("*").alias("classes")))
    of_class = stored(joined_spread(named, names, ["component"], "classes", "inner").select("label", "digest", "weight", "n_links", "component_id"))
    out = joined_spread(rows.where("vec is not null").select("id", "label", "digest"), of_class, ["label", "digest"], "weight", "inner").select("id", "n_links", "component_id")
    alone = rows.where("vec is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return out.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op12_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "embeddings"))
    return out.withColumns({c: F.col(c).cast("long") for c in ("vec_id", "component_id")})


_ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_inner_product(e, e) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS u, b.vec_id AS w FROM ok a JOIN ok b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT vec_id AS u, vec_id AS w FROM v UNION SELECT r.u, l.w FROM reach r JOIN links l ON l.u = r.w),
named AS (SELECT u, min(w) AS component_id FROM reach GROUP BY u),
counted AS (SELECT u, count(*) AS n FROM links GROUP BY u)
SELECT v.vec_id, coalesce(c.n, 0) AS n_links, CAST(component_id AS BIGINT) AS component_id, v.vec_id = component_id AS kept
FROM v JOIN named ON named.u = v.vec_id LEFT JOIN counted c ON c.u = v.vec_id
"""

QUERIES = {"op12_embedding_near_dedup": op12_embedding_near_dedup}
ORACLES = {"op12_embedding_near_dedup": _ORACLE}
