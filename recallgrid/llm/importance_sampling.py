"""Importance resampling towards a target corpus, over bucketed postings.

Features are runs of 1 to longest consecutive words; a feature's bucket is its crc32 modulo buckets. Each
task packs the postings (bucket, document, count) of its documents by slices of the buckets; the postings of
a slice meet both corpora's bucket totals in one group, where each bucket's gain is computed and multiplied
with the counts; what the slices contribute is summed by document. A group holds a share of the documents as
well (a salt), so a bucket that every document has is as many groups as the postings need; totals are summed
in each task first.

The draw is the Gumbel top-k form of sampling without replacement: weight plus noise that follows from the
document's id, highest first. Ranks come from counts by score (scores are whole and bounded: some 100,000
values at most), so no task ever sees all documents in order.

Defined results: a null or wordless text has no features and weight 0; texts are taken whole, however long;
equal ids have equal noise, each row keeps its own features and weight; of equal scores the smaller id comes
first, null ids last (their noise is that of the empty text); an empty table gives an empty result, an empty
target leaves gains of the documents' own counts. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import need_whole_ids, stored, table, thrifty, thrifty_pair
from .kernel import ALNUM, LOWER, runs_crc32, slices, words

BUCKETS = 10_000
#: Slices of the buckets; a document's weight is the sum of so many contributions at most.
SLICES = 16
#: Bytes of packed postings for which the groups of a slice are split once more.
SALT_BYTES = 128 << 20

_SLICE_BYTES = 4 << 20
_SPACE = np.frombuffer(b" ", np.uint8)


def features(data: np.ndarray, offsets: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(crc32, row) of each feature of a slice of lower-cased text, and the words of each row."""
    starts, ends, row = words(data, offsets, ALNUM)
    crc = runs_crc32(data, starts, ends)
    found, rows = [crc], [row]
    for n in range(2, longest + 1):  # the feature of n words goes on from that of its first n - 1
        if len(crc) < 2:
            break
        zero = np.zeros(len(crc) - 1, np.int64)
        crc = runs_crc32(data, starts[n - 1 :], ends[n - 1 :], runs_crc32(_SPACE, zero, zero + 1, crc[:-1]))
        whole = row[: len(crc)] == row[n - 1 :]
        found.append(crc[whole])
        rows.append(row[: len(crc)][whole])
    return np.concatenate(found), np.concatenate(rows), np.bincount(row, minlength=len(offsets) - 1)


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, longest: int = 1) -> DataFrame:
    """A stored table of packed postings and, with slice -1, of each row's id, number of words and of features.

    key tells rows apart; it is given when the table is written, and read from there ever after.
    """
    if buckets > SLICES << 16:
        raise ValueError(f"at most {SLICES << 16} buckets")

    @thrifty
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids, texts = batch.columns
            for i, j, data, offsets in slices(texts, _SLICE_BYTES):
                crc, row, n_words = features(LOWER[data], offsets, longest)
                each = np.arange(key, key + j - i, dtype=np.int64)
                key += j - i
                none = pa.nulls(j - i, pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(j - i, -1, np.int32)), pa.array(each), ids.slice(i, j - i), pa.array(n_words), pa.array(np.bincount(row, minlength=j - i)), none, none, none, none], names=names)
                if not len(crc):
                    continue
                bucket = crc.astype(np.int64) % buckets
                code, count = np.unique(((bucket % SLICES) * (j - i) + row) * (buckets // SLICES + 1) + bucket // SLICES, return_counts=True)
                place, inner = np.divmod(code, buckets // SLICES + 1)
                first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
                part, owner = np.divmod(place[first], j - i)
                size = np.diff(np.append(first, len(code))).astype(np.uint32)
                cuts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
                ends = np.append(cuts[1:], len(part))
                at = np.append(first, len(code))
                some = pa.nulls(len(cuts), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(part[cuts].astype(np.int32)), pa.array(np.full(len(cuts), each[0])), pa.nulls(len(cuts), ids.type), some, some,
                        *(pa.array([x[lo:hi].tobytes() for lo, hi in zip(cuts, ends)], pa.binary()) for x in (each[owner], size)),
                        *(pa.array([x[at[lo] : at[hi]].tobytes() for lo, hi in zip(cuts, ends)], pa.binary()) for x in (inner.astype(np.uint16), count.astype(np.uint32))),
                    ],
                    names=names,
                )

    names = ["slice", "key", "id", "n_words", "n_features", "owners", "sizes", "buckets", "counts"]
    kind = dict(docs.dtypes)[id_col]
    return stored(docs.select(id_col, text_col).mapInArrow(run, f"slice int, key long, id {kind}, n_words long, n_features long, owners binary, sizes binary, buckets binary, counts binary"))


def totals(packed: DataFrame, buckets: int, name: str) -> DataFrame:
    """(bucket, name): how often each bucket occurs; each task sends one row for each bucket at most."""

    @thrifty
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(SLICES * (buckets // SLICES + 1), np.int64)
        for batch in batches:
            for part, inner, count in zip(batch["slice"].to_numpy(), batch["buckets"], batch["counts"]):
                np.add.at(seen, np.frombuffer(inner.as_buffer(), np.uint16).astype(np.int64) * SLICES + part, np.frombuffer(count.as_buffer(), np.uint32))
        have = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(have), pa.array(seen[have])], names=["bucket", name])

    each = packed.where("slice >= 0").select("slice", "buckets", "counts").mapInArrow(run, f"bucket long, {name} long")
    return each.groupBy("bucket").agg(F.sum(name).alias(name))


def gains(s: np.ndarray, t: np.ndarray, all_s: int, all_t: int, buckets: int) -> np.ndarray:
    """floor(1000 ln of the buckets' smoothed shares in the target over those in the documents)."""
    s, t = s.astype(np.float64), t.astype(np.float64)
    return np.floor(1000 * np.log((t + 1) * float(all_s + buckets) / ((s + 1) * float(all_t + buckets)))).astype(np.int64)


def importance(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, longest: int = 1) -> DataFrame:
    """(key, id, n_words, n_features, weight) of each row of docs: weight is the floored mean of its features' gains."""
    packed = postings(docs, id_col, text_col, buckets, longest)
    aimed = postings(target.withColumn("_none", F.lit(None).cast("long")), "_none", text_col, buckets, longest)
    both = stored(totals(packed, buckets, "s").join(totals(aimed, buckets, "t"), "bucket", "full").select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t")))
    all_s, all_t, size = both.agg(F.coalesce(F.sum("s"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0))).first() + tuple(packed.agg(F.sum(F.octet_length("buckets"))).first())
    salts = 1 + 3 * (size or 0) // SALT_BYTES  # counts and owners take about twice what bucket numbers take

    @thrifty_pair
    def contributed(mine: pa.Table, sums: pa.Table) -> pa.Table:
        gain = np.zeros(buckets // SLICES + 1, np.int64)
        gain[sums["bucket"].to_numpy() // SLICES] = gains(sums["s"].to_numpy(), sums["t"].to_numpy(), all_s, all_t, buckets)
        keys, adds = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for owners, sizes, inner, count in zip(*(mine[c] for c in ("owners", "sizes", "buckets", "counts"))):
            each = gain[np.frombuffer(inner.as_buffer(), np.uint16)] * np.frombuffer(count.as_buffer(), np.uint32)
            size = np.frombuffer(sizes.as_buffer(), np.uint32).astype(np.int64)
            keys.append(np.frombuffer(owners.as_buffer(), np.int64))
            adds.append(np.add.reduceat(each, np.cumsum(size) - size))
        return pa.table({"key": np.concatenate(keys), "gain": np.concatenate(adds)})

    left = packed.where("slice >= 0").select("slice", F.pmod(F.xxhash64("key"), F.lit(salts).cast("long")).alias("salt"), "owners", "sizes", "buckets", "counts")
    right = both.select((F.col("bucket") % SLICES).cast("int").alias("slice"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"), "bucket", "s", "t")
    parts = left.groupBy("slice", "salt").cogroup(right.groupBy("slice", "salt")).applyInArrow(contributed, "key long, gain long")
    rows = packed.where("slice < 0").select("key", "id", "n_words", "n_features")
    every = rows.withColumn("gain", F.lit(0).cast("long")).unionByName(parts, allowMissingColumns=True)
    summed = every.groupBy("key").agg(F.max("id").alias("id"), F.max("n_words").alias("n_words"), F.max("n_features").alias("n_features"), F.sum("gain").alias("gain"))
    return summed.select("key", "id", "n_words", "n_features", F.when(F.col("n_features") > 0, F.expr("(gain - pmod(gain, n_features)) div n_features")).otherwise(F.lit(0)).cast("long").alias("weight"))


def noise(id_col: str, seed: str) -> F.Column:
    """Gumbel noise in thousandths, from the first 32 bits of sha256('<seed>:<id>')."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def drawn(weighted: DataFrame, percent: int = 10, least_words: int = 20, seed: str = "2024") -> DataFrame:
    """importance() with score and, for the rows drawn, rank: percent of the rows with least_words words, highest scores first."""
    scored = stored(weighted.withColumn("score", F.col("weight") + noise("id", seed)))
    able = scored.where(F.col("n_words") >= least_words)
    above = F.coalesce(F.sum("n").over(Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counted = able.groupBy("score").agg(F.count("*").alias("n")).select("score", "n", above.alias("above"), F.sum("n").over(Window.partitionBy()).alias("all"))
    cut = stored(counted.select("score", "above", F.expr(f"({int(percent)} * all) div 100").alias("most")).where("above < most"))
    place = F.col("above") + F.row_number().over(Window.partitionBy("score").orderBy(F.asc_nulls_last("id"), "key"))
    ranked = able.join(F.broadcast(cut), "score").withColumn("rank", F.when(place <= F.col("most"), place).cast("long"))
    rest = scored.where(F.col("n_words") < least_words).unionByName(able.join(F.broadcast(cut), "score", "left_anti"))
    return ranked.select(*scored.columns, "rank").unionByName(rest.withColumn("rank", F.lit(None).cast("long")))


def resampled(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, seed: str = "2024", id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, longest: int = 1) -> DataFrame:
    """(id, n_features, weight, score, rank) of each row of docs; rank is null for rows that aren't drawn."""
    out = drawn(importance(docs, target, id_col, text_col, buckets, longest), percent, least_words, seed)
    return out.select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    need_whole_ids(docs)
    return resampled(docs, table(spark, sf_dir, "benchmark")).withColumn("doc_id", F.col("doc_id").cast("long"))


_ORACLE = r"""
WITH tab AS (SELECT list_transform(range(0, 256), lambda b: list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS f FROM benchmark),
df AS (SELECT doc_id, f, count(*) AS n FROM (SELECT doc_id, unnest(w) AS f FROM d) GROUP BY ALL),
vocabulary AS (SELECT f FROM df UNION SELECT f FROM i),
bytes AS (SELECT f, hex(encode(f)) AS x FROM vocabulary),
octets AS (SELECT f, list_transform(range(0, len(x) // 2), lambda k: (instr('0123456789ABCDEF', x[2 * k + 1]) - 1) * 16 + instr('0123456789ABCDEF', x[2 * k + 2]) - 1) AS b FROM bytes),
hashed AS (SELECT f, xor(list_reduce(list_prepend(4294967295, b), lambda c, o: xor(c >> 8, t[(xor(c, o) & 255) + 1])), 4294967295) % 10000 AS bucket FROM octets, tab),
sums AS (SELECT bucket, sum(s) AS s, sum(t) AS t FROM (SELECT bucket, n AS s, 0 AS t FROM df JOIN hashed USING (f) UNION ALL SELECT bucket, 0, 1 FROM i JOIN hashed USING (f)) GROUP BY bucket),
whole AS (SELECT sum(s) AS all_s, sum(t) AS all_t FROM sums),
gain AS (SELECT bucket, CAST(floor(1000 * ln((CAST(t AS DOUBLE) + 1) * (CAST(all_s AS DOUBLE) + 10000) / ((CAST(s AS DOUBLE) + 1) * (CAST(all_t AS DOUBLE) + 10000)))) AS BIGINT) AS g FROM sums, whole),
per AS (SELECT doc_id, sum(n) AS n, sum(n * g) AS g FROM df JOIN hashed USING (f) JOIN gain USING (bucket) GROUP BY doc_id),
scored AS (SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_features, CAST(coalesce(floor(CAST(per.g AS DOUBLE) / per.n), 0) AS BIGINT) AS weight,
           list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(range(1, 9), lambda k: CAST(instr('0123456789abcdef', sha256('2024:' || d.doc_id)[k]) - 1 AS BIGINT))), lambda a, b: a * 16 + b) AS h
           FROM d LEFT JOIN per USING (doc_id)),
final AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) AS BIGINT) AS score FROM scored),
ranks AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, (10 * count(*) OVER ()) // 100 AS most FROM final WHERE n_features >= 20)
SELECT f.doc_id, f.n_features, f.weight, f.score, CAST(CASE WHEN r <= most THEN r END AS BIGINT) AS rank FROM final f LEFT JOIN ranks USING (doc_id)
"""

QUERIES = {"op13_importance_resampling": op13_importance_resampling}
ORACLES = {"op13_importance_resampling": _ORACLE}
