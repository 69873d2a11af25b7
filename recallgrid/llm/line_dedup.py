"""Line dedup by a deletion-neighbourhood join: repeated and nearly equal lines go, the earliest stays.

Lines are compared by their words. Two lines are near if one word inserted, deleted or changed makes them
equal and the shorter has at least `min_words` words; shorter lines must be equal. A line goes if an equal
or near line comes earlier, in order of document id and place in the text; this is judged on the input.

1. Equal lines meet by hash; all but the earliest go. In the same pass, lines are keyed by their halves:
   one edit leaves one half untouched, so a line that shares no half with another has no near line and
   goes no further. This loses no pair.
2. For the others, every variant with one word deleted is emitted as a hashed key with the place of the
   deletion, and so is the line itself. Equal variants with equal places are substitutions, a variant that
   equals a line is an insertion or deletion. Each line learns its earliest partner; nothing is paired up
   within a key.
3. The edit distance of each line and its partner is verified on their words before the line goes.

Records are packed binary and pre-aggregated within each map task; a common line costs a record per task.

Defined results: a null text stays null and counts no lines; lines without words always stay; the kept
lines are joined by line feeds. Rows whose id is null only lose what repeats within themselves. Rows
with equal ids are one document to each other: a line that only they have stays in each. Ids have to be whole
numbers. A text of any length is read whole: a slice of text is a few documents or one long one. Further columns
are kept as they are.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import buckets as B
from .common import joined_spread, n_buckets, need_whole_ids, only, stored, table, thrifty, thrifty_group, unused
from .kernel import SPACED, mix, runs_hash, slices, words

MIN_WORDS = 8
WORD = re.compile(r"[^\x20\x09-\x0D]+")
_U = np.uint64
_BASE, _BACK = 0x5851F42D4C957F2D, pow(0x5851F42D4C957F2D, -1, 1 << 64)
_32 = _U(32)
_LOW = _U(0xFFFFFFFF)
FULL, HALF, MANY, GONE, FLAGGED = range(5)
LINE, VARIANT = 0, 1


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base squared and so on, modulo 2**64."""
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


class Lines:
    """The lines of a slice of texts: rows, words, and hashes of any run of a line's words.

    A run's hash depends on its words alone, so a line with a word deleted has the hash of the line that
    results; it is put together from sums, without visiting the words again.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        feeds = np.flatnonzero(data == 10)
        per_row = 1 + np.diff(np.searchsorted(feeds, offsets))
        self.row = np.repeat(np.arange(len(per_row)), per_row)
        head = np.cumsum(per_row) - per_row
        self.number = np.arange(len(self.row)) - head[self.row]
        start = np.empty(len(self.row), np.int64)
        start[head] = offsets[:-1]
        start[self.number > 0] = feeds + 1
        edges = np.unique(np.append(start, len(data)))
        at, end, _ = words(data, edges, SPACED)
        self.first = np.searchsorted(at, start)
        self.size = np.diff(np.append(self.first, len(at)))
        h = runs_hash(data, at, end)
        line = np.repeat(np.arange(len(self.row)), self.size)
        longest = int(self.size.max()) if len(self.size) else 0
        self.up, self.down = powers(_BASE, longest + 1), powers(_BACK, longest + 1)
        self.sums = np.concatenate(([_U(0)], np.cumsum(h * self.up[np.arange(len(h)) - self.first[line]])))
        self.full = self.run(np.arange(len(self.row)), 0, self.size)

    def raw(self, line: np.ndarray, a, b) -> np.ndarray:
        """Sum for words a..b of lines, as if a were the first."""
        f = self.first[line]
        return (self.sums[f + b] - self.sums[f + a]) * self.down[a]

    def run(self, line: np.ndarray, a, b) -> np.ndarray:
        a = np.broadcast_to(a, line.shape)
        return mix(self.raw(line, a, b) + (b - a).astype(np.uint64) * _U(0x9E3779B97F4A7C15))

    def variants(self, line: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(line, deleted word, hash of what is left) for each word of lines."""
        size = self.size[line]
        each = np.repeat(line, size)
        k = np.arange(len(each)) - np.repeat(np.cumsum(size) - size, size)
        f = self.first[each]
        left = self.sums[f + k] - self.sums[f] + (self.sums[f + self.size[each]] - self.sums[f + k + 1]) * _U(_BACK)
        return each, k, mix(left + (self.size[each] - 1).astype(np.uint64) * _U(0x9E3779B97F4A7C15))

    def halves(self, line: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
        """(line, key): both halves of each line, for partners of the same length and of one more or less."""
        out_line, out_key = [], []
        for less in (0, 1):
            mine = line[self.size[line] - less >= min_words]
            whole = self.size[mine] - less
            half = whole // 2
            tag = whole.astype(np.uint64) * _U(2)
            out_line += [mine, mine]
            out_key += [mix(self.run(mine, 0, half) + tag), mix(self.run(mine, self.size[mine] - (whole - half), self.size[mine]) + tag + _U(1))]
        return np.concatenate(out_line), np.concatenate(out_key)

    def firsts(self) -> np.ndarray:
        """Lines with words that aren't equal to an earlier line of their row."""
        some = np.flatnonzero(self.size > 0)
        order = some[np.lexsort((some, self.full[some], self.row[some]))]
        new = np.ones(len(order), bool)
        new[1:] = (self.row[order][1:] != self.row[order][:-1]) | (self.full[order][1:] != self.full[order][:-1])
        return np.sort(order[new])


def line_slices(texts) -> Iterator[tuple[int, int, Lines]]:
    for i, j, data, offsets in slices(texts):
        yield i, j, Lines(data, offsets)


def equal_lines(docs: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, gone, flagged): hashes of lines that an earlier document has, and (32 bits of) hashes of
    lines that share a half with a different line."""
    parts = n_buckets(docs.sparkSession, docs)

    @thrifty
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = B.Packer(parts, narrow=False)
        for b in batches:
            ids = b["doc_id"].to_numpy(zero_copy_only=False)
            for i, j, ls in line_slices(b["text"]):
                yield from packer.full()
                line = ls.firsts()
                owner, full = ids[i:j][ls.row[line]], ls.full[line]
                order = np.lexsort((owner, full))
                line, owner, full = line[order], owner[order], full[order]
                begin = B.first_of(full)
                lead = owner == np.repeat(owner[begin], np.diff(np.append(begin, len(full))))
                packer.add(full[lead], owner[lead], FULL, full[lead])
                packer.add(full[~lead], owner[~lead], GONE, full[~lead], by_owner=True)
                # Of the lines that are earliest here, the halves.
                owner_of = np.zeros(len(ls.row), np.int64)
                owner_of[line] = owner
                mine, key = ls.halves(np.sort(line[lead]), min_words)
                order = np.lexsort((ls.full[mine], key))
                mine, key = mine[order], key[order]
                begin = B.first_of(key)
                size = np.diff(np.append(begin, len(key)))
                if not len(key):
                    continue
                same = np.minimum.reduceat(ls.full[mine], begin) == np.maximum.reduceat(ls.full[mine], begin)
                met = np.repeat(~same, size)
                packer.add(key[~met], owner_of[mine[~met]], HALF, ls.full[mine[~met]])
                packer.add(key[met], owner_of[mine[met]], FLAGGED, ls.full[mine[met]], by_owner=True)
                some = begin[~same]
                packer.add(key[some], np.zeros(len(some), np.int64), MANY, key[some])
        yield from packer.rest()

    @thrifty_group
    def meet(rows: pa.Table) -> pa.Table:
        keys, owners, kinds = B.unpack(rows, narrow=False)
        fulls = B.unpack_extras(rows)
        gone, flagged = [kinds == GONE], [kinds == FLAGGED]
        gone, flagged = (owners[gone[0]], fulls[gone[0]]), (owners[flagged[0]], fulls[flagged[0]])
        take = np.flatnonzero(kinds == FULL)
        take = take[np.lexsort((owners[take], keys[take]))]
        if len(take):
            begin = B.first_of(keys[take])
            least = np.repeat(owners[take][begin], np.diff(np.append(begin, len(take))))
            late = take[owners[take] > least]
            gone = np.concatenate((gone[0], owners[late])), np.concatenate((gone[1], fulls[late]))
        take = np.flatnonzero((kinds == HALF) | (kinds == MANY))
        take = take[np.argsort(keys[take], kind="stable")]
        if len(take):
            begin = B.first_of(keys[take])
            met = (np.minimum.reduceat(fulls[take], begin) != np.maximum.reduceat(fulls[take], begin)) | (np.maximum.reduceat(kinds[take], begin) == MANY)
            mine = take[np.repeat(met, np.diff(np.append(begin, len(take)))) & (kinds[take] == HALF)]
            flagged = np.concatenate((flagged[0], owners[mine])), np.concatenate((flagged[1], fulls[mine]))
        owner, full = (np.concatenate((gone[k], flagged[k])) for k in (0, 1))
        return B.answers(owner, full, np.repeat(np.array([GONE, FLAGGED], np.int8), [len(gone[0]), len(flagged[0])]), parts)

    @thrifty_group
    def gather(rows: pa.Table) -> pa.Table:
        fulls, owners, kinds = B.unpack(rows, narrow=False)
        ids = np.unique(owners)
        out = {}
        for name, kind, values in (("gone", GONE, fulls), ("flagged", FLAGGED, (fulls >> _32).astype(np.uint32))):
            some, (mine,) = B.by_owner(owners[kinds == kind], values[kinds == kind])
            of = dict(zip(some.tolist(), mine))
            out[name] = pa.array([of.get(i) for i in ids.tolist()], pa.binary())
        return pa.table({"doc_id": pa.array(ids, pa.int64()), **out})

    back = docs.mapInArrow(send, B.SCHEMA).repartition(parts, "bucket").groupBy("bucket").applyInArrow(meet, B.SCHEMA)
    return back.repartition(parts, "bucket").groupBy("bucket").applyInArrow(gather, "doc_id long, gone binary, flagged binary")


def near_partners(marked: DataFrame, parts: int) -> DataFrame:
    """(doc_id, line, partner_id, partner_line) of lines that have a near line earlier; marked is (doc_id, text, gone, flagged)."""

    @thrifty
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = B.Packer(parts, narrow=False)
        for b in batches:
            ids = b["doc_id"].to_numpy(zero_copy_only=False)
            for i, j, ls in line_slices(b["text"]):
                line = ls.firsts()
                bound = np.searchsorted(ls.row[line], np.arange(j - i + 1))
                chosen = []
                for r, (gone, flagged) in enumerate(zip(b["gone"].slice(i, j - i).to_pylist(), b["flagged"].slice(i, j - i).to_pylist())):
                    mine = line[bound[r] : bound[r + 1]]
                    full = ls.full[mine]
                    chosen.append(mine[np.isin((full >> _32).astype(np.uint32), np.frombuffer(flagged or b"", np.uint32)) & ~np.isin(full, np.frombuffer(gone or b"", np.uint64))])
                line = np.concatenate(chosen)
                each, k, key = ls.variants(line)
                at = ls.number.astype(np.uint64) << _32
                packer.add(ls.full[line], ids[i:j][ls.row[line]], LINE, at[line])
                packer.add(key, ids[i:j][ls.row[each]], VARIANT, at[each] + (k + 1).astype(np.uint64))
                yield from packer.full()
        yield from packer.rest()

    @thrifty_group
    def meet(rows: pa.Table) -> pa.Table:
        keys, owners, kinds = B.unpack(rows, narrow=False)
        extras = B.unpack_extras(rows)
        number, place = (extras >> _32).astype(np.int64), (extras & _LOW).astype(np.int64)
        found = []

        def earliest(order: np.ndarray, same: np.ndarray) -> None:
            """order: records by group, then earliest first; same: whether each has the group of the one before."""
            begin = np.flatnonzero(~same)
            lead = np.repeat(order[begin], np.diff(np.append(begin, len(order))))
            late = (owners[order] != owners[lead]) | (number[order] != number[lead])
            found.append((order[late], lead[late]))

        v = np.flatnonzero(kinds == VARIANT)
        order = v[np.lexsort((number[v], owners[v], place[v], keys[v]))]
        if len(order):
            same = np.append(False, (keys[order][1:] == keys[order][:-1]) & (place[order][1:] == place[order][:-1]))
            earliest(order, same)
        # A line and the variants that equal it: the line against the earliest variant, each variant against the line.
        lines_at = np.flatnonzero(kinds == LINE)
        lines_at = lines_at[np.lexsort((number[lines_at], owners[lines_at], keys[lines_at]))]
        lines_at = lines_at[B.first_of(keys[lines_at])]
        order = v[np.lexsort((number[v], owners[v], keys[v]))]
        if len(order) and len(lines_at):
            spot = np.searchsorted(keys[lines_at], keys[order])
            spot[spot == len(lines_at)] = 0
            hit = keys[lines_at][spot] == keys[order]
            v_hit, l_hit = order[hit], lines_at[spot[hit]]
            before = (owners[l_hit] < owners[v_hit]) | ((owners[l_hit] == owners[v_hit]) & (number[l_hit] < number[v_hit]))
            found.append((v_hit[before], l_hit[before]))
            head = B.first_of(keys[v_hit])
            found.append((l_hit[head][~before[head]], v_hit[head][~before[head]]))
        a, p = (np.concatenate([x[n] for x in found]) if found else np.zeros(0, np.int64) for n in (0, 1))
        return pa.table({"doc_id": owners[a], "line": number[a], "partner_id": owners[p], "partner_line": number[p]})

    sent = marked.mapInArrow(send, B.SCHEMA)
    pairs = sent.repartition(parts, "bucket").groupBy("bucket").applyInArrow(meet, "doc_id long, line long, partner_id long, partner_line long")
    best = pairs.groupBy("doc_id", "line").agg(F.min(F.struct("partner_id", "partner_line")).alias("p"))
    return best.select("doc_id", "line", "p.partner_id", "p.partner_line")


def split_words(line: str) -> list[str]:
    """The words of a line as the keys take them: parted by space and U+0009 to U+000D only."""
    return WORD.findall(line)


def within_one_edit(a: list[str], b: list[str]) -> bool:
    """Whether the word edit distance of a and b is at most one."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def verified(docs: DataFrame, partners: DataFrame) -> DataFrame:
    """(doc_id, gone): the hashes of lines whose partner really is within one edit."""
    wanted = partners.select("doc_id", "line").union(partners.select("partner_id", "partner_line")).distinct()
    wanted = stored(wanted.groupBy("doc_id").agg(F.collect_list("line").alias("lines")))

    @thrifty
    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, ls in line_slices(b["text"]):
                head = np.searchsorted(ls.row, np.arange(j - i))
                ids, number, text, full = [], [], [], []
                for r in range(j - i):
                    own = b["text"][i + r].as_py().split("\n")
                    for n in b["lines"][i + r].as_py():
                        if n < len(own):
                            ids.append(b["doc_id"][i + r].as_py())
                            number.append(n)
                            text.append(own[n])
                            full.append(int(ls.full[head[r] + n].view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(number, pa.int64()), pa.array(text, pa.string()), pa.array(full, pa.int64())], names=["doc_id", "line", "words", "full"])

    @thrifty
    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([within_one_edit(split_words(x.as_py()), split_words(y.as_py())) for x, y in zip(b["words"], b["partner_words"])], pa.bool_())).select(["doc_id", "full"])

    with_lines = only(docs, stored(wanted.select("doc_id")), "doc_id").join(wanted, "doc_id").where("text is not null")
    found = stored(with_lines.select("doc_id", "text", "lines").mapInArrow(pick, "doc_id long, line long, words string, full long"))
    # A line that is the partner of very many is joined by broadcast, so that they needn't meet in one task.
    followers = partners.groupBy("partner_id", "partner_line").agg(F.count("*").alias("followers"))
    partner = found.select(F.col("doc_id").alias("partner_id"), F.col("line").alias("partner_line"), F.col("words").alias("partner_words")).join(followers, ["partner_id", "partner_line"])
    own = stored(partners.join(found, ["doc_id", "line"]))
    held = joined_spread(own, stored(partner), ["partner_id", "partner_line"], "followers", "inner", 2000).select("doc_id", "full", "words", "partner_words")
    return held.mapInArrow(hold, "doc_id long, full long").distinct().groupBy("doc_id").agg(F.collect_list("full").alias("near"))


def gone_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, gone, near): the hashes of each document's lines that go because of other lines."""
    need_whole_ids(docs)
    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marks = stored(equal_lines(texts, min_words))
    flagged = marks.where("flagged is not null")
    near = only(texts, stored(flagged.select("doc_id")), "doc_id").join(flagged, "doc_id")
    partners = stored(near_partners(near, n_buckets(docs.sparkSession, docs)))
    close = verified(texts, partners)
    return marks.select("doc_id", "gone").where("gone is not null").join(close, "doc_id", "full_outer")


ADDED = ["_lines", "_removed"]


def rewritten(docs: DataFrame, min_words: int = MIN_WORDS, columns: list[str] = ADDED) -> DataFrame:
    """docs with the lines that go removed from text, and two columns: how many lines there were and went.

    columns names the added columns; docs must not have them.
    """
    if clash := {c.lower() for c in docs.columns} & {c.lower() for c in columns}:
        raise ValueError(f"docs already has columns {sorted(clash)}; give other names in columns")
    id_col, gone_col, near_col = unused(docs, "_id", "_gone", "_near")
    gone = stored(gone_lines(docs.select("doc_id", "text"), min_words)).withColumnsRenamed({"doc_id": id_col, "gone": gone_col, "near": near_col})
    joined = docs.join(gone, docs["doc_id"].cast("long") == gone[id_col], "left").drop(id_col)
    own_columns = docs.columns
    out = docs.withColumns({c: F.lit(0).cast("long") for c in columns}).schema

    @thrifty
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, ls in line_slices(b["text"]):
                text: list[str | None] = []
                n, removed = [], []
                again = ls.size > 0
                again[ls.firsts()] = False
                bound = np.searchsorted(ls.row, np.arange(j - i + 1))
                for r in range(j - i):
                    own = b["text"][i + r].as_py()
                    mine = slice(bound[r], bound[r + 1])
                    goes = again[mine]
                    keys = (b[gone_col][i + r].as_py() or b"") + np.array(b[near_col][i + r].as_py() or [], np.int64).tobytes()
                    if keys:
                        goes = goes | (np.isin(ls.full[mine], np.frombuffer(keys, np.uint64)) & (ls.size[mine] > 0))
                    n.append(len(goes) if own is not None else 0)
                    removed.append(int(goes.sum()))
                    text.append("\n".join([x for x, g in zip(own.split("\n"), goes) if not g]) if removed[-1] else own)
                part = b.slice(i, j - i)
                own_fields = [pa.array(text, pa.string()) if name == "text" else part[name] for name in own_columns]
                yield pa.RecordBatch.from_arrays([*own_fields, pa.array(n, pa.int64()), pa.array(removed, pa.int64())], names=[*own_columns, *columns])

    return joined.mapInArrow(cut, out)


@thrifty
def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sha = pa.array([hashlib.sha256((t or "").encode()).hexdigest() for t in b["text"].to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([b["doc_id"], b["_lines"], b["_removed"], sha], names=["doc_id", "n_lines", "n_removed", "kept_sha256"])


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return rewritten(docs).mapInArrow(digest, f"doc_id {dict(docs.dtypes)['doc_id']}, n_lines long, n_removed long, kept_sha256 string")


_ORACLE = r"""
WITH l AS (SELECT doc_id, i, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w
           FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL)),
k AS (SELECT doc_id, i, line, w, array_to_string(w, ' ') AS key, len(w) AS n, doc_id * 1000000 + i AS o FROM l),
f AS (SELECT key, min(o) AS o FROM k WHERE n > 0 GROUP BY key),
u AS MATERIALIZED (SELECT k.o, k.key, k.w, k.n FROM k JOIN f ON k.key = f.key AND k.o = f.o WHERE k.n >= 8),
v AS MATERIALIZED (SELECT o, n, p, array_to_string(list_concat(w[1 : p - 1], w[p + 1 :]), ' ') AS del FROM (SELECT o, n, w, unnest(range(1, n + 1)) AS p FROM u)),
sub AS (SELECT o FROM (SELECT o, min(o) OVER (PARTITION BY del, p) AS m FROM v) WHERE m < o),
ins AS (SELECT v.o AS a, u.o AS b FROM v JOIN u ON v.del = u.key AND v.n - 1 = u.n),
gone AS (SELECT o FROM sub UNION SELECT greatest(a, b) FROM ins),
m AS (SELECT k.*, n > 0 AND (k.o <> f.o OR k.o IN (SELECT o FROM gone)) AS g FROM k LEFT JOIN f USING (key)),
t AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE g) AS r, string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT g) AS kept FROM m GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_lines, coalesce(r, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents LEFT JOIN t USING (doc_id)
"""

QUERIES = {"op4_line_dedup": op4_line_dedup}
ORACLES = {"op4_line_dedup": _ORACLE}
