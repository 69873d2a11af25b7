"""Spelling variants: words one edit apart, by a positional q-gram inverted index with a count filter.

Words and their counts come from packed slices of text; all further work is on distinct words. Of two words one
edit apart, the first or the last half of the shorter one is untouched, so words are dealt into blocks by
(length, untouched half). A block with too many words has its rest halved again, as often as needed: its pairs
share one of the smaller halves as well. In a block, each word's padded trigrams over the rest are looked up with
their positions (the same for equal lengths, the same or the next for a word that is one longer), and the postings
are merged with a heap: what can't reach the count that one edit leaves is skipped, and what reaches it is
verified. One edit spoils three trigrams of a word of equal length, and two of the shorter of two words.

A pair is counted in one block only. Blocks report numbers and best neighbours by word, never pairs.

Defined results: null and empty texts have no words; long texts are taken whole, in slices that end between words
only; repeated rows count again (a row's damage follows from its id and the word); a null id is the empty text; an
empty table gives no words. Of neighbours with equal counts the smaller one, in code-point order, is the form.
Other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import need_whole_ids, only, stored, table, thrifty
from .kernel import LOWER, runs, runs_crc32, runs_text, slices

LEAST_LENGTH, LEAST_COUNT = 5, 3
Q = 3
#: Words of a block beyond which its rest is halved again.
BLOCK_WORDS = 4096
#: Distinct words that a task gathers before it passes them on.
_TOGETHER = 1_000_000

_SLICE_BYTES = 2 << 20
_ASCII = np.zeros(256, bool)
_ASCII[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
#: The first byte of U+00C0 to U+00FF in UTF-8; the second one is any continuation byte.
_LATIN = 0xC3


def letter_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the maximal runs of A-Z, a-z and U+00C0 to U+00FF."""
    latin = data == _LATIN
    return runs(_ASCII[data] | latin | np.concatenate(([False], latin[:-1])), offsets)


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", damage: int | None = 97, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of all words of least_length code points that occur least_count times.

    With damage, a word of a document loses one code point where damage divides the crc32 h of '<id>:<word>': the one at h % length.
    """

    def added(tables: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(tables).group_by("word").aggregate([("n", "sum")]).select(["word", "n_sum"]).rename_columns(["word", "n"])

    def of(values: pa.Array, n: pa.Array) -> pa.Table:
        enough = pc.greater_equal(pc.utf8_length(values), least_length)
        return pa.table({"word": values, "n": n}).filter(enough)

    @thrifty
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            ids, texts = batch.columns
            before = np.array([zlib.crc32(f"{i or ''}:".encode()) for i in ids.to_pylist()], np.uint32)
            for i, _, data, offsets in slices(texts, _SLICE_BYTES):
                data = LOWER[data]
                starts, ends, row = letter_runs(data, offsets)
                if not len(starts):
                    continue
                if damage:
                    h = runs_crc32(data, starts, ends, before[i + row])
                    struck = h % damage == 0
                    lost: Counter = Counter()
                    for a, b, x in zip(starts[struck], ends[struck], h[struck].tolist()):
                        w = data[a:b].tobytes().decode()
                        lost[w[: x % len(w)] + w[x % len(w) + 1 :]] += 1
                    held.append(of(pa.array(list(lost), pa.large_string()), pa.array(list(lost.values()), pa.int64())))
                    starts, ends = starts[~struck], ends[~struck]
                if len(starts):
                    seen = runs_text(data, starts, ends).value_counts()
                    held.append(of(seen.field("values"), seen.field("counts")))
                if sum(len(x) for x in held) > _TOGETHER:
                    held = [added(held)]
                    if len(held[0]) > _TOGETHER // 2:
                        yield from held.pop().cast(schema).to_batches()
        if held:
            yield from added(held).cast(schema).to_batches()

    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])
    each = docs.select(F.col(id_col).cast("string"), text_col).mapInArrow(run, "word string, n long")
    return each.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def merged(postings: list[list[int]], least: int) -> Iterator[int]:
    """What is in at least least of the postings (sorted lists): a heap of their heads, moved past what can't be."""
    heap = [(p[0], k, 0) for k, p in enumerate(postings)]
    heapify(heap)
    while len(heap) >= least:
        top, popped = heap[0][0], []
        while heap and heap[0][0] == top:
            popped.append(heappop(heap))
        if len(popped) >= least:
            yield top
            beyond = top + 1
        else:
            while heap and len(popped) < least - 1:
                popped.append(heappop(heap))
            if not heap:
                return
            beyond = heap[0][0]
        for _, k, at in popped:
            at = bisect_left(postings[k], beyond, at)
            if at < len(postings[k]):
                heappush(heap, (postings[k][at], k, at))


def one_edit(s: str, t: str) -> bool:
    """t is s with one code point replaced, or with one inserted."""
    i, n = 0, len(s)
    while i < n and s[i] == t[i]:
        i += 1
    return i < len(t) and s[i + (len(s) == len(t)) :] == t[i + 1 :]


def near_in_block(words: list[str], lg: int, a: int, b: int) -> Iterator[tuple[int, int]]:
    """Pairs of places of words one edit apart, of which one has lg code points and the other as many or one more.

    All words share their first a and last b code points. A pair that shares all but its last b code points too
    is another block's.
    """
    rest = lg - a - b
    padded = [f"\0\0{w}\0\0" for w in words]
    short = [i for i, w in enumerate(words) if len(w) == lg]
    long = [i for i, w in enumerate(words) if len(w) > lg]
    mine = b > 0

    def ok(i: int, j: int) -> bool:
        s, t = words[i], words[j]
        return one_edit(s, t) and not (mine and s[: lg - b] == t[: lg - b])

    # Of equal lengths: rest + 2 trigrams touch the rest, at the same places, and three may be spoiled.
    index: dict[tuple[int, str], list[int]] = {}
    for i in short:
        grams = [(k, padded[i][k : k + Q]) for k in range(a, a + rest + Q - 1)]
        if rest > 1:
            found = merged([p for g in grams if (p := index.get(g))], rest - 1)
        else:
            found = [j for j in short if j < i]  # they differ in one code point: no more than there are letters
        for j in found:
            if ok(i, j):
                yield i, j
        for g in grams:
            index.setdefault(g, []).append(i)
    # One longer: the shorter word's trigrams are at the same place or the next one, and two may be spoiled.
    if long:
        index = {}
        for j in long:
            for k in range(a, a + rest + Q):
                index.setdefault((k, padded[j][k : k + Q]), []).append(j)
        for i in short:
            grams = [(k + d, padded[i][k : k + Q]) for k in range(a, a + rest + Q - 1) for d in (0, 1)]
            for j in merged([p for g in grams if (p := index.get(g))], max(1, rest)):
                if ok(i, j):
                    yield i, j


def neighbours(words: DataFrame, least_length: int = LEAST_LENGTH, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(word, n_near, best_n, best) of each of words (word, n; distinct) that has a word one edit apart."""
    length = F.char_length("word")
    roles = words.withColumn("lg", F.explode(F.array(length, length - 1))).where(F.col("lg") >= least_length)
    start = roles.select("word", "n", "lg", F.lit(0).alias("a"), F.lit(0).alias("b"))

    def halved(rows: DataFrame) -> DataFrame:
        """Each row in the block of the first, and in that of the last half of what is left of it."""
        half = "(lg - a - b) div 2"
        both = F.expr(f"explode(array(named_struct('a', cast(a + {half} as int), 'b', b), named_struct('a', a, 'b', cast(lg - a - {half} as int))))")
        out = rows.select("word", "n", "lg", both.alias("x")).select("word", "n", "lg", "x.a", "x.b")
        return out.withColumn("block", F.concat_ws(" ", F.col("lg"), F.expr("left(word, a)"), F.expr("right(word, b)"), F.col("a")))

    @thrifty
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def report(rows: list[tuple]) -> None:
            if len(rows) > 1:
                _, _, lg, a, b, _ = rows[0]
                group, n = [r[0] for r in rows], [r[1] for r in rows]
                for i, j in near_in_block(group, lg, a, b):
                    for x, y in ((i, j), (j, i)):
                        w, best = group[x], (-n[y], group[y])
                        old = seen.get(w)
                        seen[w] = (1, best) if old is None else (old[0] + 1, min(old[1], best))

        def out() -> pa.RecordBatch:
            rows = [(w, k, -m, x) for w, (k, (m, x)) in seen.items()]
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["word", "n_near", "best_n", "best"])

        seen: dict[str, tuple[int, tuple[int, str]]] = {}
        rows: list[tuple] = []
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                if rows and r[5] != rows[0][5]:
                    report(rows)
                    rows = []
                    if len(seen) > _TOGETHER // 10:
                        yield out()
                rows.append(r)
        report(rows)
        if seen:
            yield out()

    rows, parts = halved(start), []
    while True:  # each round halves what is left of the words, so it ends
        hot = stored(rows.groupBy("block", "lg", "a", "b").agg(F.count("*").alias("size")).where((F.col("size") > block_words) & (F.col("lg") - F.col("a") - F.col("b") > 1)).select("block"))
        if not hot.count():
            parts.append(rows)
            break
        parts.append(only(rows, hot, "block", "left_anti"))
        rows = halved(only(rows, hot, "block"))
    found = None
    for p in parts:
        dealt = p.select("word", "n", "lg", "a", "b", "block").repartition("block").sortWithinPartitions("block", "word")
        near = dealt.mapInArrow(run, "word string, n_near long, best_n long, best string")
        found = near if found is None else found.unionByName(near)
    best = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("x")).select("word", "n_near", (-F.col("x.m")).alias("best_n"), F.col("x.w").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of forms (word, form), which has no cycles: the last word that forms lead to, by pointer jumping."""
    now = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = stored(now.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        now = step.select("word", "root")
        if step.where("moved").isEmpty():
            return now


def variants(words: DataFrame, times: int = 2, least_length: int = LEAST_LENGTH, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of words (word, n): a form is the most frequent near word, if it is times as frequent.

    A form's count is at least times (2 or more) the word's, so chains of forms end and are short.
    """
    if times < 2:
        raise ValueError("times has to be 2 or more, else forms can lead in circles")
    words = stored(words)
    near = neighbours(words, least_length, block_words)
    is_form = F.col("best_n") >= times * F.col("n")
    out = stored(words.join(near, "word", "left").select("word", F.when(is_form, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best_n")).alias("form_n")))
    last = roots(out.where("form is not null"))
    return out.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    need_whole_ids(docs)
    return variants(word_counts(docs))


_ORACLE = r"""
WITH RECURSIVE tab AS (SELECT list_transform(range(0, 256), lambda b: list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
found AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS r FROM documents),
counted AS (SELECT doc_id, r, count(*) AS n FROM found GROUP BY ALL),
bytes AS (SELECT doc_id, r, n, hex(encode(doc_id || ':' || r)) AS x FROM counted),
octets AS (SELECT doc_id, r, n, list_transform(range(0, len(x) // 2), lambda k: (instr('0123456789ABCDEF', x[2 * k + 1]) - 1) * 16 + instr('0123456789ABCDEF', x[2 * k + 2]) - 1) AS b FROM bytes),
hashed AS (SELECT r, n, xor(list_reduce(list_prepend(4294967295, b), lambda c, o: xor(c >> 8, t[(xor(c, o) & 255) + 1])), 4294967295) AS h FROM octets, tab),
kept AS (SELECT CASE WHEN h % 97 = 0 THEN substring(r, 1, CAST(h % length(r) AS INT)) || substring(r, CAST(h % length(r) AS INT) + 2) ELSE r END AS word, n FROM hashed),
w AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM kept WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
gone AS MATERIALIZED (SELECT word, n, i, length(word) AS len, substring(word, 1, CAST(i AS INT)) || substring(word, CAST(i AS INT) + 2) AS d FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM w)),
near AS (SELECT x.word, y.word AS other, y.n AS other_n FROM gone x JOIN gone y ON x.d = y.d AND x.i = y.i AND x.len = y.len AND x.word <> y.word
         UNION SELECT x.word, y.word, y.n FROM gone x JOIN w y ON x.d = y.word
         UNION SELECT y.word, x.word, x.n FROM gone x JOIN w y ON x.d = y.word),
best AS (SELECT word, count(*) AS n_near, min({'m': -other_n, 'w': other}) AS b FROM near GROUP BY word),
formed AS MATERIALIZED (SELECT w.word, CASE WHEN -b.m >= 2 * w.n THEN b.w END AS form, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.m >= 2 * w.n THEN -b.m END AS form_n FROM w LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS root FROM formed UNION ALL SELECT walk.word, formed.form FROM walk JOIN formed ON formed.word = walk.root WHERE formed.form IS NOT NULL),
ends AS (SELECT walk.word, walk.root FROM walk JOIN formed ON formed.word = walk.root WHERE formed.form IS NULL)
SELECT f.word, f.form, e.root, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form_n FROM formed f JOIN ends e USING (word)
"""

QUERIES = {"op11_spelling_variants": op11_spelling_variants}
ORACLES = {"op11_spelling_variants": _ORACLE}
