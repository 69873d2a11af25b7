"""SentencePiece models run by the tokenizers library, and held against the sentencepiece library.

The model's protobuf is parsed here; from it the normaliser, the space marker, the vocabulary (unigram
scores, or for a BPE model its merges in order of score) and the byte fallback are rebuilt.

Where no piece of the model crosses from a word into the next marker (`separable`, decided once for a model), a
text is a sequence of segments (markers and a word) that can be encoded apart: each task remembers segments it has
seen, up to a bound, and encodes new ones in batches on several threads. Every new batch is also encoded by the
sentencepiece library; where the two differ, the library's ids are taken and the row says so (`parity` false).
Of any other model (pieces across spaces, the marker as a suffix, spaces that aren't escaped, user-defined or
unused pieces, models of words or characters) whole texts are encoded, by both libraries, and compared whole.

Defined results: null and empty texts have no ids, and decode to the empty text; nothing is added at a
text's ends; long texts are taken whole. Repeated rows and rows without an id each get their own result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .common import table, thrifty

#: The model file; sessions may name another in spark.recallgrid.sentencepiece.model.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MODEL_SETTING = "spark.recallgrid.sentencepiece.model"
THREADS = 2
#: Bytes of segments and their ids that a worker remembers.
REMEMBER_BYTES = 24 << 20
#: What Python's strings, bytes and table entries cost besides their contents.
ENTRY_BYTES = 200
#: Segments that are encoded as one string.
TOGETHER = 512
#: Bytes of text that are handled together; a longer text is handled alone.
TEXT_BYTES = 256 << 10
MARK = "▁"
# Kinds of pieces and models in the published protobuf schema.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
UNIGRAM, BPE = 1, 2


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protobuf message."""
    i = 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            b = raw[i]
            i += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while i < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield tag >> 3, raw[i : i + size]
        i += size


def parse(raw: bytes) -> dict:
    """What encoding needs of a model file."""
    out: dict = {"pieces": [], "type": UNIGRAM, "byte_fallback": False, "unk_id": 0, "charsmap": b"", "dummy_prefix": True, "squeeze": True, "escape": True, "suffix": False}
    for number, value in fields(raw):
        if number == 1:
            f = dict(fields(value))
            out["pieces"].append((f[1].decode(), struct.unpack("<f", f.get(2, bytes(4)))[0], f.get(3, 1)))
        elif number == 2:
            f = dict(fields(value))
            out |= {"type": f.get(3, UNIGRAM), "byte_fallback": bool(f.get(35, 0)), "unk_id": f.get(40, 0), "suffix": bool(f.get(24, 0))}
        elif number == 3:
            f = dict(fields(value))
            out |= {"charsmap": f.get(2, b""), "dummy_prefix": bool(f.get(3, 1)), "squeeze": bool(f.get(4, 1)), "escape": bool(f.get(5, 1))}
    return out


def separable(model: dict) -> bool:
    """No piece crosses from a word into the next marker, so segments can be encoded apart.

    The marker has to be known: the library joins neighbouring unknown characters into one id.
    """
    crossing = re.compile(f"[^{MARK}]{MARK}")
    kinds = {kind for _, _, kind in model["pieces"]}
    known = model["byte_fallback"] or any(p == MARK for p, _, _ in model["pieces"])
    plain = model["type"] in (UNIGRAM, BPE) and model["escape"] and not model["suffix"] and kinds <= {NORMAL, UNKNOWN, CONTROL, BYTE}
    return plain and known and not any(crossing.search(p) for p, _, kind in model["pieces"] if kind == NORMAL)


def rebuild(model: dict):
    """The tokenizers.Tokenizer that encodes a run of segments, or a whole text; None where it has no such model."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    pieces = model["pieces"]
    if model["type"] == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in pieces], unk_id=model["unk_id"], byte_fallback=model["byte_fallback"])
    elif model["type"] == BPE:
        usable = {p: (s, i) for i, (p, s, kind) in enumerate(pieces) if kind not in (UNKNOWN, CONTROL, BYTE)}
        merges = []
        for p, (s, i) in usable.items():
            merges += [(-s, i, p[:k], p[k:]) for k in range(1, len(p)) if p[:k] in usable and p[k:] in usable]
        core = models.BPE({p: i for i, (p, _, _) in enumerate(pieces)}, [m[2:] for m in sorted(merges)], unk_token=pieces[model["unk_id"]][0], byte_fallback=model["byte_fallback"], fuse_unk=True)
    else:
        return None
    t = Tokenizer(core)
    if separable(model):
        t.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]+|{MARK}+"), "isolated")
    return t


class Codec:
    """Encodes and decodes texts by one model."""

    SEGMENT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+", re.S)

    def __init__(self, raw: bytes, threads: int = THREADS) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ["RAYON_NUM_THREADS"] = str(threads)
        import sentencepiece
        from tokenizers import normalizers

        self.model, self.threads = parse(raw), threads
        self.fast, self.separable = rebuild(self.model), separable(self.model)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=raw)
        self.charsmap = normalizers.Precompiled(self.model["charsmap"]) if self.model["charsmap"] else None
        self.bytes = [bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else p.encode() for p, _, kind in self.model["pieces"]]
        self.bytes[self.model["unk_id"]] = " ⁇ ".encode()
        self.seen: dict[str, bytes] = {}  # a segment's ids, as int32
        self.seen_bytes = 0
        self.differ: set[str] = set()

    def marked(self, text: str | None) -> str:
        """text normalised, with markers for its spaces."""
        if not text:
            return ""
        if self.charsmap:
            text = self.charsmap.normalize_str(text)
        if self.model["squeeze"]:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return ""
        if self.model["suffix"]:
            text += " " * self.model["dummy_prefix"]
        else:
            text = " " * self.model["dummy_prefix"] + text
        return text.replace(" ", MARK) if self.model["escape"] else text

    def segments(self, text: str | None) -> list[str]:
        return self.SEGMENT.findall(self.marked(text))

    def encode_whole(self, texts: list[str | None]) -> list[tuple[np.ndarray, bool]]:
        """(ids, whether both libraries agree) of each text, encoded whole."""
        sure = self.library.encode([t or "" for t in texts], num_threads=self.threads)
        if self.fast is None:
            return [(np.array(ids, np.int32), not t) for ids, t in zip(sure, texts)]
        got = self.fast.encode_batch([self.marked(t) for t in texts], add_special_tokens=False)
        return [(np.array(ids, np.int32), ids == fast.ids) for ids, fast in zip(sure, got)]

    def by_library(self, text: str) -> list[int]:
        """The sentencepiece library's ids for marked text; the library puts the first marker itself."""
        if text == MARK:  # the library gives nothing for a text that is empty without its marker
            return [self.library.piece_to_id(MARK)]
        return self.library.encode(text[1:] if self.model["dummy_prefix"] and text.startswith(MARK) else text)

    def learn(self, new: list[str]) -> None:
        runs = [new[i : i + TOGETHER] for i in range(0, len(new), TOGETHER)]
        joined = ["".join(r) for r in runs]
        got = self.fast.encode_batch(joined, add_special_tokens=False)
        checked = self.library.encode([x[1:] if self.model["dummy_prefix"] else x for x in joined], num_threads=self.threads)
        for run, fast, sure in zip(runs, got, checked):
            ids = fast.ids
            if ids != sure:
                for s in run:
                    self.learn_alone(s)
                continue
            raw = np.array(ids, np.int32).tobytes()
            cut = (4 * np.searchsorted(fast.word_ids, np.arange(len(run) + 1))).tolist()
            self.seen.update(zip(run, [raw[a:b] for a, b in zip(cut[:-1], cut[1:])]))

    def learn_alone(self, segment: str) -> None:
        sure = self.by_library(segment)
        self.seen[segment] = np.array(sure, np.int32).tobytes()
        if self.fast.encode(segment, add_special_tokens=False).ids != sure:
            self.differ.add(segment)

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, bool]]:
        """(ids, whether both libraries agree) of each text."""
        if not self.separable:
            return self.encode_whole(texts)
        parts = [self.segments(t) for t in texts]
        wanted = set().union(*parts) if parts else set()
        new = {s for s in wanted if s not in self.seen}
        # A text's first segment may lack the marker and its last may be markers only; these can't be joined.
        plain = [s for s in new if s[0] == MARK and s[-1] != MARK]
        self.learn(plain)
        for s in new.difference(plain):
            self.learn_alone(s)
        out = [(np.frombuffer(b"".join(map(self.seen.__getitem__, p)), np.int32), not self.differ or self.differ.isdisjoint(p)) for p in parts]
        size = sum(ENTRY_BYTES + len(s) + len(self.seen[s]) for s in new)
        if self.seen_bytes + size > REMEMBER_BYTES:  # what came first is mostly what is frequent
            for s in new:
                del self.seen[s]
            self.differ.difference_update(new)
        else:
            self.seen_bytes += size
        return out

    def decode(self, ids: list[int] | np.ndarray) -> str:
        """Pieces' and bytes' text in order; a byte that isn't part of a character becomes U+FFFD."""
        if not self.separable:
            return self.library.decode([int(i) for i in ids])
        table = self.bytes
        raw = b"".join([table[i] for i in ids])
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            text = "".join(c if ord(c) < 0xDC80 or ord(c) > 0xDCFF else "�" for c in raw.decode(errors="surrogateescape"))
        text = text.replace(MARK, " ")
        return text[1:] if self.model["dummy_prefix"] and text.startswith(" ") else text


def model_bytes(spark: SparkSession) -> bytes:
    """The model file, read through Spark so that it may lie in any store."""
    path = spark.conf.get(MODEL_SETTING, MODEL)
    path = path if ":" in path else f"file://{path}"
    if path.startswith("file://"):
        with open(path[7:], "rb") as f:
            return f.read()
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


_LOADED: dict[tuple[bytes, int], Codec] = {}


def loaded(raw_model: bytes, threads: int) -> Codec:
    """The worker's codec of a model; it outlives the task, as workers do, and there is one at a time."""
    key = (hashlib.sha256(raw_model).digest(), threads)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Codec(raw_model, threads)
    return _LOADED[key]


def runs(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of texts of at most TEXT_BYTES together."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    i = 0
    while i < len(ends):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + TEXT_BYTES, "right")))
        yield i, j
        i = j


def encode(docs: DataFrame, raw_model: bytes, id_col: str = "doc_id", text_col: str = "text", threads: int = THREADS) -> DataFrame:
    """(id, ids array<int>, parity boolean, round_trip boolean) of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(raw_model)

    @thrifty
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = loaded(shared.value, threads)
        for whole in batches:
            for i, j in runs(whole[text_col]):
                b = whole.slice(i, j - i)
                texts = b[text_col].to_pylist()
                got = codec.encode(texts)
                trip = [codec.decode(ids.tolist()) == (t or "") for (ids, _), t in zip(got, texts)]
                ends = np.cumsum([0, *(len(ids) for ids, _ in got)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([g[0] for g in got]) if got else np.zeros(0, np.int32)))
                yield pa.RecordBatch.from_arrays([b[id_col], ids, pa.array([g[1] for g in got], pa.bool_()), pa.array(trip, pa.bool_())], names=[id_col, "ids", "parity", "round_trip"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, ids array<int>, parity boolean, round_trip boolean")


def decode(rows: DataFrame, raw_model: bytes, id_col: str = "doc_id") -> DataFrame:
    """(id, text) of rows (id, ids)."""
    shared = rows.sparkSession.sparkContext.broadcast(raw_model)

    @thrifty
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = loaded(shared.value, THREADS)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b[id_col], pa.array([codec.decode(x or []) for x in b["ids"].to_pylist()], pa.string())], names=[id_col, "text"])

    kind = dict(rows.dtypes)[id_col]
    return rows.select(id_col, "ids").mapInArrow(run, f"{id_col} {kind}, text string")


@thrifty
def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = [np.asarray(x.values, np.int32) if x.is_valid else np.zeros(0, np.int32) for x in b["ids"]]
        yield pa.RecordBatch.from_arrays(
            [b["doc_id"], pa.array([len(x) for x in ids], pa.int64()), pa.array([hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for x in ids], pa.string()), b["parity"], b["round_trip"]],
            names=["doc_id", "n_tokens", "ids_sha256", "parity", "round_trip"],
        )


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kind = dict(docs.dtypes)["doc_id"]
    return encode(docs, model_bytes(spark)).mapInArrow(digest, f"doc_id {kind}, n_tokens long, ids_sha256 string, parity boolean, round_trip boolean")


QUERIES = {"op8_sentencepiece": op8_sentencepiece}
ORACLES: dict[str, str] = {}
