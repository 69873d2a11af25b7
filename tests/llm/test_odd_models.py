"""Token ids of models that aren't plain: the sentencepiece library's, whatever the model is; parity is that of whole texts."""

import struct

import pytest
import sentencepiece

from recallgrid.llm import sentencepiece_tokens

TEXTS = ["ab c ab", "a b c", "abcabc", " cab  bca ", "ab cab c", "zz ab zz zz", "é ab", "<x> ab <x>c", "ab ", "", "   ", "a▁b", "new york new yorkers", None]
BASE = [("▁", -3.0), ("▁ab", -2.0), ("a", -4.0), ("b", -4.1), ("ab", -3.2), ("c", -5.0), ("bc", -3.5), ("▁a", -3.7)]
UNIGRAM, BPE, WORD, CHARACTERS = 1, 2, 3, 4


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def field(number, value):
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def model(pieces=BASE, kind=UNIGRAM, trainer=b"", normaliser=b"", odd=()):
    raw = b""
    for text, score, type_ in [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *[(t, s, 1) for t, s in pieces], *odd]:
        raw += field(1, field(1, text.encode()) + field(2, float(score)) + field(3, type_))
    return raw + field(2, field(3, kind) + trainer) + field(3, field(1, b"identity") + field(3, 1) + field(4, 1) + normaliser)


BYTES = [(f"<0x{b:02X}>", -20.0, 6) for b in range(256)]
MODELS = {
    "plain": (model(), True),
    "pieces_across_spaces": (model([*BASE, ("b▁c", -1.0), ("▁new▁york", -2.0), *[(c, -6.0) for c in "newyorks"]]), False),
    "marker_is_a_suffix": (model([("▁", -3.0), ("ab▁", -2.0), ("a", -4.0), ("b", -4.1), ("c", -5.0), ("c▁", -4.0)], trainer=field(24, 1)), False),
    "user_defined": (model(odd=[("<x>", 0.0, 4)]), False),
    "unused": (model(odd=[("abc", -1.0, 5)]), False),
    "byte_fallback": (model(trainer=field(35, 1), odd=BYTES), True),
    "spaces_not_escaped": (model([(" ", -3.0), (" ab", -2.0), ("a", -4.0), ("b", -4.1), ("c", -5.0)], normaliser=field(5, 0)), False),
    "marker_unknown": (model([("ab", -2.0), ("a", -4.0), ("b", -4.1), ("c", -5.0)]), False),
    "bpe_across_spaces": (model([("▁", -9.0), ("a", -9.1), ("b", -9.2), ("c", -9.3), ("ab", -1.0), ("b▁", -0.5), ("▁a", -2.0), ("b▁c", -0.7)], kind=BPE), False),
    "words": (model([("▁ab", -1.0), ("▁c", -1.0)], kind=WORD), False),
    "characters": (model([("▁", -1.0), ("a", -1.0), ("b", -1.0)], kind=CHARACTERS), False),
}


@pytest.mark.parametrize("name", MODELS)
def test_ids_are_those_of_the_library(name):
    raw, separable = MODELS[name]
    library, codec = sentencepiece.SentencePieceProcessor(model_proto=raw), sentencepiece_tokens.Codec(raw)
    assert codec.separable is separable
    for _ in range(2):  # new, then remembered
        for text, (ids, _) in zip(TEXTS, codec.encode(TEXTS)):
            assert ids.tolist() == (library.encode(text) if text else []), (name, text)
    if name in ("plain", "byte_fallback", "pieces_across_spaces"):
        assert all(same for text, (_, same) in zip(TEXTS, codec.encode(TEXTS)) if text and "z" not in text and "é" not in text and "<" not in text)
    if name in ("words", "characters"):  # the tokenizers library has no such models
        assert [same for _, same in codec.encode(["ab", ""])] == [False, True]


def test_rows_of_a_model_across_spaces(spark):
    raw, _ = MODELS["pieces_across_spaces"]
    library = sentencepiece.SentencePieceProcessor(model_proto=raw)
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)] + [(None, "ab c"), (0, TEXTS[0])], "doc_id long, text string")
    out = sentencepiece_tokens.encode(docs, raw)
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0), list(r["ids"])) for r in out.collect())
    want = sorted(((i is None, i or 0), library.encode(t) if t else []) for i, t in [*enumerate(TEXTS), (None, "ab c"), (0, TEXTS[0])])
    assert got == want
    back = {r["doc_id"]: r["text"] for r in sentencepiece_tokens.decode(out, raw).collect()}
    assert back[0] == TEXTS[0] and back[12] == TEXTS[12] and back[13] == ""
