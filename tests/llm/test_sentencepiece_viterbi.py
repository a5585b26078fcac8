"""Encoding against the library's unigram search over the same pieces, decoding against the library."""

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql.functions import lit

from kpilane.llm import sentencepiece_viterbi as viterbi

FILE = public_tokenizers.path("piece_bpe_32k.model")


def _fields(data: bytes):
    """(number, wire type, value, start, end) of the fields of a protocol buffer."""
    at = 0

    def varint(i):
        value = shift = 0
        while True:
            byte = data[i]
            value |= (byte & 127) << shift
            i, shift = i + 1, shift + 7
            if byte < 128:
                return value, i

    while at < len(data):
        key, i = varint(at)
        wire = key & 7
        if wire == 0:
            value, end = varint(i)
        elif wire == 2:
            size, i = varint(i)
            value, end = data[i:i + size], i + size
        else:
            end = i + (4 if wire == 5 else 8)
            value = data[i:end]
        yield key >> 3, wire, value, at, end
        at = end


@pytest.fixture(scope="module")
def unigram():
    """The library on the same file with the model type set to unigram."""
    import sentencepiece

    data = open(FILE, "rb").read()
    for number, _, value, start, end in _fields(data):
        if number == 2:
            trainer = b"".join(bytes([0x18, 1]) if n == 3 else value[a:b] for n, _, _, a, b in _fields(value))
            assert len(trainer) == len(value)
            data = data[:end - len(value)] + trainer + data[end:]
            break
    return sentencepiece.SentencePieceProcessor(model_proto=data)


def encode(texts):
    ids, offsets = viterbi.model(FILE).encode(texts)
    return [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])]


TEXTS = ["hello world", "  two  spaces ", "a\nb\t c", "", "é中😀", " ", "<s> <0x41> </s>", "x" * 300, "ﬁ ½ \U0001F9FF͸",
         "Das ist ein längerer Satz, mit Satzzeichen; und 12345 Zahlen.", " 　 mixed​space"]


def test_equals_the_librarys_unigram_search(unigram):
    assert encode(TEXTS) == unigram.encode(TEXTS)


def test_decodes_like_the_library(unigram):
    model = viterbi.model(FILE)
    ids, offsets = model.encode(TEXTS)
    assert [d.decode() for d in model.decode(ids, offsets)] == TEXTS
    assert unigram.decode(encode(TEXTS)) == TEXTS


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=8))
def test_round_trip(texts):
    model = viterbi.model(FILE)
    ids, offsets = model.encode(texts)
    assert [d.decode() for d in model.decode(ids, offsets)] == [t.replace(viterbi.MARK, " ") for t in texts]


def test_on_documents(spark):
    rows = [(1, "one two"), (2, None), (3, ""), (1, "one two"), (None, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", lit(5))
    out = sorted(viterbi.round_trip(docs, FILE).collect(), key=str)
    assert len(out) == 5 and all(r["round_trip"] for r in out)
    assert {(r["doc_id"], r["n_tokens"]) for r in out if r["doc_id"] in (2, 3)} == {(2, 0), (3, 0)}
    back = viterbi.decode_ids(viterbi.encode_documents(docs, FILE), FILE)
    assert sorted((r["doc_id"] or 0, r["text"]) for r in back.collect()) == sorted((i or 0, t or "") for i, t in rows)
    assert viterbi.round_trip(docs.limit(0), FILE).count() == 0
