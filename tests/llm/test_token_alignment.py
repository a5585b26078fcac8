"""Cross-tokenizer alignment against a plain computation with the tokenizers' own libraries."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given
from hypothesis import strategies as st
from tokenizers import Tokenizer

from kpilane.llm import token_alignment as ta
from kpilane.llm.packing import _byte_of_char

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "  ", "a", " a", "a ", "  two  blanks  ", "tab\t x", "line\n next \n\n  end\n", "a b", "a  b",
       "<|endoftext|> and <s> </s> <unk> <0x41>", "▁mark ▁ x", "x" * 3000, "ab " * 2000, "ÄÖ é 中文 😀 ", "\x00\x1c y", "don't we'll  I'm",
       "﻿bom", "é combining", "1234567 89", "\r\n\r\n x", "　wide　 space", "�"]


def _plain(texts):
    tok = Tokenizer.from_file(A)
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=B)
    chars, names = _byte_of_char(), {i: t for t, i in tok.get_vocab().items()}

    def byte_of_piece(i):
        p = sp.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode()

    out, links = [], []
    for text in texts:
        a = tok.encode(" " + text, add_special_tokens=False).ids if text else []
        b = sp.encode(text) if text else []
        of_a, of_b = [bytes(chars[c] for c in names[i]) for i in a], [byte_of_piece(i) for i in b]
        wanted = (" " + text).encode() if text else b""
        if b"".join(of_a) != wanted or b"".join(of_b) != wanted:
            a, b, of_a, of_b = [], [], [], []
        ends_a, ends_b = np.cumsum([len(x) for x in of_a]), np.cumsum([len(x) for x in of_b])
        spans_a = [(e - len(x), e) for x, e in zip(of_a, ends_a)]
        spans_b = [(e - len(x), e) for x, e in zip(of_b, ends_b)]
        own = []
        start = 0
        for i, (s, e) in enumerate(spans_a):
            while start < len(spans_b) and spans_b[start][1] <= s:
                start += 1
            j = start
            while j < len(spans_b) and spans_b[j][0] < e:
                own.append((a[i], b[j]))
                j += 1
        both = sorted(set(ends_a.tolist()) & set(ends_b.tolist())) if a else []
        groups, low = [], 0
        for end in both:
            groups.append(",".join(str(t) for t, (s, _) in zip(a, spans_a) if low <= s < end) + "|"
                          + ",".join(str(t) for t, (s, _) in zip(b, spans_b) if low <= s < end))
            low = end
        out.append((len(a), len(b), len(both), len(own),
                    hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
        links.append(own)
    count = Counter(x for own in links for x in own)
    most = Counter()
    for (_, y), n in count.items():
        most[y] = max(most[y], n)
    return [(*row[:4], sum(count[x] == most[x[1]] for x in own), sum(count[x] for x in own), row[4])
            for row, own in zip(out, links)]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("head", [ta.HEAD, 40, 0])
def test_equals_the_plain_computation_whatever_is_broadcast(spark, head):
    texts = ODD + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()
                   if len(r.text) < 8000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in ta.align(df, A, B, head=head).collect()}
    want = _plain([t or "" for t in texts])
    for i, text in enumerate(texts):
        assert got[i] == want[i], (i, text and text[:60])


def test_a_full_table_of_units_starts_anew(spark, monkeypatch):
    tok = ta.tokenizers(A, B)
    units = ta.Units(tok)
    flat, offsets, new = units.of(["a b a", None, "b c"])
    assert flat.tolist() == [0, 1, 0, 1, 2] and offsets.tolist() == [0, 3, 3, 5] and len(new.n_a) == 3
    assert not units.full()
    monkeypatch.setattr(ta, "UNITS", 2)
    assert units.full()


def test_odd_rows_and_columns(spark, odd):
    got = ta.align(odd, A, B).collect()
    assert len(got) == odd.count()
    twice = [tuple(r)[1:] for r in got if r.doc_id == 1]
    assert len(twice) == 2 and twice[0] == twice[1]
    assert [r.groups_sha256 for r in got if r.doc_id in (3, 4)] == ["", ""]
    assert sum(r.doc_id is None for r in got) == 1
    assert ta.align(odd.limit(0), A, B).collect() == []
    clash = odd.withColumnsRenamed({"score": "row", "part": "pair", "source": "rare"})
    assert {tuple(r) for r in ta.align(clash, A, B).collect()} == {tuple(r) for r in got}


@given(st.lists(st.lists(st.integers(1, 5), min_size=1, max_size=30), min_size=1, max_size=6), st.randoms())
def test_gallop_is_a_search(lists, rng):
    ends = np.cumsum([x for own in lists for x in own])
    offsets = np.concatenate(([0], np.cumsum([len(own) for own in lists])))
    wanted, first, last = [], [], []
    for i in range(len(lists)):
        low = ends[offsets[i] - 1] if i else 0
        for w in sorted(rng.choices(range(int(low) + 1, int(ends[offsets[i + 1] - 1]) + 1), k=5)):
            wanted.append(w)
            first.append(offsets[i])
            last.append(offsets[i + 1])
    got = ta.gallop(np.array(wanted), np.array(first), np.array(last), ends)
    assert got.tolist() == np.searchsorted(ends, wanted).tolist()
