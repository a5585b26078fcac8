"""Collocations against brute force, and the parse they are counted on."""

import re
import tracemalloc
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from kpilane.llm import phrase_mining as pm


def _pieces(text):
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", lower)]


def _grams(rows):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for w in _pieces(text):
            n[lang] += len(w)
            f.update((lang, tuple(w[i:i + k])) for k in range(1, 6) for i in range(len(w) - k + 1))
    return f, n


def _plain(rows, least, top):
    f, n = _grams(rows)
    candidates = {k: a for k, a in f.items() if a >= least and len(k[1]) > 1}
    out = {}
    for (lang, w), a in candidates.items():
        if any(b >= a and len(o) > len(w) and l == lang and any(o[i:i + len(w)] == w for i in range(len(o)))
               for (l, o), b in candidates.items()):
            continue
        score, _, l, r = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]])
                             for k in range(1, len(w)))
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), l, r))
    return [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s)
            for lang in out for i, (s, a, p, l, r) in enumerate(sorted(out[lang])[:top])]


TEXTS = ["the quick brown fox jumps over the lazy dog " * 9, "The Quick, brown fox. the quick brown\tfox jumps! over",
         "word " * 400, "a b a b a b a b a b a b. a b a b", "x", "", None, " \n ", "Äpfel é 中文 Äpfel é 中文 Äpfel é 中文"]
ROWS = [(lang, t) for t in TEXTS for lang in ("en", "de", None, "en")] + [("und", "the quick brown fox jumps")] * 3


@pytest.mark.parametrize("period", [1, 3, 16])
@pytest.mark.parametrize("least, top", [(2, 2000), (5, 4)])
def test_equals_brute_force(spark, period, least, top):
    df = spark.createDataFrame(ROWS, "lang string, text string").repartition(3)
    got = [tuple(r) for r in pm.collocations(df, min_count=least, top=top, period=period).collect()]
    assert sorted(got) == sorted(_plain(ROWS, least, top)) and got


def test_equals_sql_on_prose(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet')")
    want = con.sql(pm.oracle_sql(min_count=8, top=300)).fetchall()
    got = pm.collocations(spark.read.parquet(f"{folder}/documents.parquet"), min_count=8, top=300).collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 100


@given(st.lists(st.sampled_from(["a", "b", "c", "d", ".", "\n", "dd", "É"]), max_size=80), st.integers(1, 6))
def test_every_gram_is_counted_once(words, period):
    text = " ".join(words)
    chunks = pm.parse(text.encode(), period)
    counted = Counter()
    for chunk in chunks:
        w = chunk.decode().split()
        closing = pm.WINDOW if chunk.endswith(b" ") else 0
        counted.update(tuple(w[i:i + k]) for k in range(1, 6) for i in range(len(w) - closing) if i + k <= len(w))
    assert counted == Counter({w: n for (_, w), n in _grams([("x", text)])[0].items()})


def test_equal_passages_are_cut_alike():
    passage = " ".join(f"w{i * 7919 % 251}" for i in range(400))
    inner = [set(pm.parse(f"{lead} {passage} {tail}".encode(), 8)[1:-1]) for lead, tail in (("a", "b"), ("c d e", "f g"))]
    assert len(inner[0]) > 20 and len(inner[0] ^ inner[1]) <= 4


def test_a_full_table_of_bits_changes_no_result(spark, monkeypatch):
    # every bit set: nothing is pruned before the phrases are counted by their text
    monkeypatch.setattr(pm, "bit_table", lambda keys: np.full(1 << (pm.FILTER_BITS - 5), 0xFFFFFFFF, np.uint32))
    df = spark.createDataFrame(ROWS, "lang string, text string")
    assert sorted(map(tuple, pm.collocations(df, min_count=3).collect())) == sorted(_plain(ROWS, 3, 2000))


def test_products_past_64_bits(spark):
    counts = spark.createDataFrame([("en", "a b", 2, 3 * 10**12), ("en", "a", 1, 4 * 10**12), ("en", "b", 1, 5 * 10**12)],
                                   "lang string, phrase string, size int, f long")
    totals = spark.createDataFrame([("en", 7 * 10**13)], "lang string, n long")
    row = pm.score_cuts(counts, totals).collect()[0]
    assert row.score == 1000 * 3 * 10**12 * 7 * 10**13 // (4 * 10**12 * 5 * 10**12)


def test_odd_rows_and_columns(spark, odd):
    got = sorted(map(tuple, pm.collocations(odd, min_count=2).collect()))
    assert got == sorted(_plain([(r.lang, r.text) for r in odd.collect()], 2, 2000))
    clash = odd.withColumnsRenamed({"score": "times", "part": "chunk", "source": "n"})
    assert sorted(map(tuple, pm.collocations(clash, min_count=2).collect())) == got
    assert pm.collocations(odd.limit(0)).collect() == []


def test_counts_are_summed_without_a_second_copy_of_the_rows():
    r = np.random.default_rng(1)
    want = {}

    def parts():
        for i in range(8):
            key, n = r.integers(0, 60_000, 100_000), r.integers(1, 9, 100_000)
            for k, x in zip(key.tolist(), n.tolist()):
                f, b = want.get((k, k % 3), (0, i))
                want[k, k % 3] = f + x, min(b, i)
            yield [key, key % 3, n, np.full(len(key), i)]

    tracemalloc.start()
    try:
        made = list(parts())
        held = tracemalloc.get_traced_memory()[0]
        size = 8 * 4 * 100_000 * 8
        tracemalloc.reset_peak()
        got = pm._summed(made)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert {(k, o): (n, b) for k, o, n, b in zip(*(c.tolist() for c in got))} == want
    assert peak - held < 1.2 * size
