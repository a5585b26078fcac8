"""Base counts and verdicts against brute force; order of the cascade."""

import re
from collections import Counter

from hypothesis import given
from hypothesis import strategies as st

from kpilane.llm import quality_rules as qr


def _counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    often = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(5)}
    earlier, dup = set(), 0
    for x in lines:
        dup += x in earlier
        earlier.add(x)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)), words, lines


def _kept(text):
    (n, chars, symbols, dup, repeat), words, lines = _counts(text)
    if n < 10 or 100 * repeat > 20 * n:
        return False
    capitals = len(re.findall("[A-Z]", text))
    return not (symbols * 10 > n or not 2 <= chars / n <= 15 or dup * 5 > 2 * len(lines)
                or 10 * sum(a == b for a, b in zip(words, words[1:])) > 3 * n
                or 10 * capitals > 6 * len(re.findall("[A-Za-z]", text))
                or 2 * sum(not any(c.isalpha() for c in w) for w in words) > n
                or 10 * sum(bool(re.search(r"(\.\.\.|…)\s*$", x)) for x in lines) > 3 * len(lines))


PLAIN = "The cat sat on a mat while seven old dogs slept near the warm oven."
CASES = {
    "plain": PLAIN, "symbols": PLAIN.replace(" ", " # "), "word_length": "a b c d e f g h i j k l m",
    "duplicate_lines": "one two\nthree four\nfive\nfive\nfive\nfive six seven\neight nine ten eleven\nfive\nfive",
    "stutter": "of of to to in in the the cat cat sat sat on on mats mats",
    "capitals": PLAIN.upper(), "letters": "12 34 56 78 90 11 22 33 44 55 66 seven eight nine",
    "ellipses": "one two three four five six...\nseven eight nine ten eleven… \nand more words here", "null": None,
    "empty": "", "few": "nine words are not enough for it here ok", "ten": "one two three four five six seven eight nine ten",
    "loop": "a bc def gh ijk " * 9, "unicode": "ÄÖÜ é 中文 жук ñandú " + PLAIN, "long": PLAIN * 4000,
    "nbsp": "one two three\x0bfour five\x0csix seven eight nine\r\nten eleven twelve thirteen\x85 x",
}


def test_each_rule_rejects_its_case(spark):
    rules = {r.name: r for r in qr.RULES}
    for name in rules:
        assert rules[name].rejects(qr.Text(CASES[name])), name
        assert not rules[name].rejects(qr.Text(PLAIN)), name
    rows = list(CASES.items())
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string").repartition(3)
    got = {rows[r.doc_id][0]: r for r in qr.judge(df).collect()}
    for name, text in CASES.items():
        r = got[name]
        assert tuple(r)[1:6] == _counts(text)[0], name
        assert r.kept == _kept(text), name
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert r.kept == (not r.base_failed and r.stopped_by is None) and (r.rules_tried == 0) == r.base_failed
    assert got["plain"].kept and got["unicode"].kept and not got["null"].kept


@given(st.lists(st.sampled_from(["a", "b", "cc", "DD", "#", "...", "7", "é"]), max_size=60),
       st.lists(st.sampled_from([" ", "\n", "\t ", "\x0b"]), min_size=60, max_size=60))
def test_counts_and_verdict_equal_brute_force(words, gaps):
    text = "".join(w + g for w, g in zip(words, gaps))
    t = qr.Text(text)
    counts = qr.base_counts(t)
    assert counts == _counts(text)[0]
    kept = not qr.base_fails(counts[0], counts[4]) and qr.first_rejecting(t, qr.RULES)[0] is None
    assert kept == _kept(text)


def test_order_is_rejection_per_cost_and_changes_no_verdict(spark):
    e = [qr.Estimate("a", 100, 10, 1.0), qr.Estimate("b", 100, 2, 0.1), qr.Estimate("c", 100, 0, 0.5), qr.Estimate("d", 100, 0, 0.2)]
    rules = [qr.Rule(n, lambda t: False) for n in "abcd"]
    assert [r.name for r in qr.cascade_order(rules, e)] == ["b", "a", "d", "c"]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    measured = qr.estimates(docs, sample_rows=10**6)
    assert all(x.texts == measured[0].texts > 50 for x in measured) and measured[0].rejected > 0
    texts = [r.text for r in docs.collect()]
    for rules in (qr.RULES, qr.RULES[::-1], qr.cascade_order(qr.RULES, measured)):
        assert [qr.first_rejecting(qr.Text(x), rules)[0] is None for x in texts] \
            == [not any(r.rejects(qr.Text(x)) for r in qr.RULES) for x in texts]


def test_rejected_text_meets_no_later_rule():
    met = []
    rules = [qr.Rule(n, lambda t, n=n: met.append(n) or n == "b") for n in "abc"]
    assert qr.first_rejecting(qr.Text("x"), rules) == ("b", 2) and met == ["a", "b"]


def test_labelled_documents(spark):
    sf = "/root/testdata/sf0.01"
    rows = (qr.judge(spark.read.parquet(f"{sf}/documents.parquet")).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
            .filter("n_words >= 10").collect())
    good, bad = [r.kept for r in rows if r.quality == 1], [r.kept for r in rows if r.quality == 0]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.05 * len(bad) and len(bad) > 20


def test_odd_rows_and_columns(spark, odd):
    got = sorted(qr.judge(odd).select("doc_id", "n_words", "kept").collect(), key=str)
    assert len(got) == odd.count() and sum(r.doc_id == 1 for r in got) == 2
    assert qr.judge(odd.limit(0)).collect() == []
    clash = odd.withColumnsRenamed({"score": "kept", "part": "n_words", "source": "name"})
    assert sorted(qr.judge(clash).select("doc_id", "n_words", "kept").collect(), key=str) == got
