"""The toxicity models against a plain computation, and what they can tell apart."""

import math
import pickle
import random
from collections import Counter

import numpy as np

from kpilane.llm import toxicity as tx
from kpilane.llm.common import fold

D = tx.DISCOUNT
DOCS = [("the cat sat on the mat", 0), ("the dog sat, the dog ran 12 times!", 0), ("drop dead you rat", 1),
        ("you rat! drop dead drop dead", 1), ("dead drop at the mat", 0), ("Rat rat RAT", 1), ("äöü 中文 the end the end", 0),
        ("wasserscheusal wasserscheusal", 1), ("wasserschaden wasserschaden Wasserschaden", 0)]


def _plain():
    """log P_1 - log P_0 of a word and of a pair, from n_k, followers_k and kinds counted by hand."""
    n, pairs = [Counter(), Counter()], [Counter(), Counter()]
    for text, k in DOCS:
        words = tx._words(text)
        for v, w in zip(["", *words], words):
            pairs[k][v, w] += 1
    places = {}
    for k in (0, 1):
        for (_, w), x in pairs[k].items():
            for at, c in enumerate(w + "\n"):
                h = (at >= 8, (w + "\n")[max(at - 7, 0) if at >= 8 else 0:at])
                n[k][h, c] += x
                places[w, at] = (h, c)
    kinds = Counter(places.values())
    befores = Counter(w for _, w in {*pairs[0], *pairs[1]})

    def of(counter, h):
        return sum(x for (a, _), x in counter.items() if a == h), sum(1 for a, _ in counter if a == h)

    def logs(counts, h, c, shared):
        out = []
        for k in (0, 1):
            total, followers = of(counts[k], h)
            p = (max(counts[k][h, c] - D, 0) + D * followers * shared) / total if total else shared
            out.append(math.log(p))
        return out[1] - out[0]

    def word(w):
        total, open_ = 0.0, True
        for at, c in enumerate(w + "\n"):
            h = (at >= 8, (w + "\n")[max(at - 7, 0) if at >= 8 else 0:at])
            if n[0][h, c] + n[1][h, c] < tx.MIN_COUNT:
                open_ = open_ and at >= 8
                continue
            if at < 8 and not open_:
                continue
            total += logs(n, h, c, kinds[h, c] / of(kinds, h)[0])
        return total

    def pair(v, w):
        if pairs[0][v, w] + pairs[1][v, w] < tx.MIN_COUNT:
            return 0.0
        return logs(pairs, v, w, befores[w] / len({*pairs[0], *pairs[1]}))

    return word, pair


def test_evidence_equals_the_formula(spark):
    rows = spark.createDataFrame(DOCS, "text string, toxic int")
    models = tx.models_of(tx.count_pairs(rows, "text", "toxic"))
    word, pair = _plain()
    for text, _ in [*DOCS, ("unseen words wasserscheu the catnap drop", 0)]:
        words = tx._words(text)
        for w in words:
            assert math.isclose(models.of_word(w), word(w), abs_tol=1e-9), w
        got = models.of_pairs(np.array([models.number.get(w, len(models.number)) for w in words]))
        assert np.allclose(got, [pair(v, w) for v, w in zip(["", *words], words)])


def test_the_driver_keeps_columns_and_no_object_per_word(spark):
    models = tx.models_of(tx.count_pairs(spark.createDataFrame(DOCS, "text string, toxic int"), "text", "toxic"))
    assert not [k for k, v in vars(models).items() if isinstance(v, (dict, list, tuple, set)) and v]
    sent = pickle.dumps(models)
    before = models.features("drop dead you rat, äöü 中文 wasserscheusal!")
    assert "evidence" in vars(models) and len(pickle.dumps(models)) == len(sent)
    assert pickle.loads(sent).features("drop dead you rat, äöü 中文 wasserscheusal!") == before


def _accuracy(spark, texts, labels):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    marks = spark.createDataFrame(list(enumerate(labels)), "doc_id long, toxic int")
    learned = tx.fit(docs.filter(fold("doc_id", 5) != 0), marks.filter(fold("doc_id", 5) != 0))
    rows = tx.score(docs, learned, into="p").filter(fold("doc_id", 5) == 0).collect()
    assert len(rows) > 100
    return np.mean([(r.p >= 0.5) == (labels[r.doc_id] == 1) for r in rows])


def _prose(r, n=30):
    return ["".join(r.choices(("ba", "ke", "lo", "mi", "tu", "ra", "so", "ne"), k=r.randint(1, 4))) for _ in range(n)]


def test_a_part_after_the_eighth_letter(spark):
    r = random.Random(1)
    texts, labels = [], []
    for i in range(900):
        words = _prose(r)
        first = "".join(r.choices(("wasser", "feuer", "garten", "himmel"), k=2))
        words[r.randrange(30)] = first + (r.choice(("scheusal", "ekelding")) if i % 2 else r.choice(("schaden", "leitung")))
        texts.append(" ".join(words))
        labels.append(i % 2)
    assert _accuracy(spark, texts, labels) > 0.95


def test_an_expression_of_two_words_counts_in_its_order(spark):
    r = random.Random(2)
    texts, labels = [], []
    for i in range(900):
        words = _prose(r)
        at = r.randrange(29)
        words[at:at + 2] = ["drop", "dead"] if i % 2 else ["dead", "drop"]
        texts.append(" ".join(words))
        labels.append(i % 2)
    assert _accuracy(spark, texts, labels) > 0.95


def test_digits_and_signs_are_read(spark):
    r = random.Random(3)
    texts, labels = [], []
    for i in range(900):
        words = _prose(r)
        words[r.randrange(30)] = r.choice(("88", "1488")) + "!?" if i % 2 else r.choice(("52", "2024")) + "."
        texts.append(" ".join(words))
        labels.append(i % 2)
    assert _accuracy(spark, texts, labels) > 0.95


def test_labels_that_contradict_each_other_teach_nothing(spark):
    docs = spark.createDataFrame([(i, "same text here") for i in range(50)], "doc_id long, text string")
    both = spark.createDataFrame([(i, k) for i in range(50) for k in (0, 1)], "doc_id long, toxic int")
    assert tx.fit(docs, both) is None


def test_texts_scored_together_equal_texts_scored_alone(spark, monkeypatch):
    models = tx.models_of(tx.count_pairs(spark.createDataFrame(DOCS, "text string, toxic int"), "text", "toxic"))
    texts = [t for t, _ in DOCS] + ["", "drop", " \n", "dead you rat", "unseen 12 words", "!", ""]
    alone = [models.features(t) for t in texts]
    assert alone[len(DOCS)] == [0.0] * tx.FEATURES
    for chars, memo in ((1 << 18, 300_000), (30, 300_000), (1, 1), (60, 3)):
        monkeypatch.setattr(tx, "BATCH_CHARS", chars)
        monkeypatch.setattr(tx, "MEMO", memo)
        assert models.features_of(texts) == alone
    assert models.features_of([]) == []
    # the first word of a text follows nothing, also where a text with words stands before it
    word, pair = _plain()
    after = models.features_of(["drop", "dead"])[1]
    assert math.isclose(after[4], pair("", "dead"), abs_tol=1e-9)


def test_every_pair_is_found_by_its_slot(spark):
    models = tx.Models((None, None), (None, np.random.default_rng(3).permutation(5000) * 977, np.arange(1.0, 5001)))
    where = models._slot(models.codes, len(models.slots))
    assert len(models.slots) >= 2 * 5000 and sorted(models.slots[models.slots >= 0]) == list(range(5000))
    for code, at in zip(models.codes[:500].tolist(), where[:500].tolist()):
        while models.codes[models.slots[at]] != code:
            assert models.slots[at] >= 0
            at = (at + 1) % len(models.slots)
