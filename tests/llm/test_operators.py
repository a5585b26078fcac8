"""The operators against brute force, on small tables with odd rows."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kpilane.llm import (html_density, language_id, licenses, lz_fingerprint, maxent_lm, ngram_join, packing, topk,
                         toxicity)
from kpilane.llm.common import fold
from kpilane.llm.components import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BPE = public_tokenizers.path("byte_bpe_50k.json")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def invented(seed, n, vocabulary=("ba", "ke", "lo", "mi", "tu", "ra", "so", "ne")):
    r = random.Random(seed)
    return ["".join(r.choices(vocabulary, k=r.randint(1, 3))) for _ in range(n)]


# --- fingerprints

def test_fingerprints_of_neighbours(odd):
    rows = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "", r["doc_id"]) for r in odd.collect()))
    got = lz_fingerprint.edited_neighbours(odd).collect()
    assert len(got) == len(rows)
    wanted = collections.Counter()
    for (_, _, text, doc_id), (_, _, after, _) in zip(rows, rows[1:] + rows[:1]):
        quarter = len(text) // 4
        edited = text[:len(text) - quarter] + after[:quarter]
        own, changed, following = map(lz_fingerprint.fingerprint, (text, edited, after))
        like = [lz_fingerprint.likeness(*map(lz_fingerprint.decode, p)) for p in ((own, changed), (own, following))]
        wanted[doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), own, changed, *like] += 1
    assert collections.Counter(tuple(r) for r in got) == wanted


def test_likeness_is_jaccard_for_small_sets():
    a, b = set(invented(1, 40)), set(invented(2, 40))
    expected = len(a & b) / len(a | b)
    assert lz_fingerprint.likeness(lz_fingerprint.hashes(a), lz_fingerprint.hashes(b)) == pytest.approx(expected)
    none = lz_fingerprint.hashes(set())
    assert lz_fingerprint.likeness(none, none) == 1.0 and lz_fingerprint.likeness(none, lz_fingerprint.hashes(a)) == 0.0


def test_empty_tables(odd):
    none = odd.limit(0)
    assert lz_fingerprint.edited_neighbours(none).count() == 0
    assert packing.pack(none, BPE).count() == 0
    assert ngram_join.near_duplicates(none).count() == 0
    assert licenses.scan(none).count() == 0
    pages = odd.sparkSession.createDataFrame([], "page_id long, url string, html string")
    assert html_density.main_text(pages).collect() == []
    assert maxent_lm.held_out_scores(none).count() == 0
    assert language_id.fit(none) is None
    assert language_id.identify(none, None).count() == 0
    assert toxicity.fit(none, none.withColumn("toxic", F.lit(1))) is None
    assert toxicity.score(none, None).count() == 0


def test_line_ends_are_characters_of_the_parse():
    texts = ["abcd", "ab\ncd", "", "\n\n\n", "abab", "aba\nb", "ab\nab"]
    assert len({lz_fingerprint.fingerprint(t) for t in texts}) == len(texts)
    for t in ("ab\ncd ef\n\ngh", "\n\nab"):
        for cut in range(len(t) + 1):  # a parse that goes on from where it stopped
            phrases = set()
            lz_fingerprint.parse(t[cut:], phrases, lz_fingerprint.parse(t[:cut], phrases))
            assert lz_fingerprint.encode(lz_fingerprint.hashes(phrases)) == lz_fingerprint.fingerprint(t)


# --- toxicity and language

def test_toxicity_finds_held_out_insults(spark):
    docs, labels = [], []
    for i in range(600):
        text, toxic = invented(i, 40), i % 3 == 0
        if toxic:
            text[7], text[20] = random.Random(i).choice(["gruzzil", "gruzzak", "snorfel"]), "gruzz" + invented(i, 1)[0]
        docs.append((i, " ".join(text), "extra"))
        labels.append((i, int(toxic)))
    labels += [(9000, None), (None, 1), (9001, 7)]
    docs += [(9000, "no label", "e"), (None, "no id", "e"), (9002, None, "e"), (9003, "", "e")]
    docs = spark.createDataFrame(docs, "doc_id long, text string, ordinary string")
    labels = spark.createDataFrame(labels, "doc_id long, toxic int")
    learned = toxicity.fit(docs.filter(fold("doc_id", 5) != 0), labels.filter(fold("doc_id", 5) != 0))
    rows = toxicity.score(docs, learned).filter(fold("doc_id", 5) == 0).join(labels, "doc_id").collect()
    assert len(rows) > 60
    assert np.mean([(r["toxicity"] >= 0.5) == (r["toxic"] == 1) for r in rows if r["toxic"] in (0, 1)]) > 0.97
    scored = toxicity.score(docs, learned)
    assert scored.count() == 604 and scored.columns == ["doc_id", "text", "ordinary", "toxicity"]
    assert scored.filter("toxicity is null or toxicity < 0 or toxicity > 1").count() == 0


def test_language_of_held_out_texts(spark, odd):
    sounds = {"aa": ("ba", "ke", "lo", "mi"), "bb": ("zur", "schi", "gen", "ver"), "cc": ("çé", "ou", "eau", "té")}
    rows = [(i, " ".join(invented(i, 20, sounds[lang])), lang) for i, lang in
            zip(range(300), itertools.cycle(sounds))] + [(1000, "12 34 !", "aa"), (1001, None, "bb"), (1002, "ba ke", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = language_id.fit(docs.filter(fold("doc_id", 4) != 2))
    assert learned.languages == ["aa", "bb", "cc"]
    got = {r["doc_id"]: r for r in language_id.identify(docs, learned).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang in rows[:300])
    assert got[1000]["lang_pred"] == got[1001]["lang_pred"] == "und" and got[1002]["lang_pred"] == "aa"
    assert language_id.identify(odd, learned).count() == 10


def test_codewords_differ():
    for n in (1, 2, 3, 6, 7, 40):
        code = language_id.codewords(n)
        assert len(np.unique(code, axis=0)) == n and (n == 1 or (np.abs(code.sum(axis=0)) < n).all())


# --- web pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p>";</script></head><body>
<nav><ul><li><a href="/a">Menu</a></ul></nav><header><h1>Site</h1></header><div class="cookie-notice">We use cookies</div>
<div id="content"><article><header><h1>A &eacute; title</h1></header><p>First   para &amp; more<br>text <a href=x>link</a>.
<p>Second <b>para</b> with <i>words</i> enough to be long.</p><aside>Aside</aside><form><input>Search</form>
<div class="ad">Buy</div><ul><li>one<li>two</ul><section class="comments"><p>A reader says</p></section></article></div>
<div class="sidebar"><p>Related things to read</p></div><footer>&copy; Site</footer></body></html>"""


def test_main_text():
    assert html_density.extract(PAGE) == "\n\n".join(
        ["A é title", "First para & more text link.", "Second para with words enough to be long.", "one", "two"])
    assert html_density.extract(None) == html_density.extract("") == html_density.extract("<script>x") == ""
    assert html_density.extract("no markup  at all") == "no markup at all"
    assert html_density.extract("<div><p>a<p>b</div></span></p>c") == "a\n\nb\n\nc"
    assert len(html_density.extract("<p>" + "long " * 50_000)) == 249_999
    assert html_density.extract("<div>" * 20_000 + "deep") == "deep"


def test_density_prefers_the_article_without_names():
    link = "<p><a href=1>one link</a> <a href=2>another link</a></p>"
    body = "".join(f"<p>{' '.join(invented(i, 60))}.</p>" for i in range(4))
    text = html_density.extract(f"<body><div>{link * 4}</div><div>{body}</div><div>{link * 3}</div></body>")
    assert "link" not in text and text.count("\n\n") == 3


def test_sibling_articles_and_parts_of_names():
    def paragraphs(seed):
        return [" ".join(invented(100 * seed + i, 60)) + "." for i in range(3)]

    one, two, beside = map(paragraphs, (1, 2, 3))
    links = "<ul>" + "<li><a href=1>some link</a>" * 6 + "</ul>"

    def p(texts):
        return "".join(f"<p>{t}</p>" for t in texts)

    expected = "\n\n".join(one + two)
    assert html_density.extract(f"<body><article>{p(one)}</article><article>{p(two)}</article>{links}</body>") == expected
    text = html_density.extract(f"<body><div>{links}</div><article>{p(one)}</article><div>{p(beside)}</div></body>")
    assert text == "\n\n".join(one + beside)
    for name in ("has-sidebar", "no-sidebar", "layout has-sidebar", "noSidebar"):
        page = (f'<body><div class="{name}"><article><div class="post-header"><h1>A title</h1></div>{p(one)}'
                f'<div class="post-share">Share this</div></article><div class="sidebar">{p(beside)}</div></div></body>')
        assert html_density.extract(page) == "\n\n".join(["A title"] + one)
        dense = page.replace("Share this</div>", "Share this</div><div class='post-related-form'>" + p(two) + "</div>")
        assert html_density.extract(dense) == "\n\n".join(["A title"] + one + two)


_THREE = [" ".join(invented(700 + i, 60)) + "." for i in range(3)]
_BODY = "".join(f"<p>{t}</p>" for t in _THREE)
_MAIN = "\n\n".join(["A title"] + _THREE)
_ARTICLE = f"<article><h1>A title</h1>{_BODY}</article>"


@pytest.mark.parametrize("name", ["comment-list", "user-comments", "reader-comment", "comments-area", "commentSection",
                                  "site-footer", "left-sidebar", "cookie-bar", "comments", "Sidebar", "page_notice"])
def test_parts_that_a_name_tells_go_inside_and_outside_the_article(name):
    other = f'<div class="{name}">' + "".join(f"<p>{' '.join(invented(900 + i, 60))}.</p>" for i in range(2)) + "</div>"
    for page in (f"<body>{_ARTICLE}{other}</body>", f"<body><article><h1>A title</h1>{_BODY}{other}</article></body>",
                 f"<body>{other}<div><h1>A title</h1>{_BODY}</div></body>"):
        assert html_density.extract(page) == _MAIN


@pytest.mark.parametrize("name", ["widget", "share", "header", "search", "form", "banner", "has-sidebar", "no-comments", "with-footer"])
def test_no_name_drops_what_encloses_the_text(name):
    for inside in (_ARTICLE, f"<h1>A title</h1>{_BODY}", f"<div><h1>A title</h1>{_BODY}</div>"):
        assert html_density.extract(f'<body><div class="{name}">{inside}</div></body>') == _MAIN
    assert html_density.extract(f'<body><div class="{name}">{_BODY}</div></body>') == "\n\n".join(_THREE)


def test_forms_lose_their_fields_only_where_they_hold_the_text():
    fields = "<label>Name</label><input value=x><select><option>one</select><textarea>y</textarea><button>Send</button>"
    assert html_density.extract(f"<body><form action=x>{_ARTICLE}<input><button>Go</button></form></body>") == _MAIN
    assert html_density.extract(f"<body>{_ARTICLE}<form>{fields}</form></body>") == _MAIN


def test_titles_in_headers_and_pages_headers():
    assert html_density.extract(
        f'<body><article><div class="header"><h1>A title</h1></div>{_BODY}</article></body>') == _MAIN
    assert html_density.extract(
        f'<body><div class="header"><h1>The site</h1><a href=/>Home</a></div>{_ARTICLE}</body>') == _MAIN
    assert html_density.extract(
        f'<body>{_ARTICLE}<div class="sidebar"><article><h2>Teaser</h2><p>Read this too.</p></article></div></body>') == _MAIN


def test_empty_elements_inside_words():
    text = html_density.extract("<p>a long<wbr>word and an im<img src=x>age, one<br>two<hr>three</p>")
    assert text.startswith("a longword and an image, one two")


def test_pages_table(spark):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, None)]
    got = html_density.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string"))
    assert sorted((r["page_id"] or 0, r["n_chars"] > 0) for r in got.collect()) == [(0, False), (1, True), (1, True)]


# --- near duplicates

def brute_components(rows, similarity=85):
    sets = []
    for _, text in rows:
        w = words(text)
        sets.append({tuple(w[i:i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        common = len(sets[i] & sets[j])
        if common and 100 * common >= similarity * len(sets[i] | sets[j]):
            parent[root(i)] = root(j)
    least = collections.defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        least[root(i)].append(doc_id)
    return collections.Counter(
        (doc_id, len(sets[i]), min(d for d in least[root(i)] if d is not None) if any(
            d is not None for d in least[root(i)]) else None) for i, (doc_id, _) in enumerate(rows))


def edited(base, edits, r):
    out = list(base)
    for _ in range(edits):
        out[r.randrange(len(out))] = "".join(r.choices("abcdefgh", k=6))
    return " ".join(out)


def test_near_duplicates_against_brute_force(spark):
    r = random.Random(5)
    rows = []
    base, passage = invented(1, 150), invented(2, 30)
    rows += [(len(rows) + i, edited(base, r.randint(0, 7), r)) for i in range(120)]  # a cluster with near misses
    rows += [(1000 + i, " ".join(passage + invented(100 + i, r.choice((2, 5, 9, 60))))) for i in range(120)]  # a shared passage
    for i in range(40):
        own = invented(500 + i, r.randint(1, 60))
        rows += [(2000 + 3 * i, " ".join(own)), (2001 + 3 * i, edited(own, 1, r)), (2002 + 3 * i, " ".join(own).upper())]
    rows += [(None, " ".join(base)), (5000, None), (5001, ""), (5002, " \n"), (2000, rows[240][1]), (2000, rows[240][1])]
    docs = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, component long")
    got = ngram_join.near_duplicates(docs)
    assert collections.Counter(tuple(x) for x in got.collect()) == brute_components(rows)


def test_block_forest_is_exact():
    r = random.Random(3)
    base = [r.randrange(1 << 54) for _ in range(60)]
    sets = [sorted({*r.sample(base, r.randint(48, 60)), *(r.randrange(1 << 54) for _ in range(r.randint(0, 4)))}) for _ in range(40)]

    def block(part):
        payloads = [np.array(s, "<u8").view(np.uint8).reshape(-1, 8)[:, :7].tobytes() for s in part]
        return ngram_join._pack_block(pa.table({"cluster": [0] * len(part), "band": [0] * len(part), "block": [0] * len(part),
                                               "set": [sets.index(s) for s in part], "payload": payloads}))["packed"][0].as_buffer()

    u, v = ngram_join.block_forest(block(sets[:25]), block(sets[25:]))
    linked = [(i, j) for i in range(25) for j in range(25, 40)
              if 100 * len({*sets[i]} & {*sets[j]}) >= 85 * len({*sets[i]} | {*sets[j]})]
    assert linked and set(map(lambda p: (min(p), max(p)), zip(u.tolist(), v.tolist()))) <= set(linked)
    assert len({n for p in linked for n in p}) == len({*u.tolist(), *v.tolist()})


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, j) for j in range(101, 160)] + [(7, 7), (1, 0)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "u long, v long")).collect()))
    assert got == {**{i: 0 for i in range(31)}, **{i: 100 for i in range(100, 160)}}


# --- language model

def test_base_score_against_brute_force(odd):
    rows = [(r["doc_id"], words(r["text"]) + ["\n"]) for r in odd.collect()]
    held = [i is None or zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows]
    counts = collections.Counter(t for (_, w), h in zip(rows, held) if not h for t in w)
    total, kinds = sum(counts.values()), len(counts)
    expected = sorted((str(i), h, len(w), sum(counts[t] > 0 for t in w), total,
                       round(sum(math.log10((counts[t] + 0.1) / (total + 0.1 * (kinds + 1))) for t in w), 4))
                      for (i, w), h in zip(rows, held))
    got = maxent_lm.held_out_scores(odd).collect()
    assert sorted((str(r[0]), r[1], r[2], r[3], r[4], round(r[5], 4)) for r in got) == expected
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)


def test_model_is_a_distribution_and_beats_the_base(spark):
    rows = [(i, " ".join(w for first in invented(i, 30) for w in (first, first[:2] + "xx"))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model, counts = maxent_lm.train(docs.filter(fold("doc_id", 10) != 0))
    logs = model.log_softmax(maxent_lm.Tokens(pa.array([t for _, t in rows[:5]])).features())
    assert np.allclose(np.exp(logs.astype(float)).sum(axis=1), 1, atol=1e-4)
    mass = np.bincount(model.classes, 10.0 ** model.within, minlength=maxent_lm.CLASSES)
    assert np.allclose(mass[mass > 0], 1)
    got = maxent_lm.held_out_scores(docs).filter("held_out").agg(F.sum("base_score"), F.sum("score")).first()
    assert got[1] > got[0]


def test_updates_take_every_training_row_once(spark, monkeypatch):
    rows = [(i, "one hot text" if i % 3 == 0 else " ".join(invented(i, 9))) for i in range(300)] + [(None, "no id"), (400, None)]
    rows += [(i and i + 1000, t) for i, t in rows]  # no word is seen once, so every token counts once
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    tokens = sum(len(words(t)) + 1 for _, t in rows)
    taken = []
    update = maxent_lm.Model.update

    def counted(self, gradient, seen):
        taken.append(seen[:maxent_lm.FEATURES].sum())
        update(self, gradient, seen)

    monkeypatch.setattr(maxent_lm.Model, "update", counted)
    maxent_lm.train(docs)
    assert len(taken) == maxent_lm.UPDATES and sum(taken) == tokens
    hot = docs.filter("text = 'one hot text'").groupBy(maxent_lm.part_of("doc_id", "text")).count().collect()
    assert len(hot) == maxent_lm.UPDATES and max(r[1] for r in hot) < 100


def test_gradient_rows_do_not_grow_with_the_input_splits(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(invented(i, 9))) for i in range(400)], "doc_id long, text string")
    tasks, real = [], type(docs).mapInArrow

    def spied(self, run, schema, *a, **k):
        if "seen" in str(schema):
            tasks.append(self.rdd.getNumPartitions())
        return real(self, run, schema, *a, **k)

    monkeypatch.setattr(type(docs), "mapInArrow", spied)
    cores = spark.sparkContext.defaultParallelism
    many, _ = maxent_lm.train(docs.repartition(9 * cores))
    few, _ = maxent_lm.train(docs.coalesce(1))
    assert len(tasks) == 2 * maxent_lm.UPDATES and max(tasks) <= cores
    assert np.allclose(many.weights, few.weights, atol=1e-5)
    assert [maxent_lm.gradient_tasks(n, 6) for n in (0, 1 << 24, 70 << 24)] == [6, 6, 70]


def test_scores_do_not_depend_on_head(spark, monkeypatch):
    r = random.Random(8)
    often, rare = sorted(set(invented(1, 60))), itertools.count()
    rows = [(i, " ".join(f"x{next(rare)}" if r.random() < 0.1 else r.choice(often) for _ in range(30))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    training = docs.filter(fold("doc_id", 10) != 0)
    counts = collections.Counter(w for t, in training.select("text").collect() for w in words(t))
    kinds, once = len(counts), sum(n == 1 for n in counts.values())
    scores, unseen = [], []
    for head in (1 << 18, kinds - once, (kinds - once) // 2):  # the whole vocabulary, all but words seen once, fewer
        monkeypatch.setattr(maxent_lm, "HEAD", head)
        model, vocabulary = maxent_lm.train(training)
        scores.append(dict(map(tuple, maxent_lm.score(docs, model, vocabulary).select("doc_id", "score").collect())))
        unseen.append(model.share[-1] * model.unseen)
    assert scores[0] == pytest.approx(scores[1], abs=1e-4)
    tokens = sum(counts.values()) + training.count()
    assert unseen == pytest.approx([once / (tokens + once)] * 3, rel=0.02)
    drift = [abs(scores[0][i] - scores[2][i]) / 31 for i in scores[0]]  # class boundaries move with HEAD, the mass does not
    assert np.mean(drift) < 0.1


# --- top k

def test_top_k_against_brute_force(spark):
    r = np.random.default_rng(4)
    rows = [(int(i), [float(x) for x in r.normal(size=16) * (1 + i % 5)], 1) for i in range(300)]
    rows += [(400 + i, rows[40][1], 1) for i in range(60)]  # one vector many times
    rows += [(500, None, 1), (520, [1.0, float("nan")] + [0.0] * 14, 1), (540, [float("inf")] * 16, 1), (560, [None] * 16, 1),
             (None, [1.0] * 16, 1), (580, [0.5, -3.0], 1), (600, [], 1), (620, [0.0] * 16, 1)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v, _ in rows if i is not None and v is not None
            and all(x is not None and math.isfinite(x) for x in v)]
    expected = set()
    for q, v in kept:
        if q % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in kept if i != q)[:20]
            expected |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(best)}
    assert set(map(tuple, topk.top_k(vectors).collect())) == expected
    assert topk.top_k(vectors.limit(0)).count() == 0
    few = vectors.filter("vec_id in (20, 40, 41)")
    assert topk.top_k(few).count() == 4


def test_top_k_of_repeated_ids_against_the_oracle(spark, monkeypatch):
    import duckdb

    monkeypatch.setattr(topk, "BLOCK", 64)
    r = np.random.default_rng(6)
    rows = [(i, [float(x) for x in r.normal(size=8)]) for i in range(200)]
    rows += [(7, [4.0] * 8)] * 30  # more than k equal best rows under one id
    rows += [(9, [float(x) for x in r.normal(size=8) * 3]) for _ in range(40)]  # one id with different vectors
    rows += [rows[20]] * 2 + [(40, [float(x) for x in r.normal(size=8)])]  # queries with equal and with different rows
    embeddings = pa.table({"vec_id": [i for i, _ in rows], "embedding": [v for _, v in rows]})
    with duckdb.connect() as con:
        con.register("embeddings", embeddings)
        expected = con.sql(topk.oracle_sql()).fetchall()
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted(map(tuple, got)) == sorted(expected) and len(got) == 200


# --- licences

def test_licence_scan(spark):
    rows = [(1, "Released under the MIT License. MIT\nlicense; Apache License, Version 2.0"), (2, None), (3, ""), (None, "mit"),
            (4, "This work is licensed under the GNU General Public License version 3."), (5, "cc by nc cc-BY-NC 4.0"),
            (6, "smith license"), (7, "license " * 1000 + "mit license"), (1, "x"), (8, "Under the MIT-License"),
            (9, "MIT License"), (10, "under the mit; under the MIT license under the mit license")]
    docs = spark.createDataFrame([(*x, 0.1) for x in rows], "doc_id long, text string, words double")
    got = collections.defaultdict(list)
    for r in licenses.scan(docs).collect():
        got[r["doc_id"]].append(tuple(r)[1:])
    assert sorted(got[1], key=str) == sorted([(12, 2, 1, 7, "apache-2,mit", "apache-2,mit", 1.0),
                                                      (1, 0, None, None, "", "", 0.0)], key=str)
    assert got[2] == got[3] == [(0, 0, None, None, "", "", 0.0)]
    assert got[4] == [(12, 0, None, None, "", "gpl-3", 1.0)]
    assert got[5] == [(8, 2, 0, 3, "cc-by-nc", "cc-by-nc", 1.0)]
    assert got[6][0][1] == 0 and got[7] == [(1002, 0, None, None, "", "mit", 1.0)]
    assert got[8] == [(4, 1, 0, 0, "mit", "mit", 1.0)]
    # a bare licence name is the method's label, no base place
    assert got[9] == [(2, 0, None, None, "", "mit", 1.0)]
    assert got[10] == [(11, 2, 3, 7, "mit", "mit", 1.0)]


# --- packing

def test_packing_covers_every_id_once(odd):
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(BPE)
    special = odd.unionByName(odd.filter("doc_id = 4").withColumn("doc_id", F.lit(99).cast("long"))
                              .withColumn("text", F.lit("a <|endoftext|> b  \n\n c")))
    rows = [(r["doc_id"], exact.encode(r["text"] or "", add_special_tokens=False).ids + [0]) for r in special.collect()]
    pieces = packing.pack(special.coalesce(2), BPE).collect()
    by_sequence = collections.defaultdict(list)
    for p in pieces:
        by_sequence[p["sequence_id"]].append((p["offset"], p["length"]))
    padded = 0
    for parts in by_sequence.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end and length > 0
            end += length
        assert end <= packing.WINDOW
        padded += 0 if end & (end - 1) == 0 else packing.WINDOW - end
    assert padded == 0
    wanted = collections.Counter()
    for doc_id, ids in rows:
        wanted[doc_id] += len(ids)
    got = collections.Counter()
    texts = dict(rows)
    for p in pieces:
        got[p["doc_id"]] += p["length"]
        ids = np.array(texts[p["doc_id"]][p["start"]:p["start"] + p["length"]], "<u4")
        assert p["doc_tokens"] == len(texts[p["doc_id"]]) and p["ids_crc32"] == zlib.crc32(ids.tobytes())
    assert got == wanted
