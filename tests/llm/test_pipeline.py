"""The pipeline's stages on the smallest given tables, against what their operators decide."""

import itertools
import random

import corpus_pipeline
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_stages_follow_each_other(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs.limit(1).withColumn("text", F.lit(None).cast("string")).withColumn("doc_id", F.lit(None).cast("long"))
    docs = docs.unionByName(odd).unionByName(docs.limit(1)).withColumn("lang_pred", F.lit(1))
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns
        assert set(map(tuple, kept.collect())) <= set(map(tuple, docs.collect()))
        docs = kept.checkpoint()
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.7 * sizes[0]
    assert docs.filter("text is null").count() == 0
    assert docs.groupBy("doc_id").count().filter("count > 1").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == docs.count()


def test_empty_table_passes(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_near_duplicates_of_five_words_from_080(spark):
    r = random.Random(11)

    def word():
        return "".join(r.choices("abcdefgh", k=7))

    rows, between = [], 0
    for i in range(40):
        own = [word() for _ in range(300)]
        n = r.choice((20, 24, 28, 30, 36, 50))  # consecutive words replaced, or more appended
        changed = own[:100] + [word() for _ in range(n)] + own[100 + n:] if i % 2 else own + [word() for _ in range(2 * n)]
        rows += [(2 * i, " ".join(own)), (2 * i + 1, " ".join(changed))]
    sets = [{tuple(w[k:k + 5]) for k in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    dropped = set()
    for i, j in itertools.combinations(range(len(rows)), 2):
        likeness = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
        between += 0.8 <= likeness < 0.85
        dropped |= {rows[j][0]} if likeness >= 0.8 else set()
    kept = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF)
    assert between >= 5 and {x["doc_id"] for x in kept.collect()} == {i for i, _ in rows} - dropped
    assert len(dropped) < 40


def test_rows_that_share_an_id_are_told_apart(spark):
    r = random.Random(5)
    a, b = (" ".join("".join(r.choices("abcdefgh", k=6)) for _ in range(200)) for _ in "ab")
    near = a.replace(a.split()[100], "changed", 1)
    rows = [(3, a, "x"), (5, near, "x"), (5, b, "x"), (None, a, "x"), (None, "alone " + b[::-1], "x"), (7, None, "x")]
    for order in (rows, rows[::-1], rows[2:] + rows[:2]):
        docs = spark.createDataFrame(order, "doc_id long, text string, row string").repartition(2)
        kept = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
        assert kept.columns == docs.columns
        assert sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, (rows[0], rows[2], rows[4], rows[5])))


def test_a_step_of_the_components_plans_its_links_once(spark):
    from kpilane.llm import components as c

    r = random.Random(8)
    rows = [(r.randrange(200), r.randrange(200)) for _ in range(170)]
    links = spark.createDataFrame(rows, "u long, v long").filter("u <> v")
    plan = c._small_star(c._large_star(links))._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count("LogicalRDD") <= 4
    least = {x: x for pair in rows for x in pair}
    while any(least[a] != least[b] for a, b in rows):
        for a, b in rows:
            least[a] = least[b] = min(least[a], least[b])
    linked = {x for a, b in rows if a != b for x in (a, b)}
    assert sorted(map(tuple, c.components(links).collect())) == sorted((x, least[x]) for x in linked)
