"""A training-data pipeline over ``documents``: toxicity, language, near duplicates, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept; all
but the last return the rows they keep with the columns of ``docs``, extra ones included.

- ``toxicity`` drops rows that score 0.5 or more; the models learn from the labelled rows of
  ``docs`` outside label fold 0. Without both labels nothing is dropped.
- ``language_id`` drops rows without a letter and rows whose language is ambiguous.
- ``near_duplicates`` keeps of every group of near duplicates (Jaccard similarity of five-word
  shingles at least 0.8) one row, that with the smallest id; rows without an id come last, and among
  equal ids any one stays. Groups are of rows, so rows that share an id without being
  alike each stay. Rows without words are in no group.
- ``packing`` returns the pieces of the packed sequences.

An empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpilane.llm import language_id, ngram_join, packing, toxicity
from kpilane.llm.common import fold, free_name, require_checkpoint_dir, ship_package, stored, table
from kpilane.llm.queries import BPE_FILE

TOXIC_FROM = 0.5
SHINGLE = 5  # words
SIMILARITY = 80  # percent


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    labels = table(spark, sf_dir, "labels")
    learned = toxicity.fit(docs.filter(fold("doc_id", 5) != 0), labels.filter(fold("doc_id", 5) != 0))
    into = free_name("toxicity", docs.columns)
    return toxicity.score(docs, learned, into=into).filter(F.col(into) < TOXIC_FROM).select(*docs.columns)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    learned = language_id.fit(docs.filter(fold("doc_id", 4) != 2))
    if learned is None:  # nothing to tell languages by
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    lang = free_name("lang_pred", docs.columns)
    score = free_name("lang_score", docs.columns)
    ambiguous = free_name("lang_ambiguous", docs.columns)
    found = language_id.identify(docs, learned, into=(lang, score, ambiguous))
    return found.filter((F.col(lang) != language_id.UNKNOWN) & ~F.col(ambiguous)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    row = free_name("row", docs.columns)
    # numbered once and written, so that every pass below sees the same numbers
    numbered = stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    groups = ngram_join.near_duplicates(numbered, id_col=row, shingle=SHINGLE, similarity=SIMILARITY)
    members = groups.select(F.col("doc_id").alias(row), F.col("component_id").alias("group")).join(
        numbered.select(F.col("doc_id").alias("id"), row), row)
    first = members.groupBy("group").agg(F.min(F.struct(F.col("id").isNull(), "id", row)).alias("first"))
    kept = stored(first.select(F.col("first")[row].alias(row)), "kept")
    return numbered.join(kept, row, "left_semi").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return packing.pack(docs, BPE_FILE)


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", drop_unknown_language),
    ("near_duplicates", drop_near_duplicates),
    ("packing", pack),
]

# the stages hold fitted models and an iterated join: tested against brute force in tests/llm/test_pipeline.py
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is cut from its lineage in the shared checkpoint folder."""
    require_checkpoint_dir(spark)
    docs = table(spark, sf_dir, "documents")
    for place, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if place < len(STAGES) - 1:
            docs = docs.checkpoint()
    return docs
