"""The operators bound to the given tables: one query each, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpilane.llm import (html_density, language_id, licenses, lz_fingerprint, maxent_lm, ngram_join, packing,
                         phrase_mining, quality_rules, sentencepiece_viterbi, token_alignment, topk, toxicity)
from kpilane.llm.common import fold, ship_package, table

BPE_FILE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_FILE = public_tokenizers.path("piece_bpe_32k.model")


def op1_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lz_fingerprint.edited_neighbours(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    learned = toxicity.fit(docs.filter(fold("doc_id", 5) != 0), labels.filter(fold("doc_id", 5) != 0))
    scored = toxicity.score(docs.select("doc_id", "text"), learned, into="score")
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score",
                         F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op3_html_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_density.main_text(table(spark, sf_dir, "pages"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_viterbi.round_trip(table(spark, sf_dir, "documents"), PIECE_FILE)


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learned = language_id.fit(docs.filter(fold("doc_id", 4) != 2))
    found = language_id.identify(docs.select("doc_id", "text"), learned, into=("lang_pred", "score", "ambiguous"))
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "ambiguous")


def op7_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent_lm.held_out_scores(table(spark, sf_dir, "documents"))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), BPE_FILE)


def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_mining.collocations(table(spark, sf_dir, "documents"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align(table(spark, sf_dir, "documents"), BPE_FILE, PIECE_FILE)


def _with_package(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {q.__name__: _with_package(q) for q in (
    op1_lz_fingerprint, op2_toxicity, op3_html_density, op4_sentencepiece, op5_ngram_join, op6_language_id, op7_maxent_lm,
    op8_topk, op9_licenses, op10_packing, op11_phrase_mining,
    op12_quality_rules, op13_token_alignment)}
ORACLE = {"op8_topk": topk.oracle_sql(), "op9_licenses": licenses.oracle_sql(),
          "op11_phrase_mining": phrase_mining.oracle_sql(), "op12_quality_rules": quality_rules.oracle_sql()}
