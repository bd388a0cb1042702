"""Queries of operators that learn from the tables before they judge them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm import language, preference, quality_rules
from sieveline.llm.registry import query, table
from sieveline.llm.samples import held_out


@query()
def op2_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.learn(docs.where(~held_out(F.col("doc_id"))))
    return language.predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query()
def op7_preference_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scorer = preference.learn(docs, labels.where(~held_out(F.col("doc_id"))))
    return preference.score(docs, scorer).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                                                 (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query()
def op8_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge_quality(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
