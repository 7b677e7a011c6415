"""A training corpus in five stages: language, repeated lines, near copies, test
items, mixture.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as
Parquet to the shared folder and reads again as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.llm import language, line_dedup, mixing, simhash, tiling
from logweir.llm.common import fresh, stored

MAJORITY = 0.5  # share of a text's letters that one language must have


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are in one language: those without letters (null and empty
    texts among them) or without a language of most letters go."""
    model = language.learn(docs.where(language.may_learn(F.col("doc_id"))))
    lang, score = fresh(docs, "lang_pred", "score")
    found = language.label_spans(docs, model, *docs.columns, names=(lang, score))
    return found.where((F.col(lang) != "und") & (F.col(score) >= MAJORITY)).select(*docs.columns)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated lines; those of which no word is left go."""
    out = line_dedup.without_repeated_lines(docs)
    left = (F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")
    chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.where(left).withColumn("n_chars", chars).select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, by fingerprints of three-word shingles at most two bits apart."""
    return simhash.one_of_each(docs)


def without_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark table."""
    return tiling.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time the mixture reads a document, with block and place."""
    return mixing.schedule(mixing.mixed(docs))


STAGES = [
    ("language_id", by_language),
    ("line_dedup", without_repeated_lines),
    ("near_dedup", without_near_copies),
    ("decontamination", without_test_items),
    ("mixing", mixture),
]

#: SQL can't express the language model; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of a folder of tables."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"corpus-{name}")
    return docs
