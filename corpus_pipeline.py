"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import decontaminate, mixing, ngram_join, quality, suffix_dedup
from tallyspark.llm.common import id_mod, staged, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine accepts (score of at least 0.7)."""
    model = quality.train(docs, table(spark, sf_dir, "labels"), "quality", training=id_mod("doc_id", 4) != 2)
    return quality.score(docs, model, out="_q_score").where(F.col("_q_score") >= quality.THRESHOLD).drop("_q_score")


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component at Jaccard 0.8 over five-word shingles."""
    return ngram_join.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of 200-byte strings that occur more than once."""
    return suffix_dedup.dedup_texts(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages, re-parameterised ones included."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each use of a document in training order: mix_pass, mix_words, mix_position are added."""
    return mixing.training_order(docs)


STAGES = [
    ("quality_classifier", keep_quality),
    ("ngram_jaccard_join", one_of_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("benchmark_decontamination", drop_contaminated),
    ("source_mixing", mix_sources),
]
#: The stages train a model and cut texts, which SQL cannot express; the tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
