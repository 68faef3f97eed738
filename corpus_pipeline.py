"""A training corpus from ``documents`` in five stages, each written as Parquet and reread."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlab.llm import bpe, decontaminate, language, pii, simhash
from postlab.llm.queries import documents, vocabulary
from postlab.session import join_sized, settle

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

# Stages of models and bit counts are beyond SQL.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter or far from every language go.

    Profiles and cutoffs come from all labelled texts; a text that is recognised as the language of its
    own label passes a lower one.
    """
    rows = docs.select(F.struct("*").alias("row"), "text", "lang")
    labelled = language.labelled_texts(docs)
    totals = settle(language.gram_totals(labelled))
    profiles = language.profiles_of(totals)
    if not profiles.names:  # nothing to be far from
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    least = F.lit(language.LEAST_SCORE)
    for name, score in language.least_scores(labelled, totals).items():
        least = F.when(F.col("lang_pred") == name, score).otherwise(least)
    least = F.when(F.col("lang_pred") == F.col("lang"), language.LEAST_SCORE).otherwise(least)
    known = language.predict(rows, profiles)
    return known.filter((F.col("lang_pred") != language.UNDETERMINED)
                        & (F.col("score") >= least)).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, whatever its id; ids may be null or repeat."""
    return simhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, question and answer, go.

    Texts are judged, not ids: clean documents stay beside one that leaks and has the same
    id or, as they, none.
    """
    rows = docs.select(F.struct("*").alias("row"), "text", F.sha2("text", 256).alias("print"))
    leaks = decontaminate.find_leaks(
        rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id="print")
    leaked = settle(leaks.select(F.col("doc_id").alias("print")).distinct())
    return join_sized(rows.drop("text"), leaked, "print", "left_anti").select("row.*")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; the length follows the text."""
    clean = pii.redact(docs, pii.fit(docs))
    return clean.withColumn("n_chars", F.char_length("text").cast("bigint"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids with their byte offsets."""
    return bpe.encode(docs.select("doc_id", "lang", "source", "text"), vocabulary(spark))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("pii", personal_data),
    ("byte_bpe", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir))
    return docs
