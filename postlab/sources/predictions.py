"""Prediction files: ``(test_case, id, category)`` as TSV with a header."""

from __future__ import annotations

from pyspark.sql import DataFrame

from postlab.sources.posts import write_delimited

COLUMNS = ("test_case", "id", "category")


def prediction_path(path: str, task: str, language: str | None = None) -> str:
    """``out.tsv`` -> ``out_task1_ml.tsv`` or, for one language, ``out_es_task1_ml.tsv``."""
    parts = [path.removesuffix(".tsv"), language, task, "ml"]
    return "_".join(p for p in parts if p) + ".tsv"


def second_head_path(path: str) -> str:
    return path.removesuffix(".tsv") + "_task2.tsv"


def write_predictions(df: DataFrame, path: str) -> str:
    """Write one prediction set as a directory of part files; returns its path."""
    return write_delimited(df.select(*COLUMNS), path, "\t")


def write_two_heads(df: DataFrame, path: str, category1: str, category2: str) -> tuple[str, str]:
    """Two prediction files from one scored frame, which is computed once."""
    scored = df.select("test_case", "id", category1, category2).persist()
    try:
        return (
            write_predictions(scored.withColumnRenamed(category1, "category"), path),
            write_predictions(scored.withColumnRenamed(category2, "category"),
                              second_head_path(path)),
        )
    finally:
        scored.unpersist()
