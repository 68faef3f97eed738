"""Saving and loading fitted models, one directory per language."""

from __future__ import annotations

from pyspark.ml import PipelineModel


def save_model(model: PipelineModel, path: str, language: str = "all") -> str:
    target = f"{path.rstrip('/')}/{language}"
    model.write().overwrite().save(target)
    return target


def load_model(path: str, language: str = "all") -> PipelineModel:
    return PipelineModel.load(f"{path.rstrip('/')}/{language}")
