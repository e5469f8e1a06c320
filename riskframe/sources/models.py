"""Fitted models on disk."""

from __future__ import annotations

from pyspark.ml import PipelineModel

from riskframe.plans.evaluate import FittedEnsemble, load_any


def save_model(model: PipelineModel | FittedEnsemble, path: str, overwrite: bool = False) -> None:
    """Save a single model or an ensemble; ``load_model`` tells them apart."""
    if isinstance(model, FittedEnsemble):
        model.save(path, overwrite)
        return
    writer = model.write()
    (writer.overwrite() if overwrite else writer).save(path)


def load_model(path: str) -> PipelineModel | FittedEnsemble:
    return load_any(path)
