"""Reading and writing tables, logs, run folders, model folders and the model registry."""

from .delimited import read_csv_table, read_tsv_log, write_csv_table
from .learning_curve import flatten_learning_curve, read_learning_curve
from .models import load_model, save_model
from .registry import (
    compare_features,
    explode_features,
    latest_models,
    model_row,
    read_model_info,
    read_registry,
    register_model,
    write_model_info,
)
from .runs import read_runs, union_runs, write_run

__all__ = [
    "compare_features",
    "explode_features",
    "flatten_learning_curve",
    "latest_models",
    "load_model",
    "model_row",
    "read_csv_table",
    "read_learning_curve",
    "read_model_info",
    "read_registry",
    "read_runs",
    "read_tsv_log",
    "register_model",
    "save_model",
    "union_runs",
    "write_csv_table",
    "write_model_info",
    "write_run",
]
