"""Column expressions: hash order, labels, text forms and small linear algebra."""

from .hashing import hash_order, hash_uniform
from .labels import decode_label, encode_label
from .numeric import dot, rounded, safe_ratio
from .text import join_in_order, mean_pm_std, metric_title, name_slug, percent_text, run_stamp

__all__ = [
    "decode_label",
    "dot",
    "encode_label",
    "hash_order",
    "hash_uniform",
    "join_in_order",
    "mean_pm_std",
    "metric_title",
    "name_slug",
    "percent_text",
    "rounded",
    "run_stamp",
    "safe_ratio",
]
