"""Column expressions shared by the operators (all native Spark expressions)."""

from .columns import (
    as_long_ids,
    in_span,
    is_core,
    percent_label,
    ratio,
    shares_author,
    within_percentile_lower,
    within_percentile_upper,
)

__all__ = [
    "as_long_ids",
    "in_span",
    "is_core",
    "percent_label",
    "ratio",
    "shares_author",
    "within_percentile_lower",
    "within_percentile_upper",
]
