"""Cleaning plans: fit (aggregate jobs) and transform (one lazy projection)."""

from tabletidy.plans.cleaning import (
    CleaningPlan,
    CleanResult,
    ColumnPlan,
    apply_fills,
    clean,
    drop_exact_duplicates,
    fit,
    fit_fills,
    fit_types,
    replace_all_placeholders,
    table_metrics,
    transform,
)

__all__ = [
    "CleaningPlan",
    "CleanResult",
    "ColumnPlan",
    "apply_fills",
    "clean",
    "drop_exact_duplicates",
    "fit",
    "fit_fills",
    "fit_types",
    "replace_all_placeholders",
    "table_metrics",
    "transform",
]
