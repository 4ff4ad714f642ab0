"""Native column expressions: missing-cell predicates, numeric parsing, rounding."""

from tabletidy.functions.predicates import (
    COERCIBLE_TEXT_RE,
    NUMERIC_KINDS,
    NUMERIC_TEXT_RE,
    PLACEHOLDERS,
    UNKNOWN_FILL,
    coerce_numeric,
    dtype_label,
    is_missing,
    is_placeholder,
    kind_of,
    null_nan,
    numeric_text_ok,
    parses_as_number,
    pct,
    placeholder_sets,
    placeholders_json,
    replace_placeholders,
    strip_ws,
)

__all__ = [
    "COERCIBLE_TEXT_RE",
    "NUMERIC_KINDS",
    "NUMERIC_TEXT_RE",
    "PLACEHOLDERS",
    "UNKNOWN_FILL",
    "coerce_numeric",
    "dtype_label",
    "is_missing",
    "is_placeholder",
    "kind_of",
    "null_nan",
    "numeric_text_ok",
    "parses_as_number",
    "pct",
    "placeholder_sets",
    "placeholders_json",
    "replace_placeholders",
    "strip_ws",
]
